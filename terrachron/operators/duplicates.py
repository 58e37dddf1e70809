"""Fuzzy duplicate hints: same item, same title, or similar titles near in time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X

REASONS = ("1 same item", "2 same title", "3 similar title, date and place")


def duplicate_hints(events: DataFrame, similarity: float = 0.6, years: int = 1, km: float = 150) -> DataFrame:
    """(id, other, reason), the first reason that holds.

    Records of the same item or title are linked to the first of them: a group of n makes n - 1 rows.
    Pairs of similar titles are listed, smaller id first. Rows of one key are met by equi-joins: the item, the title, and for similar titles the title's token set: equal
    titles have one token set, and sets as similar as this share one of their rarest tokens (prefix filtering)."""
    e = events.select(
        "id", T.year_of("date_start").alias("year"), X.norm_title("title").alias("norm"), F.array_sort(X.title_tokens("title")).alias("tok"), "countries", "lon", "lat",
        (F.col("location_quality") == "precise").alias("precise"), F.array_distinct(F.array_compact(F.array("wikidata_qid", "resolved_qid"))).alias("qids"),
    )
    other = e.select(*(F.col(c).alias(f"{c}2") for c in e.columns))
    by_item = e.select("id", F.explode("qids").alias("q")).withColumn("first", F.min("id").over(Window.partitionBy("q")))
    same_item = by_item.where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("id2"), F.lit(REASONS[0]).alias("reason")).distinct()
    by_title = e.where("norm <> ''").select("id", "norm").withColumn("first", F.min("id").over(Window.partitionBy("norm")))
    same_title = by_title.where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("id2"), F.lit(REASONS[1]).alias("reason"))
    sets = e.where(F.size("tok") > 0).select("tok", "norm").distinct()
    counts = sets.select(F.explode("tok").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ordered = sets.select("tok", "norm", F.explode("tok").alias("t")).join(counts, "t").groupBy("tok", "norm").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ranked"))
    keep = F.size("tok") - F.ceil(F.size("tok") * similarity).cast("int") + 1
    prefix = ordered.select("tok", "norm", F.explode(F.slice("ranked", 1, keep)).alias("p")).select("tok", "norm", F.col("p.t").alias("t"))
    twin = prefix.select(F.col("tok").alias("tok2"), F.col("norm").alias("norm2"), "t")
    alike = prefix.join(twin, "t").where((F.col("norm") != F.col("norm2")) & (X.jaccard(F.col("tok"), F.col("tok2")) >= similarity)).select("norm", "norm2").distinct()
    spread = e.withColumn("yj", F.explode(F.sequence(F.col("year") - years, F.col("year") + years)))
    near = F.when(F.col("precise") & F.col("precise2"), S.haversine_km("lon", "lat", "lon2", "lat2", S.EARTH_KM_FLAGS) <= km).otherwise(F.arrays_overlap("countries", "countries2"))
    similar = spread.join(alike, "norm").join(other, ["norm2"]).where((F.col("year2") == F.col("yj")) & (F.col("id") < F.col("id2"))).where(near).select("id", "id2", F.lit(REASONS[2]).alias("reason"))
    every = same_item.unionByName(same_title).unionByName(similar)
    return every.groupBy("id", F.col("id2").alias("other")).agg(F.min("reason").alias("reason"))


def prune_hints(hints: DataFrame, kept: DataFrame) -> DataFrame:
    """Hints whose other row is kept."""
    return hints.join(kept.select(F.col("id").alias("other")), "other", "left_semi")
