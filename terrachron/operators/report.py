"""Aggregates: roll-ups, funnels, breakdowns, coverage, clustering, statistics, histories of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X
from ..session import settle

#: Group of each class of the test view; the first groups that override all others (fixed values).
GROUP_OF_CLASS = {"battle": "war", "war": "war", "treaty": "treaty", "election": "political", "bombing": "terrorism"}
OVERRIDING = ("terrorism", "atrocity")


def group_of(classes: Column, table: dict[str, str] = GROUP_OF_CLASS, overriding=OVERRIDING) -> Column:
    """The one group of a class set: an overriding one, the only one, "mixed", or "unclassified"; no shuffle."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    groups = F.array_distinct(F.array_compact(F.transform(F.coalesce(classes, F.array()), lambda c: F.try_element_at(names, c))))
    out = F.when(F.size(groups) == 0, "unclassified").when(F.size(groups) == 1, F.get(groups, F.lit(0))).otherwise("mixed")
    for g in reversed(overriding):
        out = F.when(F.array_contains(groups, g), g).otherwise(out)
    return out


def deciding_classes(classes: Column, table: dict[str, str] = GROUP_OF_CLASS, overriding=OVERRIDING) -> Column:
    """The classes behind ``group_of``."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    g = group_of(classes, table, overriding)
    return F.filter(classes, lambda c: F.try_element_at(names, c).isNotNull() & ((g == "mixed") | (F.try_element_at(names, c) == g)))


def not_events(classes: Column, labels: tuple[str, ...]) -> Column:
    return F.arrays_overlap(classes, F.array(*map(F.lit, labels)))


def yearly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(T.year_of("date_start").alias("year")).agg(F.count("*").alias("n"))


def candidate_rollup(rows: DataFrame) -> DataFrame:
    """One row for each item: first date, last end, most pages, countries, classes in order of the class table."""
    return rows.groupBy("qid").agg(
        F.min("date").alias("date"), F.max("end").alias("end"), F.max("sitelinks").alias("sitelinks"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("class_order", "class"))), lambda c: c["class"]), ",").alias("classes"), F.max("has_article").alias("has_article"),
    )


def funnel(candidates: DataFrame, least: int = 10) -> DataFrame:
    """(stage, n, removed): all, with an article, with enough pages; one pass."""
    article = F.col("has_article")
    counts = candidates.agg(F.count("*").alias("a"), F.count_if(article).alias("b"), F.count_if(article & (F.col("sitelinks") >= least)).alias("c"))
    stages = F.array(
        F.struct(F.lit(1).cast("long").alias("step"), F.lit("raw").alias("stage"), F.col("a").alias("n"), F.lit(0).cast("long").alias("removed")),
        F.struct(F.lit(2).cast("long").alias("step"), F.lit("article").alias("stage"), F.col("b").alias("n"), (F.col("a") - F.col("b")).alias("removed")),
        F.struct(F.lit(3).cast("long").alias("step"), F.lit("sitelinks").alias("stage"), F.col("c").alias("n"), (F.col("b") - F.col("c")).alias("removed")),
    )
    return counts.select(F.inline(stages))


def breakdowns(candidates: DataFrame, least: int = 10) -> DataFrame:
    """(dim, key, raw, no_article, few_sitelinks, passed): by country, class, group and decade; a row with several tags counts once in each."""
    keys = F.concat(
        F.transform(F.array_distinct("countries"), lambda c: F.struct(F.lit("country").alias("dim"), c.alias("key"))),
        F.transform(F.array_distinct("classes"), lambda c: F.struct(F.lit("class").alias("dim"), c.alias("key"))),
        F.array(F.struct(F.lit("group").alias("dim"), group_of(F.col("classes")).alias("key"))),
        F.array(F.struct(F.lit("decade").alias("dim"), T.decade_label(T.decade_floor(T.year_of("date"))).alias("key"))),
    )
    article, enough = F.col("has_article"), F.col("sitelinks") >= least
    long = candidates.select("has_article", "sitelinks", F.inline(keys))
    return long.groupBy("dim", "key").agg(F.count("*").alias("raw"), F.count_if(~article).alias("no_article"), F.count_if(article & ~enough).alias("few_sitelinks"), F.count_if(article & enough).alias("passed"))


def coverage(events: DataFrame, many: int = 8) -> DataFrame:
    """(country, n, n_without_many, place): tags counted with and without records of ``many`` tags, by count then name."""
    tags = events.select(F.size("countries").alias("tags"), F.explode("countries").alias("country"))
    out = tags.groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("tags") < many).alias("n_without_many"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "country")).cast("long"))  # as many rows as countries


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at floor(n / 2) of the sorted values of each group."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col(value).alias("median"))


def largest_stack(events: DataFrame) -> DataFrame:
    points = events.where(S.has_coordinates()).groupBy("lon", "lat").agg(F.count("*").alias("n"))
    return points.agg(F.max("n").alias("largest"), F.count("*").alias("points"))


def grid_clusters(events: DataFrame, zooms=(2, 5, 8), radius_px: float = 40, tile_px: float = 512) -> DataFrame:
    """(zoom, cx, cy, n, x, y): points gathered on a Mercator grid of the cluster radius; an approximation of greedy clustering."""
    x, y = S.mercator()
    placed = events.where(S.real_coordinates()).select(x.alias("mx"), y.alias("my"), F.explode(F.array(*map(F.lit, zooms))).alias("zoom"))
    cell = F.pow(F.lit(2.0), F.col("zoom")) * (tile_px / radius_px)
    return placed.groupBy("zoom", F.floor(F.col("mx") * cell).alias("cx"), F.floor(F.col("my") * cell).alias("cy")).agg(F.count("*").alias("n"), F.avg("mx").alias("x"), F.avg("my").alias("y"))


def bounds(events: DataFrame) -> DataFrame:
    return events.where(S.has_coordinates()).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"), F.count("*").alias("count"))


def distance_bands(distances: DataFrame, km: str = "km", limits=(1.0, 5.0, 10.0)) -> DataFrame:
    band = F.lit(f"over {limits[-1]:g}")
    for limit in reversed(limits):
        band = F.when(F.col(km) <= limit, f"up to {limit:g}").otherwise(band)
    return distances.groupBy(F.when(F.col(km).isNull(), "none").otherwise(band).alias("band")).agg(F.count("*").alias("n"))


def field_checks(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, checked, mismatched) over columns named a_<field> and b_<field>."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")).alias("ok")) for f in fields))
    return pairs.select(F.inline(rows)).groupBy("field").agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("mismatched"))


def stratum_table(df: DataFrame, by: list[str], flags: list[str], numbers: list[str]) -> DataFrame:
    """n, shares of flags and medians of numbers for each stratum and, with the key ALL, each dimension's total."""
    keys = F.array(*(F.struct(F.lit(b).alias("dim"), F.col(b).cast("string").alias("key")) for b in by), F.struct(F.lit("all").alias("dim"), F.lit("ALL").alias("key")))
    long = df.select(*flags, *numbers, F.inline(keys))
    aggs = [F.count("*").alias("n"), *(F.round(F.avg(F.col(f).cast("double")), 6).alias(f"share_{f}") for f in flags), *(F.round(F.percentile(n, F.lit(0.5)), 6).alias(f"median_{n}") for n in numbers)]
    return long.groupBy("dim", "key").agg(*aggs)


def signal_score(parts: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """A sum of points for conditions, and the names of those met."""
    points = F.array(*(F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in parts.values()))
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, (c, _) in parts.items())))
    return F.aggregate(points, F.lit(0), lambda a, b: a + b), names


def next_ends(periods: DataFrame) -> DataFrame:
    """(end, next): for each end the smallest end among the periods that start after it; no row where none does.

    Starts and ends are laid out by range; each part works out its own minima, behind those of the parts after it, a row for each part."""
    marks = periods.select(F.col("start_year").alias("at"), F.col("end_year").alias("value"), F.lit(None).cast("long").alias("asked"))
    asked = periods.select("end_year").distinct().select(F.col("end_year").alias("at"), F.lit(None).cast("long").alias("value"), F.col("end_year").alias("asked"))
    parts = settle(marks.unionByName(asked).repartitionByRange("at").withColumn("_part", F.spark_partition_id()))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("_part").agg(F.min("value").alias("_least")).select("_part", F.min("_least").over(later).alias("_base"))
    after = Window.partitionBy("_part").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("_own", F.min("value").over(after)).where("asked IS NOT NULL")
    return own.join(F.broadcast(bases), "_part").select(F.col("asked").alias("end"), F.least("_own", "_base").alias("next")).where("next IS NOT NULL")


def minimum_years(features: DataFrame, close_open: bool = False, rounds: int = 40) -> DataFrame:
    """(year): years that hit every period with as few as the greedy rule needs: by end, the end of each period not yet hit.

    An end leads to the next one that the rule takes; the years are those reached from the first end, found by doubling
    the steps, so rounds grow with the logarithm of the years. With ``close_open`` no period goes on after the last one starts."""
    spans = features.select(F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year")).distinct()
    last = spans.agg(F.max("start_year").alias("last"))  # one row
    periods = settle(spans.crossJoin(F.broadcast(last)).select("start_year", (F.least("end_year", "last") if close_open else F.col("end_year")).alias("end_year")).distinct())
    steps = settle(next_ends(periods))
    reached, n = settle(periods.agg(F.min("end_year").alias("year")).where("year IS NOT NULL")), 1
    for _ in range(rounds):
        further = reached.join(steps, F.col("year") == F.col("end")).select(F.col("next").alias("year"))
        reached = settle(reached.unionByName(further).distinct())
        size = reached.count()
        if size == n:
            return reached
        n = size
        steps = settle(steps.join(steps.select(F.col("end").alias("next"), F.col("next").alias("after")), "next").select("end", F.col("after").alias("next")))
    raise RuntimeError(f"years did not settle in {rounds} rounds")


def edit_history(revisions: DataFrame) -> DataFrame:
    """One row for each article: edits, editors, share of the top editor, counts of tags and comment words; editors are summed before articles."""
    per_user = revisions.groupBy("article", "editor").agg(F.count("*").alias("k"), F.count_if(F.col("tag") == "error").alias("errors"), F.count_if(F.col("comment").rlike("1")).alias("ones"))
    return per_user.groupBy("article").agg(
        F.sum("k").alias("edits"), F.count("*").alias("editors"), (F.max("k") / F.sum("k")).alias("top_share"), F.sum("errors").alias("errors"), F.sum("ones").alias("ones")
    )


def reference_hosts(pages: DataFrame, official: tuple[str, ...] = (".gov", ".edu")) -> DataFrame:
    """(host, n, n_pages, official): hosts of the links of pages; a relative link has its page's host."""
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"href=\"((?:https?://|/)[^\"]*)\""), 1)).alias("link"))
    full = F.when(F.startswith("link", F.lit("/")), F.col("url")).otherwise(F.col("link"))
    hosts = links.select("page_id", F.lower(F.regexp_extract(full, r"^https?://([^/:?#]+)", 1)).alias("host")).where("host <> ''")
    ends = F.lit(False)
    for o in official:
        ends = ends | F.endswith("host", F.lit(o))
    return hosts.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages")).withColumn("official", ends)


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy(X.flag_code("flag").alias("code")).agg(F.count("*").alias("n"))
