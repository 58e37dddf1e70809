"""Windowed operators over histories: runs of revisions, churn, stored moments, stratified picks, neighbours in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def revision_runs(revisions: DataFrame, text: str, anchor: Column) -> DataFrame:
    """(article, place, first_rev, last_rev, n): runs of revisions with equal text, newest first from the one current at ``anchor``, then older and newer in turn."""
    w = Window.partitionBy("article").orderBy(F.desc("ts"), F.desc("revid"))
    fresh = F.lag(text).over(w).isNull() | ~F.lag(text).over(w).eqNullSafe(F.col(text))
    rows = revisions.withColumn("_new", fresh.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("article", "run").agg(F.min("revid").alias("first_rev"), F.max("revid").alias("last_rev"), F.count("*").alias("n"), F.count_if(F.col("ts") <= anchor).alias("past"))
    whole = Window.partitionBy("article")
    current = F.coalesce(F.min(F.when(F.col("past") > 0, F.col("run"))).over(whole), F.max("run").over(whole))
    away = F.col("run") - current
    order = F.when(away == 0, 0).when(away > 0, away * 2 - 1).otherwise(-away * 2)
    out = runs.withColumn("_order", order)
    return out.withColumn("place", F.row_number().over(whole.orderBy("_order")).cast("long")).select("article", "place", "first_rev", "last_rev", "n")


def churn(revisions: DataFrame, size: str) -> DataFrame:
    """(article, churn): the sizes' absolute changes from one revision to the next, summed."""
    w = Window.partitionBy("article").orderBy("ts", "revid")
    return revisions.withColumn("_step", F.abs(F.col(size) - F.lag(size).over(w))).groupBy("article").agg(F.round(F.coalesce(F.sum("_step"), F.lit(0.0)), 4).alias("churn"))


def since_stored(revisions: DataFrame, moment: Column) -> DataFrame:
    """(article, current_rev, edits_after): the revision current at a moment, and the edits since."""
    return revisions.groupBy("article").agg(
        F.max_by(F.when(F.col("ts") <= moment, F.col("revid")), F.when(F.col("ts") <= moment, F.struct("ts", "revid"))).alias("current_rev"), F.count_if(F.col("ts") > moment).alias("edits_after")
    )


def seeded_order(key: str, seed: int) -> Column:
    """A repeatable order that depends on key and seed alone."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def seeded_sample(df: DataFrame, n: int, key: str = "id", seed: int = 1) -> DataFrame:
    """``n`` rows, the same for the same seed."""
    return df.orderBy(seeded_order(key, seed), key).limit(n)


def round_robin(df: DataFrame, stratum: str, group: str, n: int, key: str = "id", seed: int = 1) -> DataFrame:
    """``n`` rows of each stratum, one of each of its groups in turn: short groups leave their turns to the others."""
    turn = F.row_number().over(Window.partitionBy(stratum, group).orderBy(seeded_order(key, seed), key))
    ranked = df.withColumn("turn", turn.cast("long")).where(F.col("turn") <= n)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("turn", group))
    return ranked.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def previous_and_next(events: DataFrame, by: Column) -> DataFrame:
    """(id, prev_id, next_id) in order of start date, undated last: within partitions of ``by``, stitched over their first and last rows.

    ``by`` must follow the order (a decade); there are few partitions."""
    rows = events.select("id", "date_start", by.alias("_part"))
    order = [F.col("date_start").asc_nulls_last(), F.col("id").asc()]
    w = Window.partitionBy("_part").orderBy(*order)
    inner = rows.withColumn("prev_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))
    ends = rows.groupBy("_part").agg(F.min_by("id", F.struct(F.coalesce("date_start", F.lit("9999-99-99")), "id")).alias("first"), F.max_by("id", F.struct(F.coalesce("date_start", F.lit("9999-99-99")), "id")).alias("last"))
    p = Window.orderBy(F.col("_part").asc_nulls_last())
    stitched = ends.select("_part", F.lag("last").over(p).alias("_before"), F.lead("first").over(p).alias("_after"))
    out = inner.join(F.broadcast(stitched), inner["_part"].eqNullSafe(stitched["_part"]))  # a row for each decade
    return out.select("id", F.coalesce("prev_id", "_before").alias("prev_id"), F.coalesce("next_id", "_after").alias("next_id"))
