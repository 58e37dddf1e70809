"""Join helpers: bands, grid cells, intervals, islands and priority de-duplication, all as equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle and sort: Spark's estimate of a small file or of exploded rows can be far below what a broadcast would hold in the driver."""
    return df.hint("merge")


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, width: float) -> DataFrame:
    """Pairs of rows whose keys differ by at most ``width``: each left row meets the three buckets around its own."""
    own = F.floor(F.col(left_key) / width)
    a = left.withColumn("_band", F.explode(F.array(own - 1, own, own + 1)))
    b = right.withColumn("_band", F.floor(F.col(right_key) / width))
    return a.join(b, "_band").where(F.abs(F.col(left_key) - F.col(right_key)) <= width).drop("_band")


def cell_join(left: DataFrame, right: DataFrame, lon: str, lat: str, right_lon: str, right_lat: str, size_lon: Callable[[Column], Column] | float, size_lat: float) -> DataFrame:
    """Candidate pairs of points at most one grid cell apart: the left row is written to nine cells, the right one to its own."""
    x, y = F.floor(F.col(lon) / size_lon), F.floor(F.col(lat) / size_lat)
    around = F.array(*(F.struct((x + i).alias("x"), (y + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.withColumn("_cell", F.explode(around))
    b = right.withColumn("_cell", F.struct(F.floor(F.col(right_lon) / size_lon).alias("x"), F.floor(F.col(right_lat) / size_lat).alias("y")))
    return a.join(b, "_cell").drop("_cell")


def box_cells(w: Column, s: Column, e: Column, n: Column, size: float) -> Column:
    """The grid cells that a box touches."""
    xs, ys = (F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in ((w, e), (s, n)))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def point_cell(lon: Column, lat: Column, size: float) -> Column:
    return F.struct(F.floor(lon / size).alias("x"), F.floor(lat / size).alias("y"))


def interval_join(left: DataFrame, dimension: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows of ``left`` with the dimension's rows of their key that hold at ``at``."""
    return left.join(dimension, key).where(F.col(at).between(F.col(start), F.col(end)))


def islands(df: DataFrame, by: list[str], order: str, same: list[str], step: int = 1) -> DataFrame:
    """Runs of rows that follow each other by ``step`` with equal ``same``: (by, same, start, end, n_rows)."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.lag(order).over(w).isNull() | (F.col(order) - F.lag(order).over(w) != step)
    for c in same:
        fresh = fresh | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = df.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, *same, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n_rows")).drop("_run")


def top_per_group(df: DataFrame, by: list[str], keys: list[Column], n: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("long")).where(F.col(name) <= n)


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a declared order."""
    return top_per_group(df, key, order, 1, "_nth").drop("_nth")


def by_priority(groups: list[tuple[str, DataFrame]], n: int) -> DataFrame:
    """The top ``n`` of each (id, group), in the order of the groups: what an earlier group took is not offered again.

    Each group's frame has (id, other, d); the result adds ``grp`` and ``place``."""
    out = taken = None
    for name, pairs in groups:
        if taken is not None:
            pairs = pairs.join(taken, ["id", "other"], "left_anti")
        top = top_per_group(pairs, ["id"], [F.col("d").asc_nulls_last(), F.col("other").asc()], n).select("id", "other", F.lit(name).alias("grp"), "place")
        out = top if out is None else out.unionByName(top)
        taken = top.select("id", "other") if taken is None else taken.unionByName(top.select("id", "other"))
    return out
