"""Connected components by alternating large-star and small-star steps.

Minima are combined before they are shuffled; the centre of a star may be the end of most edges, so
its minimum goes back to its edges over several salted keys. The edge table is written to the shared
folder after each round, so that no lineage grows and no edge passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise


SALTS = 16


def with_least(rows: DataFrame, key: str | list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key``; rows of one key are spread over at most SALTS joins, as many as they have salts."""
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    least = salted.groupBy(*keys).agg(F.min(value).alias(name), F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"))
    there = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    return salted.join(least.withColumn("salt", F.explode(there)).drop("salts"), [*keys, "salt"]).drop("salt")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: two long columns, the first two. Returns (node, component) for every node that has
    an edge to another node; component is the smallest node of its component. Self loops, repeated
    edges and null ends are ignored; no edges give an empty table."""
    a, b = edges.columns[:2]
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = materialise(pairs)
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = with_least(both, "u", "v", "m").withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        small = large.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        links = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        stars = small.select(F.inline(links)).where("hi <> lo").distinct()
        now = materialise(stars)
        after = _state(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
