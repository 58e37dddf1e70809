"""Shared helpers: materialised tables in the shared folder, table reading, hash constants."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_HELD: list = []
#: So many texts of an Arrow batch are Python strings at a time.
TEXT_ROWS = 250


def hold_only(cache=None) -> None:
    """Let go of the cache that another operator left in this worker process: one is held at a time, or none. ``cache`` has ``release``."""
    if _HELD[:1] != [cache]:
        for other in _HELD:
            other.release()
        _HELD[:] = [] if cache is None else [cache]


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``rows`` rows, whose texts alone are Python strings at a time; Arrow's unused memory is given back after the last one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that no column made beside it can clash with one of theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
