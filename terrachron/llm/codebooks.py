"""Vector codes: integer product codebooks whose distances come from tables over value dictionaries.

Components are integers. In each chunk of rows, every dimension has a dictionary of its distinct integers and a
table of their squared differences to that dimension of all entries; the distances of a part are then gathers
from the tables by dictionary code, added over its dimensions. Each round sends sums and counts of a task, one
row for each entry, and the driver holds codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_ROWS = 4096
#: Integers below this keep the squared distances of a part within 64 bits.
LARGEST = 1 << 28
BROADCAST_LABELS = 100_000
SALTS = 16


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, the code of each row): by address where the values lie close together, else by sorting."""
    low, high = int(column.min()), int(column.max())
    if high - low > 8 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    present = np.zeros(high - low + 1, bool)
    present[column - low] = True
    return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[column - low]


def nearest(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row and part: ``values`` is rows by dimensions, ``books`` parts by entries by the dimensions of a part; ties to the lower entry."""
    parts, entries, width = books.shape
    codes, least = (np.zeros((len(values), parts), np.int64) for _ in range(2))
    for p in range(parts):
        distance = np.zeros((len(values), entries), np.int64)
        for j in range(width):
            words, code = dictionary(values[:, p * width + j])
            distance += ((words[:, None] - books[p, :, j]) ** 2)[code]
        codes[:, p] = distance.argmin(axis=1)
        least[:, p] = distance.min(axis=1)
    return codes, least


def integers(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the components of rows of ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat.reshape(-1, width) * scale)
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // scale} and more are not coded: their squared distances do not fit 64 bits")
    return out.astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    parts, entries, width = books.shape
    counts = np.zeros(parts * entries, np.int64)
    sums = np.zeros((parts * entries, width), np.int64)
    for batch in batches:
        for at in range(0, len(batch), CHUNK_ROWS):
            values = integers(batch.column(0).slice(at, CHUNK_ROWS), parts * width, scale)
            codes, _ = nearest(values, books)
            where = (codes + np.arange(parts) * entries).ravel()
            counts += np.bincount(where, minlength=parts * entries)
            np.add.at(sums, where, values.reshape(-1, width))
    used = np.flatnonzero(counts)
    if len(used):
        flat = pa.array(sums[used].ravel(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), flat)], ["slot", "n", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for at in range(0, len(batch), CHUNK_ROWS):
            rows = batch.slice(at, CHUNK_ROWS)
            codes, least = nearest(integers(rows.column(2), parts * width, scale), books)
            digits = codes.astype(np.uint8).tobytes().hex()
            size = 2 * parts
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([digits[i : i + size] for i in range(0, len(digits), size)], pa.string()), pa.array(least.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector is there and has finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, dimensions of a part) of usable ``rows``; None where there are none."""
    first = rows.where("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).collect() or rows.orderBy("embedding").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["embedding"])
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    first = [r for r in first if len(r["embedding"]) == size]
    width = size // parts
    start = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), size, scale)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    vectors = rows.where(F.size("embedding") == size).select("embedding")
    for _ in range(rounds):
        sums = vectors.mapInArrow(lambda b, books=books: _sums(b, books, scale), "slot long, n long, sums array<long>")
        each = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
        for row in sums.groupBy("slot").agg(F.sum("n").alias("n"), *each).collect():  # a row for each entry
            p, e = divmod(row["slot"], len(first))
            books[p, e] = [int(row[f"s{j}"]) // row["n"] for j in range(width)]
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of usable ``rows`` under ``books``."""
    size = books.shape[0] * books.shape[2]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.where(F.size("embedding") == size).mapInArrow(lambda b: _codes(b, books, scale), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` with the sum of ``error`` over equal labels, nulls together. A table of up to ``most`` labels is broadcast; a larger one is joined, each label over several keys."""
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= most:
        return coded.join(F.broadcast(sums), same, "left").drop("of")
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("by", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, same & (F.col("by") == F.col("salt")), "left").drop("of", "by", "salt")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, most: int = BROADCAST_LABELS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that is coded.

    Rows whose vector is null, empty, or holds null or non-finite components have no code, nor have rows of another
    length than the first one. Codebooks start from the rows of the smallest ids, equal ids in the order of their
    vectors; null ids start none unless all are null. Repeated rows are coded each; fewer rows than ``entries`` make
    that many entries; other columns are ignored; no rows give no rows. Components of 2**20 and more raise an error,
    as their squared distances would not fit the result."""
    rows = usable(vectors)
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    coded = with_label_error(materialise(encode(rows, books, scale)), most)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Squared differences by list functions, round by round; the codebook of a round is a table of (p, e, w)."""
    assign = "SELECT r.vec_id, r.label, r.p, r.x, min({'d': list_sum(list_transform(list_zip(r.x, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}) AS m FROM parts r JOIN book{k} b USING (p) GROUP BY ALL"
    steps = [f"""
kept AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS w FROM parts QUALIFY e < {entries})"""]
    for k in range(rounds):
        steps.append(f"assign{k} AS MATERIALIZED ({assign.replace('{k}', str(k))})")
        steps.append(f"mean{k} AS (SELECT p, m.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM assign{k}, (SELECT unnest(range(1, len(x) + 1)) AS j FROM (SELECT x FROM parts LIMIT 1)) GROUP BY ALL)")
        steps.append(f"list{k} AS (SELECT p, e, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS w FROM mean{k} GROUP BY ALL)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.w, b.w) AS w FROM book{k} b LEFT JOIN list{k} l USING (p, e))")
    steps.append(f"final AS MATERIALIZED ({assign.replace('{k}', str(rounds))})")
    steps.append("coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM final GROUP BY ALL)")
    steps.append("labels_sum AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY ALL)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT c.vec_id, c.code, c.error, s.label_error, book.codebooks_sha256 FROM coded c JOIN labels_sum s ON c.label IS NOT DISTINCT FROM s.label, book"


OP11_SQL = _op11_sql()
