"""Token-ID files: fixed-width bit packing with block offsets.

A dataset is a folder of part files written by Spark in ascending document order. Each row is one
block of whole documents: the ids of its documents, each in the fewest bits that hold the
vocabulary, least significant bit first, and the offsets at which its documents begin. A block
is unpacked with a few numpy gathers; any document can be read from its block by offset alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, slices, table
from .pieces import encoder

END_ID = 1
BLOCK_TOKENS = 1 << 15
VOCABULARY = "word_bpe_49k.json"
BLOCKS = "part int, block int, bits int, n_tokens long, first_id long, last_id long, doc_ids array<long>, doc_starts array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Bit i * bits + j of the result is bit j of id i."""
    if not 1 <= bits <= 32:
        raise ValueError("ids have 1 to 32 bits")
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack_ids(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the id at ``start`` on: random access into a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    raw = np.frombuffer(payload, np.uint8)[start * bits // 8 : -(-(start + count) * bits // 8)]
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    at = np.arange(count, dtype=np.int64) * bits + start * bits % 8
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k] << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _block(part: int, number: int, docs: list, ids: list, bits: int) -> tuple:
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return part, number, bits, int(lens.sum()), docs[0], docs[-1], docs, (np.cumsum(lens) - lens).tolist(), pack_ids(np.concatenate(ids), bits)


def _encode(batches: Iterator[pa.RecordBatch], path: str, bits: int, end_id: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("payload", pa.binary())])
    docs: list = []
    ids: list = []
    waiting = number = part = 0

    def close() -> pa.RecordBatch:
        row = _block(part, number, docs, ids, bits)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in slices(batches):
        part = batch.column(2)[0].as_py()
        for doc, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
            docs.append(doc)
            ids.append(np.append(found, np.uint32(end_id)).astype(np.uint32))
            waiting += len(ids[-1])
            if waiting >= block_tokens:
                yield close()
                docs, ids, waiting, number = [], [], 0, number + 1
    if docs:
        yield close()


def write_token_files(docs: DataFrame, out: str, path: str | None = None, parts: int | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> str:
    """Write the ids of all documents, ``end_id`` after each, to folder ``out`` in ascending doc_id order (null ids first).

    A null text is empty and is written as its end id alone. Rows with equal ids are written in the order of
    their texts' hashes, then their texts. No rows give no blocks. Other columns are ignored."""
    path = path or public_tokenizers.path(VOCABULARY)
    bits = bits_for(encoder(path).tokenizer.get_vocab_size(with_added_tokens=True))
    spark = docs.sparkSession
    if parts is None:
        files = docs.inputFiles()
        parts = max(1, spark.sparkContext.defaultParallelism, 2 * len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id())
    blocks = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(lambda b: _encode(b, path, bits, end_id, block_tokens), BLOCKS)
    blocks.write.mode("overwrite").parquet(out)
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "block", "nth", "doc_id", "doc_start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_ids(row["payload"], row["bits"], 0, row["n_tokens"])
            bounds = [*row["doc_starts"], row["n_tokens"]]
            n = len(row["doc_ids"])
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lens = [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_starts"], pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                names,
            )


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, block_start): ids before each block. Parts are summed on their own and their totals once more, a row for each part."""
    sizes = blocks.select("part", "block", "n_tokens")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return local.join(bases, "part").select("part", "block", (F.col("base") + F.col("in_part")).alias("block_start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from their ids."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    rows = blocks.mapInArrow(_decode, "part int, block int, nth int, doc_id long, doc_start long, n_tokens long, ids_crc32 long")
    joined = rows.join(block_starts(blocks), ["part", "block"])
    return joined.select("doc_id", (F.col("block_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def read_document_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, read by its offset from its block alone: files and row groups are pruned by the first and last id of their blocks."""
    rows = spark.read.schema(BLOCKS).parquet(path).where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).collect()
    out = []
    for row in rows:
        bounds = [*row["doc_starts"], row["n_tokens"]]
        out += [unpack_ids(bytes(row["payload"]), row["bits"], bounds[i], bounds[i + 1] - bounds[i]) for i, d in enumerate(row["doc_ids"]) if d == doc_id]
    return out


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    out = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    return read_digests(spark, write_token_files(table(spark, sf_dir, "documents"), out))
