"""Cost-balanced packing of tokenised documents into sequences of at most 2048 tokens.

Each task packs the documents of its own partition, in blocks of bounded size, so nothing is
shuffled. Full-length pieces of long documents are sequences of their own. The rest of a block is
sorted by length, descending, and each piece goes to the sequence of lowest estimated cost (linear
plus quadratic attention) with capacity for it; what fits nowhere whole is cut over the sequences
with room left, lowest cost first. A block opens just as many sequences as its tokens need, so at
most one sequence a block is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table
from .pieces import encoder

SEQUENCE_TOKENS = 2048
BLOCK_TOKENS = 1_000_000
END_ID = 1
LINEAR_COST, QUADRATIC_COST = 1.0, 1.0 / 1024
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def attention_cost(length: int) -> float:
    return LINEAR_COST * length + QUADRATIC_COST * length * length


def pack_lengths(lengths: list[int], size: int = SEQUENCE_TOKENS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start within the item, length) for items of 1 to ``size`` tokens.

    Items go in descending length, ties in given order, to the cheapest sequence with room for them
    whole; the others are cut over the room left, cheapest sequence first."""
    n = -(-sum(lengths) // size)
    used, cost = np.zeros(n, np.int64), np.zeros(n)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def put(item: int, start: int, length: int, k: int) -> None:
        out[k].append((item, start, length))
        used[k] += length
        cost[k] += attention_cost(length)

    late = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = np.flatnonzero(used <= size - lengths[item])
        if len(fits):
            put(item, 0, lengths[item], int(fits[cost[fits].argmin()]))
        else:
            late.append(item)
    room = sorted((k for k in range(n) if used[k] < size), key=lambda k: (-cost[k], k))
    for item in late:
        done = 0
        while done < lengths[item]:
            k = room[-1]
            take = min(lengths[item] - done, size - int(used[k]))
            put(item, done, take, k)
            done += take
            if used[k] == size:
                room.pop()
    return out


def _packed(batches: Iterator[pa.RecordBatch], path: str, size: int, block: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    serial = TaskContext.get().partitionId() << 36
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"]
    rows: list[tuple] = []
    rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of pieces shorter than a sequence
    waiting = 0

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def close() -> None:
        nonlocal serial, rest, waiting
        for sequence in pack_lengths([len(r[2]) for r in rest], size):
            total, offset = sum(attention_cost(n) for _, _, n in sequence), 0
            for item, start, length in sequence:
                doc, at, ids, tokens = rest[item]
                rows.append((doc, at + start, length, crc(ids[start : start + length]), tokens, serial, offset, total))
                offset += length
            serial += 1
        rest, waiting = [], 0

    def flush() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.float64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)
        rows.clear()
        return out

    for part in slices(batches):
        for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
            ids = np.append(ids, np.uint32(END_ID)).astype(np.uint32)
            tokens = len(ids)
            whole = tokens - tokens % size
            for at in range(0, whole, size):
                rows.append((doc, at, size, crc(ids[at : at + size]), tokens, serial, 0, attention_cost(size)))
                serial += 1
            if tokens > whole:
                rest.append((doc, whole, ids[whole:].copy(), tokens))  # a view would keep all ids of the document
                waiting += tokens - whole
            if waiting >= block:
                close()
            if len(rows) > 20_000:
                yield flush()
    close()
    yield flush()


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE_TOKENS, block: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: each id, the end id of the document included, lies in exactly one.

    A null text is empty and packs as its end id alone; null and repeated ids are kept as they are;
    a text of any length is cut; other columns are ignored; no rows give no rows. ``sequence_id`` is
    unique over the table; ``offset`` runs without gaps from 0 in each sequence."""
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _packed(b, path, size, block), SCHEMA)


def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
