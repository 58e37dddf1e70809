"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words get Karp-Rabin hashes on both sides. A bitmap of fixed size, made from
the benchmark's hashes, lets each task drop almost all other runs of its documents; the rest is
joined with the benchmark's runs by hash. For each (document, item) pair the shared seeds are
joined to maximal matches; the longest match is marked, over and over, without overlap on either
side, down to ``min_match`` words. As tiles may lie in any order, reordered passages count. A
pair is reported when its tiles cover at least ``threshold`` of the item's words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .words import normal, word_hashes

MIN_MATCH = 5
THRESHOLD = 0.5
FILTER_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)
BATCH_WORDS = 200_000
TEXT_ROWS = 500


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * BASE + hashes[i : n + i]
    out = (out ^ (out >> np.uint64(33))) * MIX
    return out ^ (out >> np.uint64(29))


def _item_runs(batches: Iterator[pa.RecordBatch], min_match: int) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "item_hash", "item_words", "size", "run", "item_pos"]
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for item, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = word_hashes(normal(text).split())
            size = min(min_match, len(hashes))
            if size:
                runs = run_hashes(hashes, size).view(np.int64).tolist()
                for c, v in zip(cols, (item, mark, len(hashes), size), strict=False):
                    c += [v] * len(runs)
                cols[4] += runs
                cols[5] += range(len(runs))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _document_runs(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap, bits: int) -> Iterator[pa.RecordBatch]:
    """The runs of documents that pass the bitmap: (doc_id, text_hash, size, run, doc_pos)."""
    there = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
    shift = np.uint64(64 - bits)
    for batch in slices(batches, TEXT_ROWS):
        ids, marks, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        at = 0
        while at < len(texts):
            words: list[bytes] = []
            lens: list[int] = []
            first = at
            while at < len(texts) and (at == first or len(words) < BATCH_WORDS):
                found = normal(texts[at]).split()
                words += found
                lens.append(len(found))
                at += 1
            hashes = word_hashes(words)
            ends = np.cumsum(np.array(lens, np.int64))
            owner = np.repeat(np.arange(len(lens)), lens)
            for size in sizes:
                runs = run_hashes(hashes, size)
                hit = np.flatnonzero(there[runs >> shift])
                hit = hit[hit + size <= ends[owner[hit]]]  # a run lies in one document
                who = owner[hit]
                start = (ends - np.array(lens))[who]
                rows = pa.array(who + first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), marks.take(rows), pa.array(np.full(len(hit), size, np.int32)), pa.array(runs[hit].view(np.int64)), pa.array((hit - start).astype(np.int32))],
                    ["doc_id", "text_hash", "size", "run", "doc_pos"],
                )


def tiles(seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the (document, item) positions at which runs of ``size`` words are equal: (document position, item position, length), longest first, ties by item then document position."""
    ordered = sorted((d - i, d, i) for d, i in set(seeds))
    heap: list[tuple[int, int, int]] = []
    for at, (diagonal, d, i) in enumerate(ordered):
        if at and ordered[at - 1][0] == diagonal and ordered[at - 1][1] == d - 1:
            length, i0, d0 = heap[-1]
            heap[-1] = (length - 1, i0, d0)
        else:
            heap.append((-size, i, d))
    heapq.heapify(heap)
    doc_used: set[int] = set()
    item_used: set[int] = set()
    out = []
    while heap:
        length, i, d = heapq.heappop(heap)
        free = [k for k in range(-length) if i + k not in item_used and d + k not in doc_used]
        if len(free) == -length:
            out.append((d, i, -length))
            item_used.update(range(i, i - length))
            doc_used.update(range(d, d - length))
            continue
        start = 0
        for k in range(1, len(free) + 1):  # what is left of the match goes back by its new length
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= size:
                    heapq.heappush(heap, (start - k, i + free[start], d + free[start]))
                start = k
    return out


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covered, count, longest = [], [], []
        for size, seeds in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            found = tiles([(s["doc_pos"], s["item_pos"]) for s in seeds], size)
            covered.append(sum(n for _, _, n in found))
            count.append(len(found))
            longest.append(max(n for _, _, n in found))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(covered, pa.int64()), pa.array(count, pa.int64()), pa.array(longest, pa.int64())],
            ["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile"],
        )


def _bitmap(runs: DataFrame, bits: int) -> bytes:
    """One bit for each leading ``bits`` bits of a hash: of fixed size, whatever the benchmark's."""
    top = runs.select(F.shiftrightunsigned("run", 64 - bits).alias("b")).distinct()  # at most 2**bits rows
    there = np.zeros(1 << bits, np.uint8)
    there[top.toArrow()["b"].to_numpy()] = 1
    return np.packbits(there).tobytes()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile) of the pairs whose tiles cover at least ``threshold`` of the item.

    Words are lower-cased and lose ASCII punctuation. An item shorter than ``min_match`` words must
    match whole. Null and empty texts have no words and match nothing. Rows with a null id keep it.
    Rows that repeat an id and its text are one document, or one item; rows that repeat an id with
    another text are matched each on its own. Other columns are ignored; no rows on either side
    give no rows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text").distinct()
    runs = materialise(items.mapInArrow(lambda b: _item_runs(b, min_match), "item_id long, item_hash long, item_words int, size int, run long, item_pos int"))
    sizes = sorted(r["size"] for r in runs.select("size").distinct().collect())  # at most min_match rows
    bitmap = spark.sparkContext.broadcast(_bitmap(runs, filter_bits))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    hits = rows.mapInArrow(lambda b: _document_runs(b, sizes, bitmap, filter_bits), "doc_id long, text_hash long, size int, run long, doc_pos int")
    seeds = hits.join(runs, ["size", "run"])
    pairs = seeds.groupBy("doc_id", "text_hash", "item_id", "item_hash", "item_words", "size").agg(F.collect_set(F.struct("doc_pos", "item_pos")).alias("seeds"))
    tiled = pairs.select("doc_id", "item_id", "item_words", "size", "seeds").mapInArrow(_tile, "doc_id long, item_id long, item_words int, covered_words long, n_tiles long, longest_tile long")
    coverage = (F.col("covered_words") / F.col("item_words")).alias("coverage")
    return tiled.select("doc_id", "item_id", "item_words", "covered_words", coverage, "n_tiles", "longest_tile").where(F.col("coverage") >= threshold)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` in no contaminated pair, by doc_id; a null id is matched like any other."""
    found = materialise(contaminated_pairs(docs, benchmark, **options).select(F.col("doc_id").alias("found_id")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
