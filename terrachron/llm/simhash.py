"""Near-duplicate documents by SimHash and multi-index hashing.

Fingerprints are computed where the texts are; only (doc_id, fingerprint) moves on. Equal
fingerprints are one node. Links between nodes are found in two steps whose size follows the
number of nodes, not the square of a group's size:

1. Every node is written under itself and under the points one upward bit flip away. Nodes that
   share a point differ in two bits at most, and a point has at most 65 nodes: each is linked to
   the point's smallest node. Dense clouds of near copies collapse here.
2. Multi-index hashing for the rest: a fingerprint has two 32-bit segments. Of two fingerprints
   within three bits, one segment differs in at most one bit, so every node looks up the Hamming
   ball of radius one around each of its segments in the table of segments (upward flips only:
   the other node of the pair looks up the downward ones) and complete distances are verified.
   Only nodes of different components of step 1 make rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bits import majority
from .common import TEXT_ROWS, hold_only, materialise, table, whole_row
from .graph import connected_components

MAX_BITS = 3
SHINGLE_WORDS = 3
SEED = 42
BATCH_HASHES = 200_000


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> list[bytes]:
    """Space-joined runs of ``size`` words of the text with A-Z lowered; fewer words: all of them; none: no shingle."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only ASCII letters and white space
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprints(texts: list, size: int = SHINGLE_WORDS) -> np.ndarray:
    out, hashes, sizes = [], [], []
    digest = xxhash.xxh64_intdigest

    def close() -> None:
        out.append(majority(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
        hashes.clear()
        sizes.clear()

    for text in texts:
        found = [digest(s, SEED) for s in shingles(text, size)]
        hashes += found
        sizes.append(len(found))
        if len(hashes) >= BATCH_HASHES:
            close()
    close()
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, size: int = SHINGLE_WORDS, text_col: str = "text", name: str = "fp") -> DataFrame:
    @F.arrow_udf("long")
    def of(text: pa.Array) -> pa.Array:
        hold_only()
        texts = (t for at in range(0, len(text), TEXT_ROWS) for t in text.slice(at, TEXT_ROWS).to_pylist())
        return pa.array(fingerprints(texts, size).view(np.int64))

    return docs.withColumn(name, of(F.col(text_col)))


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _flips(word, width: int):
    """``word`` and every value with one of its clear low ``width`` bits set."""
    clear = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: word.bitwiseAND(_bit(i)) == 0)
    return F.concat(F.array(word), F.transform(clear, lambda i: word.bitwiseOR(_bit(i))))


def link_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``nodes``: distinct ``fp`` (long). Returns (node, component) of the nodes linked to another by chains of at most ``max_bits`` differing bits; at most 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    fp = F.col("fp")
    comp = None
    if max_bits >= 2:
        points = nodes.select("fp", F.explode(_flips(fp, 64)).alias("point"))
        near = points.withColumn("least", F.min("fp").over(Window.partitionBy("point"))).where("fp <> least").select("fp", "least")
        comp = connected_components(near).withColumnRenamed("node", "fp")
        placed = nodes.join(comp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("c"))
    else:
        placed = nodes.select("fp", fp.alias("c"))
    placed = materialise(placed)
    low = F.lit(0xFFFFFFFF).cast("long")
    segments = F.array(
        F.struct(F.lit(0).cast("long").alias("seg"), F.shiftrightunsigned(fp, 32).alias("val")),
        F.struct(F.lit(1 << 32).cast("long").alias("seg"), fp.bitwiseAND(low).alias("val")),
    )
    parts = placed.select("fp", "c", F.inline(segments))
    entries = parts.select(F.col("seg").bitwiseOR(F.col("val")).alias("key"), F.col("fp").alias("fp_t"), F.col("c").alias("c_t"))
    probes = parts.select("seg", "fp", "c", F.explode(_flips(F.col("val"), 32)).alias("ball")).select(F.col("seg").bitwiseOR(F.col("ball")).alias("key"), "fp", "c")
    close = F.bit_count(fp.bitwiseXOR(F.col("fp_t"))) <= max_bits
    links = probes.join(entries, (probes["key"] == entries["key"]) & (F.col("c") != F.col("c_t")) & close)
    links = links.select(F.greatest("c", "c_t").alias("a"), F.least("c", "c_t").alias("b"))
    wider = connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("wide"))
    return placed.join(wider, "c", "left").select(F.col("fp").alias("node"), F.coalesce("wide", "c").alias("component"))


def _groups(docs: DataFrame, max_bits: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row; (fp, component, component_id) of every fingerprint."""
    found = materialise(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), size).select("doc_id", "text_hash", "fp"))
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    placed = link_fingerprints(nodes.select("fp"), max_bits).withColumnRenamed("node", "fp")
    placed = materialise(nodes.join(placed, "fp"))
    least = placed.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    return found, materialise(placed.join(least, "component").select("fp", "component", "component_id"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints that differ in ``max_bits`` or
    fewer bits. Null texts count as empty and have fingerprint zero, linked like any other. Rows
    with a null doc_id keep it and take part; they do not count for the smallest id (a group of
    nothing else has component_id null). Repeated rows stay; other columns are ignored; no rows
    give no rows."""
    found, by_fp = _groups(docs, max_bits, size)
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.join(by_fp, "fp").select("doc_id", fingerprint, "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` for each group, with its columns: that of the smallest doc_id, then text hash.

    Rows that share an id but not a group do not stand for each other; of rows that repeat an id and
    its text one stays; documents without an id stay. Null and empty texts are one group (fingerprint
    zero). Columns of any name may come with the documents; no rows give no rows."""
    found, by_fp = _groups(docs, max_bits, size)
    placed = found.where("doc_id IS NOT NULL").join(by_fp, "fp")
    kept = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"))
    kept = kept.select(F.col("keep.doc_id").alias("id"), F.col("keep.text_hash").alias("hash"))
    rows = docs.where("doc_id IS NOT NULL").select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    one = Window.partitionBy("id", "hash").orderBy("hash")
    chosen = rows.join(kept, ["id", "hash"], "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return chosen.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
