"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard.

Inner products become distances by one more coordinate that gives all vectors of a shard the same
length; nearest by distance is then largest by inner product. A shard's tree keeps, for each
vantage point, the ranges of distances inside and outside its median sphere. A block of queries
walks the tree together; a subtree is skipped for a query when the triangle inequality's lower
bound times ``factor`` exceeds its distance to the k-th best so far. Factor 1 is exact; larger
factors skip more.

Equal vectors are indexed once, with the smallest of their ids: no query can return more of them.
Shards and query blocks have bounded sizes, and a (shard, block) pair is one row to search.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

NEIGHBOURS = 20
FACTOR = 1.1
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LEAF_ROWS = 256
SLACK = 1e-9
CHUNK = 1 << 16
SALTS = 16


class VantagePointTree:
    """Over the rows of ``vectors``; nodes in arrays, rows of a node contiguous in ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.square = float(norms.max(initial=0.0))
        lifted = np.concatenate([self.vectors, np.sqrt(np.maximum(self.square - norms, 0.0))[:, None]], axis=1)
        self.order = np.arange(len(vectors))
        self.nodes: list = []  # (start, end, vantage row or -1, inner child, outer child, ranges)
        self._grow(lifted, 0, len(vectors), leaf)

    def _grow(self, lifted: np.ndarray, start: int, end: int, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append(None)
        rows = self.order[start:end]
        if end - start <= leaf:
            self.nodes[number] = (start, end, -1, -1, -1, None)
            return number
        centre = lifted[rows].mean(axis=0)
        vantage = rows[int(np.argmax(((lifted[rows] - centre) ** 2).sum(axis=1)))]
        away = np.sqrt(((lifted[rows] - lifted[vantage]) ** 2).sum(axis=1))
        sort = np.argsort(away, kind="stable")
        self.order[start:end], away = rows[sort], away[sort]
        half = (end - start) // 2
        ranges = (away[0], away[half - 1], away[half], away[-1])
        inner = self._grow(lifted, start, start + half, leaf)
        outer = self._grow(lifted, start + half, end, leaf)
        self.nodes[number] = (start, end, int(vantage), inner, outer, ranges)
        return number

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, inner product) of the ``k`` nearest of each query and of all rows that tie with the last of them.

        Products of the walk are rounded otherwise than the exact ones, so rows within SLACK of the last are weighed again."""
        queries = np.ascontiguousarray(queries, np.float64)
        n = len(queries)
        best = np.full((n, k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        norms = np.einsum("ij,ij->i", queries, queries)
        base = norms + self.square
        slack = SLACK * (1 + np.sqrt(norms * self.square))
        home = np.full(n, -1)

        def away(who: np.ndarray, vantage: int) -> np.ndarray:
            return np.sqrt(np.maximum(base[who] - 2 * (queries[who] @ self.vectors[vantage]), 0.0))

        def visit(who: np.ndarray, number: int) -> None:
            start, end = self.nodes[number][:2]
            rows = self.order[start:end]
            scores = queries[who] @ self.vectors[rows].T
            both = np.concatenate([best[who], scores], axis=1)
            best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            q, r = np.nonzero(scores >= (best[who].min(axis=1) - slack[who])[:, None])
            kept.append((who[q], rows[r], scores[q, r]))

        stack = [(0, np.arange(n))]
        while stack:  # every query first visits the leaf it falls in, for a close bound
            number, who = stack.pop()
            start, end, vantage, inner, outer, ranges = self.nodes[number]
            if not len(who):
                continue
            if vantage < 0:
                home[who] = number
                visit(who, number)
                continue
            near = away(who, vantage) < (ranges[1] + ranges[2]) / 2
            stack += [(inner, who[near]), (outer, who[~near])]
        stack = [(0, np.arange(n), np.zeros(n))]
        while stack:
            number, who, bound = stack.pop()
            start, end, vantage, inner, outer, ranges = self.nodes[number]
            reach = np.sqrt(np.maximum(base[who] - 2 * (best[who].min(axis=1) - slack[who]), 0.0)) * (1 + 1e-12)
            open_ = bound * factor <= reach
            if vantage < 0:
                open_ &= home[who] != number
            who, bound = who[open_], bound[open_]
            if not len(who):
                continue
            if vantage < 0:
                visit(who, number)
                continue
            d = away(who, vantage)
            least_in = np.maximum(bound, np.maximum(d - ranges[1], ranges[0] - d))
            least_out = np.maximum(bound, np.maximum(d - ranges[3], ranges[2] - d))
            children = [(outer, who, least_out), (inner, who, least_in)]
            stack += children if least_in.sum() <= least_out.sum() else children[::-1]
        q, r, walked = (np.concatenate(x) for x in zip(*kept, strict=True))
        last = best.min(axis=1) - slack
        near = walked >= last[q]
        q, r = q[near], r[near]
        exact = np.concatenate([(self.vectors[r[at : at + CHUNK]] * queries[q[at : at + CHUNK]]).sum(axis=1) for at in range(0, len(q), CHUNK)]) if len(q) else np.zeros(0)
        return q, r, exact


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids with a finite vector that is not zero; of rows with the same id, the one that sorts first."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _build(frame: pd.DataFrame, leaf: int) -> pd.DataFrame:
    import pickle

    frame = frame.sort_values("first_id")
    tree = VantagePointTree(np.stack(frame["vector"].to_numpy()), leaf)
    out = io.BytesIO()
    pickle.dump((tree, [np.asarray(i, np.int64) for i in frame["ids"]]), out)
    return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "shard": [frame["shard"].iloc[0]], "tree": [out.getvalue()]})


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    import pickle

    for batch in batches:
        for row in batch.to_pylist():
            tree, ids = pickle.loads(row["tree"])
            names = [q["vec_id"] for q in row["queries"]]
            queries = np.array([q["vector"] for q in row["queries"]], np.float64)
            q, rows, scores = tree.search(queries, min(len(ids), k + 1), factor)
            order = np.argsort(q, kind="stable")
            q, rows, scores = q[order], rows[order], scores[order]
            ends = np.searchsorted(q, np.arange(len(names) + 1))
            out = []
            for i, name in enumerate(names):
                each = [ids[r] for r in rows[ends[i] : ends[i + 1]]]
                flat = np.concatenate(each) if each else np.zeros(0, np.int64)
                score = np.repeat(scores[ends[i] : ends[i + 1]], [len(e) for e in each])
                score, flat = score[flat != name], flat[flat != name]
                top = np.lexsort((flat, -score))[:k]
                out.append((name, [{"vec_id": int(flat[t]), "score": float(score[t])} for t in top]))
            kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], kind)], ["query_id", "near"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of ``vectors`` with the largest inner product, the query's own id left out; all of them where there are fewer.

    Ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do null ids; of rows that repeat an id the vector that sorts
    first counts. Only vectors of the same length are compared. Other columns are ignored; no
    rows give no rows."""
    base = _usable(vectors, id_col, vector_col)
    salted = base.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for by in (["vector", "salt"], ["vector"]):  # copies of one vector are thinned out over several keys first
        salted = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    few = salted
    groups = materialise(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("vector", "ids", F.element_at("ids", 1).alias("first_id"), F.size("vector").alias("dim")))
    asked = materialise(_usable(queries, id_col, vector_col).select("vec_id", "vector", F.size("vector").alias("dim")))
    shards = max(1, -(-groups.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    sharded = groups.withColumn("shard", F.pmod(F.xxhash64("first_id"), F.lit(shards)).cast("int"))
    trees = materialise(sharded.groupBy("dim", "shard").applyInPandas(lambda f: _build(f, leaf_rows), "dim int, shard int, tree binary"))
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    pairs = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees.hint("shuffle_merge"), ["dim", "shard"])
    spread = pairs.select("queries", "tree").repartition(max(1, min(shards * blocks, 10_000)))
    found = spread.mapInArrow(lambda b: _search(b, k, factor), "query_id long, near array<struct<vec_id:long,score:double>>")
    rows = found.select("query_id", F.inline("near"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vantage_point_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
