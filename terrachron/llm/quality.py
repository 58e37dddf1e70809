"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a short vector of text features. Training boosts one feature at a time in a
fixed cycle: a shallow tree over that feature's bins is fitted to the loss gradient and added, at
a small rate, to the feature's lookup table. The strongest pairs of features then get
two-dimensional tables in the same way. A score is the sum of the looked-up bins through the
logistic function, taken for a whole batch at once.

The model is fitted on a bounded sample of labelled documents (``sample_rows``, smallest hashes of
doc_id), which alone passes the driver. Every document is scored, where it is stored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, hold_only, table, whole_row

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 80, 40, 6
RATE, LEAF_WEIGHT = 0.2, 5.0
FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "upper", "digit", "punctuation", "symbol", "high_bytes",
    "log_lines", "line_words", "repeated_lines", "sentence_words", "bangs", "bars", "capital_words", "compressed",
)

_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; a null text counts as empty, whose features are all 0."""
    raw = (text or "").encode("utf-8")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    ends = int(count[46] + count[33] + count[63])
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / m, len(kinds) / m, max(kinds.values(), default=0) / m,
        count[65:91].sum() / n, count[48:58].sum() / n, count[_PUNCTUATION].sum() / n, count[_SYMBOL].sum() / n, count[128:].sum() / n,
        float(np.log1p(len(lines))), len(words) / k, 1 - len(set(lines)) / k, len(words) / (ends + 1), count[33] / m, count[124] / m,
        sum(w[:1].isupper() for w in kinds) / max(1, len(kinds)), len(zlib.compress(raw[:n], 1)) / n,
    ]


def feature_matrix(texts: list) -> np.ndarray:
    return np.array([text_features(t if isinstance(t, str) else None) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``pairs`` holds (feature, feature, table)."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, values in self.pairs:
            out += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray | float, h: np.ndarray | float):
    return g / (h + LEAF_WEIGHT)


def _gain(g, h):
    return g * g / (h + LEAF_WEIGHT)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of a tree with at most three leaves."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = max(((*_split(g[a:b], h[a:b]), a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), default=(0.0, 0, 0))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[2] + best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values over a grid of bins: a cut on one axis, then one on the other on each side."""
    best_gain, best = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            gain, values = -_gain(g.sum(), h.sum()), np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                row_g, row_h = gg[part].sum(axis=0), hh[part].sum(axis=0)
                more, at = _split(row_g, row_h)
                gain += more + _gain(row_g.sum(), row_h.sum())
                for side in (slice(0, at), slice(at, None)):
                    values[part, side] = _leaf(row_g[side].sum(), row_h[side].sum())
            if gain > best_gain:
                best_gain, best = gain, values.T if flip else values
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boosted lookup tables for label 1 against 0. With one class or no rows the model is constant."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        model.edges, model.tables = [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1]
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, values in enumerate(model.tables):
            g, h = gradient()
            step = RATE * _shallow_tree(np.bincount(at[j], g, len(values)), np.bincount(at[j], h, len(values)))
            values += step
            f += step[at[j]]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    ranked = sorted(((-_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)))
    model.pairs = [(a, b, np.zeros_like(grid(a, b, g))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, values in model.pairs:
            g, h = gradient()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            values += step
            f += step[rough[a], rough[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, features, label) of the sample: labelled rows outside the held-out fold, a label of 0 or 1, smallest hashes first."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(fold != 0)
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return pd.Series(list(feature_matrix(list(text))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    return rows.select("doc_id", features("text").alias("features"), "label")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    rows = training_rows(docs, labels, sample_rows).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    x = np.array(rows["features"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(np.float64))


def _score(model: AdditiveModel) -> Column:
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        hold_only()
        parts = [feature_matrix(text.slice(at, TEXT_ROWS).to_pylist()) for at in range(0, len(text), TEXT_ROWS)]
        return pa.array(model.score(np.concatenate([feature_matrix([]), *parts])))

    return score("text")


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with its columns, whose text scores ``threshold`` or more; rows are treated as in ``score_documents``, and columns of any name may come with them."""
    return docs.select(whole_row(docs), _score(model).alias("score")).where(F.col("score") >= threshold).select("row.*")


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    A null text is scored as an empty one. Null and repeated ids and repeated rows stay (a null id
    is not held out); other columns are no input of a score; no rows give no rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, _score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
