"""Language-model scoring by context-tree weighting over bytes.

The text is the sequence of its lower-cased words, each followed by a blank, and an end byte. A
byte's context is the ``depth`` bytes before it, across blanks; a document starts behind ``depth``
blanks. Each byte is eight binary decisions; for each decision and each context length the tree holds
the counts of zeros and ones, a Krichevsky-Trofimov estimate of them, and the weight with which the
node's own estimate and its longer contexts are mixed. The predictive probability is the mixture over
all depths whose context was seen in training: an unseen context adds no estimate, and the mixture ends
at the context before it. A document's score is the sum over its bytes.

A step is a context and the byte after it. Steps are counted in each task before the shuffle. The tree
is cut at ``SPLIT`` bytes of context: each subtree below the cut is worked out whole in one group of
bounded expected size, the levels above it are small tables joined on the parent node. Each distinct
step gets its log-probability once. The most frequent ``frequent_steps`` steps and ``frequent_words``
words (fixed bounds) are broadcast to the documents; rarer ones are joined.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

DEPTH = 5
SPLIT = 3
CHUNK_BYTES = 1 << 20
COUNT_BYTES = 1 << 21
MERGED_STEPS = 1 << 20
GROUP_STEPS = 50_000
FOLDS = 10
SMOOTHING = 0.1
FREQUENT_WORDS = 150_000
FREQUENT_STEPS = 1 << 21
FLUSH_WORDS = 200_000
SLICE_ROWS = 2000
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: only ASCII letters and white space


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 10; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train: Counter = Counter()
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        names = [*train, *(w for w in held if w not in train)]
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array([train[w] for w in names], pa.int64())], ["word", "n"])
        train.clear()
        held.clear()
        return out

    for batch in batches:
        for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if out:
                held.update(dict.fromkeys(words_of(text), 0))
                held[END] = 0
            else:
                train.update(words_of(text))
                train[END] += 1
            if len(train) + len(held) > FLUSH_WORDS:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of ``docs`` (text, held_out) and the end token, with its count in training documents."""
    rows = docs.select("text", "held_out")
    return rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def running_text(words: list[bytes], depth: int) -> bytes:
    """The bytes that are scored, behind ``depth`` blanks: every byte has a whole context."""
    return b" " * depth + (b" ".join(words) + b" " if words else b"") + END


def _keys(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, piece of each) of all bytes but the first ``depth`` of every piece, last byte first.

    A step is one word: the context, its last byte in the highest place, and the byte after it in the lowest."""
    joined = b"".join(pieces)
    back = joined[::-1] + bytes(7)
    here = np.ndarray((len(joined),), ">u8", back, 0, (1,)).astype(np.uint64)
    here >>= np.uint64(8 * (7 - depth))
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    use = np.ones(len(joined), bool)
    use[((np.cumsum(lens) - lens)[:, None] + np.arange(depth)).ravel()] = False
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)[use][::-1]
    here = here[use[::-1]]
    byte = here >> np.uint64(8 * depth)
    here &= np.uint64((1 << 8 * depth) - 1)
    here <<= np.uint64(8)
    here |= byte
    return here, owner


def step_keys(texts: Iterable[bytes], depth: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(steps, number of the text of each) of a bounded number of bytes at a time; a longer text comes in several parts."""
    pieces: list[bytes] = []
    numbers: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - depth, chunk):
            pieces.append(text[at : at + chunk + depth])
            numbers.append(number)
            size += len(pieces[-1])
            if size >= chunk:
                keys, owner = _keys(pieces, depth)
                yield keys, np.array(numbers)[owner]
                pieces, numbers, size = [], [], 0
    if pieces:
        keys, owner = _keys(pieces, depth)
        yield keys, np.array(numbers)[owner]


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n[order], first)


def _step_counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(key, n) summed over as many chunks as a bounded table holds; held-out documents count nothing."""
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    for batch in _slices(batches):
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for flag in (False, True):
            for found, _ in step_keys((running_text(words_of(t), depth) for t, held in rows if held == flag), depth, COUNT_BYTES):
                found.sort()
                first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                times = np.zeros(len(first), np.int64) if flag else np.diff(np.r_[first, len(found)])
                keys, n = _sums(np.concatenate([keys, found[first]]), np.concatenate([n, times]))
                if len(keys) > MERGED_STEPS:
                    yield out()
                    keys, n = keys[:0], n[:0]
    yield out()


def step_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n): every distinct step of ``docs`` (text, held_out), with its count in training documents."""
    return docs.select("text", "held_out").mapInArrow(lambda b: _step_counts(b, depth), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _log_gamma_terms(x, log):
    """Stirling's series seven above ``x`` (at least a half), for columns and arrays."""
    z = x + 7
    series = (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    return series - log(product)


def _log_kt(zeros, ones, log):
    """Logarithm of the Krichevsky-Trofimov block probability."""
    return _log_gamma_terms(zeros + 0.5, log) + _log_gamma_terms(ones + 0.5, log) - _log_gamma_terms(zeros + ones + 1.0, log) - math.log(math.pi)


class Subtrees:
    """The nodes with ``low`` to ``depth`` bytes of context over some distinct steps, for one bit of the byte at a time."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: int, depth: int):
        order = np.argsort(keys)
        self.order, self.low, self.depth = order, low, depth
        self.rows = {depth: (keys[order], n[order].astype(np.float64))}
        self.up: dict[int, np.ndarray] = {}
        for d in range(depth, low, -1):  # one context byte fewer: its steps, and where each step of this level went
            full, count = self.rows[d]
            cut = full >> np.uint64(16) << np.uint64(8) | full & np.uint64(255)
            sort = np.argsort(cut, kind="stable")
            cut = cut[sort]
            new = np.r_[True, cut[1:] != cut[:-1]]
            self.up[d] = np.empty(len(cut), np.int64)
            self.up[d][sort] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            self.rows[d - 1] = cut[first], np.add.reduceat(count[sort], first)

    def grow(self, k: int) -> None:
        """Counts, own estimates and mixtures of the nodes that decide bit ``k``, from the longest contexts up."""
        self.k = k
        self.first, self.node, self.total, self.ones, self.own, self.below, self.parent = {}, {}, {}, {}, {}, {}, {}
        for d in range(self.depth, self.low - 1, -1):
            keys, n = self.rows[d]
            place = keys >> np.uint64(8 - k)
            new = np.r_[True, place[1:] != place[:-1]]
            first = self.first[d] = np.flatnonzero(new)
            self.node[d] = np.cumsum(new) - 1
            self.total[d] = np.add.reduceat(n, first)
            self.ones[d] = np.add.reduceat(n * (keys >> np.uint64(7 - k) & np.uint64(1)), first)
            self.own[d] = _log_kt(self.total[d] - self.ones[d], self.ones[d], np.log)
            if d == self.depth:
                self.mixed = self.own[d]
            else:
                self.parent[d + 1] = self.node[d][self.up[d + 1][self.first[d + 1]]]
                self.below[d] = np.bincount(self.parent[d + 1], self.mixed, len(first))
                self.mixed = np.logaddexp(self.own[d], self.below[d]) - math.log(2)

    def names(self) -> np.ndarray:
        """The nodes at the cut: their context, and below it a one and the bits before bit k."""
        keys = self.rows[self.low][0][self.first[self.low]]
        prefix = np.uint64(1 << self.k) | (keys & np.uint64(255)) >> np.uint64(8 - self.k)
        return (keys >> np.uint64(8) << np.uint64(8) | prefix).view(np.int64)

    def log_probabilities(self, share: np.ndarray, rest: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of each step's bit k, given for each node at the cut what shorter contexts add, the weight left, and the mixture without this node."""
        for d in range(self.low, self.depth + 1):
            if d > self.low:
                share, rest, stop = (x[self.parent[d]] for x in (share, rest, stop))
            kt = (self.ones[d] + 0.5) / (self.total[d] + 1.0)
            weight = 1 / (1 + np.exp(np.minimum(self.below[d] - self.own[d], 700.0))) if d < self.depth else 1.0
            seen = self.total[d] > 0
            stop = np.where(seen, share + rest * kt, stop)
            share, rest = share + rest * weight * kt, rest * (1 - weight)
        bit = self.rows[self.depth][0] >> np.uint64(7 - self.k) & np.uint64(1)
        one = stop[self.node[self.depth]]
        return np.log(np.where(bit == 1, one, 1 - one))


def _steps(found: pa.Table, low: int, depth: int) -> Subtrees:
    return Subtrees(found["key"].to_numpy().view(np.uint64), found["n"].to_numpy(), low, depth)


def _cut_nodes(found: pa.Table, low: int, depth: int) -> pa.Table:
    tree = _steps(found, low, depth)
    parts = []
    for k in range(8):
        tree.grow(k)
        parts.append((tree.names(), tree.total[low] - tree.ones[low], tree.ones[low], tree.mixed))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["node", "n0", "n1", "mixed"])


def _step_logs(found: pa.Table, reach: pa.Table, low: int, depth: int) -> pa.Table:
    tree = _steps(found, low, depth)
    names = reach["node"].to_numpy()
    order = np.argsort(names)
    names = names[order]
    given = [reach[c].to_numpy()[order] for c in ("share", "rest", "stop")]
    logp = np.zeros(len(tree.order))
    for k in range(8):
        tree.grow(k)
        at = np.searchsorted(names, tree.names())
        logp += tree.log_probabilities(*(g[at] for g in given))
    return pa.table([pa.array(tree.rows[depth][0].view(np.int64)), pa.array(tree.rows[depth][1].astype(np.int64)), pa.array(logp)], ["key", "n", "logp"])


def _upper(node: Column) -> Column:
    """The node with one context byte fewer, the farthest."""
    return F.shiftleft(F.shiftrightunsigned(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255).cast("long")))


def _reach(level: DataFrame, share: Column, rest: Column, stop: Column) -> DataFrame:
    """(up, share, rest, stop) that the longer contexts of each node of ``level`` are given."""
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    weight = 1 / (1 + F.exp(F.col("below") - F.col("own")))
    end = F.when(F.col("n0") + F.col("n1") > 0, share + rest * kt).otherwise(stop)
    return level.select(F.col("node").alias("up"), (share + rest * weight * kt).alias("share"), (rest * (1 - weight)).alias("rest"), end.alias("stop"))


def cut_reach(nodes: DataFrame, low: int) -> DataFrame:
    """``nodes``: (node, n0, n1, mixed) with ``low`` bytes of context. (node, share, rest, stop) from the levels above."""
    if not low:
        return nodes.select("node", F.lit(0.0).alias("share"), F.lit(1.0).alias("rest"), F.lit(0.5).alias("stop"))
    levels = {low: nodes}
    for d in range(low - 1, -1, -1):
        sums = levels[d + 1].groupBy(_upper(F.col("node")).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mixed").alias("below"))
        own = sums.withColumn("own", _log_kt(F.col("n0"), F.col("n1"), F.log))
        high, least = F.greatest("own", "below"), F.least("own", "below")
        levels[d] = own.withColumn("mixed", high + F.log1p(F.exp(least - high)) - math.log(2))
    reach = _reach(levels[0], F.lit(0.0), F.lit(1.0), F.lit(0.5))
    for d in range(1, low):
        reach = _reach(levels[d].withColumn("up", _upper(F.col("node"))).join(reach, "up"), F.col("share"), F.col("rest"), F.col("stop"))
    return nodes.select("node", _upper(F.col("node")).alias("up")).join(reach, "up").select("node", "share", "rest", "stop")


def context_tree(counts: DataFrame, depth: int, split: int = SPLIT, group_steps: int = GROUP_STEPS) -> DataFrame:
    """``counts``: distinct steps (key, n). Returns (key, n, logp): the natural logarithm of the mixed probability of each step's byte in its context."""
    low = min(split, depth)
    groups = max(1, -(-counts.count() // group_steps))
    bucket = lambda context: F.pmod(F.xxhash64(context), F.lit(groups)).cast("int").alias("bucket")
    steps = counts.select(bucket(F.shiftrightunsigned("key", 8 * (depth - low) + 8)), "key", "n")
    nodes = materialise(steps.groupBy("bucket").applyInArrow(lambda t: _cut_nodes(t, low, depth), "node long, n0 double, n1 double, mixed double"))
    reach = cut_reach(nodes, low)
    reach = reach.select(bucket(F.shiftrightunsigned("node", 8)), "*")
    logs = steps.groupBy("bucket").cogroup(reach.groupBy("bucket"))
    return logs.applyInArrow(lambda t, r: _step_logs(t, r, low, depth), "key long, n long, logp double")


def _listed(docs: list[np.ndarray], keys: list[np.ndarray], n: int) -> pa.Array:
    """For each of ``n`` documents the list of its distinct keys and how often each comes."""
    doc, key = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((docs, np.int64), (keys, np.uint64)))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(doc)])
    offsets = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(key[first].view(np.int64)), pa.array(times)], ["key", "times"]))


def _document_rows(batches: Iterator[pa.RecordBatch], shared, depth: int) -> Iterator[pa.RecordBatch]:
    """Sums over each document's frequent words and steps; its other words and steps with their counts."""
    (names, c, base), (steps, logs) = shared.value
    number = {w: i for i, w in enumerate(names)}
    for batch in _slices(batches):
        out: list[list] = [[], [], [], []]
        rare_words: list[bytes] = []
        rare_times: list[int] = []
        bounds = [0]

        def texts() -> Iterator[bytes]:
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                run = running_text(words, depth)
                words.append(END)
                got = np.fromiter(map(number.get, words, itertools.repeat(-1)), np.int64, len(words))
                rare = Counter(words[i] for i in np.flatnonzero(got < 0).tolist())
                got = got[got >= 0]
                rare_words.extend(rare)
                rare_times.extend(rare.values())
                bounds.append(len(rare_words))
                for values, v in zip(out, (len(words), len(run) - depth, int((c[got] > 0).sum()), float(base[got].sum())), strict=True):
                    values.append(v)
                yield run

        ctw = np.zeros(len(batch))
        rare_docs, rare_steps = [], []
        for keys, owner in step_keys(texts(), depth):
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times = np.diff(np.r_[first, len(keys)])
            if len(steps):
                at = np.minimum(np.searchsorted(steps, keys[first]), len(steps) - 1)
                hit = steps[at] == keys[first]
                ctw += np.bincount(owner, np.repeat(np.where(hit, logs[at], 0.0), times), len(batch))
            else:
                hit = np.zeros(len(first), bool)
            if not hit.all():
                left = np.repeat(~hit, times)
                rare_docs.append(owner[left])
                rare_steps.append(keys[left])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(rare_times, pa.int64())], ["word", "times"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rare), pa.array(ctw), _listed(rare_docs, rare_steps, len(batch))],
            ["row", "held_out", "n_tokens", "n_bytes", "n_known", "base", "rare", "ctw", "rare_steps"],
        )


def frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows from some ``count`` on, as many as ``most`` allows: the count is found from a histogram of at most 512 steps, so no task gathers or sorts the rows."""
    step = F.floor(F.log2(count) * 8)
    seen = rows.where(F.col(count) > 0)
    total, least = 0, None
    for row in sorted(seen.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return seen.where(step >= least) if least is not None else seen.limit(0)


def score_documents(docs: DataFrame, depth: int = DEPTH, frequent_words: int = FREQUENT_WORDS, frequent_steps: int = FREQUENT_STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row of ``docs``.

    Scores are log10 probabilities; bits_per_byte is the code length over the bytes of the words,
    a blank after each, and the end byte; ``depth`` is 1 to 7 bytes. A null text is empty: it has the
    end token alone. Null ids are training documents; repeated rows count and are scored each; other
    columns are ignored; texts of any length are scored whole. No rows give no rows; without training
    documents every bit of a byte has probability one half."""
    if not 1 <= depth <= 7:
        raise ValueError("a context and the byte after it have at most 64 bits")
    spark = docs.sparkSession
    keyed = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", is_held_out(F.col("doc_id")))
    words = materialise(word_counts(keyed))
    totals = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    words = words.withColumn("base", F.log10((F.col("c") + SMOOTHING) / F.lit(n + SMOOTHING * (v + 1))))
    steps = materialise(context_tree(materialise(step_counts(keyed, depth)), depth))
    top = frequent(words, "c", frequent_words).toArrow()
    near = frequent(steps, "n", frequent_steps).select("key", "logp").toArrow()
    keys = near["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((([w.encode() for w in top["word"].to_pylist()], top["c"].to_numpy(), top["base"].to_numpy()), (keys[order], near["logp"].to_numpy()[order])))
    sums = "row struct<id:long,doc_id:long>, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, rare array<struct<word:string,times:long>>, ctw double, rare_steps array<struct<key:long,times:long>>"
    rows = keyed.select(F.struct("id", "doc_id").alias("row"), "held_out", "text").mapInArrow(lambda b: _document_rows(b, shared, depth), sums)
    rows = materialise(rows)
    shared.destroy()  # the rows are written: workers let go of it
    none, times = F.lit(0.0), F.col("times")
    known = F.when(F.col("c") > 0, times).otherwise(0).alias("more_known")
    more_words = rows.select(F.col("row.id").alias("id"), F.inline("rare")).join(words, "word").select("id", known, (times * F.col("base")).alias("more_base"), none.alias("more_ctw"))
    more_steps = rows.select(F.col("row.id").alias("id"), F.inline("rare_steps")).join(steps, "key").select("id", F.lit(0).alias("more_known"), none.alias("more_base"), (times * F.col("logp")).alias("more_ctw"))
    more = more_words.unionByName(more_steps).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("more_known", "more_base", "more_ctw")))
    out = rows.drop("rare", "rare_steps").withColumn("id", F.col("row.id")).join(more, "id", "left")
    nats = F.col("ctw") + F.coalesce("more_ctw", none)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"), (nats / math.log(10)).alias("score"), (-nats / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
