"""Alignment of two tokenizers over one byte string, by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the token of the other tokenizer that overlaps it and
ends farthest to the right, or to itself where both end; doubling all pointers at once leads every token to the
last token of its component, and that token labels the group. Links are the pairs of tokens that overlap: one
for each stretch between two ends of any kind.

Texts are cut where both tokenizers always cut, and each distinct chunk is encoded and aligned once in a worker;
a document is a gather over its chunks. The links of the documents are written to the shared folder, counted
there, and looked up again: pairs above a count that at most ``frequent`` of them reach are sent to the tasks,
the others are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_only, materialise, table
from .pieces import BATCH_CHARS, WHITE

BYTE_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_CHUNKS = 200_000
CHUNK_CHARS = 32
FREQUENT_PAIRS = 1 << 20
TASK_PAIRS = 1 << 21
COLUMNS = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, {groups} string, pairs binary, times binary"
SLICE = 512


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and of every B token, numbered from left to right.

    Both arrays hold the ascending ends of tokens that cover the same bytes without gaps."""
    n = len(a_ends)
    point = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)])
    both = b_ends[point[:n] - n] == a_ends
    point[:n][both] = np.flatnonzero(both)
    while True:
        farther = point[point]
        if np.array_equal(farther, point):
            break
        point = farther
    number = (np.cumsum(both) - 1)[point]  # a component ends where both end: its last token is one of A
    return number[:n], number[n:]


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every overlapping pair, from left to right."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Aligner:
    """Aligned chunks of texts under two tokenizer files, kept up to a bound in each worker process."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        from .token_counts import byte_letters

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        model = sentencepiece_model_pb2.ModelProto()
        with open(piece_path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space stands in the text already
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(y))] for y in (self.a_bytes, self.b_bytes))
        self.shift = max(1, (len(self.b_bytes) - 1).bit_length())
        self.bits = self.shift + max(1, (size - 1).bit_length())
        self.chunks = chunk_pattern([p.piece for p in model.pieces])
        self.release()

    def release(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.strings: list[str] = []
        self.sums = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; links are -1 where the bytes differ
        self.pairs = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encode and align chunks that are not known yet."""
        found_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        found_b = self.b.encode(new, num_threads=1)
        strings, sums = [""] * len(new), np.zeros((len(new), 4), np.int64)
        sums[:, 3] = -1
        same = [k for k, (chunk, a, b) in enumerate(zip(new, found_a, found_b, strict=True)) if b"".join(map(self.a_bytes.__getitem__, a)) == chunk.encode() == b"".join(map(self.b_bytes.__getitem__, b))]
        pairs, starts = self.pairs, np.full(len(new), len(self.pairs))
        if same:
            a_ids, b_ids = (np.fromiter((i for k in same for i in f[k]), np.int64) for f in (found_a, found_b))
            n_a, n_b = (np.fromiter((len(f[k]) for k in same), np.int64, len(same)) for f in (found_a, found_b))
            a_ends, b_ends = np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids])
            a_group, b_group = groups_of(a_ends, b_ends)
            link_a, link_b = links_of(a_ends, b_ends)
            a_cut, b_cut = np.cumsum(n_a), np.cumsum(n_b)
            cut = a_ends[a_cut - 1]  # both tokenizers end at the end of a chunk
            link_cut = np.searchsorted(np.union1d(a_ends, b_ends), cut, side="right")
            group_cut = a_group[a_cut - 1] + 1
            sums[same] = np.stack([n_a, n_b, np.diff(group_cut, prepend=0), np.diff(link_cut, prepend=0)], axis=1)
            starts[same] = len(pairs) + link_cut - sums[same, 3]
            pairs = np.concatenate([pairs, a_ids[link_a] << self.shift | b_ids[link_b]])
            for k, text in zip(same, self._render(a_ids, b_ids, a_group, b_group, a_cut + b_cut), strict=True):
                strings[k] = text
        self.pairs, self.strings = pairs, self.strings + strings
        self.sums, self.starts = np.concatenate([self.sums, sums]), np.concatenate([self.starts, starts])
        self.chars += sum(map(len, new))

    def _render(self, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, cuts: np.ndarray) -> Iterator[str]:
        """``a1,a2|b1;a3|b2`` of each stretch of tokens between two ``cuts``."""
        key = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.append(key[1:] != key[:-1], True)
        after = np.where(last, np.where(key % 2 == 0, 1, 2), 0).tolist()
        names = list(map(self.a_text.__getitem__, a_ids.tolist())) + list(map(self.b_text.__getitem__, b_ids.tolist()))
        parts = [names[i] + ",|;"[s] for i, s in zip(order.tolist(), after, strict=True)]
        at = 0
        for end in cuts.tolist():
            yield "".join(parts[at:end])[:-1]
            at = end

    def align(self, texts: list) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, distinct pairs, times) of each text; zeros and nothing where the tokens' bytes differ from it."""
        hold_only(self)
        at = 0
        while at < len(texts):
            end, chars, chunks, bounds = at, 0, [], [0]
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
                text = texts[end] or ""
                if text and SPACE not in text:
                    chunks += self.chunks.findall(" " + text)
                chars += len(text)
                bounds.append(len(chunks))
                end += 1
            new = list(dict.fromkeys(c for c in chunks if c not in self.index))
            if new:
                self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
                self._learn(new)
            codes = list(map(self.index.__getitem__, chunks))
            yield from self._documents(np.array(codes, np.int64), codes, np.array(bounds))
            if len(self.index) > CACHE_CHUNKS or self.chars > CACHE_CHUNKS * CHUNK_CHARS:
                self.release()
            at = end

    def _documents(self, codes: np.ndarray, listed: list, bounds: np.ndarray) -> Iterator[tuple]:
        sums = self.sums[codes]
        failed = np.concatenate([[0], np.cumsum(sums[:, 3] < 0)])
        whole = (failed[bounds[1:]] == failed[bounds[:-1]]) & (bounds[1:] > bounds[:-1])
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sums, axis=0)])
        totals = totals[bounds[1:]] - totals[bounds[:-1]]
        owner = np.repeat(np.arange(len(whole)), np.diff(bounds))
        kept = whole[owner]
        lens = sums[kept, 3]
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[codes[kept]] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
        keys = np.sort(np.repeat(owner[kept], lens) << self.bits | self.pairs[at])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        cut = np.searchsorted(keys, np.arange(len(whole) + 1) << self.bits)
        keys &= (1 << self.bits) - 1
        for k, full in enumerate(whole.tolist()):
            if full:
                yield (*totals[k].tolist(), ";".join(map(self.strings.__getitem__, listed[bounds[k] : bounds[k + 1]])), keys[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]])
            else:
                yield 0, 0, 0, 0, "", keys[:0], times[:0]


def chunk_pattern(pieces: list[str]) -> re.Pattern:
    """Chunks at whose ends both tokenizers always cut: white space, then other characters.

    The byte-level pattern ends a token before white space that follows other characters, and no piece holds a space
    behind another character. White space that some piece does hold behind one keeps its chunk open."""
    blank = re.compile(f"[{WHITE}{SPACE}]")
    joined = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if blank.match(b) and not blank.match(a)}
    if joined & {SPACE, " "}:
        return re.compile(".+", re.DOTALL)
    more = f"(?:[{re.escape(''.join(sorted(joined)))}][{WHITE}]*[^{WHITE}]*)*" if joined else ""
    return re.compile(f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner for each pair of files and worker process."""
    key = byte_path, piece_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_path, piece_path)
    return _ALIGNERS[key]


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], pair_type: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of COLUMNS; the groups themselves, or their SHA-256."""
    align = aligner(*paths).align
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256" if digest else "groups", "pairs", "times"]
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            rows = list(align(part.column(1).to_pylist()))
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            groups = pa.array([hashlib.sha256(r[4].encode()).hexdigest() if digest and r[0] else r[4] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers, groups, *(pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in ((5, pair_type), (6, "<u4")))], names)


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times): the groups of every text as a string, and its
    distinct linked pairs (A id << shift | B id) with the number of their links, as little-endian longs and ints.

    A row for each row of ``docs``; null and empty texts, and texts that the tokens do not give back byte by byte,
    have zeros, '' and no pairs. Null and repeated ids are kept as they are, other columns are ignored, no rows give
    no rows. Texts of any length are aligned whole."""
    paths = byte_path or public_tokenizers.path(BYTE_MODEL), piece_path or public_tokenizers.path(PIECE_MODEL)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: _aligned(b, paths, "<i8", False), COLUMNS.format(kind=kind, groups="groups"))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], kind: str, most: int) -> Iterator[pa.RecordBatch]:
    """(pair, n): the links of each pair in a task, in several rows where a task has more than ``most`` distinct pairs."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], ["pair", "n"])

    for batch in batches:
        for at in range(0, len(batch), SLICE):
            rows = batch.slice(at, SLICE)
            keys, counts = (np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in rows.column(k)), t).astype(np.int64) for k, t in ((0, kind), (1, "<u4")))
            held = _summed(np.concatenate([held[0], keys]), np.concatenate([held[1], counts]))
            if len(held[0]) > most:
                yield out()
                held = held[0][:0], held[1][:0]
    if len(held[0]):
        yield out()


def _look_up(batches: Iterator[pa.RecordBatch], kind: str, known) -> Iterator[pa.RecordBatch]:
    """Adds n_best and count_sum over the pairs that ``known`` has, and the rest as (pair, times)."""
    keys, counts, best = known.value
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            rows = batch.slice(at, SLICE)
            ends, n_best, count_sum, rest_pairs, rest_times = [0], [], [], [], []
            for pairs, times in zip(rows.column("pairs"), rows.column("times"), strict=True):
                pair = np.frombuffer(pairs.as_buffer(), kind).astype(np.int64)
                time = np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
                place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
                place = place[hit]
                n_best.append(int(time[hit][best[place]].sum()))
                count_sum.append(int((time[hit] * counts[place]).sum()))
                rest_pairs.append(pair[~hit])
                rest_times.append(time[~hit])
                ends.append(ends[-1] + len(rest_pairs[-1]))
            rest = pa.StructArray.from_arrays([pa.array(np.concatenate(rest_pairs), pa.int64()), pa.array(np.concatenate(rest_times), pa.int64())], ["pair", "times"])
            names = ["row_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], [*names, "n_best", "count_sum", "rest"])


def pair_counts(links: DataFrame, shift: int, kind: str = "<i8", most: int = TASK_PAIRS) -> DataFrame:
    """(pair, b, n, best): corpus-wide links of each id pair; ``best`` where no pair of its B id has more."""
    partial = links.select("pairs", "times").mapInArrow(lambda b: _count(b, kind, most), "pair long, n long")
    counts = materialise(partial.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << shift) - 1))))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # at most a row for each id of B's vocabulary
    return counts.join(F.broadcast(highest), "b").select("pair", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def alignment_counts(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    Rows are treated as in ``align_documents``; ``groups_sha256`` is '' for rows without tokens. At most ``frequent``
    pairs, those of the highest counts, pass the driver; all others are joined by pair, and each of those is in no
    more links than the count that the frequent ones exceed."""
    spark = docs.sparkSession
    paths = byte_path or public_tokenizers.path(BYTE_MODEL), piece_path or public_tokenizers.path(PIECE_MODEL)
    shift, bits = aligner(*paths).shift, aligner(*paths).bits
    kind = "<u4" if bits <= 32 else "<i8"
    columns = COLUMNS.format(kind=docs.schema["doc_id"].dataType.simpleString(), groups="groups_sha256")
    encoded = docs.select("doc_id", "text").mapInArrow(lambda b: _aligned(b, paths, kind, True), columns)
    links = materialise(encoded.withColumn("row_no", F.monotonically_increasing_id()))
    counts = pair_counts(links, shift, kind)
    sizes = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("power")).agg(F.count("*").alias("pairs")).orderBy(F.desc("power")).collect()  # at most 64 rows
    least, held = None, 0
    for row in sizes:
        held += row["pairs"]
        if held > frequent:
            break
        least = 1 << row["power"]
    if least is None:
        known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    else:
        got = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()
        order = np.argsort(got["pair"].to_numpy())
        known = got["pair"].to_numpy()[order], got["n"].to_numpy()[order], got["best"].to_numpy(zero_copy_only=False)[order]
    sent = spark.sparkContext.broadcast(known)
    out = links.mapInArrow(lambda b: _look_up(b, kind, sent), f"row_no long, {columns.rsplit(', ', 2)[0]}, n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    final = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if held <= frequent:  # every pair was sent
        return out.select(*final)
    out = materialise(out)
    rare = counts.where(F.col("n") < least) if least is not None else counts
    rest = out.select("row_no", F.inline("rest")).join(rare, "pair").groupBy("row_no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = out.join(rest, "row_no", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*final)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
