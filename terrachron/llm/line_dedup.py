"""Fuzzy line deduplication.

Lines are normalised (lower case, no ASCII punctuation, single blanks). Equal normal lines are one
class. Classes whose edit similarity over words reaches 0.8 are linked, and one occurrence of each
connected group stays: the first by document, then line. No link is lost.

Candidates: an edit changes at most RUN_WORDS runs of RUN_WORDS neighbouring words, so of the runs of a line of m
words at most RUN_WORDS * d - (n - m) are missing in a line of n >= m words that is d edits apart. All runs have one order
(frequent in a part of the documents last, then long words first, then by hash), and a line has its first runs in it as
blocks, one more than can be missing: similar lines share a block, since the block of either that comes first and is
in the other line is a block there too. In lines too short for a common run of RUN_WORDS words, runs have fewer.

The classes of a block meet in a bucket of blocks with their numbers of words. A block is split where, in order of these, the
next class is too long to be similar to any before it; in each part the classes are written with two leaders, the least and the
greatest class. A line's signature has MAX_BITS bits, each the parity of the number of its words that hash there: a changed
word changes two bits at most, a word more or less one, so pairs that differ in more bits than that for the edits allowed are
not similar. What is left is verified by word edits.

Candidate pairs do not grow with the square of a group: classes are first compared with their leaders, and
after these links only classes of different groups that share a block are paired, once, at the least block they share, and of these
links components are made over whole groups. Only candidates' texts are fetched; documents without a dropped line are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hold_only, materialise, slices, table, whole_row
from .graph import connected_components, with_least
from .words import normal_lines, text_hashes

SIMILARITY = 0.8
RUN_WORDS = 3
#: The bits of a line's signature.
MAX_BITS = 256
SIGNS = ["s0", "s1", "s2", "s3"]
MIX = np.uint64(0xFF51AFD7ED558CCD)
SAMPLE_PARTS = 16
FREQUENT_RUNS = 1 << 16
COUNT_RUNS = 2_000_000
KNOWN_BITS = 20
BUCKET_BITS = 20
BLOCK_BUCKETS = 1 << 10
BATCH_BLOCKS = 1_000_000
FILTER_BITS = 22
TEXT_ROWS = 1000
BATCH_WORDS = 200_000
LONGEST = 31
SEEN_LINES = 200_000
LINES = "doc_id long, text_hash long, line int, a long, b long, n int, s0 long, s1 long, s2 long, s3 long"
#: Lines of more words count as this many where blocks are split by length.
MOST_WORDS = (1 << 15) - 1
BLOCKS = "bucket int, keys binary, names binary, sizes binary"
SHARED = "key long, a long, n int, x1 long, x2 long"


def most_edits(words: int, similarity: float) -> int:
    """The most edits that leave two lines, the longer of ``words`` words, similar enough."""
    return int((1 - similarity + 1e-12) * words + 1e-9)


def run_size(longer: int, similarity: float) -> int:
    """The words of a run for pairs whose longer line has ``longer`` words: the most with which such a pair shares a run."""
    edits = most_edits(longer, similarity)
    return next(q for q in range(RUN_WORDS, 0, -1) if q == 1 or longer - q + 1 - q * edits >= 1)


@lru_cache(1 << 16)
def chosen_runs(words: int, similarity: float) -> tuple[int, ...]:
    """How many runs of 1, 2 .. RUN_WORDS words a line of ``words`` words is found by: enough for partners of every length that can be similar."""
    counts = [0] * RUN_WORDS
    longer = words
    while words >= longer - most_edits(longer, similarity):
        if edits := most_edits(longer, similarity):  # none: equal lines only
            q = run_size(longer, similarity)
            counts[q - 1] = max(counts[q - 1], words - longer + q * edits + 1)
        longer += 1
    return tuple(counts)


def run_prints(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of each run of ``size`` words within a line, told apart by size."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    if size == 1:
        return first, hashes[first]
    prints = hashes[first]
    for i in range(1, size):
        prints = prints * MIX ^ hashes[first + i]
    return first, prints ^ np.uint64(0x9E3779B97F4A7C15 * size & (1 << 64) - 1)


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], list[bytes]]]:
    """(digests, numbers of words, normal texts) of some lines at a time; a line that came shortly before is left out."""
    digest = xxhash.xxh3_128_digest
    seen: set[bytes] = set()
    digests: list[bytes] = []
    sizes: list[int] = []
    texts: list[bytes] = []
    held = 0
    hold_only()
    for batch in slices(batches, TEXT_ROWS):
        for text in batch.column(0).to_pylist():
            for line in normal_lines(text):
                if line:
                    name = digest(line)
                    if name in seen:
                        continue
                    seen.add(name)
                    digests.append(name)
                    sizes.append(line.count(b" ") + 1)
                    texts.append(line)
                    held += sizes[-1]
            if held >= BATCH_WORDS:
                yield digests, sizes, texts
                digests, sizes, texts, held = [], [], [], 0
            if len(seen) > SEEN_LINES:
                seen.clear()
    if texts:
        yield digests, sizes, texts


def _run_counts(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(key, n) of the runs that come more than once among COUNT_RUNS or so."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["key", "n"])

    for _, sizes, texts in _line_words(batches):
        hashes, owner = text_hashes(b" ".join([*texts, b""])), np.repeat(np.arange(len(sizes)), sizes)
        needed = {q for n in set(sizes) for q, c in enumerate(chosen_runs(n, similarity), 1) if c}
        held += [run_prints(hashes, owner, q)[1] for q in sorted(needed)]
        if sum(map(len, held)) >= COUNT_RUNS:
            yield counted()
    if held:
        yield counted()


def frequent_runs(docs: DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent runs of one of SAMPLE_PARTS parts of the texts, by key, and their counts; it only sets the order of runs."""
    part = docs.where(F.pmod("text_hash", F.lit(SAMPLE_PARTS)) == 0).select("text")
    counts = part.mapInArrow(lambda b: _run_counts(b, similarity), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = counts.where("n > 3").orderBy(F.desc("n"), "key").limit(FREQUENT_RUNS).toArrow()
    keys, n = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def line_signs(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The signature of each line in four words of 64 bits: each bit is the parity of the number of words that hash there."""
    out = np.zeros((len(lens), 4), np.uint64)
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    words = hashes * MIX
    words ^= words >> np.uint64(32)
    words *= MIX
    part, bits = (words >> np.uint64(56) & np.uint64(3)).astype(np.uint8), np.uint64(1) << (words >> np.uint64(58))
    starts = (np.cumsum(lens) - lens)[full]
    for k in range(4):
        out[full, k] = np.bitwise_xor.reduceat(np.where(part == k, bits, np.uint64(0)), starts)
    return out


def run_blocks(sizes: list[int], text: bytes, hashes: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(line, block) of all blocks of lines of ``sizes`` words; ``text``: these words, each followed by a blank, ``hashes``: theirs. ``exact``: every run is a block."""
    known, counts = frequent
    ranks = np.minimum(4 * np.log2(np.maximum(counts, 1)), 63).astype(np.uint64)
    there = np.zeros(1 << KNOWN_BITS, bool)
    there[known >> np.uint64(64 - KNOWN_BITS)] = True
    lens = np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)
    ends = np.r_[-1, np.flatnonzero(np.frombuffer(text, np.uint8) == 32)]
    kinds, kind = np.unique(lens, return_inverse=True)
    wanted = np.array([chosen_runs(n, similarity) for n in kinds.tolist()], np.int64).reshape(-1, RUN_WORDS)[kind]
    lines, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for q in range(1, RUN_WORDS + 1):
        mine = np.flatnonzero((wanted[:, q - 1] > 0)[owner])
        at, prints = run_prints(hashes[mine], owner[mine], q)
        if not len(at):
            continue
        at = mine[at]
        line = owner[at]
        rank = np.zeros(len(line), np.uint64)
        if len(known):
            maybe = np.flatnonzero(there[prints >> np.uint64(64 - KNOWN_BITS)])
            near = np.minimum(np.searchsorted(known, prints[maybe]), len(known) - 1)
            rank[maybe] = np.where(known[near] == prints[maybe], ranks[near], 0)
        short = (LONGEST - np.minimum(ends[at + q] - ends[at] - q, LONGEST)).astype(np.uint64)
        place = rank << np.uint64(36) | short << np.uint64(31) | prints * MIX >> np.uint64(33)
        order = np.lexsort((place, line)) if len(lens) >> 22 else np.argsort(line.astype(np.uint64) << np.uint64(42) | place)
        line, prints, place = line[order], prints[order], place[order]
        if not exact:  # runs that tie with the last block are blocks
            many = np.bincount(line, minlength=len(lens))
            last = np.cumsum(many) - many + np.minimum(many, wanted[:, q - 1]) - 1
            keep = place <= place[last[line]]
            line, prints = line[keep], prints[keep]
        new = np.r_[True, (line[1:] != line[:-1]) | (prints[1:] != prints[:-1])]
        lines.append(line[new])
        blocks.append(prints[new])
    return np.concatenate(lines), np.concatenate(blocks)


def line_blocks(sizes: list[int], words: list[bytes], similarity: float, frequent: tuple[np.ndarray, np.ndarray], exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature of each line, how many blocks each has, all blocks in a row, the line of each) of lines of ``sizes`` words; ``words``: these words, or the normal texts of the lines, in order."""
    text = b" ".join([*words, b""])
    hashes = text_hashes(text)
    line, blocks = run_blocks(sizes, text, hashes, similarity, frequent, exact)
    order = np.argsort(line, kind="stable")
    return line_signs(hashes, np.array(sizes, np.int64)), np.bincount(line, minlength=len(sizes)), blocks[order], line[order]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that has words: where it is, a 128-bit hash of its normal form, the number of its words and its signature (null if it came shortly before)."""
    digest = xxhash.xxh3_128_digest
    seen: set[bytes] = set()
    hold_only()
    for batch in slices(batches, TEXT_ROWS):
        row: list[int] = []
        number: list[int] = []
        digests: list[bytes] = []
        new: list[int] = []
        normals: list[bytes] = []
        for k, text in enumerate(batch.column(2).to_pylist()):
            for i, line in enumerate(normal_lines(text)):
                if line:
                    name = digest(line)
                    if name not in seen:
                        seen.add(name)
                        new.append(len(row))
                        normals.append(line)
                    row.append(k)
                    number.append(i)
                    digests.append(name)
        lens = np.array([line.count(b" ") + 1 for line in normals], np.int64)
        each = np.zeros((5, len(row)), np.int64)
        each[0, new] = lens
        each[1:, new] = line_signs(text_hashes(b" ".join([*normals, b""])) if normals else np.zeros(0, np.uint64), lens).view(np.int64).T
        names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        rows, came = pa.array(np.array(row, np.int64)), each[0] == 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.array(number, np.int32)), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])),
                pa.array(each[0].astype(np.int32), mask=came), *(pa.array(x, mask=came) for x in each[1:]),
            ],
            ["doc_id", "text_hash", "line", "a", "b", "n", *SIGNS],
        )
        if len(seen) > SEEN_LINES:
            seen.clear()


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float, frequent: tuple[np.ndarray, np.ndarray], exact: bool) -> Iterator[pa.RecordBatch]:
    """For each bucket the blocks of some lines, the classes that have them and the numbers of their words."""
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    words: list[np.ndarray] = []

    def dealt() -> pa.RecordBatch:
        mixed, names, lens = np.concatenate(held), np.concatenate(owners), np.concatenate(words)
        for x in (held, owners, words):
            x.clear()
        bucket = (mixed & np.uint64(BLOCK_BUCKETS - 1)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=BLOCK_BUCKETS)
        full = np.flatnonzero(counts)
        offsets = np.r_[0, np.cumsum(counts[full])]
        packed = []
        for x in ((mixed >> np.uint64(32)).astype(np.uint32), names, lens):
            packed.append(pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])]))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *packed], ["bucket", "keys", "names", "sizes"])

    for digests, sizes, texts in _line_words(batches):
        text = b" ".join([*texts, b""])
        line, blocks = run_blocks(sizes, text, text_hashes(text), similarity, frequent, exact)
        mixed = blocks * MIX
        held.append(mixed ^ mixed >> np.uint64(29))
        owners.append(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[line, 0])
        words.append(np.minimum(sizes, MOST_WORDS).astype(np.int16)[line])
        if sum(map(len, held)) >= BATCH_BLOCKS:
            yield dealt()
    if held:
        yield dealt()


def _shared(rows: pa.Table, similarity: float) -> pa.Table:
    """(key, a, n, x1, x2) of the blocks of a bucket that several classes have: each class with the number of them, the least and the greatest; of two classes one row.

    A block's classes are taken by their numbers of words, and the block is split where the next one is too long to be similar to any before it."""
    keys, names, lens = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint32), ("names", np.int64), ("sizes", np.int16)))
    order = np.argsort(keys)
    keys, names, lens = keys[order], names[order], lens[order].astype(np.int64)
    same = keys[1:] == keys[:-1]
    some = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    keys, names, lens = keys[some], names[some], lens[some]
    order = np.lexsort((names, lens, keys))
    keys, names, lens = keys[order], names[order], lens[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])][: len(keys)])
    keys, names, lens = keys[new], names[new], lens[new]
    least = lens - np.floor((1 - similarity + 1e-12) * lens + 1e-9).astype(np.int64)
    block = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    part = block | np.r_[True, lens[:-1] < least[1:]][: len(keys)]
    first = np.flatnonzero(part)
    sizes = np.diff(np.r_[first, len(keys)])
    at = np.cumsum(part) - 1
    if len(first):
        n, x1, x2 = sizes[at], np.minimum.reduceat(names, first)[at], np.maximum.reduceat(names, first)[at]
        nth = at - np.maximum.accumulate(np.where(block, at, 0))
    else:
        n, x1, x2, nth = at, names, names, at
    keep = np.flatnonzero((n > 2) | (n == 2) & (names != x1))
    bucket = rows.column("bucket")[0].as_py()
    key = nth << 42 | np.int64(bucket) << np.int64(32) | keys.astype(np.int64)
    return pa.table([pa.array(key[keep]), pa.array(names[keep]), pa.array(n[keep].astype(np.int32)), pa.array(x1[keep]), pa.array(x2[keep])], names=["key", "a", "n", "x1", "x2"])


def _line_texts(batches: Iterator[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
    """(a, words) of the lines whose class passes the bitmap; of those that come again shortly, one."""
    there = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
    digest = xxhash.xxh3_128_digest
    seen: set[bytes] = set()
    hold_only()
    for batch in slices(batches, TEXT_ROWS):
        digests, lines = [], []
        for text in batch.column(0).to_pylist():
            for line in normal_lines(text):
                if line:
                    name = digest(line)
                    if name not in seen:
                        seen.add(name)
                        digests.append(name)
                        lines.append(line)
        names = np.ascontiguousarray(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[:, 0])
        hit = np.flatnonzero(there[names.view(np.uint64) >> np.uint64(64 - FILTER_BITS)])
        yield pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array([lines[k] for k in hit.tolist()], pa.binary())], ["a", "words"])
        if len(seen) > SEEN_LINES:
            seen.clear()


def word_edits(left: list[bytes], right: list[bytes]) -> int:
    """Edit distance over words, a bit-parallel column at a time; the lists may be of any length."""
    start = next((i for i, (x, y) in enumerate(zip(left, right, strict=False)) if x != y), min(len(left), len(right)))
    left, right = left[start:], right[start:]
    same = next((i for i, (x, y) in enumerate(zip(reversed(left), reversed(right), strict=False)) if x != y), min(len(left), len(right)))
    left, right = left[: len(left) - same], right[: len(right) - same]
    if not left or not right:
        return len(left) or len(right)
    places: dict[bytes, int] = {}
    for i, w in enumerate(left):
        places[w] = places.get(w, 0) | (1 << i)
    full, last = (1 << len(left)) - 1, 1 << (len(left) - 1)
    plus, minus, distance = full, 0, len(left)
    for w in right:
        match = places.get(w, 0)
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        distance += bool(up & last) - bool(down & last)
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
    return distance


def edit_similarity(left: list[bytes], right: list[bytes]) -> float:
    return 1 - word_edits(left, right) / max(len(left), len(right), 1)


def similar(left: list[bytes], right: list[bytes], similarity: float) -> bool:
    """Whether the edit similarity reaches ``similarity``; in lines of equal length words that differ in place are an upper bound of the edits."""
    if len(left) == len(right) and 1 - sum(map(ne, left, right)) / max(len(left), 1) >= similarity - 1e-12:
        return True
    return edit_similarity(left, right) >= similarity - 1e-12


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The rows whose last two columns, two lines, are similar, without these."""
    for batch in batches:
        keep = [similar(x.split(), y.split(), similarity) for x, y in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(list(range(batch.num_columns - 2)))


def _near(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with a bucket number of ``names``: a semi-join with at most 2**BUCKET_BITS of them leaves few rows to shuffle."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(1 << BUCKET_BITS)).cast("int"))


def _matches(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def line_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, words): the normal texts of the classes ``wanted`` (a, doc), distinct; ``doc``: the id of a document that has the class.

    Documents outside the buckets of these ids are not read into lines, and a bitmap of fixed size keeps most other
    lines where they are; a join with ``wanted`` drops the rest."""
    top = wanted.select(F.shiftrightunsigned("a", 64 - FILTER_BITS).alias("bit")).distinct()  # at most 2**FILTER_BITS rows
    there = np.zeros(1 << FILTER_BITS, np.uint8)
    there[top.toArrow()["bit"].to_numpy()] = 1
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(there).tobytes())
    buckets = F.broadcast(_near(wanted, ["doc"]).select("bucket").distinct())  # at most 2**BUCKET_BITS rows
    read = _near(docs, ["doc_id"]).join(buckets, "bucket", "left_semi").select("text")
    found = read.mapInArrow(lambda b: _line_texts(b, bitmap), "a long, words binary")
    return found.join(wanted, "a", "left_semi").dropDuplicates(["a"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (x, y, ..) whose lines are similar enough."""
    both = pairs.join(texts.select(F.col("a").alias("x"), F.col("words").alias("words_x")), "x").join(texts.select(F.col("a").alias("y"), F.col("words").alias("words_y")), "y")
    return both.select(*pairs.columns, "words_x", "words_y").mapInArrow(lambda b: _similar(b, similarity), pairs.schema)


def _may_match(one: str, other: str, similarity: float, exact: bool) -> F.Column:
    """Whether two lines can be similar, from their lengths and signatures."""
    of = lambda side, name: F.col(f"{side}.{name}")
    most = F.floor(F.greatest(of(one, "n"), of(other, "n")) * (1 - similarity + 1e-12) + 1e-9)
    bits = sum((F.bit_count(of(one, c).bitwiseXOR(of(other, c))) for c in SIGNS), F.abs(of(one, "n") - of(other, "n")))
    near = F.abs(of(one, "n") - of(other, "n")) <= most
    return near if exact else near & (bits <= 2 * most)


def shared_blocks(docs: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """(key, a, n, x1, x2) of the blocks of several classes, see ``_shared``."""
    frequent = frequent_runs(docs, similarity)
    blocks = docs.select("text").mapInArrow(lambda b: _blocks(b, similarity, frequent, exact), BLOCKS)
    return blocks.groupBy("bucket").applyInArrow(lambda rows: _shared(rows, similarity), SHARED)


def _ends(pairs: DataFrame) -> DataFrame:
    """The classes of pairs (x, y, dx, dy), each with a document that has it."""
    return pairs.select(F.inline(F.array(F.struct(F.col("x").alias("a"), F.col("dx").alias("doc")), F.struct(F.col("y").alias("a"), F.col("dy").alias("doc"))))).distinct()


def line_links(classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """(a, component) of the ``classes`` (a, doc, n, signature) that are linked to another one."""
    one, two = classes.alias("one"), classes.alias("two")
    may = _may_match("one", "two", similarity, exact)
    shared = materialise(shared_blocks(docs, similarity, exact))
    ties = shared.select("a", F.explode(F.array("x1", "x2")).alias("lead")).where("a <> lead")
    stars = ties.select(F.greatest("a", "lead").alias("x"), F.least("a", "lead").alias("y")).distinct()
    docs_of = F.col("one.doc").alias("dx"), F.col("two.doc").alias("dy")
    near = materialise(stars.join(one, F.col("x") == F.col("one.a")).join(two, (F.col("y") == F.col("two.a")) & may).select("x", "y", *docs_of))
    ends = materialise(_ends(near))
    texts = materialise(line_texts(ends, docs))
    groups = materialise(connected_components(verified(near.select("x", "y"), texts, similarity)).select(F.col("node").alias("a"), F.col("component").alias("c")))
    placed = materialise(shared.where("n > 2").select("key", "a").join(groups, "a", "left").select("key", "a", F.coalesce("c", "a").alias("c")))
    split = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key")
    apart = materialise(placed.join(split, "key", "left_semi").groupBy("a", "c").agg(F.collect_list("key").alias("keys")).join(classes, "a"))
    open_ = apart.select("*", F.explode("keys").alias("key"))
    least = F.array_min(F.array_intersect("one.keys", "two.keys")) == F.col("one.key")
    differ = (F.col("one.key") == F.col("two.key")) & (F.col("one.c") != F.col("two.c")) & (F.col("one.a") > F.col("two.a")) & may & least
    rest = open_.alias("one").join(open_.alias("two"), differ)
    rest = rest.select(F.col("one.a").alias("x"), F.col("two.a").alias("y"), F.col("one.c").alias("cx"), F.col("two.c").alias("cy"), *docs_of).distinct()
    rest = materialise(rest.join(near, ["x", "y"], "left_anti"))
    unread = materialise(_ends(rest).join(ends, "a", "left_anti"))
    texts = texts.unionByName(materialise(line_texts(unread, docs)))
    second = materialise(verified(rest.select("x", "y", "cx", "cy"), texts, similarity))
    merged = connected_components(second.select("cx", "cy"))
    sides = F.array(F.struct(F.col("x").alias("a"), F.col("cx").alias("c")), F.struct(F.col("y").alias("a"), F.col("cy").alias("c")))
    every = groups.unionByName(second.select(F.inline(sides))).distinct()
    return every.join(merged, every["c"] == merged["node"], "left").select("a", F.coalesce("component", "c").alias("component"))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """(doc_id, text_hash, dropped): the numbers of the lines that go, for each text that loses any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = materialise(docs.mapInArrow(_lines, LINES))
    classes = materialise(lines.groupBy("a", "b").agg(F.min("doc_id").alias("doc"), F.count("*").alias("times"), *(F.max(c).alias(c) for c in ("n", *SIGNS))))
    links = line_links(classes.select("a", "doc", "n", *SIGNS), docs, similarity, exact)
    linked = classes.join(links, "a", "left").where("times > 1 OR component IS NOT NULL")
    marked = linked.select("a", "b", F.coalesce("component", "a").alias("group"), F.when(F.col("component").isNull(), F.col("b")).otherwise(F.lit(0)).alias("alone"))
    place = F.struct("doc_id", "text_hash", "line").alias("place")
    found = materialise(lines.select("a", "b", place).join(marked, ["a", "b"]).select("group", "alone", "place"))
    drops = with_least(found, ["group", "alone"], "place", "keep").where("place <> keep").select("place.*")
    return drops.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def marked_lines(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """(row, n_lines, dropped): every row of ``docs`` as a struct, the number of its lines and the numbers of those that go (null: none).

    A line ends at a line feed. Lines without words (only white space or punctuation, or empty)
    stay where they are, as does a null or empty text. Of a connected group the occurrence
    with the smallest doc_id (null first), text hash and line number stays; rows that repeat an id
    and its text are one document and lose the same lines. Columns of any name may come with the
    documents. No rows give no rows. ``exact`` is for checks: every run is a block and no signature is asked, with the same result."""
    found = materialise(_near(repeated_lines(docs, similarity, exact), ["doc_id", "text_hash"]))
    text = F.coalesce("text", F.lit(""))
    lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines")
    full = _near(docs.select(whole_row(docs), lines, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")), ["doc_id", "text_hash"])
    buckets = F.broadcast(found.select("bucket").distinct())  # at most 2**BUCKET_BITS rows
    same = full.join(buckets, "bucket", "left_anti").select("row", "n_lines", F.lit(None).cast("array<int>").alias("dropped"))
    some = full.join(buckets, "bucket", "left_semi")
    some = some.join(found, _matches(some, found), "left").select("row", "n_lines", "dropped")
    return same.unionByName(some)


def kept_text(text, dropped):
    """``text`` without the lines whose numbers are in ``dropped`` (null: none)."""
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(dropped, i)), "\n")
    return F.when(dropped.isNull(), text).otherwise(left)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """``docs`` with its columns, ``text`` without the repeated lines; rows are treated as in ``marked_lines``. A document may be left with an empty text."""
    text = kept_text(F.col("row.text"), F.col("dropped"))
    return marked_lines(docs, similarity, exact).select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op1_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every document: its lines, the numbers of those that go, and the crc32 of the text that stays."""
    docs = marked_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.crc32(F.coalesce(kept_text(F.col("row.text"), F.col("dropped")), F.lit("")).cast("binary")).alias("kept_crc32")
    return docs.select("row.doc_id", F.col("n_lines").cast("long"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.col("dropped").alias("dropped_lines"), kept)
