"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

The pieces of a text are merged with a heap of adjacent pairs keyed by merge rank over a doubly
linked list of symbols. A piece's count is its bytes minus its merges. Counts of distinct pieces
are kept in a bounded cache in each worker; the text column never leaves its partition.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_only, table
from .pieces import BATCH_CHARS, CHUNK, PieceStore

TOKEN_LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        number: dict[str, int] = {c: i for i, c in enumerate(letters)}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = number.setdefault(a + b, len(number))
            self.merged[number[a], number[b]] = (rank, whole)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.store = PieceStore(lambda pieces: (np.fromiter(map(self.chunk_tokens, pieces), np.int64, len(pieces)), np.ones(len(pieces), np.int64)), np.int64)

    def piece_tokens(self, piece: bytes) -> int:
        """Symbols left when no adjacent pair has a rank: lowest rank first, then leftmost."""
        n = len(piece)
        if n < 2:
            return n
        symbol: list = list(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        merged = self.merged
        heap = []
        for i in range(n - 1):
            if got := merged.get((symbol[i], symbol[i + 1])):
                heap.append((got[0], i, got[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if symbol[i] is None or j < 0 or (got := merged.get((symbol[i], symbol[j]))) is None or got[1] != whole:
                continue  # the pair has changed since it was pushed
            symbol[i], symbol[j] = whole, None
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if got := merged.get((whole, symbol[k])):
                    heapq.heappush(heap, (got[0], i, got[1]))
            if (h := before[i]) >= 0 and (got := merged.get((symbol[h], whole))):
                heapq.heappush(heap, (got[0], h, got[1]))
        return n - merges

    def chunk_tokens(self, chunk: str) -> int:
        return sum(self.piece_tokens(p.encode("utf-8")) for p in self.split.findall(chunk))

    def counts(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        hold_only(self.store)
        at = 0
        while at < len(texts):
            end, chars, chunks, owner = at, 0, [], []
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
                text = texts[end] or ""
                chars += len(text)
                parts = [text]
                if any(s in text for s in self.special):
                    parts = self.specials.split(text)
                    out[end] += len(parts) - 1
                for part in parts:
                    found = CHUNK.findall(part)
                    chunks += found
                    owner.append((end, len(found)))
                end += 1
            if chunks:
                each = self.store.gather(self.store.codes(chunks))[0]
                who = np.repeat([o for o, _ in owner], [n for _, n in owner])
                out[at:end] += np.bincount(who - at, each, end - at).astype(np.int64)
            self.store.trim()
            at = end
        return out


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids and repeated rows are
    kept as they are; other columns are ignored; no rows give no rows. Texts of any length are
    counted whole. Special strings inside a text are one token each."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series(counter(path).counts([t if isinstance(t, str) else None for t in text]))

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
