"""Encoding whole texts piece by piece, with a bounded cache of pieces already encoded.

A text is cut only where the tokenizer's own splitting always cuts, so that the ids of the text are
the ids of its pieces in order. Each distinct piece is encoded by the tokenizers library once and
kept in flat arrays; the ids of a batch of texts are then one vectorised gather. New pieces are encoded
many in one string, whose ids are dealt out again by the number of bytes that each id stands for.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

from .common import hold_only

#: White space as Unicode defines it (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with at most one blank before it, or white space as the pattern of byte-level BPE takes it.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Letters of Latin blocks that stay letters when small, and ASCII punctuation.
NEAR_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
MARKS = "!-/:-@\\[-`{-~"
#: Chunks whose leading letters are a piece of their own where white space, a mark or nothing follows: both tokenizers end a run of letters there.
FINE_CHUNK = re.compile(f" ?[{NEAR_LETTERS}]+(?![^{WHITE}{MARKS}])|{CHUNK.pattern}")
FINE_WORD = re.compile(f"[{NEAR_LETTERS}]+(?![^ {MARKS}])|[^ ]+")
#: Letters outside Latin blocks, and the one Latin capital whose small form is two letters.
FAR_LETTERS = re.compile("[^\\x00-\u012f\u0131-\u024f]")
CACHE_PIECES = 450_000
BATCH_CHARS = 2_000_000
#: Texts are cut into pieces and encoded this many characters at a time: what a batch takes beside the store is over ten times its text.
ENCODE_CHARS = 250_000
ENCODE_PIECES = 250_000
JOINED_PIECES = 64
PIECE_CHARS = 32


class _Index(dict):
    """Piece to number; an unknown piece gets the next number and waits in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list = []

    def __missing__(self, piece):
        number = self[piece] = len(self)
        self.pending.append(piece)
        return number


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The values of ``flat`` from each start on, as many as ``lens`` says, in a row."""
    ends = np.cumsum(lens)
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(len(at))
    return flat[at]


class PieceStore:
    """Numbers pieces and keeps an array of values for each; ``values_of`` gives all values of some pieces in a row, and how many each has.

    Once it holds ``limit`` pieces, or ``PIECE_CHARS`` times as many characters, it keeps those that came most often, up to
    half of either bound, with half their counts, and lets go of the others: most pieces of a text come once."""

    def __init__(self, values_of: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype, limit: int = CACHE_PIECES):
        self.values_of, self.dtype, self.limit = values_of, dtype, limit
        self.release()

    def release(self) -> None:
        self.index = _Index()
        self.chars = 0
        self.flat = np.empty(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.times = np.zeros(1 << 14, np.int64)
        self.used = 0

    def codes(self, pieces: list) -> np.ndarray:
        out = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        pending = self.index.pending
        if pending:
            self.index.pending = []
            self.chars += sum(map(len, pending))
            self._append(len(self.index) - len(pending), *self.values_of(pending))
        np.add.at(self.times, out, 1)
        return out

    def _append(self, first: int, values: np.ndarray, lens: np.ndarray) -> None:
        """Values of the pieces from number ``first`` on."""
        total, end = self.used + len(values), first + len(lens)
        while end > len(self.lens):
            self.lens, self.starts, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.starts, self.times))
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.lens[first:end] = lens
        self.starts[first:end] = self.used + np.cumsum(lens) - lens
        self.times[first:end] = 0
        self.flat[self.used : total] = values
        self.used = total

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of ``codes`` in a row, and how many each has."""
        lens = self.lens[codes]
        return _gather(self.flat, self.starts[codes], lens), lens

    def trim(self) -> None:
        if len(self.index) <= self.limit and self.chars <= self.limit * PIECE_CHARS:
            return
        pieces, times = list(self.index), self.times
        often = np.argsort(-times[: len(pieces)], kind="stable")[: self.limit // 2]
        sizes = np.fromiter((len(pieces[k]) for k in often.tolist()), np.int64, len(often))
        often = np.sort(often[np.cumsum(sizes) <= self.limit * PIECE_CHARS // 2])
        values, lens = self.gather(often)
        self.release()
        for k in often.tolist():
            self.index[pieces[k]] = len(self.index)
            self.chars += len(pieces[k])
        self._append(0, values, lens)
        self.times[: len(often)] = times[often] >> 1


class TextEncoder:
    """Ids of whole texts under a tokenizers file; no special tokens are added, their strings count as the library's default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_white = "Removed" in str(self.tokenizer.pre_tokenizer)
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.store = PieceStore(self._encode, np.uint32, ENCODE_PIECES)
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[number] = len(token.removesuffix("</w>"))  # byte-level tokens have a letter for each byte

    def release(self) -> None:
        """Let go of the pieces, and of the tokenizer unless it is in use; ``encoder`` loads it again."""
        self.store.release()
        for path in [p for p, e in _ENCODERS.items() if e is self]:
            del _ENCODERS[path]

    def _encode(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        joins = [k for k, p in enumerate(pieces) if self._may_join(p)]
        if len(joins) < 2:
            return self._encode_each(pieces)
        alone = sorted(set(range(len(pieces))).difference(joins))
        ids, lens = self._encode_joined([pieces[k] for k in joins])
        if not alone:
            return ids, lens
        more_ids, more_lens = self._encode_each([pieces[k] for k in alone])
        order = np.argsort(np.array(joins + alone))
        lens = np.concatenate([lens, more_lens])
        starts = np.cumsum(lens) - lens
        return _gather(np.concatenate([ids, more_ids]), starts[order], lens[order]), lens[order]

    def _encode_each(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _may_join(self, piece: str) -> bool:
        """Whether the piece is cut from others before and after it, and keeps its bytes in the tokenizer."""
        if "<" in piece or not piece.isprintable():
            return False
        return piece != "" and not FAR_LETTERS.search(piece) if self.drops_white else piece[:1] == " " and piece[1:2] not in ("", " ")

    def _encode_joined(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        between = " " if self.drops_white else ""
        texts = [between.join(pieces[k : k + JOINED_PIECES]) for k in range(0, len(pieces), JOINED_PIECES)]
        ids, _ = self._encode_each(texts)
        ends = np.cumsum(np.fromiter((len(p) if p.isascii() else len((p.lower() if self.lowers else p).encode()) for p in pieces), np.int64, len(pieces)))
        token_ends = np.cumsum(self.id_bytes[ids])
        upto = np.searchsorted(token_ends, ends, side="right")
        if len(ids) == upto[-1] and (token_ends[np.maximum(upto - 1, 0)] == ends).all():
            return ids, np.diff(upto, prepend=0)
        if len(pieces) <= JOINED_PIECES:  # some piece changes its bytes
            return self._encode_each(pieces)
        half = len(pieces) // 2
        parts = self._encode_joined(pieces[:half]), self._encode_joined(pieces[half:])
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _pieces(self, text: str) -> list:
        if self.drops_white:  # white space only separates; a special string has none
            if any(s in text for s in self.special):
                return text.replace("\n", " ").split(" ")
            if self.lowers and "<" not in text and not FAR_LETTERS.search(text):
                text = text.lower()  # fewer distinct pieces; the tokenizer does the same to these letters
            return FINE_WORD.findall(text.replace("\n", " "))
        if any(s in text for s in self.special):  # such a string ends the run of white space before it: leave the text whole
            return [text]
        return FINE_CHUNK.findall(text)

    def encode(self, texts: list) -> Iterator[np.ndarray]:
        """An array of ids for each text; None counts as empty. An array holds the ids of its neighbours too: copy what is to stay."""
        hold_only(self)
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= ENCODE_CHARS):
                chars += len(texts[end] or "")
                end += 1
            pieces: list = []
            bounds = [0]
            for text in texts[at:end]:
                if text:
                    pieces += self._pieces(text)
                bounds.append(len(pieces))
            ids, lens = self.store.gather(self.store.codes(pieces))
            ends = np.concatenate([[0], np.cumsum(lens)])[bounds]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield ids[a:b]
            self.store.trim()
            at = end


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
