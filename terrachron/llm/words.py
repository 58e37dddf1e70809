"""Normalised words and their hashes, kept in a bounded cache."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import hold_only

#: ASCII punctuation, removed from words (fixed values).
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Other ASCII white space as blanks; line feeds stay.
BLANKS = bytes.maketrans(b"\t\r\x0b\x0c", b"    ")
CACHE_WORDS = 250_000
SLAB = 1 << 17
BASE = 0x9E3779B97F4A7C15
#: A number for each byte; blanks and line feeds, which end words, count for nothing.
BYTES = np.array([0 if b in b" \n" else xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def normal(text: str | None) -> bytes:
    """Lower case, without ASCII punctuation, as UTF-8; white space stays."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION)


def normal_lines(text: str | None) -> list[bytes]:
    """The lines of ``text`` in normal form, their words divided by single blanks; a line without words is empty."""
    lines = (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANKS, PUNCTUATION).split(b"\n")
    return [b" ".join(line.split()) if b"  " in line else line.strip(b" ") for line in lines]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def release(self) -> None:
        self.clear()


_CACHE = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    hold_only(_CACHE)
    out = np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))
    if len(_CACHE) > CACHE_WORDS:
        _CACHE.clear()
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE, SLAB), _powers(pow(BASE, -1, 1 << 64), SLAB)


def text_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, whose words are each followed by one blank or line feed.

    It is a polynomial in BASE over the numbers of a word's bytes, modulo 2**64, and then mixed. Slabs of whole
    words are worked out at a time, so memory beside the text is bounded by the longest word."""
    data = np.frombuffer(text, np.uint8)
    parts = [np.zeros(0, np.uint64)]
    at = 0
    while at < len(data):
        slab = data[at : at + SLAB]
        ends = np.flatnonzero((slab == 32) | (slab == 10))
        if not len(ends):  # a word beyond one slab
            stops = [k for k in (text.find(b" ", at), text.find(b"\n", at)) if k >= 0]
            slab = data[at : min(stops) + 1]
            ends = np.array([len(slab) - 1])
        size = int(ends[-1]) + 1
        up, down = (_UP, _DOWN) if size <= SLAB else (_powers(BASE, size), np.ones(1, np.uint64))
        starts = np.r_[0, ends[:-1] + 1]
        parts.append(np.add.reduceat(BYTES[slab[:size]] * up[:size], starts) * down[starts])
        at += size
    out = np.concatenate(parts)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ out >> np.uint64(32)
