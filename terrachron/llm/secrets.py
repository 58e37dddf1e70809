"""Secrets in texts and in what is encoded inside them: a worklist of decoded layers.

Every layer is scanned by the same patterns. URL and Unicode escapes of a layer are decoded all at once, which
gives one further layer; every base64 run, and everything compressed in one, gives a layer of its own. Layers wait
in a list until no new one appears; a layer that was seen at the same place is not taken up again, so data that
decode to themselves end. Every character of a layer knows which code points of the text it came from, and a match
is reported at those.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Runs of at least so many characters: the leftmost match of the open run, kept where it is long enough.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
ASSIGN_VALUE = 8
#: Escapes that are decoded together: bytes as %XX or \xXX, code points as \uXXXX, \UXXXXXXXX, \u{X} or numeric character references.
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: An escaped escape sign, escaped again any number of times, and the sign that all of them become.
CHAINS = ((re.compile("%(?:25)+(?=[0-9A-Fa-f]{2})"), "%"), (re.compile(r"\\(?:u005[cC])+(?=u[0-9A-Fa-f]{4})"), "\\"), (re.compile("&(?:#38;|#[xX]26;)+(?=#)"), "&"))
#: Base64 over lines of 60 characters or more and a last one, or in one run in either alphabet.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_CHARS = 16
WINDOW, OVERLAP = 1 << 22, 1 << 20
PIECE = 1 << 16
#: How many layers may be compressed one inside the other; data that expand without end stop there.
NESTED = 64


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the matches of a text, leftmost and without overlap for each kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_VALUE:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


class Layer:
    """A decoded text; ``lo`` and ``hi`` are the origin's code points at which each of its characters begins and ends, or one number each for all."""

    def __init__(self, text: str, lo, hi, nested: int = 0):
        self.text, self.lo, self.hi, self.nested = text, lo, hi, nested

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[start]), int(self.hi[end - 1])

    def part(self, start: int, end: int) -> tuple:
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return self.lo[start:end], self.hi[start:end]


def _decoded(match: str) -> list[tuple[str, int, int]] | None:
    """(text, start, end) of the characters that a run of escapes stands for; None where it stands for no text."""
    try:
        if match[0] in "%\\" and match[1] not in "uU":
            step = 3 if match[0] == "%" else 4
            return _characters(bytes.fromhex(match.replace("%", "").replace("\\x", "")), step)
        if match.startswith("&"):
            digits = match[2:-1]
            return [(_character(int(digits[1:], 16) if digits[0] in "xX" else int(digits)), 0, len(match))]
        if match.startswith("\\U") or match.startswith("\\u{"):
            return [(_character(int(match[2:].strip("{}"), 16)), 0, len(match))]
        units = [int(match[i + 2 : i + 6], 16) for i in range(0, len(match), 6)]
        out, k = [], 0
        while k < len(units):
            pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
            code = 0x10000 + (units[k] - 0xD800 << 10) + units[k + 1] - 0xDC00 if pair else units[k]
            out.append((_character(code), 6 * k, 6 * (k + 1 + pair)))
            k += 1 + pair
        return out
    except (ValueError, OverflowError):
        return None


def _character(code: int) -> str:
    """The character of a code point; half of a surrogate pair is a replacement character."""
    return "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)


def _characters(data: bytes, step: int) -> list[tuple[str, int, int]]:
    """The characters of UTF-8 ``data``, each of whose bytes takes ``step`` characters; a byte that is none of them is a replacement character."""
    text = data.decode("utf-8", "surrogateescape")
    out, at = [], 0
    for c in text:
        n = 1 if 0xDC80 <= ord(c) < 0xDD00 else len(c.encode("utf-8"))
        out.append((c if n > 1 or ord(c) < 0x80 else "\ufffd", at * step, (at + n) * step))
        at += n
    return out


def _substituted(layer: Layer, found: list[tuple[int, int, list]]) -> Layer | None:
    """``layer`` with the stretches (start, end, characters) replaced; None where there are none."""
    if not found:
        return None
    texts, lows, highs, at = [], [], [], 0
    for start, end, chars in [*found, (len(layer.text), len(layer.text), [])]:
        lo, hi = layer.part(at, start)
        texts.append(layer.text[at:start])
        lows.append(lo)
        highs.append(hi)
        for c, a, b in chars:
            lo, hi = layer.span(start + a, start + b)
            texts.append(c)
            lows.append([lo])
            highs.append([hi])
        at = end
    text = "".join(texts)
    if isinstance(layer.lo, int):
        return Layer(text, layer.lo, layer.hi, layer.nested)
    return Layer(text, np.concatenate(lows).astype(np.int64), np.concatenate(highs).astype(np.int64), layer.nested)


def unescaped(layer: Layer) -> Layer | None:
    """The next layer by URL and Unicode escapes; escapes that were escaped several times are brought down to one first."""
    for pattern, sign in CHAINS:
        shorter = _substituted(layer, [(m.start(), m.end(), [(sign, 0, m.end() - m.start())]) for m in pattern.finditer(layer.text)])
        layer = shorter or layer
    found = [(m.start(), m.end(), chars) for m in ESCAPE.finditer(layer.text) if (chars := _decoded(m.group()))]
    return _substituted(layer, found)


def escaped_bytes(layer: Layer) -> Iterator[tuple[bytes, int, int]]:
    """(data, start, end) of runs of byte escapes that are compressed data."""
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2}){8,}|(?:\\x[0-9A-Fa-f]{2}){8,}", layer.text):
        data = bytes.fromhex(m.group().replace("%", "").replace("\\x", ""))
        if opened(data):
            yield data, m.start(), m.end()


def based(layer: Layer) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(data, offset, places) of base64 runs in each of the four alignments: the data where they are text or compressed,
    else the legible stretches of them, which begin ``offset`` bytes after the run; ``places`` are those of its letters."""
    for m in BASE64.finditer(layer.text):
        codes = np.frombuffer(m.group().rstrip("=").encode("ascii"), np.uint8)
        places = np.flatnonzero((codes != 10) & (codes != 13))
        letters = codes[places].tobytes().replace(b"-", b"+").replace(b"_", b"/")
        for skip in range(4):
            piece = letters[skip:]
            if len(piece) < BASE64_CHARS:
                break
            piece = piece[: len(piece) - (len(piece) % 4 == 1)]
            at = m.start() + places[skip : skip + len(piece)]
            data = base64.b64decode(piece + b"=" * (-len(piece) % 4))
            if opened(data) or readable(data):
                yield data, 0, at
                break
            if (packed := data.find(b"\x1f\x8b\x08")) >= 0 and opened(data[packed:]):
                yield data[packed:], packed, at
            for x in LEGIBLE.finditer(data):
                yield x.group(), x.start(), at


def readable(data: bytes) -> str | None:
    """``data`` as text, if it is UTF-8 or UTF-16 without control characters; else None."""
    wide = len(data) > 3 and len(data) % 2 == 0 and not any(data[1:64:2])
    try:
        text = data.decode("utf-16-le" if wide else "utf-8")
    except UnicodeDecodeError:
        return None
    return None if CONTROL.search(text) else text


LEGIBLE = re.compile(rb"[\t\n\r -~]{12,}")
CONTROL = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]")


def _zstd():
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


#: First bytes of compressed data, and what unpacks them (fixed values of the formats).
FORMATS = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78\x01", zlib.decompressobj), (b"\x78\x5e", zlib.decompressobj), (b"\x78\x9c", zlib.decompressobj), (b"\x78\xda", zlib.decompressobj),
    (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor), (b"\x28\xb5\x2f\xfd", _zstd),
)


def opened(data: bytes):
    """A new unpacker where ``data`` begins as one of FORMATS and its first bytes can be unpacked; else None."""
    for magic, make in FORMATS:
        if data.startswith(magic):
            try:
                make().decompress(data[:PIECE])
                return make()
            except Exception:  # every unpacker has errors of its own
                return None
    return None


def unpacked(data: bytes) -> Iterator[bytes]:
    """What ``data`` holds, as far as it can be unpacked, in windows that overlap."""
    unpacker, held, first = opened(data), b"", True
    if unpacker is None:
        return
    for at in range(0, len(data), 1024):  # bounds what one step can give
        try:
            held += unpacker.decompress(data[at : at + 1024])
        except Exception:  # cut off or damaged: what came before it stays
            break
        while len(held) > WINDOW:
            yield held[:WINDOW]
            held, first = held[WINDOW - OVERLAP :], False
        if getattr(unpacker, "eof", False):
            break
    if first or len(held) > OVERLAP:
        yield held


def find_secrets(text: str | None) -> tuple[list, list, int]:
    """(spans of the text itself, spans of all layers, layers read beyond the text), each span as (start, kind number, end), sorted and distinct."""
    text = text or ""
    base = sorted((s, KINDS.index(k), e) for k, s, e in scan(text))
    found, read = set(base), 0
    if not (ESCAPE.search(text) or BASE64.search(text)):
        return base, base, 0
    seen: set = set()
    work = [iter([Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = hashlib.blake2b(layer.text.encode("utf-8"), digest_size=16).digest(), layer.span(0, len(layer.text))
        if key in seen:
            continue
        if seen:
            read += 1
            for kind, start, end in scan(layer.text):
                lo, hi = layer.span(start, end)
                found.add((lo, KINDS.index(kind), hi))
        seen.add(key)
        work.append(inside(layer, seen))
    return base, sorted(found), read


def inside(layer: Layer, seen: set) -> Iterator[Layer]:
    """The layers that ``layer`` encodes, one at a time."""
    if (further := unescaped(layer)) is not None:
        yield further
    for data, start, end in escaped_bytes(layer):
        yield from _unpacked_layers(data, *layer.span(start, end), layer.nested, seen)
    for data, offset, at in based(layer):
        if opened(data):
            yield from _unpacked_layers(data, *layer.span(int(at[0]), int(at[-1]) + 1), layer.nested, seen)
            continue
        text = readable(data)
        if not text or isinstance(layer.lo, int):
            yield Layer(text or "", layer.lo, layer.hi, layer.nested)
            continue
        wide = len(text.encode("utf-8")) != len(data)
        sizes = np.ones(len(text), np.int64) if text.isascii() and not wide else np.fromiter((len(c.encode("utf-16-le" if wide else "utf-8")) for c in text), np.int64, len(text))
        ends = offset + np.cumsum(sizes)
        first, last = ends - sizes, ends - 1
        yield Layer(text, layer.lo[at[first // 3 * 4 + first % 3]], layer.hi[at[last // 3 * 4 + last % 3 + 1]], layer.nested)


def _unpacked_layers(data: bytes, lo: int, hi: int, nested: int, seen: set) -> Iterator[Layer]:
    """What was compressed comes from the whole run; data that were unpacked there before are not again. Binary data are read byte by byte, as their texts are still legible."""
    if opened(data):
        key = hashlib.blake2b(data, digest_size=16).digest(), (lo, hi)
        if key not in seen and nested < NESTED:
            seen.add(key)
            for window in unpacked(data):
                yield from _unpacked_layers(window, lo, hi, nested + 1, seen)
        return
    try:
        yield Layer(data.decode("utf-8"), lo, hi, nested)
    except UnicodeDecodeError:
        yield Layer(data.decode("latin-1"), lo, hi, nested)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(c.split()[0] for c in SCANNED.split(", "))]
    for batch in batches:
        counts, digests, spans, layers = [], [], [], []
        for text in batch.column(1).to_pylist():
            base, found, read = find_secrets(text)
            counts.append([sum(k == n for _, k, _ in base) for n in range(3)])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(found))
            layers.append(read)
        numbers = [pa.array([c[n] for c in counts], pa.int64()) for n in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(layers, pa.int64())], names)


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers), a row for each row of ``docs``.

    The counts and the digest are of the spans of the text itself; ``spans`` has those of its decoded layers too, as
    code points of the text, equal ones once; ``n_layers`` is how many layers were read beyond the text. A null text
    is empty: no spans, '' and the digest of ''. Null and repeated ids and repeated rows are kept as they are, other
    columns are ignored, no rows give no rows. Texts of any length are scanned whole; what is compressed is read in
    windows of WINDOW bytes that overlap by OVERLAP, so memory stays bounded, and NESTED layers deep at most."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scan_batches, f"doc_id {kind}, {SCANNED}")


def op12_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
