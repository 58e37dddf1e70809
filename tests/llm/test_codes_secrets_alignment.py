"""Vector codes, secret scans and tokenizer alignment against plain versions, and on odd tables."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter
from math import floor

import pytest

pytest.importorskip("terrachron.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
import zstandard  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from terrachron.llm import align, codebooks, secrets  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label int, code string, sums long"


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label) by the letter, in lists of Python integers."""
    kept = [(i, [floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept)[:entries]
    books = [[v[p * width : p * width + width] for _, v, _ in first] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, w, strict=True)), e) for e, w in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                x = v[p * width : p * width + width]
                held.setdefault(assign(p, x)[1], []).append(x)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else w for e, w in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [assign(p, v[p * width : p * width + width]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    by = Counter()
    for _, _, error, label in out:
        by[label] += error
    sha = hashlib.sha256(",".join(str(x) for book in books for w in book for x in w).encode()).hexdigest()
    return sorted((i, code, error, by[label], sha) for i, code, error, label in out)


@pytest.mark.parametrize("most", [100, 0])
def test_vector_codes_against_plain_version(spark, most):
    r = random.Random(4)
    rows = [(i, [r.choice([-2, -1, 0, 1, 2, 3]) / 256 + r.choice([0, 0.001]) for _ in range(8)], r.choice([None, 1, 2])) for i in r.sample(range(-50, 900), 300)]
    rows += [(2000 + i, [r.gauss(0, 900) for _ in range(8)], 5) for i in range(40)]  # values far apart: dictionaries by sorting
    rows += [(3000, None, 1), (3001, [], 1), (3002, [None] * 8, 1), (3003, [float("nan")] * 8, 1), (3004, [1.0] * 7 + [float("inf")], 1), (7000, rows[0][1], None), (7000, rows[0][1], None)]
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], VECTORS).repartition(7)
    got = sorted(tuple(x) for x in codebooks.vector_codes(df, 4, 16, 2, most=most).collect())
    assert got == plain_codes(rows, 4, 16, 2)


def test_vector_codes_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codebooks.vector_codes(none).count() == 0
    assert codebooks.vector_codes(spark.createDataFrame([(1, None, 1, "", 0)], VECTORS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    few = [(None, [0.5] * 16, None), (None, [0.25] * 16, None)]
    got = codebooks.vector_codes(spark.createDataFrame([(*row, "", 0) for row in few], VECTORS)).collect()
    assert sorted(x.code for x in got) == ["00" * 16, "01" * 16] and {x.error for x in got} == {0}
    with pytest.raises(ValueError):
        codebooks.vector_codes(spark.createDataFrame([(1, [0.5] * 15, 1, "", 0)], VECTORS)).count()


def plain_spans(text):
    """The spans of the text itself, by the open patterns, short matches dropped."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m.group(2)) >= 8 else []
    for n, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)), 1):
        out += [(m.start(), n, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return sorted(out)


def test_secrets_of_the_text_itself():
    r = random.Random(8)
    bits = ["password", "PASSWD", "Secret", "toKen", "api_key", "APIKEY", "ſecret", "toKen", " = ", ":", "=", "'", '"', " ", "abcdefgh", "x1", "a1b2c3d4" * 4, "AKIA", "AKIAABCDEFGHIJKL", "ABCDEFGHIJKL", "\n", "é", "f" * 31, "0"]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        base, found, _ = secrets.find_secrets(text)
        assert base == plain_spans(text) and set(base) <= set(found)


SECRET = 'password = "hunter2hunter2"'
CODED = {
    "percent": urllib.parse.quote(SECRET, safe=""),
    "percent twice": urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
    "all percent, three times": "".join(f"%2525{b:02X}" for b in SECRET.encode()),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "references": "".join(f"&#{ord(c)};" for c in SECRET),
    "bytes": "".join(f"\\x{b:02x}" for b in SECRET.encode()),
    "base64": base64.b64encode(SECRET.encode()).decode(),
    "base64 twice": base64.b64encode(base64.b64encode(SECRET.encode())).decode(),
    "base64 without padding": base64.b64encode(SECRET.encode()).decode().rstrip("="),
    "base64 behind a path": "path/" + base64.b64encode(("abc " + SECRET + " def").encode()).decode(),
    "base64 for urls": base64.urlsafe_b64encode(("??>>~~" + SECRET).encode()).decode(),
    "base64 in lines": base64.encodebytes(("a line of text\n" * 10 + SECRET).encode()).decode(),
    "base64 of utf-16": base64.b64encode(SECRET.encode("utf-16-le")).decode(),
    "gzip": base64.b64encode(gzip.compress(SECRET.encode())).decode(),
    "zlib": base64.b64encode(zlib.compress(SECRET.encode())).decode(),
    "bzip2": base64.b64encode(bz2.compress(SECRET.encode())).decode(),
    "xz": base64.b64encode(lzma.compress(SECRET.encode())).decode(),
    "zstd": base64.b64encode(zstandard.ZstdCompressor().compress(SECRET.encode())).decode(),
    "gzip of gzip": base64.b64encode(gzip.compress(gzip.compress(SECRET.encode()))).decode(),
    "five layers": urllib.parse.quote(base64.b64encode(gzip.compress("".join(f"\\u{ord(c):04x}" for c in urllib.parse.quote(SECRET)).encode())).decode(), safe=""),
    "percent-coded gzip": "".join(f"%{b:02x}" for b in gzip.compress(SECRET.encode())),
    "mixed": "\\u0070%61%73%73word%3D&#97;&#98;&#99;defghij",
}


@pytest.mark.parametrize("name", CODED)
def test_coded_secrets_are_found_in_their_place(name):
    before = "Sèche 😀 text. "
    text = f"{before}{CODED[name]} and the rest"
    base, found, layers = secrets.find_secrets(text)
    new = [s for s in found if s not in base and s[1] == 0]
    assert new and layers and not [s for s in base if s[1] == 0]
    assert all(len(before) <= s and e <= len(before) + len(CODED[name]) for s, _, e in new)


def test_spans_of_coded_secrets():
    for head, code, tail in (("é ", SECRET.replace("=", "%3D"), " é"), ("", "password=abc\\u0064efghij", "!"), ("x ", "&#112;assword=abcdefgh", " y")):
        _, found, _ = secrets.find_secrets(head + code + tail)
        assert found == [(len(head), 0, len(head + code) - (code[-1] == '"'))]
    blob = base64.b64encode(b"0123456789 token=abcdefghi 01234").decode()
    _, found, _ = secrets.find_secrets(blob)
    assert [(s, e) for s, k, e in found if k == 0] == [(11 // 3 * 4 + 11 % 3, 25 // 3 * 4 + 25 % 3 + 2)]


def test_layers_end():
    began = time.time()
    assert secrets.find_secrets("%25" * 30000 + "41")[2] == 1
    assert secrets.find_secrets("%5Cu0025" * 500 + "41")[2] > 1
    assert secrets.find_secrets("\\u005c" * 3000 + "u0041")[1] == []
    data = gzip.compress(b"\x1f\x8b\x08 not a stream")
    assert secrets.find_secrets(base64.b64encode(data).decode())[2] == 1
    bomb = base64.b64encode(zlib.compress(b"a b " * (12 << 20) + SECRET.encode())).decode()
    assert [(k, s, e) for s, k, e in secrets.find_secrets(bomb)[1]] == [(0, 0, len(bomb.rstrip("=")))]
    cut = base64.b64encode(gzip.compress((SECRET + " " + "".join(map(str, range(4000)))).encode())[:-40]).decode()
    assert any(k == 0 for _, k, _ in secrets.find_secrets(cut)[1])
    assert time.time() - began < 60


def test_data_that_unpack_to_themselves_end(monkeypatch):
    data = gzip.compress(b"anything")
    calls = []
    monkeypatch.setattr(secrets, "unpacked", lambda data: calls.append(1) or iter([data]))
    assert secrets.find_secrets(base64.b64encode(data).decode())[2] == 0 and len(calls) == 1


def test_scan_documents(spark):
    rows = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, CODED["gzip"]), (5, "x " * 200_000 + CODED["percent"])]
    df = spark.createDataFrame([(*row, "n", 1) for row in rows], "doc_id long, text string, spans string, n_hex long")
    got = sorted((tuple(x) for x in secrets.scan_documents(df).collect()), key=str)
    assert [(x[0], x[1]) for x in got] == [(1, 0), (2, 0), (3, 1), (3, 1), (5, 0), (None, 0)]
    assert got[0][4] == hashlib.sha256(b"").hexdigest() and got[0][5] == ""
    assert got[2][5] == f"assign:0:{len(SECRET) - 1}" and got[2][4] == hashlib.sha256(got[2][5].encode()).hexdigest()
    assert got[4][5].startswith("assign:400000:") and got[5][5] and got[5][6] == 1
    assert secrets.scan_documents(df.limit(0)).count() == 0


def plain_alignment(rows):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    held, count = [], Counter()
    for text in rows:
        got = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            held.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s, e in t if lo <= s and e <= hi) for t in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        count.update(links)
        held.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if h is None else (*h[:3], len(h[3]), sum(count[x] == top[x[1]] for x in h[3]), sum(count[x] for x in h[3]), h[4]) for h in held]


def alignment_texts():
    r = random.Random(2)
    odd = [None, "", " ", "  ", "a▁b", "x\r\ny  z\r z\r", "\r", "\r\n \r\na\r b", "<|endoftext|> hi<s></s>", "été é", "😀 x👨‍👩", "tab\tx\t\ty", "　a　　b c\xa0d", "a\0b", " lead", "trail  ", "x" * 2000, "\n\n\n", "don't  we'll\n's"]
    bits = ["a", "b", " ", "  ", "\r", "\n", "\t", "'s", ";", ")", "{", "　", "\xa0", "9", "中", "😀", "the", "ing", "*/", "Straße"]
    return odd + ["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(400)] + ["the " * 300] * 3


@pytest.mark.parametrize("frequent", [1 << 20, 200, 0])
def test_alignment_against_plain_version(spark, frequent):
    rows = alignment_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, n_a long").repartition(5)
    got = {x[0]: tuple(x)[1:] for x in align.alignment_counts(df, frequent=frequent).collect()}
    assert [got[i] for i in range(len(rows))] == plain_alignment(rows)


def test_alignment_caches_and_slices(spark, monkeypatch):
    """Chunks that are forgotten and learnt again, and links counted in many small tables, change nothing."""
    monkeypatch.setattr(align, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(align, "BATCH_CHARS", 50)
    rows = alignment_texts()
    one = align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    got = [(*x[:4], hashlib.sha256(x[4].encode()).hexdigest() if x[0] else "") for x in one.align(rows)]
    assert got == [(*w[:4], w[6]) for w in plain_alignment(rows)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    links = align.align_documents(df)
    many = {(x.pair, x.n, x.best) for x in align.pair_counts(links, one.shift, most=3).collect()}
    assert many == {(x.pair, x.n, x.best) for x in align.pair_counts(links, one.shift).collect()}


def test_alignment_odd_tables(spark):
    df = spark.createDataFrame([(None, "one two", 1), (4, "one two", 1), (4, "one two", 1), (5, None, 1)], "doc_id long, text string, best int")
    got = sorted((tuple(x) for x in align.alignment_counts(df).collect()), key=str)
    assert len(got) == 4 and len({x[1:] for x in got if x[0] != 5}) == 1 and got[2] == (5, 0, 0, 0, 0, 0, 0, "")
    assert align.alignment_counts(df.limit(0)).count() == 0


def test_groups_by_pointer_jumping():
    import numpy as np

    r = random.Random(6)
    for _ in range(300):
        n = r.randint(1, 60)
        a, b = (np.array(sorted({n, *r.sample(range(1, n + 1), r.randint(0, n - 1))})) for _ in range(2))
        got_a, got_b = align.groups_of(a, b)
        both = sorted(set(a) & set(b))
        assert got_a.tolist() == [sum(c < e for c in both) for e in a] and got_b.tolist() == [sum(c < e for c in both) for e in b]
        starts = (np.append(0, a[:-1]), np.append(0, b[:-1]))
        assert sorted(zip(*(x.tolist() for x in align.links_of(a, b)), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
