"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import math
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("terrachron.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from terrachron.llm import ann, chat, common, ctw, decontam, graph, line_dedup, packing, pieces, quality, simhash, token_counts, token_files, words  # noqa: E402
from terrachron.llm.words import normal  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"
WORDS = [f"w{i}x" for i in range(400)]


def texts(seed=3, n=40):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(30, 90))) + ".\n" + " ".join(r.choices(WORDS, k=12)) for _ in range(n)]
    near = [t.replace(t.split()[5], "changed", 1) for t in base[:10]]
    return [*base, *near, base[0], base[0], None, "", "   \n\n", "!!!\n???", "one", "One two", "a b c", "x " * 5000]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    out = [(i, t, "en", "s", 1, 0.5, 7) for i, t in enumerate(rows)]
    return spark.createDataFrame(out, DOCS)


def odd_rows(spark):
    """Null ids, repeated rows, one id with two texts."""
    return spark.createDataFrame([(None, "alpha beta gamma delta", None, None, None, None, None), (1, None, "", "", 0, None, None), (2, "same text here now", "en", "s", 1, 1.0, 1), (2, "same text here now", "en", "s", 1, 1.0, 1), (2, "other text here then", "en", "s", 1, 1.0, 1)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    want = groups(200, links)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    for node, component in got.items():
        assert want[node] == component
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert graph.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_documents(spark):
    rows = texts()
    got = {x.doc_id: x for x in simhash.near_duplicates(frame(spark)).collect()}
    prints = [plain_fingerprint(t) for t in rows]
    want = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert all(int(got[i].fingerprint, 16) == prints[i] and got[i].component_id == want[i] for i in range(len(rows)))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    odd = simhash.near_duplicates(odd_rows(spark)).collect()
    assert len(odd) == 5 and sum(x.doc_id is None and x.component_id is None for x in odd) == 1
    assert sorted(x.doc_id for x in simhash.keep_one(frame(spark)).collect()) == sorted(set(want))


def test_fingerprint_links_at_every_distance(spark):
    """Distances 1 to 4 in all kinds of places, and a dense cloud whose pairs would be many."""
    r = random.Random(9)
    nodes = [r.getrandbits(64) for _ in range(30)]
    nodes += [n ^ sum(1 << b for b in r.sample(range(64), k)) for n in nodes[:24] for k in (1, 2, 3, 4)]
    cloud = r.getrandbits(64)
    nodes += [cloud ^ sum(1 << b for b in r.sample(range(10), r.randint(0, 5))) for _ in range(300)]
    nodes = sorted(set(nodes))
    want = groups(len(nodes), [(i, j) for i in range(len(nodes)) for j in range(i) if (nodes[i] ^ nodes[j]).bit_count() <= 3])
    signed = np.array(nodes, np.uint64).view(np.int64).tolist()
    got = {x.node: x.component for x in simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    seen = defaultdict(set)
    for s, w in zip(signed, want, strict=True):
        seen[w].add(got[s])
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_word_edits():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(800):
        a, b = ([r.choice(b"abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert line_dedup.word_edits(a, b) == plain(a, b)


def test_line_dedup(spark):
    r = random.Random(4)
    lines = [" ".join(r.choices(WORDS, k=60)) for _ in range(30)]
    rows = ["\n".join(r.choices(lines, k=4) + [" ".join(r.choices(WORDS, k=40)) for _ in range(2)]) for _ in range(25)]
    rows += [t.replace(" w", " W", 3).replace("x ", "x, ", 2) for t in rows[:5]] + [rows[0].replace(rows[0].split()[3], "else", 1), None, "", "\n\n", "--\n--", "only", "only\nonly"]
    first, at = {}, []
    for d, t in enumerate(rows):
        for k, line in enumerate(normal(t).split(b"\n")):
            if w := tuple(line.split()):
                first.setdefault(w, len(first))
                at.append((first[w], d, k))
    kinds = list(first)

    near = [(i, j) for i in range(len(kinds)) for j in range(i) if line_dedup.edit_similarity(list(kinds[i]), list(kinds[j])) >= 0.8]
    component = groups(len(kinds), near)
    keep = {}
    for c, d, k in at:
        keep[component[c]] = min(keep.get(component[c], (d, k)), (d, k))
    drop = defaultdict(set)
    for c, d, k in at:
        if keep[component[c]] != (d, k):
            drop[d].add(k)
    got = {x.doc_id: x for x in line_dedup.marked_lines(frame(spark, rows)).select("row.doc_id", line_dedup.kept_text(F.col("row.text"), F.col("dropped")).alias("text"), F.col("dropped").alias("_dropped")).collect()}
    for d, t in enumerate(rows):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d])
        assert got[d].text == want and set(got[d]._dropped or ()) == drop[d]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    odd = line_dedup.dedup_lines(odd_rows(spark)).collect()
    assert len(odd) == 5 and {x.text for x in odd} == {"alpha beta gamma delta", None, "same text here now", "other text here then"}


def edited(r, line, edits):
    near = list(line)
    for k in r.sample(range(len(near)), edits):
        near[k] = f"new{r.randrange(10**6)}"
    return near


def test_text_hashes_do_not_depend_on_place_or_slab():
    """A word has one hash wherever it stands, also in words longer than a slab and at a slab's end."""
    draw = random.Random(3)
    parts = [bytes(draw.choices(b"abcdefgh\xc3\xa9", k=draw.randrange(1, 12))) for _ in range(3000)]
    parts[7:7] = [b"x" * (words.SLAB - 1), b"y" * words.SLAB, b"z" * (2 * words.SLAB + 5)]
    apart = [int(words.text_hashes(w + b" ")[0]) for w in parts]
    assert words.text_hashes(b" ".join([*parts, b""])).tolist() == apart
    assert words.text_hashes(b"\n".join([*parts, b""])).tolist() == apart
    assert len(set(apart)) == len(set(parts))
    assert not len(words.text_hashes(b""))


def test_line_dedup_finds_all_similar_short_lines(spark):
    """Against brute force over all pairs of lines of up to eleven words, without a fingerprint: edits of any kind down to a similarity of 0.8."""
    r = random.Random(12)
    rows = []
    for n in [4, 5, 5, 6, 7, 8, 9, 10, 10, 11] * 5:
        line = r.choices(WORDS + ["a", "of", "the"] * 60, k=n)
        rows.append(" ".join(line))
        for _ in range(3):
            near = list(line)
            for _ in range(r.randint(1, 2)):
                i = r.randrange(len(near))
                near[i : i + r.choice([0, 1, 1, 1])] = [f"new{r.randrange(10**6)}"] * r.choice([0, 1, 1, 1])
            rows.append(" ".join(near[:11]) or "none")
    r.shuffle(rows)
    lines = [t.encode().split() for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if line_dedup.edit_similarity(lines[i], lines[j]) >= 0.8 - 1e-12]
    assert len(pairs) > 100
    component = groups(len(rows), pairs)
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [i for i in range(len(rows)) if got[i]] == [i for i in range(len(rows)) if component[i] == i]


@pytest.mark.parametrize("words, share, least", [(5, 0.2, 0.98), (10, 0.1, 0.98), (10, 0.2, 0.98), (20, 0.2, 0.9), (40, 0.2, 0.9), (80, 0.2, 0.9), (160, 0.2, 0.9), (40, 0.1, 0.99), (160, 0.1, 0.99), (20, 0.05, 0.99), (80, 0.0125, 0.99)])
def test_line_dedup_recall_by_length(words, share, least):
    """The share of pairs of lines, a part of their words replaced at random, that meet in a block."""
    r = random.Random(words)
    hits = 0
    usual = line_dedup.line_blocks([3], [b"a", b"of", b"the"], 0.5, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))[2]
    known = np.unique(np.r_[usual, np.random.default_rng(1).integers(0, 1 << 62, 50).astype(np.uint64)])
    for frequent in ((known[:0], np.zeros(0, np.int64)), (known, np.full(len(known), 9))):
        for k in range(300):
            line = r.choices(WORDS + ["a", "of", "the"] * 60, k=words)
            near = edited(r, line, round(share * words))
            if k % 3 == 1 and near != line:  # a changed word goes
                del near[next(i for i, w in enumerate(near) if w.startswith("new"))]
            elif k % 3 == 2:  # it comes in between
                i = next((i for i, w in enumerate(near) if w.startswith("new")), 0)
                near[i] = line[i]
                near = near[:i] + ["new"] + near[i:-1]
            if line_dedup.edit_similarity(line, near) < 0.8 - 1e-12:
                hits += 1 if share == 0.2 else 0
                continue
            sides = [[w.encode() for w in x] for x in (line, near)]
            sims, counts, blocks, _ = line_dedup.line_blocks([len(line), len(near)], sides[0] + sides[1], 0.8, frequent)
            hits += bool({*blocks[: counts[0]]} & {*blocks[counts[0] :]}) and sum(int(x).bit_count() for x in sims[0] ^ sims[1]) <= line_dedup.MAX_BITS
    assert hits >= least * 600


def test_line_dedup_exact_way(spark):
    """Without bounds on blocks and bits, all similar pairs of lines of any length are linked."""
    r = random.Random(21)
    rows = []
    for n in (9, 14, 20, 33, 50, 90) * 4:
        line = r.choices(WORDS + ["a", "of", "the"] * 60, k=n)
        rows += [" ".join(line)] + [" ".join(edited(r, line, int(0.2 * n + 1e-9))) for _ in range(3)]
    lines = [t.encode().split() for t in rows]
    component = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if line_dedup.edit_similarity(lines[i], lines[j]) >= 0.8 - 1e-12])
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows), exact=True).collect()}
    assert [i for i in range(len(rows)) if got[i]] == [i for i in range(len(rows)) if component[i] == i]


def test_line_dedup_loses_no_pair_of_long_lines():
    """Lines of up to 300 words with as many edits as a similarity of 0.8 allows, of one kind or mixed: each pair shares a block, and its signatures differ in no more bits than the edits explain."""
    r = random.Random(31)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for k in range(1500):
        line = r.choices(WORDS + ["a", "of", "the"] * 60, k=r.choice([6, 12, 20, 33, 56, 90, 150, 300]))
        near, kind = list(line), k % 4
        for _ in range(line_dedup.most_edits(len(line), 0.8)):
            i = r.randrange(len(near))
            near[i : i + (kind != 2)] = [] if kind == 1 or kind == 3 and r.random() < 0.3 else [r.choice(WORDS)]
        n = max(len(line), len(near))
        most, edits = line_dedup.most_edits(n, 0.8), line_dedup.word_edits([w.encode() for w in line], [w.encode() for w in near])
        assert edits <= most
        if edits:
            sims, counts, blocks, _ = line_dedup.line_blocks([len(line), len(near)], [w.encode() for w in line + near], 0.8, none)
            assert {*blocks[: counts[0]].tolist()} & {*blocks[counts[0] :].tolist()}
            assert sum(int(x).bit_count() for x in sims[0] ^ sims[1]) + abs(len(line) - len(near)) <= 2 * edits


def test_line_dedup_splits_blocks_by_length():
    """Classes of one block that can be similar by their numbers of words stay together, others only where a chain of such joins them; lines beyond MOST_WORDS count as that long."""
    r = random.Random(41)
    entries = [(r.randrange(40), k // 2, min(n, line_dedup.MOST_WORDS)) for k in range(1200) for n in [int(1.01 ** r.uniform(0, 1100))]]
    sizes = {name: n for _, name, n in entries}
    entries = [(key, name, sizes[name]) for key, name, _ in entries]
    packed = [np.array(x, kind).tobytes() for x, kind in zip(zip(*entries, strict=True), (np.uint32, np.int64, np.int16), strict=True)]
    got = line_dedup._shared(pa.table([pa.array([5], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["bucket", "keys", "names", "sizes"]), 0.8).to_pylist()
    together = defaultdict(set)
    for x in got:
        together[x["key"]] |= {x["a"], x["x1"], x["x2"]}
        assert x["x1"] < x["x2"] and (x["n"] > 2 or x["a"] == x["x2"])
    assert all(len(together[x["key"]]) == x["n"] for x in got)
    by_key = defaultdict(set)
    for key, name, _ in entries:
        by_key[key].add(name)
    want = defaultdict(set)
    for key, names in by_key.items():
        near = [(x, y) for x in names for y in names if x < y and abs(sizes[x] - sizes[y]) <= line_dedup.most_edits(max(sizes[x], sizes[y]), 0.8)]
        for name, of in enumerate(groups(600, near)):
            if name in names:
                want[key, of].add(name)
    assert sorted(map(sorted, together.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert len(together) > 2 * len(by_key)


def test_least_of_a_key_is_joined_to_its_salts_alone(spark):
    """Rows of small keys are not copied for salts they do not have; several columns may be the key."""
    rows = [(k, k % 3, v) for k in range(500) for v in ([k + 7] if k else range(9, 400))]
    out = graph.with_least(spark.createDataFrame(rows, "k long, m int, v long"), ["k", "m"], "v", "least")
    assert sorted(map(tuple, out.collect())) == sorted((k, m, v, k + 7 if k else 9) for k, m, v in rows)


def test_line_dedup_links_all_long_lines(spark):
    """The way of the query, against brute force: pairs at 0.8, chains and a group whose leaders are far from most of it; all ways agree."""
    r = random.Random(17)
    rows = []
    for _ in range(250):
        line = r.choices(WORDS, k=r.choice([40, 60, 100]))
        rows += [" ".join(line), " ".join(edited(r, line, len(line) // 5))]
    line = r.choices(WORDS, k=60)
    for _ in range(60):
        rows.append(" ".join(line))
        line = edited(r, line, 8)
    r.shuffle(rows)
    lines = [t.encode().split() for t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if len({*lines[i]} & {*lines[j]}) > 20 and line_dedup.edit_similarity(lines[i], lines[j]) >= 0.8 - 1e-12]
    component = groups(len(rows), close)
    want = [i for i in range(len(rows)) if component[i] == i]
    for exact in (False, True):
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows), exact=exact).collect()}
        assert [i for i in range(len(rows)) if got[i]] == want


def test_line_dedup_long_text(spark):
    """One line of 60,000 words and its copy with every hundredth word changed."""
    r = random.Random(3)
    line = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    rows = [" ".join(line), " ".join(w if k % 100 else "other" for k, w in enumerate(line)), "a line of its own here"]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[0] == rows[0] and got[1] == "" and got[2] == rows[2]


def test_tiles_against_naive():
    def naive(a, b, size):
        used_a, used_b, total = set(), set(), 0
        while True:
            best = (0, 0, 0)
            for j in range(len(b)):
                for i in range(len(a)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < size:
                return total
            total += best[0]
            used_a.update(range(best[1], best[1] + best[0]))
            used_b.update(range(best[2], best[2] + best[0]))

    r = random.Random(7)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randint(2, 25))], [r.choice("abc") for _ in range(r.randint(2, 15))]
        seeds = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2]]
        assert sum(n for _, _, n in decontam.tiles(seeds, 2)) == naive(a, b, 2)


def test_decontamination(spark):
    r = random.Random(8)
    items = [" ".join(r.choices(WORDS, k=40)) for _ in range(6)] + ["tiny one", "", None]
    halves = items[1].split()
    docs = [items[0], "before " + items[0].upper() + " after", " ".join(halves[20:] + ["between"] + halves[:20]), " ".join(items[2].split()[:25]), " ".join(items[3].split()[:12]), "a tiny one b", " ".join(r.choices(WORDS, k=100)), None, ""]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    got = {(x.doc_id, x.item_id): x for x in decontam.contaminated_pairs(frame(spark, docs), bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2), (5, 6)}
    assert got[0, 0].coverage == 1.0 and got[2, 1].n_tiles == 2 and got[3, 2].coverage == 25 / 40
    left = decontam.drop_contaminated(frame(spark, docs), bench)
    assert sorted(x.doc_id for x in left.collect()) == [4, 6, 7, 8] and left.columns == frame(spark, docs).columns
    assert decontam.contaminated_pairs(empty(spark), bench).count() == 0
    assert decontam.contaminated_pairs(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontam.contaminated_pairs(odd_rows(spark), bench).count() == 0


def test_chat_format(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None), (None, "odd")]
    rows = [(c, i, *turns[i], 9) for c, n in ((1, 2), (2, 5), (3, 1), (4, 2)) for i in range(n)]
    rows += [(5, i + 10, *turns[i], 9) for i in range(3)] + [(6, 0, "user", "hi there", 9), (7, 0, "user", "hi there", 9), (None, None, "user", "lost", 9), (8, 0, "user", "x", 9), (8, 0, "user", "x", 9)]
    rows += [(9, i, "user", str(i), 9) for i in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {(x.conv_id, x.part): x for x in chat.format_conversations(df).collect()}
    assert {k[0] for k in got} == {2, 6, 8, 9, None} and [got[9, p].n_turns for p in range(3)] == [1024, 1024, 452]
    assert got[2, 0].text == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\n<|end|>\n<|unknown|>\nodd<|end|>\n"
    assert got[9, 2].text.startswith("<|user|>\n2048<|end|>\n") and got[8, 0].n_turns == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_vantage_point_search(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 16))
    x = (centres[r.integers(0, 8, 900)] + r.normal(scale=0.3, size=(900, 16))) * r.uniform(0.5, 2, (900, 1))
    x[300:340] = x[300]  # copies
    tree = ann.VantagePointTree(x, 32)
    q, _, scores = tree.search(x[:50], 10, 1.0)
    want = np.sort(x[:50] @ x.T, axis=1)[:, ::-1][:, :10]
    assert all(np.allclose(np.sort(scores[q == i])[::-1][:10], want[i]) for i in range(50))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] + [1.0] * 14, 0), (2004, [], 0), (None, x[1].tolist(), 0), (5, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    queries = df.where("vec_id % 20 = 0")
    for factor, least in ((1.0, 1.0), (ann.FACTOR, 0.9)):
        got = defaultdict(list)
        for y in ann.nearest(df, queries, factor=factor, shard_rows=200, block_queries=16, leaf_rows=32).orderBy("query_id", "rank").collect():
            got[y.query_id].append((y.rank, y.vec_id, y.score))
        hit = 0
        for q in range(0, 900, 20):
            scores = (x * x[q]).sum(axis=1)
            order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
            assert [a for a, _, _ in got[q]] == list(range(1, 21))
            hit += len({v for _, v, _ in got[q]} & set(order))
            if factor == 1.0:
                assert [v for _, v, _ in got[q]] == order and np.allclose([s for _, _, s in got[q]], scores[order], rtol=1e-12)
        assert hit >= least * 45 * 20
    assert set(got) == set(range(0, 900, 20))
    assert ann.nearest(df.limit(0), queries).count() == 0
    assert ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).count() == 4


def test_vantage_point_ties_go_to_the_smaller_id(spark):
    """Vectors of zeros and ones, where most products tie: every rank is that of brute force."""
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (1500, 12)).astype(float)
    x[:, 0] = 1
    ids = r.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for y in ann.nearest(df, df.where("vec_id % 20 = 0"), factor=1.0, shard_rows=400, block_queries=16, leaf_rows=32).orderBy("query_id", "rank").collect():
        got[y.query_id].append((y.vec_id, y.score))
    of = {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, found in got.items():
        scores = {i: float(v @ of[q]) for i, v in of.items() if i != q}
        assert found == [(i, scores[i]) for i in sorted(scores, key=lambda i: (-scores[i], i))[:20]]
    assert len(got) == 75


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piecewise_encoding(name):
    r = random.Random(1)
    letters = list(" \n\t\r\x0b\x1c\x85 　ab'sA1.9é́ÀΣ<|>") + ["<|endoftext|>", "'s", "  ", "日本", " 's", "ǅ", "İ"]
    rows = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["", "word " * 3000]
    path = public_tokenizers.path(name)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    encoder = pieces.TextEncoder(path)
    encoder.store.limit = 50  # generations change often
    assert [x.tolist() for x in encoder.encode(rows)] == want
    if name.startswith("byte"):
        assert token_counts.MergeCounter(path).counts(rows).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_before_marks_are_encoded_once(name, monkeypatch):
    path = public_tokenizers.path(name)
    rows = ["a word, a word. a (word) word; don't word's WORD'S", "a\nword\u0130, \u0130's word\u0301, x\u2028word<\u0338 \u00e9t\u00e9's <|endoftext|>word, word12, 12word.", "word", "word,<|endoftext|>."]
    encoder = pieces.TextEncoder(path)
    seen = []
    encode = encoder.store.values_of
    monkeypatch.setattr(encoder.store, "values_of", lambda found: (seen.extend(found), encode(found))[1])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(rows)] == want
    seen.clear()
    encoder.store.release()
    list(encoder.encode([" word, word. word! word; word: word? word) word"]))
    assert sum("word" in p for p in seen) == 1, seen


def test_workers_let_go_of_what_other_stages_left(monkeypatch):
    """Lines, fingerprints and scores need no cache: the tokenizer and its pieces, or words, of an earlier stage go."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["a few words"])], ["doc_id", "text_hash", "text"])
    assert list(pieces.encoder(path).encode(["a few words"])) and path in pieces._ENCODERS
    assert [b.num_rows for b in line_dedup._lines(iter([batch]))] == [1]
    assert path not in pieces._ENCODERS and not common._HELD


def test_texts_become_strings_a_part_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001))], ["doc_id"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(0, 3)]), 250))
    assert [p.num_rows for p in parts] == [250, 250, 250, 250, 1, 3] and parts[1].column(0)[0].as_py() == 250


def test_store_keeps_the_pieces_that_come_often():
    seen = []
    store = pieces.PieceStore(lambda found: (seen.extend(found), (np.fromiter(map(int, found), np.int64), np.ones(len(found), np.int64)))[1], np.int64, 100)
    often = [str(k) for k in range(40)]
    for k in range(50):
        once = [str(1000 * k + 1000 + i) for i in range(20)]
        values, lens = store.gather(store.codes([*often, *once]))
        assert values.tolist() == [int(x) for x in [*often, *once]] and len(values) == lens.sum()
        store.trim()
        assert len(store.index) <= 100 and set(often) <= set(store.index)
    assert len(seen) == len(set(seen)) == 40 + 50 * 20


def test_token_counts(spark):
    rows = texts()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {x.doc_id: x for x in token_counts.count_tokens(frame(spark)).collect()}
    for i, t in enumerate(rows):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.count_tokens(empty(spark)).count() == 0 and token_counts.count_tokens(odd_rows(spark)).count() == 5


def test_bit_packing_round_trip():
    r = np.random.default_rng(0)
    for bits in range(1, 33):
        ids = r.integers(0, 1 << bits, 997).astype(np.uint32)
        payload = token_files.pack_ids(ids, bits)
        assert len(payload) == -(-997 * bits // 8)
        assert (token_files.unpack_ids(payload, bits, 0, 997) == ids).all() and (token_files.unpack_ids(payload, bits, 401, 99) == ids[401:500]).all()
    with pytest.raises(ValueError):
        token_files.pack_ids(np.array([8]), 3)
    assert token_files.bits_for(49408) == 16 and token_files.bits_for(2) == 1


def test_token_files(spark, tmp_path):
    rows = texts()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = token_files.write_token_files(frame(spark), str(tmp_path / "ids"), parts=3, block_tokens=500)
    got = {x.doc_id: x for x in token_files.read_digests(spark, out).collect()}
    start = 0
    for i, t in enumerate(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_document_ids(spark, out, 4)[0].tolist() == [*tokenizer.encode(rows[4], add_special_tokens=False).ids, 1]
    assert token_files.read_digests(spark, token_files.write_token_files(empty(spark), str(tmp_path / "none"), parts=2)).count() == 0
    odd = [token_files.write_token_files(odd_rows(spark).repartition(n), str(tmp_path / f"odd{n}"), parts=2) for n in (1, 5)]
    first, second = (sorted(map(tuple, token_files.read_digests(spark, o).collect()), key=str) for o in odd)
    assert len(first) == 5 and first == second
    assert len(token_files.read_document_ids(spark, odd[0], 2)) == 3 and len(token_files.read_document_ids(spark, odd[0], 1)) == 1 and not token_files.read_document_ids(spark, odd[0], 9)


def test_keep_one_with_an_id_of_two_texts(spark):
    """An id in two groups stands for each with the text of that group."""
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    for one, two in ((a, b), (b, a)):
        rows = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two), (3, two), (None, one)], "doc_id long, text string")
        assert sorted((x.doc_id or 0, x.text) for x in simhash.keep_one(rows).collect()) == [(0, one), (1, one), (2, two)]


def test_packing(spark):
    rows = texts() + [" ".join(WORDS * 8)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(frame(spark, rows).coalesce(2), block=4000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    for i, t in enumerate(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for x in sorted(sequence, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    assert packing.pack_documents(empty(spark)).count() == 0 and packing.pack_documents(odd_rows(spark)).count() == 5


def test_packing_holds_little_beside_its_batch(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    r = random.Random(5)
    texts = [" ".join(f"{r.randrange(10**6):x}" for _ in range(1500)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces.encoder(path)
    del texts
    tracemalloc.start()
    try:
        ids = sum(sum(b["length"].to_pylist()) for b in packing._packed(iter([batch]), path, 2048, 1_000_000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pieces.encoder(path).store.release()
    assert ids > 1_000_000 and peak < 70_000_000, (ids, peak)


def test_pack_lengths_fills_sequences():
    r = random.Random(3)
    for _ in range(50):
        lengths = [r.choice([r.randint(1, 2047), r.randint(1, 60)]) for _ in range(r.randint(1, 400))]
        packed = packing.pack_lengths(lengths)
        assert len(packed) == -(-sum(lengths) // 2048) and all(sum(n for _, _, n in s) <= 2048 for s in packed)
        seen = defaultdict(list)
        for s in packed:
            for item, start, n in s:
                seen[item].append((start, n))
        for i, length in enumerate(lengths):
            at = 0
            for start, n in sorted(seen[i]):
                assert start == at
                at += n
            assert at == length


def test_pack_lengths_takes_the_cheapest_sequence():
    """Against the rule by the letter: descending items, each to the cheapest sequence with room, ties to the first."""
    r = random.Random(9)
    for _ in range(60):
        lengths = [r.randint(1, r.choice([100, 2048])) for _ in range(r.randint(1, 120))]
        n = -(-sum(lengths) // 2048)
        used, cost, want = [0] * n, [0.0] * n, {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [k for k in range(n) if used[k] + lengths[i] <= 2048]
            if fits:
                k = min(fits, key=lambda k: (cost[k], k))
                used[k] += lengths[i]
                cost[k] += packing.attention_cost(lengths[i])
                want[i] = k
        got = {i: k for k, s in enumerate(packing.pack_lengths(lengths)) for i, start, length in s if length == lengths[i]}
        assert got == want


def test_pack_lengths_looks_at_every_sequence():
    """The 70 cheapest sequences have no room for the last five items, five dearer ones have: they stay whole."""
    packed = packing.pack_lengths([300] * 5 + [1020] * 140 + [1700] * 5)
    assert len(packed) == 75 and sum(map(len, packed)) == 150
    assert sum({i < 5 for i, _, _ in s} == {True, False} and any(i >= 145 for i, _, _ in s) for s in packed) == 5


def plain_tree(rows, depth, train):
    """log10 probability of each text from a tree over running bytes, by the definition."""

    def steps(text):
        z = b" " * depth + b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"
        return [(z[i - depth : i], z[i]) for i in range(depth, len(z))]

    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, t in enumerate(rows):
        for context, byte in steps(t) if i in train else ():
            for d in range(len(context) + 1):
                for k in range(8):
                    key = (context[len(context) - d :], (1 << k) | (byte >> (8 - k)))
                    counts[key][(byte >> (7 - k)) & 1] += 1
                    if d:
                        children[key[0][1:], key[1]].add(key)

    def kt(key):
        z, o = counts[key]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    @lru_cache(None)
    def mixed(key):
        if key not in children:
            return kt(key)
        own, below = kt(key), sum(map(mixed, sorted(children[key])))
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def one(context, d, prefix):
        key = (context[len(context) - d :], prefix)
        z, o = counts.get(key, (0, 0))
        here = (o + 0.5) / (z + o + 1)
        longer = (context[len(context) - d - 1 :], prefix)
        if d == len(context) or longer not in counts:  # an unseen context adds nothing
            return here
        weight = math.exp(min(700, kt(key) - sum(map(mixed, sorted(children[key])))))
        return (weight * here + one(context, d + 1, prefix)) / (weight + 1)

    out = []
    for t in rows:
        score = 0.0
        for context, byte in steps(t):
            for k in range(8):
                p = one(context, 0, (1 << k) | (byte >> (8 - k)))
                score += math.log10(p if (byte >> (7 - k)) & 1 else 1 - p)
        out.append(score)
    return out


@pytest.mark.parametrize("depth", [2, 3, 5, 7])
def test_context_tree_against_plain_version(spark, depth):
    """Scores, base scores and counts; broadcast and joined words and steps; word order matters."""
    r = random.Random(5)
    rows = [" ".join(r.choice(["red fox", "old dog", "Red cat"]) for _ in range(r.randint(1, 12))) for _ in range(25)] + [None, "", "red old fox dog", "red fox old dog", "red fox old dog", "zebra \u00e9t\u00e9"]
    train = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 10}
    words = defaultdict(int)
    for i in train:
        for w in [*(rows[i] or "").lower().split(), "\n"]:
            words[w] += 1
    n, v = sum(words.values()), len(words)
    want = plain_tree(rows, depth, train)
    for few in ({}, {"frequent_words": 3, "frequent_steps": 20}):
        got = {x.doc_id: x for x in ctw.score_documents(frame(spark, rows), depth, **few).collect()}
        assert len(got) == len(rows) and (depth < 5 or got[27].score < got[28].score - 1)
        for i, t in enumerate(rows):
            tokens = [*(t or "").lower().split(), "\n"]
            base = sum(math.log10((words.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
            x = got[i]
            assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(tokens), sum(words.get(w, 0) > 0 for w in tokens), n, i not in train)
            assert math.isclose(x.score, want[i], rel_tol=1e-9) and math.isclose(x.base_score, base, rel_tol=1e-9)


def test_context_tree_odd_tables(spark):
    assert ctw.score_documents(empty(spark)).count() == 0 and ctw.score_documents(odd_rows(spark)).count() == 5
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = ctw.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert alone.train_tokens == 0 and math.isclose(alone.score, 4 * 8 * math.log10(0.5))


def test_context_tree_cuts_long_texts(monkeypatch):
    text = b"     " + b"some words in a row " * 50 + b"\n"
    whole = np.concatenate([k for k, _ in ctw.step_keys([text, text], 5)])
    parts = list(ctw.step_keys([text, text], 5, chunk=64))
    assert len(parts) > 20 and sorted(np.concatenate([k for k, _ in parts])) == sorted(whole) and len(whole) == 2 * (len(text) - 5)
    assert np.concatenate([o for _, o in parts]).sum() == len(text) - 5


def test_context_tree_in_groups(spark):
    """The cut and the number of groups do not change the tree; the probabilities of all next bytes sum to one."""
    r = random.Random(2)
    counts = {}
    for _ in range(300):
        counts[int.from_bytes(bytes(r.choice(b"ab ") for _ in range(5)), "big")] = r.randint(0, 9)
    for byte in range(256):
        counts.setdefault(int.from_bytes(b"abab", "big") << 8 | byte, 0)
    frame_ = spark.createDataFrame(list(counts.items()), "key long, n long")
    a, b, c = ({x.key: x.logp for x in ctw.context_tree(frame_, 4, **o).collect()} for o in ({}, {"group_steps": 40}, {"split": 1}))
    assert a.keys() == b.keys() == c.keys() == counts.keys()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) and math.isclose(a[k], c[k], rel_tol=1e-9) for k in a)
    assert math.isclose(sum(math.exp(a[int.from_bytes(b"abab", "big") << 8 | byte]) for byte in range(256)), 1.0, rel_tol=1e-9)


def test_context_tree_beats_word_counts(spark):
    """On held-out documents of the test table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ctw.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_quality_classifier(spark):
    r = random.Random(6)
    good = [" ".join(r.choices(WORDS, k=r.randint(20, 80))) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in r.choices(WORDS, k=30)) for _ in range(60)] + [("spam | " * 30).strip() for _ in range(40)]
    rows = [*good, *bad, None, ""]
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0, 0) for i in range(250)] + [(0, None, 1), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.train(docs, labels)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 250]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == (x.doc_id < 150) for x in held) >= 0.97 * len(held)
    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells the label
    assert ((quality.fit(x[:1500], y[:1500]).score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.85
    nothing = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.score_documents(docs, nothing).collect()} == {0.5}
    assert quality.score_documents(empty(spark), model).count() == 0 and quality.score_documents(odd_rows(spark), model).count() == 5
