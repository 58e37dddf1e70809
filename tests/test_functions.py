"""Literal cases of expressions and operators."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terrachron.functions import spatial as S
from terrachron.functions import temporal as T
from terrachron.functions import text as X
from terrachron.operators import borders as B
from terrachron.operators import compare as C
from terrachron.operators import derive as L
from terrachron.operators import duplicates as D
from terrachron.operators import joins as J
from terrachron.operators import pages as P
from terrachron.operators import search as Q
from terrachron.operators import windows as W
from terrachron.sources import files as A


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, value if not isinstance(value, (str, int, float, bool, type(None))) else F.lit(value))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "start,end,precision,end_precision,ongoing,want",
    [
        ("1948-05-15", None, "day", None, False, "15 May 1948"), ("1948-05-15", None, "month", None, False, "May 1948"), ("1948-05-15", None, "year", None, False, "1948"),
        ("1948-05-15", "1949-03-10", "day", "day", False, "15 May 1948 – 10 March 1949"), ("1948-05-15", "1948-05-20", "day", "day", False, "15–20 May 1948"),
        ("1948-05-15", "1948-06-20", "day", "day", False, "15 May – 20 June 1948"), ("1948-05-15", "1949-01-01", "day", "year", False, "15 May 1948 – 1949"),
        ("1948-05-15", "1948-01-01", "day", "year", False, "1948"), ("1949-05-15", "1948-01-01", "day", "day", False, "1949–1948"), ("1901-01-01", None, "century", None, False, "20th century"),
        ("2011-03-15", None, "day", None, True, "15 March 2011 – ongoing (per source)"), ("2011-01-01", None, "year", None, True, "2011–ongoing (per source)"), (None, None, "day", None, False, ""),
    ],
)
def test_event_dates(spark, start, end, precision, end_precision, ongoing, want):
    got = one(spark, T.format_event_date(ongoing=F.lit(ongoing)), date_start=F.lit(start).cast("string"), date_end=F.lit(end).cast("string"), date_precision=precision, date_end_precision=F.lit(end_precision).cast("string"))
    assert got == want


@pytest.mark.parametrize("date,code,want", [("2002-01-01", 9, "2002-12-31"), ("2000-02-01", 10, "2000-02-29"), ("1995-01-01", 8, "1999-12-31"), ("1901-01-01", 7, "2000-12-31"), ("2000-01-01", 7, "2000-12-31"), ("1001-01-01", 6, "2000-12-31"), ("2002-05-03", 11, "2002-05-03"), ("2002", 9, None), ("2002-01-01", 5, None)])
def test_last_day_of_period(spark, date, code, want):
    assert one(spark, T.last_day_of_period(F.lit(date), F.lit(code))) == want


def test_calendar(spark):
    assert one(spark, T.julian_to_gregorian(F.lit(1914), F.lit(7), F.lit(20))) == "1914-08-02"
    assert one(spark, T.julian_to_gregorian(F.lit(1900), F.lit(2), F.lit(30))) is None
    assert one(spark, T.source_date(F.lit("+1940-00-00T00:00:00Z"), F.lit(9), F.lit(True))) == "1940-00-00"
    assert one(spark, T.fill_zero_parts(F.lit("1940-00-00"))) == "1940-01-01"
    assert [one(spark, T.is_real_date(F.lit(d))) for d in ("2000-02-29", "1900-02-29", "2000-13-01", "x")] == [True, False, False, False]
    assert T.last_year(2031, 2026) == 2029 and T.last_year(2020, 2026) == 2026
    assert one(spark, T.ongoing_signal(), title="Border war (2011–present)", date_start="2011-01-01", date_end=F.lit(None).cast("string"), date_end_open=F.lit(None).cast("string")) == "title"


def test_geometry(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    ring = lambda *p: F.array(*(point(*q) for q in p))
    square = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    shape = F.array(F.array(square, hole))
    inside = lambda x, y: one(spark, S.in_polygons(F.col("p"), F.lit(float(x)), F.lit(float(y))), p=shape)
    assert inside(1, 1) and not inside(5, 5) and not inside(11, 5) and inside(4.5, 3.9)
    assert one(spark, S.ring_area(F.col("r")), r=square) == pytest.approx(100)
    at = one(spark, S.ring_centroid(F.col("r")), r=square)
    assert (at.lon, at.lat) == (5, 5)
    assert one(spark, S.label_anchor(F.col("p")), p=shape) is None
    assert one(spark, F.size(S.ring_problems(F.col("p"))), p=F.array(F.array(ring((0, 0), (1, 1), (2, 0))))) == 2
    assert one(spark, F.size(S.drop_collinear(F.col("r"))), r=ring((0, 0), (5, 0), (10, 0), (10, 10), (10, 10), (0, 0))) == 4
    assert one(spark, S.segment_km(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(math.pi * 6371 / 180)
    assert one(spark, S.cells_in_box(F.array(F.lit("0_0"), F.lit("5_0"), F.lit("10_5")), 5, (1, 1, 6, 4))) == ["0_0", "5_0"]
    assert S.circle_box(0, 89, 500)[0] == -180 and S.circle_box(179.9, 0, 100)[0] == -180
    assert [one(spark, S.compass_point(F.lit(float(b)))) for b in (0, 44, 90, 225, 350)] == ["N", "NE", "E", "SW", "N"]
    assert [one(spark, S.decimal_places(F.lit(v))) for v in (1.0, 1.5, 1.25, 1.123)] == [0, 1, 2, 3]


def test_crossings(spark):
    bow = [[[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]]]
    fine = [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]]
    holed = [[fine[0][0], [(1.0, 1.0), (3.0, 1.0), (3.0, 1.5), (1.0, 1.5), (1.0, 1.0)]]]
    rows = [(n, 1, 2, p) for n, p in (("bow", bow), ("fine", fine), ("holed", holed))]
    df = spark.createDataFrame(rows, "name string, start_year int, end_year int, polygons array<array<array<struct<lon:double,lat:double>>>>")
    found = {(r.name, r.sid.ring == r.sid2.ring) for r in B.crossings(df).collect()}
    assert found == {("bow", True), ("holed", False)}


def test_text(spark):
    assert one(spark, X.fold(F.lit("Çeşme Łódź Straße ÆØ"))) == "cesme lodz strasse aeo"
    assert one(spark, X.tokenize(F.lit("Six-Day War (1967)"))) == ["six", "day", "war", "1967"]
    assert one(spark, X.title_years(F.lit("Unrest (2011–12) and 1990-present, 1967–1970"))) == [2011, 2012, 1990, 1967, 1970]
    assert one(spark, X.exact_days(F.lit("From 5 June 1967 to June 10, 1967; 3–4 May 1948."))) == ["1967-06-05", "1948-05-03", "1967-06-10"]
    assert one(spark, X.lead_dates(F.lit("In 1967 and 1948."))) == ["1948", "1967"]
    assert one(spark, X.first_sentence(F.lit("It was. Then more.\nNext"))) == "It was."
    assert one(spark, X.slugify(F.lit("L'été à Bağdad!"))) == "lete-a-bagdad"
    assert one(spark, X.norm_title(F.lit("The Great War"))) == "greatwar"
    assert one(spark, X.note_sentences(F.lit("Est. 1995; see source. Next one."))) == ["Est. 1995; see source.", "Next one."]
    assert one(spark, X.source_items(F.lit("A (x; y); B; C"))) == ["A (x; y)", "B", "C"]
    assert one(spark, X.title_from_url(F.lit("https://en.wikipedia.org/wiki/Six%E2%80%93Day_War#top"))) == "Six–Day War"
    assert one(spark, X.query_marks(F.lit("The warship at war"), ["war"])) == "The **warship** at **war**"
    assert [one(spark, X.csv_cell(F.lit(v))) for v in ("a,b", 'q"', "=1+1", "-5", None)] == ['"a,b"', '"q"""', "'=1+1", "-5", ""]
    assert one(spark, X.text_sha1(F.lit("abc"))) == "a9993e364706"
    assert X.bucket_count(815) == 64 and X.bucket_count(64 * 32 + 1) == 128
    h = 0x811C9DC5
    for c in b"six-day-war":
        h = ((h ^ c) * 0x01000193) % 2**32
    assert one(spark, X.hash_bucket(F.lit("six-day-war"), 64)) == h % 64
    assert [Q.stem_word(w) for w in ("wars", "cities", "fighting", "stopped", "quickly", "peace")] == ["war", "citi", "fight", "stop", "quick", "peac"]
    assert P.paragraphs("<p>One <b>two</b><sup>[1]</sup></p><script>x</script><p> </p><p>Three") == ["One two", "Three"]
    assert one(spark, X.quote_check(F.lit("“so  it”"), F.lit('and "so it" went'), F.lit(""))) == "extract"


def test_joins_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(0, 100), r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k double, x double, y double")
    other = df.select(F.col("id").alias("id2"), F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    got = {(a.id, a.id2) for a in J.band_join(df, other, "k", "k2", 3.0).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) <= 3}
    near = J.cell_join(df, other, "x", "y", "x2", "y2", 2.0, 2.0).where("abs(x - x2) <= 2 AND abs(y - y2) <= 2")
    assert {(a.id, a.id2) for a in near.collect()} == {(a[0], b[0]) for a in rows for b in rows if abs(a[2] - b[2]) <= 2 and abs(a[3] - b[3]) <= 2}
    runs = spark.createDataFrame([(1, y, v) for y, v in ((1, "a"), (2, "a"), (4, "a"), (5, "b"), (6, "b"))], "id long, year int, v string")
    assert sorted((x.start, x.end, x.v) for x in J.islands(runs, ["id"], "year", ["v"]).collect()) == [(1, 2, "a"), (4, 4, "a"), (5, 6, "b")]
    first = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0)], "id long, other long, d double")
    second = spark.createDataFrame([(1, 2, 0.5), (1, 4, 9.0)], "id long, other long, d double")
    assert sorted((x.other, x.grp) for x in J.by_priority([("p", first), ("q", second)], 1).collect()) == [(2, "p"), (4, "q")]


def test_duplicate_hints(spark):
    rows = [
        ("a", "Q1", "Q1", "Battle of the Red River Crossing", "1990-01-01", 0.0, 0.0, "precise", ["X"]), ("b", "Q2", "Q2", "The Battle of Red River", "1990-06-01", 1.0, 0.5, "precise", ["Y"]),
        ("c", "Q3", "Q1", "Other", "1990-01-01", 9.0, 9.0, "none", ["Z"]), ("d", "Q4", "Q4", "Other", "1950-01-01", 9.0, 9.0, "none", ["Z"]), ("e", "Q5", "Q5", "Battle of Red River", "1999-01-01", 0.0, 0.0, "precise", ["X"]),
    ]
    df = spark.createDataFrame(rows, "id string, wikidata_qid string, resolved_qid string, title string, date_start string, lon double, lat double, location_quality string, countries array<string>")
    got = {(r.id, r.other): r.reason[0] for r in D.duplicate_hints(df).collect()}
    assert got == {("a", "c"): "1", ("c", "d"): "2", ("b", "e"): "2", ("a", "b"): "3"}


def test_sources_and_sinks(spark, tmp_path):
    lines = [json.dumps({"id": "a", "title": "T", "sitelinks": None}), json.dumps({"id": "b", "odd": 1}), "no json"]
    (tmp_path / "e.json").write_text("[\n" + ",\n".join(lines) + "\n]\n")
    got = {r.id: r for r in A.read_events(spark, str(tmp_path / "e.json")).collect()}
    assert got["a"].has_sitelinks and not got["b"].has_sitelinks and got["b"].unknown_fields == ["odd"] and got[None].corrupt
    shape = {"type": "Feature", "properties": {"name": "N", "start_year": 1, "end_year": 2}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[\n' + json.dumps(shape, separators=(",", ":")) + "\n]}\n")
    row = A.read_features(spark, str(tmp_path / "f.json")).first()
    assert row.name == "N" and row.polygons[0][0][1].lon == 1.0
    (tmp_path / "g.md").write_text("# x\n\n| Event (QID) | Why the rule misses it |\n| --- | --- |\n| War \\| peace (Q12) | too few |\n| Siege ([Q7](https://x.y)) | `none` |\n")
    gaps = A.known_gaps(spark, str(tmp_path / "g.md")).collect()
    assert [(g.name, g.qid) for g in gaps] == [("War | peace", "Q12"), ("Siege", "Q7")]
    with pytest.raises(ValueError):
        A.markdown_table(spark, str(tmp_path / "g.md"), ("Missing",))
    (tmp_path / "s.tsv").write_text("# note\nQ1\tP580\t+1990\n\nQ2\tP625\t@1/2\n")
    assert [tuple(r) for r in A.read_suggestions(spark, str(tmp_path / "s.tsv")).collect()] == [("Q1", "P580", "+1990"), ("Q2", "P625", "@1/2")]
    import hashlib

    (tmp_path / "pins").mkdir()
    (tmp_path / "pins" / "x.bin").write_bytes(b"abc")
    pins = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0")], "file string, sha256 string")
    assert {(r.file, r.ok) for r in A.check_pins(spark, str(tmp_path / "pins"), pins).collect()} == {("x.bin", True), ("y.bin", False)}
    rows = spark.createDataFrame([("a", "=x", 1.5), ("b", 'q"', None)], "id string, title string, lat double")
    A.write_csv(rows, str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for part in ("a-header", "b-rows") for p in sorted((tmp_path / "csv" / part).glob("part*"))).decode()
    assert text.startswith("﻿id,title,lat\r\n") and "a,'=x,1.5\r\n" in text and 'b,"q""",\r\n' in text
    A.write_json_export(rows, str(tmp_path / "json"), {"q": "x"}, "free")
    assert spark.read.json(str(tmp_path / "json" / "header")).first()["count"] == 2
    A.write_buckets(rows, str(tmp_path / "buckets"), 4)
    assert spark.read.json(str(tmp_path / "buckets")).count() == 2
    shuffled = rows.orderBy(F.desc("id"))
    assert A.content_version(rows).first() == A.content_version(shuffled).first() != A.content_version(rows.limit(1)).first()


def test_comparison_and_derivation(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        C.size_guard(df.limit(8), df)
    C.size_guard(df.limit(9), df)
    claims = F.array(*(F.struct(F.lit(t).alias("time"), F.lit(p).alias("precision"), F.lit(q).alias("property")) for t, p, q in (("1940-00-00", 9, "P585"), ("1940-01-01", 11, "P580"))))
    kept = one(spark, L.kept_precision(F.col("c"), F.lit("1940-01-01")), c=claims)
    assert (kept.precision, kept.property) == (11, "P580")
    assert one(spark, L.merged_labels(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == ["a", "b", "c"]
    reviews = spark.createDataFrame([("a", "h1", ["one", "two"]), ("b", "old", ["one"])], "id string, text_sha1 string, phrases array<string>")
    events = spark.createDataFrame([("a", "h1", "one here"), ("b", "new", "one")], "id string, text_sha1 string, text string")
    assert {(r.id, r.stale, tuple(r.phrases)) for r in L.review_findings(reviews, events).collect()} == {("a", False, ("one",)), ("b", True, ())}


def test_round_robin_spills_over(spark):
    df = spark.createDataFrame([(i, "s", "big" if i < 30 else "small") for i in range(32)], "id long, stratum string, grp string")
    got = W.round_robin(df, "stratum", "grp", 10).collect()
    assert len(got) == 10 and sum(r.grp == "small" for r in got) == 2


def test_missing_locations_are_numbered_in_parts(spark):
    """The same numbers as one sorted list, without a task that takes all rows."""
    from terrachron.operators import derive

    rows = [(f"e{i * 7919 % 1000:03}", None if i % 9 == 0 else i * 31 % 6, "none" if i % 7 else "precise") for i in range(1000)]
    events = spark.createDataFrame(rows, "id string, sitelinks_current long, location_quality string")
    out = derive.missing_locations(events, spark.createDataFrame([("e005",), ("e700",)], "id string"))
    want = sorted((r for r in rows if r[2] == "none" and r[0] not in ("e005", "e700")), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(x.id, x.sitelinks_current, x.place) for x in out.orderBy("place").collect()] == [(r[0], r[1], i) for i, r in enumerate(want, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(sitelinks_current" not in plan and "windowspecdefinition(_part" in plan


#: Words of the published description of the stemmer and of its rules, with their stems.
STEMS = """knackeries knackeri knightly knight happy happi generously generous dying die skies sky skis ski news news hopping hop hoping hope relational relat national nation adjustment adjust
arsenal arsenal succeed succeed exceed exceed proceeding proceed evening evening outing outing inning inning herring herring cries cri ties tie gas gas this this kiwis kiwi gaps gap luxuriated luxuri
controlling control bananas banana communism communism consignment consign consistency consist consolingly consol knots knot generate generat generic generic organization organiz universities universiti
easily easili replied repli flies fli geology geolog apology apolog battles battl sieges sieg revolutions revolut bombing bomb agreed agre added add egged egg boycotted boycot by by say say youth youth
sensational sensat traditional tradit callousness callous conformably conform differently differ analogously analog radically radic roll roll controll control nation's nation yes yes
early earli gently gentl past past pasted paste"""


def test_stems():
    from terrachron.functions.stemming import stem_word

    words = STEMS.split()
    assert {w: stem_word(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))
