"""Derivation, titles, stale notes, bounded relations, overlaps and place walks on literal cases and against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrachron.functions import overlap
from terrachron.operators import joins as J
from terrachron.operators import notes as N
from terrachron.operators import places as P
from terrachron.operators import quality as K
from terrachron.operators import records as R
from terrachron.operators import relate
from terrachron.operators import report as G
from terrachron.operators import titles

#: (note, start, end, precision, extract, why): notes as the sources write them.
NOTES = [
    ("date_order_invalid: Wikidata start (1921-04-01) is after end (1921-03-31); shown as Wikidata gives them", "1921-04-01", "1921-03-31", "day", "", None),
    ("date_order_invalid: Wikidata start (1921-04-01) is after end (1921-03-31); shown as Wikidata gives them", "1921-04-01", "1921-03-30", "day", "", "other values"),
    ("date_order_invalid: Wikidata start (1979-02-11) is after end (1970-01-01, year precision); shown as Wikidata gives them", "1979-02-11", "1970-01-01", "day", "", None),
    ("date_order_invalid: date_end (2001-01-01) precedes date_start (2002-01-01) in source Wikidata", "2002-01-01", "2001-01-01", "day", "", None),
    ("date_order_invalid: date_end (2001-01-01) precedes date_start (2002-01-01) in source Wikidata", "2002-01-01", "2003-01-01", "day", "", "in order"),
    ("date_end_precision_coarse: Wikidata end time 2002-01-01 has only year precision (the year runs to 2002-12-31), so it is not before the start (2002-03-27); stored as Wikidata gives it", "2002-03-27", "2002-01-01", "day", "2002", None),
    ("date_end_precision_coarse: Wikidata end time 2002-01-01 has only year precision (the year runs to 2002-12-31), so it is not before the start (2002-03-27)", "2002-03-27", "2002-12-31", "day", "2002", "in order"),
    ("date_end_precision_coarse: Wikidata end time 1970-01-01 has only year precision (the year runs to 1970-12-31), so it is not before the start (1970-03-27)", "1979-02-11", "1970-01-01", "day", "", "other values"),
    ("wikipedia_dates_note: Wikipedia lead mentions 2 August 1990; Wikidata gives 1990-08-02 to 1990-01-01", "1990-08-02", "1990-01-01", "day", "", None),
    ("wikipedia_dates_note: Wikipedia lead mentions years 1980; Wikidata gives 1990-08-02 to 1990-01-01 (start year 1990 not in lead)", "1990-08-02", "1990-01-01", "day", "", None),
    ("wikipedia_dates_note: Wikipedia lead mentions years 1980; Wikidata gives 1990-08-02 to 1990-01-01 (start year 1989 not in lead)", "1990-08-02", "1990-01-01", "day", "", "other values"),
    ("wikipedia_dates_note: Wikipedia lead mentions years 1980; Wikidata gives 1990-08-02", "1990-08-02", "1990-01-01", "day", "", "other values"),
    ("wikipedia_dates_note: Wikipedia lead mentions years 1980; Wikidata gives 1990-08-02 to 1990-01-01", "1990-08-02", "1991-01-01", "day", "", "in order"),
    ("date_start_year_not_in_lead: start year 2014 (2014-06-05) is not within 1 year of any year in the Wikipedia lead [2001]", "2014-06-05", None, "day", "In 2001", None),
    ("date_start_year_not_in_lead: start year 2014 (2014-06-05) is not within 1 year of any year in the Wikipedia lead [2001]", "2014-06-05", None, "day", "In 2013", "in lead"),
    ("date_start_year_not_in_lead: start year 2014 (2014-06-05) is not within 1 year", "2014-06-06", None, "day", "In 2001", "other values"),
    ("date_source_adjusted: x; used P580 start time 2014-06-05", "2014-06-05", None, "day", "", None),
    ("date_source_adjusted: x; used P580 start time 2014-06-00", "2014-06-01", None, "month", "", None),
    ("date_source_adjusted: x; used P580 start time 2014-06-04", "2014-06-05", None, "day", "", "other values"),
    ("category_year_mismatch: Wikipedia year categories mention [1958] but none is within 1 year of 2014", "2014-06-05", None, "day", "", None),
    ("category_year_mismatch: Wikipedia year categories mention [2014] but none is within 1 year of 2020", "2014-06-05", None, "day", "", "other values"),
    ("category_year_mismatch: Wikipedia year categories mention [2015] but none is within 1 year of 2014", "2014-06-05", None, "day", "", "listed"),
    ("category_year_mismatch: Wikipedia year categories mention [1990] but none is within 1 year of 2014-2016", "2014-06-05", "2016-01-01", "day", "", None),
    ("category_year_mismatch: Wikipedia year categories mention [1990] but none is within 1 year of 2014-2015", "2014-06-05", "2016-01-01", "day", "", "other values"),
    ("date_year_mismatch: date_start year (2013) not found (within 1 year) in Wikipedia extract", "2014-06-05", None, "day", "", "other values"),
    ("date_year_mismatch: date_start year (2014) not found (within 1 year) in Wikipedia extract", "2014-06-05", None, "day", "", None),
    ("date_end_year_mismatch: date_end year (2014) not found (within 1 year)", "2013-06-05", "2015-01-01", "day", "", "other values"),
    ("date_end_year_mismatch: date_end year (2015) not found (within 1 year)", "2013-06-05", "2015-01-01", "day", "", None),
    ("unverified_date: no year appears in the Wikipedia extract and category years [1990] do not confirm 2014; x", "2013-06-05", None, "day", "", "other values"),
    ("unverified_date: no year appears in the Wikipedia extract and no year category is available", "2013-06-05", None, "day", "", None),
    ("month_precision_day_in_lead: date_start 2023-05-01 has only month precision in Wikidata, but ...", "2023-05-01", None, "month", "", None),
    ("month_precision_day_in_lead: date_start 2014-06-05 has only month precision in Wikidata, x", "2014-06-05", None, "day", "", "other values"),
    ("date_precision_coarse: Wikidata records the date only to century precision", "1901-01-01", None, "century", "", None),
    ("date_precision_coarse: Wikidata records the date only to century precision", "1901-01-01", None, "day", "", "other values"),
    ("data_fix F1: set by hand", "1901-01-01", None, "day", "", None),
    ("date_order_invalid: Wikidata start (x) is after end (y)", "someday", "1900-01-01", "day", "", None),
]


def test_stale_notes(spark):
    rows = spark.createDataFrame([(i, *n[:5]) for i, n in enumerate(NOTES)], "i int, note string, date_start string, date_end string, date_precision string, extract string")
    got = rows.withColumn("n", N.parse_note(F.col("note"))).select("i", N.stale_note(F.col("n")).alias("why")).collect()
    assert {x.i: x.why for x in got} == {i: n[5] for i, n in enumerate(NOTES)}


def test_stale_findings_name_their_list(spark):
    df = spark.createDataFrame([("2014-06-05", None, "day", "", [NOTES[18][0], NOTES[20][0]], [NOTES[20][0], NOTES[18][0]])], "date_start string, date_end string, date_precision string, extract string, date_flags array<string>, review_reasons array<string>")
    got = df.select(F.inline(N.stale_note_findings())).collect()
    assert [(x.level, x.code, x.msg) for x in got] == [("error", "stale_date_flag", "date_source_adjusted: other values"), ("warning", "stale_review_reason", "category_year_mismatch: other values")]


def test_replaced_notes_keep_their_place(spark):
    made = [[], ["a"], ["x"], ["a", "x", "b"]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "i int, codes array<string>").withColumn("notes", F.transform("codes", lambda c: F.struct(c.alias("code"), F.create_map().cast("map<string,string>").alias("facts"))))
    fresh, none = F.array(R.note("x", k=F.lit(1))), R.no_notes()
    got = df.orderBy("i").select(R.codes(R.replaced(F.col("notes"), "x", fresh)).alias("a"), R.codes(R.replaced(F.col("notes"), "x", none)).alias("b")).collect()
    assert [x.a for x in got] == [["x"], ["a", "x"], ["x"], ["a", "x", "b"]] and [x.b for x in got] == [[], ["a"], [], ["a", "b"]]
    assert spark.range(1).select(R.note_text(R.note("c", b=F.lit(2), a=F.lit(None)))).first()[0] == "c: a unknown, b 2"


def test_steps_tell_who_set_a_field(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    steps = [("one", lambda: {"x": F.col("x") + 1}), ("two", lambda: {"x": F.col("x") * 1, "y": F.lit("b")})]
    row = R.derive(df, steps, ("x", "y")).first()
    assert (row.x, row.y, row.set_by.x, row.set_by.y) == (2, "b", "one", "two")


def test_titles_given_up_are_free_for_later_changes(spark):
    """A chain: 1 leaves A; 2 takes A and leaves B; 3 takes B; 0 asks for B too early; 4 asks for A too late; 5 and 6 want each other's."""
    held = {"0": "Z", "1": "A", "2": "B", "3": "C", "4": "D", "5": "E", "6": "F"}
    asked = {"0": "B", "1": "N", "2": "A", "3": "B", "4": "A", "5": "F", "6": "E"}
    records = spark.createDataFrame([(i, t, "u") for i, t in held.items()], "id string, title string, wikipedia_url string")
    rows = [(i, held[i], "u", asked[i], "u", 1, "title_stale", None) for i in held]
    changes = spark.createDataFrame(rows, "id string, old_title string, old_url string, new_title string, new_url string, article_page int, kind string, hold string")
    got = {x.id: x.outcome for x in titles.outcomes(records, changes).collect()}
    assert got == {"0": "duplicate", "1": "applied", "2": "applied", "3": "applied", "4": "duplicate", "5": "duplicate", "6": "duplicate"}


def test_places_take_the_nearest_claims(spark):
    claims = spark.createDataFrame([("top", "X", True, True), ("top", "O1", False, True), ("top", "O2", False, True), ("mid", "Y", True, True), ("mid", "Old", False, False)], "place string, country string, tracked boolean, sovereign boolean")
    within = spark.createDataFrame([("leaf", "mid"), ("mid", "top"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "top"), ("lost", "lost"), ("r1", "r2"), ("r2", "r1")], "place string, parent string")
    got = {x.place: (x.inside, x.outside, x.lends, x.tags) for x in P.place_tags(claims, within).collect()}
    top, mid = (1, 2, False, ["X"]), (1, 0, True, ["Y"])
    assert got == {"top": top, "mid": mid, "leaf": mid, "a": top, "b": top, "c": top}
    records = spark.createDataFrame([("e", ["X", "Y", "Z"], ["Z"]), ("f", ["X", "Y"], ["X"])], "id string, countries array<string>, direct array<string>")
    at = spark.createDataFrame([("e", "a"), ("e", "leaf"), ("f", "a")], "id string, place string")
    assert {x.id: (x.countries, x.removed) for x in P.outside_tags(records, at, P.place_tags(claims, within)).collect()} == {"e": (["Y", "Z"], ["X"]), "f": (["X", "Y"], [])}


def test_neighbours_against_all_pairs(spark):
    r = random.Random(1)
    rows = [(f"e{i}", f"{r.randint(1990, 1996)}-01-01", r.sample([f"c{k}" for k in range(12)], r.randint(0, 12))) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, date_start string, countries array<string>")
    want = {a[0]: sum(b[0] != a[0] and bool(set(a[2]) & set(b[2])) and abs(int(a[1][:4]) - int(b[1][:4])) <= 1 for b in rows) for a in rows}
    for most in (8, 3):
        assert {x.id: x.n for x in relate.neighbours(df, most_tags=most).collect()} == {k: v for k, v in want.items() if v}


def top(pairs, n=5):
    by = defaultdict(list)
    for x in pairs.collect():
        by[x.id].append((x.d is None, x.d, x.other))
    return {k: [o for *_, o in sorted(v)[:n]] for k, v in by.items()}


def test_nearest_in_space_has_the_nearest(spark):
    """Scattered and crowded records, many at one point: the first five are those of all pairs."""
    r = random.Random(5)
    points = [(r.uniform(0, 6), r.uniform(30, 34)) for _ in range(150)] + [(2 + r.uniform(0, 0.02), 32 + r.uniform(0, 0.02)) for _ in range(80)] + [(2.01, 32.01)] * 60 + [(2.4, 32.0)] * 3
    rows = [(f"e{i:03}", x, y, "precise" if i % 17 else "none") for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double, location_quality string")
    skipped = df.select("id", F.lit(0).alias("k"))
    assert top(relate.nearest_in_space(df, skipped)) == top(relate.nearby(df))


@pytest.mark.parametrize("small", [40, 3])
def test_nearest_siblings_have_the_nearest(spark, small):
    r = random.Random(6)
    rows = [(f"e{i:03}", f"Q{i + 1}", r.choice(["Q9001", "Q9002", None]), r.choice([None, f"2000-01-{r.randint(1, 28):02}", f"2000-0{r.randint(1, 9)}-01", "2000-05-05"])) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, wikidata_qid string, parent_qid string, date_start string")
    skipped = df.select("id", F.lit(0).alias("k"))
    assert top(relate.nearest_siblings(df, skipped, small=small)) == top(relate.shared_parent(df))


def test_contained_groups(spark):
    members = {"A": "abc", "B": "ab", "C": "ab", "D": "bd", "E": "d", "F": "xyz"}
    df = spark.createDataFrame([(g, m) for g, ms in members.items() for m in ms], "group_qid string, id string")
    want = {(a, b) for a in members for b in members if a != b and set(members[a]) <= set(members[b]) and (len(members[b]) > len(members[a]) or b < a)}
    assert {(x.a, x.b) for x in relate.contained(df).collect()} == want


def ring(*points):
    return [{"lon": x, "lat": y} for x, y in points]


def test_shared_parts():
    square = [[ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))]]
    hole = [[ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((2, 2), (8, 2), (8, 8), (2, 8), (2, 2))]]
    box = lambda w, s, e, n: overlap.EARTH_KM**2 * math.radians(e - w) * (math.sin(math.radians(n)) - math.sin(math.radians(s)))
    band = [[ring((-1, 4), (11, 4), (11, 6), (-1, 6), (-1, 4))]]
    assert overlap.shared_parts(square, band) == pytest.approx([box(0, 4, 10, 6)])
    assert overlap.shared_parts(hole, band) == pytest.approx([box(8, 4, 10, 6), box(0, 4, 2, 6)])
    diamond = [[ring((5, -5), (15, 5), (5, 15), (-5, 5), (5, -5))]]
    assert overlap.shared_parts(square, diamond) == pytest.approx([box(0, 0, 10, 10)])
    corner = [[ring((5, 5), (15, 5), (5, 15), (5, 5))]]
    assert sum(overlap.shared_parts(square, corner)) == pytest.approx(box(5, 5, 10, 10), rel=1e-3)
    cross = [[ring((-5, 0), (5, 0), (-5, 10), (5, 10), (-5, 0))]]  # crosses itself
    assert len(overlap.shared_parts(square, cross)) == 2
    assert overlap.shared_parts(square, [[ring((10, 0), (20, 0), (20, 10), (10, 10), (10, 0))]]) == [] and overlap.shared_parts(square, []) == []


def test_fewest_years_against_the_greedy_rule(spark):
    r = random.Random(7)
    spans = [(s := r.randint(1900, 1990), s + r.randint(0, 15)) for _ in range(200)]
    chosen = []
    for s, e in sorted(spans, key=lambda p: (p[1], p[0])):
        if not chosen or s > chosen[-1]:
            chosen.append(e)
    df = spark.createDataFrame(spans, "start_year int, end_year int")
    assert sorted(x.year for x in G.minimum_years(df).collect()) == chosen
    assert G.minimum_years(df.limit(0)).count() == 0


def test_gate(spark):
    found = spark.createDataFrame([("a", "warning", "x"), ("b", "warning", "y")], "id string, level string, code string")
    base = found.select("id", "code")
    K.enforce(found, base)
    with pytest.raises(ValueError, match="0 errors and 1 warnings"):
        K.enforce(found, base.where("id = 'a'"))


def test_by_priority_of_nothing(spark):
    none = spark.createDataFrame([], "id string, other string, d double")
    assert J.by_priority([("a", none), ("b", none)], 5).count() == 0
