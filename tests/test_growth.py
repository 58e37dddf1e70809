"""Relations, borders and texts that grow: equal to brute force, and no pairs where counts do."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terrachron.functions import spatial
from terrachron.functions.masks import met_by_year
from terrachron.operators import borders, derive, relate
from terrachron.operators.records import with_sources
from terrachron.plans import QUERIES, SQL
from terrachron.session import CLEANUP, settle


def test_same_time_sums_without_pairs(spark):
    rnd = random.Random(4)
    rows = [(f"e{rnd.randrange(60)}", f"{rnd.choice((1999, 2000))}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 28):02}", rnd.choice(("day", "day", "month"))) for _ in range(90)]
    df = spark.createDataFrame(rows, "id string, date_start string, date_precision string")
    want = {tuple(r) for r in relate.same_time(df).groupBy("id").agg(F.count("*"), F.sum("d")).collect()}
    assert {tuple(r) for r in relate.same_time_sums(df).collect()} == want and len({r[0] for r in rows}) < len(rows)
    crowd = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.lit("2000-02-03").alias("date_start"), F.lit("day").alias("date_precision"))
    sums = relate.same_time_sums(crowd).agg(F.count("*"), F.min("n"), F.max("n"), F.max("d")).first()
    assert tuple(sums) == (200_000, 199_999, 199_999, 0.0)


def test_related_is_brute_force_and_follows_records(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        day = f"{rnd.choice((1999, 2000))}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 28):02}" if i % 3 else "2000-05-05"
        at = (10.0 + rnd.randrange(3) / 100, 50.0) if i % 4 else (rnd.uniform(9, 11), rnd.uniform(49, 51))
        rows.append((f"e{i}", f"Q{i + 1}", f"Q{rnd.choice((1, 2, 3, 7 + i // 9))}" if i % 5 else None, "t", day, rnd.choice(("day", "day", "year")), *at, rnd.choice(("precise", "precise", "none"))))
    columns = "id string, wikidata_qid string, parent_qid string, title string, date_start string, date_precision string, lon double, lat double, location_quality string"
    df = spark.createDataFrame(rows, columns)
    pairs = lambda found: {(r.id, r.other): r.d for r in found.collect()}
    groups = {"shared_parent": pairs(relate.shared_parent(df)), "nearby": pairs(relate.nearby(df)), "same_time": pairs(relate.same_time(df))}
    item = {r[1]: r[0] for r in rows}
    own = {(r[0], item[r[2]]) for r in rows if r[2] in item and r[2] != r[1]}
    taken, want = own | {(b, a) for a, b in own}, set()
    for name, found in groups.items():
        shown = set()
        for i in {a for a, _ in found}:
            fit = sorted(((float("inf") if d is None else d), o) for (a, o), d in found.items() if a == i and (a, o) not in taken)
            shown |= {(i, o, name, k + 1) for k, (_, o) in enumerate(fit[:5])}
        taken, want = taken | {x[:2] for x in shown}, want | shown
    out = relate.related(df)
    assert {tuple(r) for r in out.select("id", "other", "grp", "place").collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_neighbours_in_crowded_years(spark):
    rnd = random.Random(6)
    names = [f"c{k}" for k in range(14)]
    rows = [(f"e{i}", f"{rnd.randint(1990, 1994)}-01-01", [*rnd.sample(names, rnd.choice((0, 1, 3, 9, 12))), None][: rnd.choice((14, 99))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, date_start string, countries array<string>")
    sets = [(i, int(y[:4]), {c for c in tags if c}) for i, y, tags in rows]
    want = {i: sum(j != i and bool(a & b) and abs(x - y) <= 1 for j, y, b in sets) for i, x, a in sets}
    want = {k: v for k, v in want.items() if v}
    assert {r.id: r.n for r in relate.neighbours(df).collect()} == want
    assert {r.id: r.n for r in relate.neighbours(df, mask_tags=13).collect()} == want
    batch = pa.RecordBatch.from_pydict({"y": [1] * 40_000 + [1] * 3, "asked": [0] * 40_000 + [1] * 3, "mask": [*range(40_000), 0, 1, 2**16 - 1], "n": [1] * 40_003})
    met = [x for b in met_by_year(16)(iter([batch])) for x in b.column("met").to_pylist()]
    assert met == [0, 20_000, 39_999]
    many = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.lit("2000-01-01").alias("date_start"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.concat(F.lit("c"), ((F.col("id") * 7919 + k * k * 31 + k) % 25).cast("string"))).alias("countries"))
    assert relate.neighbours(many).agg(F.count("*")).first()[0] == 60_000  # sets of up to twelve: country by country they met each other


def test_border_checks_of_many_areas_are_their_sql(spark, tmp_path):
    keys = [k + turn for turn in (0, 2048, 4096, 90_112) for k in range(1, 15)]
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64())}), tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    got = QUERIES["k44_border_checks"](spark, str(tmp_path)).select("check", "name", "start_year", "finding").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f'SELECT "check", name, start_year, finding FROM ({SQL["k44_border_checks"]})').fetchall())


def test_boxes_of_all_sizes_meet_once(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(90):
        x, y, side = rnd.uniform(-5, 5), rnd.uniform(-5, 5), rnd.choice((0.0, 0.25, 1.0, rnd.uniform(0.01, 4), 30.0 if i % 30 == 0 else 2.0))
        rows.append((f"n{i // 2}", None, 1990 + i % 2 * rnd.choice((1, 5)), 1990 + rnd.choice((4, 9)), {"w": x, "s": y, "e": x + side, "n": y + side / 2}))
    of = ["name", "status", "start_year", "end_year"]
    df = spark.createDataFrame(rows, "name string, status string, start_year int, end_year int, _box struct<w:double,s:double,e:double,n:double>")
    years = (F.col("start_year") <= F.col("end_year2")) & (F.col("start_year2") <= F.col("end_year"))
    want = set()
    for a in rows:
        for b in rows:
            p, q = a[4], b[4]
            touch = p["w"] < q["e"] and q["w"] < p["e"] and p["s"] < q["n"] and q["s"] < p["n"]
            if (a[0], a[2]) < (b[0], b[2]) and a[2] <= b[3] and b[2] <= a[3] and touch:
                want.add((*a[:4], *b[:4]))
    got = [tuple(r) for r in borders.touching_boxes(df, of, years).collect()]
    assert set(got) == want and len(got) == len(want)


def test_crossings_are_not_broadcast(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": pa.array(range(50), pa.int64())}), tmp_path / "customer.parquet")
    found = QUERIES["k43_geometry_findings"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_nearby_makes_pairs_last(spark, monkeypatch):
    monkeypatch.setattr(relate, "IDS_IN_ROW", 3)
    rnd = random.Random(8)
    points = [(rnd.uniform(9, 11), rnd.uniform(49, 51)) for _ in range(12)]
    rows = [(f"e{i}", *rnd.choice(points), rnd.choice(("precise", "precise", "none"))) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double, location_quality string")
    placed = df.where("location_quality = 'precise'").select("id", "lon", "lat")
    d = spatial.haversine_km("lon", "lat", "x2", "y2")
    every = placed.crossJoin(placed.toDF("other", "x2", "y2")).where("id <> other").withColumn("d", d).where("d <= 50").select("id", "other", F.round("d", 4).alias("d"))
    got = relate.nearby(df, places=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(others") < plan.index("Join") and "Broadcast" not in plan


def test_lead_dates_are_read_once_for_each_text(spark):
    plan = QUERIES["l05_finalized"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("regexp_extract_all")
    rows = spark.createDataFrame([("a", None), ("b", ["1999", "2001"])], "id string, lead_dates array<string>")
    rows = rows.select("*", F.lit("2000-02-01").alias("date_start"), F.lit("2000-01-01").alias("date_end"), F.array(F.lit("war")).alias("wikidata_classes"), F.lit("none").alias("location_quality"))
    told = {r.id: (r.lead_dates, r.date_flags) for r in derive.finalize(rows).collect()}
    assert told == {"a": ([], ["date_order_invalid: 2000-01-01 precedes 2000-02-01"]), "b": (["1999", "2001"], ["date_order_invalid: 2000-01-01 precedes 2000-02-01; lead: 1999, 2001"])}


def test_settled_steps_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = lambda: {f for f in map(str, (x.getName() for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files()))) if f.startswith("shuffle_")}
    before = shuffles()
    kept = settle(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")))
    assert shuffles() <= before and spark.conf.get(CLEANUP) == "false" and kept.count() == 7



def test_sources_are_found_for_records_of_no_item(spark):
    records = spark.createDataFrame([("a", "Q1", "https://en.wikipedia.org/wiki/A", "t"), ("b", None, "https://en.wikipedia.org/wiki/B", "t"), ("c", "Q1", None, "C")], "id string, wikidata_qid string, wikipedia_url string, title string")
    entities = spark.createDataFrame([("Q1", 1)], "wikidata_qid string, x int")
    leads = spark.createDataFrame([("A", "la"), ("B", "lb"), ("C", "lc")], "article string, extract string")
    ledger = spark.createDataFrame([("Q1", "F1")], "wikidata_qid string, ref string")
    got = {r.id: (r.entity and r.entity.x, r.lead and r.lead.extract, r.fix and r.fix.ref) for r in with_sources(records, entities, leads, ledger).collect()}
    assert got == {"a": (1, "la", "F1"), "b": (None, "lb", None), "c": (1, "lc", "F1")}
