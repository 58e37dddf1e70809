"""The pipeline's stages: columns, effects of their decisions, whole inputs."""

import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import __spark_entry__  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[1] == ids[2] and ids[4] == ids[5]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


CLASHES = ["score", "predicted", "_lines", "_hash", "_id", "_bucket", "_dropped", "_nth", "row", "hash", "id", "nth", "bucket", "dropped", "n_lines", "found_id", "keep", "a.b", "salt"]


def test_stages_on_odd_tables(spark):
    """Null ids and texts, empty and very long texts, repeated rows, an id of two texts, clashing columns, empty tables."""
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    long_text = " ".join(f"word{k % 9001} of" for k in range(120_000))
    texts = [(None, "alpha beta gamma delta and more"), (1, None), (2, "same text here now"), (2, "same text here now"), (2, "other text here then"), (3, ""), (4, "  \n\n"), (5, long_text)]
    rows = [(i, t, 0, *CLASHES) for i, t in texts]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, none, SF).count() == 0, name
        got = out.collect()
        assert all([r[c] for c in CLASHES] == CLASHES for r in got), name
        ids = [r.doc_id for r in got]
        if name == "line dedup":
            assert len(got) == len(rows) and [r.text for r in got if r.doc_id == 5] == [long_text] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        if name == "simhash near-dedup":
            assert sorted(i or 0 for i in ids) == [0, 1, 2, 2, 5]
        if name == "benchmark decontamination":
            assert len(got) == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_line_dedup_stage_loses_no_link(spark):
    """Of each pair of long lines at a similarity of 0.8 the second goes."""
    r = random.Random(8)
    rows = []
    for k in range(300):
        line = [f"w{r.randrange(10**6)}" for _ in range(100)]
        near = [f"new{r.randrange(10**6)}" if i in picked else w for picked in [{*r.sample(range(100), 20)}] for i, w in enumerate(line)]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(near))]
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert all(got[i] == (text if i % 2 == 0 else "") for i, text in rows)


def test_registered():
    every = __spark_entry__.queries()
    assert "pipeline" in every and all(any(n.startswith(f"op{k}_") for n in every) for k in range(1, 11))
