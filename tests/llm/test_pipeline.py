"""The pipeline stage by stage, and its guard in the entry module."""

import corpus_pipeline
import pytest
from brute import components, contamination, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SF).cache()))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_each_stage(spark, stages):
    a, b, c, d, e = (stages[n] for n, _ in corpus_pipeline.STAGES)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(texts(a).keys() & good) >= 0.97 * len(good) and len(texts(a).keys() & bad) <= 0.2 * len(bad) + 1
    assert set(texts(b)) == {x[2] for x in components(texts(a).items())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts(c)) == {x[0] for x in contamination(texts(b).items(), items) if not x[4]}
    assert set(texts(d)) == set(texts(c)) and not any(pii(t) for t in texts(d).values())
    assert {r.doc_id for r in e.select("doc_id").distinct().collect()} == set(texts(d))


def test_run(spark, stages):
    last = stages[corpus_pipeline.STAGES[-1][0]]
    out = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert out.columns == last.columns and {r.doc_id for r in out.select(*key).collect()} == {r.doc_id for r in last.select(*key).collect()}


def test_entry_has_the_queries():
    import __spark_entry__

    assert {"pipeline", "op1_benchmark_decontamination"} <= set(__spark_entry__.queries())
