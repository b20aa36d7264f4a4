"""Percentiles of many groups at once: a hot group, null keys, ties, empty groups and names that clash."""

import random

import pytest
from pyspark.sql import functions as F

from ephemera.operators import evaluate, profile

Q = {"low": 0.05, "mid": 0.5, "high": 0.95}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    out = [("hot", 1, r.gauss(0, 1), float(i % 7)) for i in range(4000)]
    out += [(f"g{i % 60}", i % 2, r.choice([None, r.uniform(-9, 9), 5.0]), 1.0) for i in range(1500)]
    out += [(None, 3, float(i), None) for i in range(50)] + [("one", 1, 2.5, None), ("none", 1, None, None), ("none", None, None, None), ("big", 1, 1e300, 1.0), ("big", 1, -1e300, 1.0), ("big", 1, 0.0, 1.0)]
    return spark.createDataFrame(out, "g string, k0 int, value double, n double").repartition(6).cache()


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("slots", [4, 4096])
def test_percentiles_by_group(rows, most, slots):
    got = profile.percentiles(rows, ["value", "n"], Q, slots=slots, by=["g", "k0"], most=most)
    assert got.columns == ["g", "k0", "column", *Q]
    for c in ("value", "n"):
        plain = rows.where(F.col(c).isNotNull()).groupBy("g", "k0").agg(F.percentile(c, F.array(*map(F.lit, Q.values()))).alias("q"))
        want = {(r.g, r.k0): r.q for r in plain.collect()}
        found = {(r.g, r.k0): [r[x] for x in Q] for r in got.where(F.col("column") == c).collect()}
        assert found.keys() == want.keys()
        assert all(found[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)


@pytest.mark.parametrize("most", [100_000, 0])
def test_hot_groups_are_joined_where_they_are(spark, rows, monkeypatch, most):
    monkeypatch.setattr(profile, "MOST_GROUPS", most)
    monkeypatch.setattr(profile, "HUBS", 4)
    d = profile.with_percentiles(rows, ["g"], "value", {"mid": 0.5}, "found")
    assert d.columns == [*rows.columns, "found"] and d.count() == rows.count()
    want = {r.g: r.m for r in rows.groupBy("g").agg(F.percentile("value", F.lit(0.5)).alias("m")).collect()}
    assert {r.g: r.found and r.found.mid for r in d.select("g", "found").distinct().collect()} == pytest.approx(want)
    groups = profile.Groups(rows.groupBy("g").agg(F.count("*").alias("n")))
    assert [r.g for r in groups.hubs.collect()] == ["hot"] and groups.few == (most > 0)


def test_classes(rows):
    d = rows.withColumnRenamed("value", "y").withColumn("y_hat", F.col("y") * 0.5)
    got = evaluate.tercile_classes(d, ["g"])
    b = d.groupBy("g").agg(F.percentile("y", F.array(F.lit(0.33), F.lit(0.66))).alias("q"))
    name = lambda c: F.when(F.col(c) <= F.col("q")[0], "low").when(F.col(c) <= F.col("q")[1], "medium").when(F.col(c).isNotNull(), "high")
    want = d.alias("d").join(b.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select(*d.columns, name("y").alias("true_class"), name("y_hat").alias("predicted_class"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == rows.count()


def test_empty(rows):
    assert profile.percentiles(rows.limit(0), ["value"], Q, by=["g"]).count() == 0
    assert evaluate.tercile_classes(rows.limit(0).withColumnRenamed("value", "y").withColumn("y_hat", F.lit(1.0)), ["g"]).count() == 0
