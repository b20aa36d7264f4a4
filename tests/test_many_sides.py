"""Several sides interpolated in one order of time against one as-of join after another."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ephemera.operators.asof import Samples, interpolate_asof, interpolate_many

START = datetime(2025, 7, 6)


def tables(spark, seed):
    r = random.Random(seed)
    at = lambda: None if r.random() < 0.03 else START + timedelta(minutes=10 * r.randrange(9000))
    # "G1" has most rows, "G3" a single sample, "G4" none; times repeat
    key = lambda *more: r.choice([None, "G1", "G1", "G1", "G1", "G2", *more])
    left = [(key("G3", "G4"), at(), i, r.random()) for i in range(400)]
    a = [(key(), at(), None if r.random() < 0.1 else r.random(), r.random()) for _ in range(150)] + [("G3", START + timedelta(days=3), 1.0, 2.0)]
    b = [(key(), at(), None if r.random() < 0.3 else r.random()) for _ in range(60)] + [("G3", START + timedelta(days=3), 3.0)] + [("G2", START, 1.0), ("G2", START, 2.0)]
    return (spark.createDataFrame(x, s) for x, s in ((left, "k0 string, t timestamp_ntz, row int, x double"), (a, "k0 string, t timestamp_ntz, x double, y double"), (b, "k0 string, t timestamp_ntz, p double")))


def cells(df):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("bucket", [None, "day", "week"])
@pytest.mark.parametrize("edges", [("drop", "null"), ("clamp", "null"), ("null", "clamp"), ("drop", "drop")])
def test_equals_one_join_after_another(spark, bucket, edges):
    left, a, b = tables(spark, len(edges[0]) + len(edges[1]))
    got = interpolate_many(left, [Samples(a, ["x", "y"], edges[0]), Samples(b, ["p"], edges[1], skip_null=True, min_points=2)], "k0", "t", bucket)
    want = interpolate_asof(interpolate_asof(left, a, "k0", "t", ["x", "y"], edges[0]), b, "k0", "t", ["p"], edges[1], skip_null=True, min_points=2)
    assert sorted(got.columns) == sorted(want.columns) and cells(got.select(want.columns)) == cells(want) and want.count() > 50


def test_empty_sides_and_times(spark):
    left, a, b = tables(spark, 5)
    sides = lambda x, y: [Samples(x, ["y"], "null"), Samples(y, ["p"], "clamp")]
    for bucket in (None, "day"):
        none = interpolate_many(left, sides(a.limit(0), b.limit(0)), ["k0"], "t", bucket)
        assert none.count() == left.count() and none.where("y is not null or p is not null").count() == 0
        assert interpolate_many(left.limit(0), sides(a, b), "k0", "t", bucket).count() == 0
    given = interpolate_many(left, sides(a, b), "k0", "t", "day", times=left.select("k0", "t"))
    assert cells(given) == cells(interpolate_many(left, sides(a, b), "k0", "t"))
    with pytest.raises(ValueError, match="min_points"):
        interpolate_many(left, [Samples(a, ["y"], min_points=3)], "k0", "t")


def test_one_exchange_of_the_left_side(spark):
    left, a, b = tables(spark, 6)
    d = interpolate_many(left.withColumn("mark", F.expr("uuid()")), [Samples(a, ["y"]), Samples(b, ["p"], "null")], "k0", "t", "day", times=left.select("k0", "t"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("uuid(") == 1
