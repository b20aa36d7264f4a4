import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ephemera.operators import asof
from ephemera.operators.asof import cross_times, interpolate_asof, nearest_asof, snap_to_grid

T0 = datetime(2025, 7, 6, 12, 0, 0)
H, M = timedelta(hours=1), timedelta(minutes=1)


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"satellite string, timestamp timestamp_ntz{extra}")


@pytest.mark.parametrize("bucket", [None, "hour", "day", "week"])
def test_nearest(spark, bucket):
    left = frame(spark, [("G01", T0 - 2 * H), ("G01", T0 - 2 * H - timedelta(microseconds=1)), ("G01", T0 + H), ("G01", T0 + 4 * H), ("G01", T0), ("G02", T0), (None, T0), ("G01", None)])
    right = frame(spark, [("G01", T0, 1.0), ("G01", T0 + 2 * H, 2.0), ("G01", T0 + 2 * H, 3.0), (None, T0, 9.0)], ", v double")
    got = {r.timestamp: (r.v, r.age_s) for r in nearest_asof(left, right, "satellite", "timestamp", 7200, bucket=bucket).collect()}
    assert got == {T0 - 2 * H: (1.0, 7200.0), T0 + H: (1.0, 3600.0), T0 + 4 * H: (2.0, 7200.0), T0: (1.0, 0.0)}
    full = nearest_asof(left, right, "satellite", "timestamp", 7200, how="left", bucket=bucket)
    assert full.count() == 8 and full.where("v is null").count() == 4


@pytest.mark.parametrize("bucket", [None, "hour"])
def test_interpolation_policies(spark, bucket):
    right = frame(spark, [("G01", T0 + 15 * M * i, 26560000.0 + 1000 * i) for i in range(5)], ", x double")
    left = frame(spark, [("G01", T0 + 7.5 * M * i) for i in range(-1, 10)])
    go = lambda **k: {r.timestamp: r.x for r in interpolate_asof(left, right, "satellite", "timestamp", ["x"], bucket=bucket, **k).collect()}
    got = go(edge="drop")
    assert got == {T0 + 7.5 * M * i: 26560000.0 + 500 * i for i in range(9)}
    assert go(edge="null")[T0 - 7.5 * M] is None
    clamped = go(edge="clamp")
    assert clamped[T0 - 7.5 * M] == 26560000.0 and clamped[T0 + 67.5 * M] == 26564000.0
    assert set(go(edge="null", min_points=6).values()) == {None}


def test_null_samples(spark):
    right = frame(spark, [("G01", T0, 1.0), ("G01", T0 + H, None), ("G01", T0 + 2 * H, 3.0), ("G02", T0, 5.0)], ", c double")
    left = frame(spark, [("G01", T0 + H), ("G02", T0), ("G03", T0)])
    got = {r.satellite: r.c for r in interpolate_asof(left, right, "satellite", "timestamp", ["c"], "null", skip_null=True, min_points=2).collect()}
    assert got == {"G01": 2.0, "G02": None, "G03": None}


def test_empty_sides(spark):
    some, none = frame(spark, [("G01", T0, 1.0)], ", v double"), frame(spark, [], ", v double")
    assert nearest_asof(none.drop("v"), some, "satellite", "timestamp", 1).count() == 0
    assert nearest_asof(some.drop("v"), none, "satellite", "timestamp", 1, how="left").first().v is None


@pytest.mark.parametrize("tolerance", [60.0, 600.0])
def test_grid(spark, tolerance):
    rows = [("G01", T0 + 7 * M, 1.0), ("G01", T0 + 15 * M + timedelta(seconds=40), 2.0), ("G01", T0 + 15 * M - timedelta(seconds=40), 3.0), ("G01", T0 + 45 * M, 4.0)]
    got = {r.timestamp: r.v for r in snap_to_grid(frame(spark, rows, ", v double"), "satellite", "timestamp", 15, tolerance).collect()}
    want = {T0 + 15 * M: 3.0, T0 + 45 * M: 4.0}
    assert got == (want if tolerance == 60 else want | {T0: 1.0})


def test_cross_times(spark):
    d = frame(spark, [("G01", T0), ("G02", T0), ("G02", T0 + H)])
    assert cross_times(d, d).count() == 4


NAMES = ["k", "t", "b", "kind", "row", "p", "k0", "A.b"]


@pytest.mark.parametrize("key", NAMES)
def test_any_name_of_the_key(spark, key):
    left = spark.createDataFrame([(1, "1970-01-05 10:00:20", 5), (2, "1970-01-05 10:00:20", 6), (1, "1970-01-07 10:00:00", 7), (None, "1970-01-05 10:00:20", 8)], "key int, time string, id int")
    right = spark.createDataFrame([(1, "1970-01-05 10:00:00", "one"), (2, "1970-01-05 10:00:30", "two"), (1, "1970-01-07 10:00:40", "one-late"), (2, "1970-01-09 00:00:00", "two-late")], "key int, time string, what string")
    naive = lambda d: d.withColumn("time", F.col("time").cast("timestamp_ntz")).withColumnRenamed("key", key)
    want = [(5, "one", 20.0), (6, "two", 10.0), (7, "one-late", 40.0)]
    for bucket in (None, "day"):
        got = asof.nearest_asof(naive(left), naive(right), key, "time", 60, bucket=bucket)
        assert sorted((r.id, r.what, r.age_s) for r in got.collect()) == want
        assert got.columns == [key, "time", "id", "time_right", "what", "age_s"]
        values = naive(right).withColumn("x", F.length("what").cast("double"))
        line = asof.interpolate_asof(naive(left), values, key, "time", ["x"], "clamp", min_points=2, bucket=bucket)
        assert {r.id: r.x for r in line.collect()} == pytest.approx({5: 3 + 5 * 20 / 172840, 6: 3.0, 7: 8 - 5 * 40 / 172840, 8: None})
    snapped = asof.snap_to_grid(naive(right), key, "time")
    assert sorted(r.what for r in snapped.collect()) == ["one", "one-late", "two", "two-late"]
    assert snapped.columns == [key, "time", "what"]


@pytest.mark.parametrize("bucket", ["hour", "day", "week"])
def test_bucketed_equals_plain_on_random_series(spark, bucket):
    r = random.Random(bucket)
    when = lambda: (r.randrange(4), r.randrange(40 * 86400))
    left = spark.createDataFrame([(*when(), k) for k in range(300)] + [(9, 5, 900), (None, 5, 901), (1, None, 902)], "k int, sec int, id int")
    right = spark.createDataFrame([(*when(), float(k)) for k in range(120)], "k int, sec int, x double")
    timed = lambda d: d.withColumn("time", F.timestamp_add("SECOND", F.col("sec"), F.lit("2024-01-01").cast("timestamp_ntz"))).drop("sec")
    for f in (
        lambda b: asof.nearest_asof(timed(left), timed(right), "k", "time", 86400 * 3, how="left", bucket=b),
        lambda b: asof.interpolate_asof(timed(left), timed(right), "k", "time", ["x"], "clamp", bucket=b),
        lambda b: asof.interpolate_asof(timed(left), timed(right), "k", "time", ["x"], "drop", bucket=b),
        lambda b: asof.interpolate_asof(timed(left), timed(right), "k", "time", ["x"], "null", bucket=b, times=timed(left.unionByName(left.withColumn("sec", F.col("sec") + 900_000)))),
    ):
        plain, cut = f(None), f(bucket)
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect())) and plain.count() > 100


def test_every_key_at_every_time(spark):
    s = spark.createDataFrame([("G01", "2024-01-01 00:00", 0.0), ("G01", "2024-01-01 01:00", 6.0), ("G02", "2024-01-01 00:30", 2.0), ("G02", "2024-01-01 00:40", None)], "satellite string, timestamp string, bias double")
    s = s.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    times = spark.createDataFrame([("2023-12-31 23:00",), ("2024-01-01 00:10",), ("2024-01-01 02:00",)], "timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = {(r.satellite, r.timestamp.hour): r.bias for r in asof.at_every_time(s, times, "satellite", "timestamp", ["bias"]).collect()}
    assert got == pytest.approx({("G01", 23): 0.0, ("G01", 0): 1.0, ("G01", 2): 6.0, ("G02", 23): 2.0, ("G02", 0): 2.0, ("G02", 2): 2.0})
