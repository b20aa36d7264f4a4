"""Cells of validity give what joining every time with every key gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ephemera.operators.asof import cross_times, nearest_asof, nearest_on_grid
from ephemera.operators.states import broadcast_states, broadcast_states_on_grid

START = dt.datetime(2025, 7, 6)


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", None]), START + dt.timedelta(minutes=5 * r.randrange(-100, 700)), r.random(), "x") for _ in range(120)]
    rows += [("even", START + dt.timedelta(minutes=60 * k), float(k), "x") for k in range(20)] + [("even", START + dt.timedelta(minutes=60), -1.0, "least of repeats"), ("one", START + dt.timedelta(hours=9, microseconds=1), 5.0, "x"), ("no time", None, 1.0, "x")]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, k0 double, age_s string").repartition(4).cache()


def grid(spark, start, end, step):
    n = int((end - start).total_seconds() // step) + 1
    return spark.createDataFrame([(start + dt.timedelta(seconds=step * k),) for k in range(n)], "t timestamp_ntz")


@pytest.mark.parametrize(("offset", "step", "tolerance"), [(0, 1800, 7200), (0, 1800, 1800), (137, 900, 3600), (0, 60, 30), (-90000, 3600, 10**6), (0, 7, 100)])
def test_equals_the_join(spark, samples, offset, step, tolerance):
    start = START + dt.timedelta(seconds=offset)
    end = start + dt.timedelta(hours=30 if step > 60 else 2, seconds=11)
    want = nearest_asof(cross_times(grid(spark, start, end, step), samples, "t", "k"), samples, "k", "t", tolerance)
    got = nearest_on_grid(samples, "k", "t", start, end, step, tolerance)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_ephemerides_are_exchanged_once(samples):
    end = START + dt.timedelta(hours=3)
    plan = nearest_on_grid(samples.where("t > '2025-07-05'"), "k", "t", START, end, 60, 3600)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_empty_grids_and_tables(samples):
    assert nearest_on_grid(samples, "k", "t", START, START - dt.timedelta(hours=1), 60, 3600).count() == 0
    assert nearest_on_grid(samples.limit(0), "k", "t", START, START + dt.timedelta(hours=1), 60, 3600).count() == 0
    with pytest.raises(ValueError, match="step"):
        nearest_on_grid(samples, "k", "t", START, START, 0, 1)


def test_states_on_a_grid(spark):
    from test_orbit import nav

    d = nav(spark)
    lo = d.agg(F.min("timestamp")).first()[0] - dt.timedelta(hours=1)
    hi = lo + dt.timedelta(hours=8)
    times = grid(spark, lo, hi, 900).withColumnRenamed("t", "timestamp")
    want, got = broadcast_states(d, times), broadcast_states_on_grid(d, lo, hi, 900)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
