"""Series cut in time give what the uncut ones give: hot keys, empty stretches, null keys and names that clash."""

import datetime as dt
import random
from statistics import fmean, stdev

import pytest
from pyspark.sql import functions as F

from ephemera.operators import forecast, sequences, windows
from ephemera.operators.periods import with_forward_halo

START = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """One key with most rows, in clusters and with long breaks; a short key, a single row, a null key."""
    r = random.Random(4)
    rows, t = [], START
    for i in range(900):
        t += dt.timedelta(minutes=r.choice([1, 5, 15, 15, 15, 200]) + (60 * 24 * 9 if i in (300, 301, 640) else 0))
        rows.append(("hot", t, i, r.choice([None, r.uniform(-5, 5), r.uniform(-5, 5)]), i * 1.5))
    rows += [("short", START + dt.timedelta(hours=7 * i), i, float(i), 2.0) for i in range(9)] + [("one", START, 0, None, 1.0)]
    rows += [(None, START + dt.timedelta(hours=5 * i), i, float(i * i) if i % 3 else None, 0.5) for i in range(40)]
    rows += [("none known", START + dt.timedelta(hours=30 * i), i, None, 0.5) for i in range(5)]
    return spark.createDataFrame(rows, "unit string, row timestamp_ntz, place int, x double, y double").repartition(5).cache()


def same(a, b):
    a, b = (sorted(map(str, d.collect())) for d in (a, b.select(*a.columns)))
    assert a == b and a


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
@pytest.mark.parametrize(("lookback", "horizon", "stride"), [(6, 2, 1), (1, 1, 3), (30, 4, 2), (5, 3, 7)])
def test_windows(series, bucket, lookback, horizon, stride):
    plain, cut = (sequences.make_windows(series, "unit", ["row", "place"], ["x", "y"], ["y"], lookback, horizon, stride, b) for b in (None, bucket))
    same(plain, cut)


@pytest.mark.parametrize("bucket", ["hour", "week"])
def test_nested_windows_targets_and_lags(series, bucket):
    w = sequences.make_windows(series, "unit", "row", ["y"], ["y"], 3, 1)
    same(sequences.nested_windows(w, "unit", 4), sequences.nested_windows(w, "unit", 4, bucket=bucket))
    same(*(forecast.multi_horizon_targets(series, "unit", "row", "y", [1, 3, 20], b) for b in (None, bucket)))
    known = series.where("unit is not null")
    same(*(forecast.lag_features(known, "unit", "row", "y", 3, b) for b in (None, bucket)))
    same(*(forecast.persistence(known, "unit", "row", "y", b) for b in (None, bucket)))


@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_gaps(series, bucket):
    same(*(windows.fill_gaps(series, "unit", "row", ["x", "y"], b) for b in (None, bucket)))


@pytest.mark.parametrize("bucket", ["hour", "week"])
@pytest.mark.parametrize(("most", "share"), [(12, 4), (500, 2), (1, 1), (10**6, 1)])
def test_frames_that_depend_on_the_key(series, bucket, most, share):
    known = series.where("unit is not null")
    got = windows.adaptive_rolling(known, "unit", ["row", "place"], ["y", "x"], most, share, bucket)
    assert got.columns == [*series.columns, "y_ma", "y_std", "x_ma", "x_std"]
    found = {(r.unit, r.place): r for r in got.collect()}
    rows = sorted(known.collect(), key=lambda r: (r.row, r.place))
    assert len(found) == len(rows)
    for key in {r.unit for r in rows}:
        own = [r for r in rows if r.unit == key]
        k = max(1, min(most, len(own) // share))
        for i, r in enumerate(own):
            for c in "yx":
                values = [v for v in (q[c] for q in own[max(0, i - k + 1) : i + 1]) if v is not None]
                ma, std = found[key, r.place][f"{c}_ma"], found[key, r.place][f"{c}_std"]
                if not values:
                    assert ma is None and std is None
                    continue
                assert ma == pytest.approx(fmean(values), rel=1e-9, abs=1e-9)
                assert std == pytest.approx(stdev(values) if len(values) > 1 else 0.0, rel=1e-6, abs=1e-6)


def test_gaps_take_one_sort_and_no_key_is_whole(series):
    plan = windows.fill_gaps(series, "unit", "row", ["x"], "day")._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    # the rows by unit and time, the periods of each key and, unless they are broadcast, the units for the join
    assert len(sorts) <= 3 and sum("Sort [unit" in x and "_w0" in x for x in sorts) == 1 and "SortAggregate" not in plan, sorts
    halo = with_forward_halo(series.where("unit = 'hot'"), "unit", "row", 10, "day")
    sizes = [r.n for r in halo.groupBy("unit").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 250 and halo.where("place is not null").count() == 900
    lent = halo.where("place is null").groupBy("unit").count().agg(F.max("count")).first()[0]
    assert lent == 10


def test_empty(spark):
    none = spark.createDataFrame([], "k string, t timestamp_ntz, x double")
    assert sequences.make_windows(none, "k", "t", ["x"], ["x"], 2, 1, 1, "day").count() == 0
    assert windows.fill_gaps(none, "k", "t", ["x"], "day").count() == 0
