"""Batch forecasting of keyed series: targets, recursive forecasts, their summary and regression baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ephemera.functions.names import quoted
from ephemera.operators.periods import with_following, within
from ephemera.operators.windows import series, tail, with_halo

STEPS = {"15min": 1, "30min": 2, "1hr": 4, "2hr": 8, "4hr": 16, "8hr": 32, "24hr": 96}


def multi_horizon_targets(df: DataFrame, by: str, on: str | list[str], col: str, steps: list[int], bucket: str | None = None) -> DataFrame:
    """(row columns, step, target): the value ``step`` rows ahead in the key; rows without one are left out.

    ``bucket`` cuts long keys into periods, which borrow the rows that the steps reach; the result is the same.
    """
    if bucket is not None:
        w, row = within(on), F.col("row")
        ahead = F.array(*(F.struct(F.lit(s).alias("step"), F.lead(row.getField(col), s).over(w).alias("target")) for s in steps))
        d = with_following(df, by, on, max(steps), bucket, {"ahead": ahead}).select("row", F.explode("ahead").alias("a"))
        return d.where("a.target is not null").select(*(row.getField(c).alias(c) for c in df.columns), "a.step", "a.target")
    w = series(by, on)
    ahead = F.array(*(F.struct(F.lit(s).alias("step"), F.lead(col, s).over(w).alias("target")) for s in steps))
    return df.withColumn("__a", ahead).withColumn("__p", F.explode("__a")).select(*df.columns, "__p.step", "__p.target").where("target is not null")


def recursive_forecast(
    df: DataFrame, by: str, on: str | list[str], features: list[str], n_targets: int, predict: Callable[[np.ndarray], np.ndarray], steps: int = 96, lookback: int = 36
) -> DataFrame:
    """(by, step, feature, y_hat, error): each key rolled forward ``steps`` times from its last ``lookback`` rows.

    ``predict`` maps (keys, lookback, features) to (keys, n_targets) and is called once a step for each batch of keys;
    each forecast is appended with the other features 0.  Shorter horizons are prefixes of the one roll.  Keys with
    fewer than ``lookback`` rows give one row with ``error``.  The last rows are chosen before the shuffle, so a key has
    ``lookback`` rows at most.
    """
    order = [on] if isinstance(on, str) else list(on)
    last = tail(df, by, order, lookback)
    row = F.struct(*(quoted(c).alias(f"o{i}") for i, c in enumerate(order)), F.array(*(quoted(c).cast("double") for c in features)).alias("x"))
    rows = last.groupBy(quoted(by).alias("key")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias("x"))
    ready, short = rows.where(F.size("x") == lookback), rows.where(F.size("x") < lookback)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.num_rows
            if not keys:
                continue
            x = np.array(b.column(1).to_pylist(), float).reshape(keys, lookback, len(features))
            found = np.empty((keys, steps, n_targets))
            for step in range(steps):
                found[:, step] = np.asarray(predict(x), float).reshape(keys, n_targets)
                new = np.zeros((keys, 1, len(features)))
                new[:, 0, :n_targets] = found[:, step]
                x = np.concatenate([x[:, 1:], new], axis=1)
            flat = pa.array(found.reshape(-1))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, keys * steps * n_targets + 1, n_targets), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, keys * steps + 1, steps), pa.int32()), inner)], names=["key", "y"])

    kind = df.schema[by].dataType.simpleString()
    names = F.array(*map(F.lit, features[:n_targets]))
    rolled = ready.mapInArrow(roll, f"key {kind}, y array<array<double>>").select("key", F.posexplode("y").alias("step", "y"))
    rolled = rolled.select("key", (F.col("step") + 1).alias("step"), F.explode(F.arrays_zip(names.alias("feature"), F.col("y").alias("y_hat"))).alias("r"))
    rolled = rolled.select(F.col("key").alias(by), "step", "r.feature", "r.y_hat", F.lit(None).cast("string").alias("error"))
    none = short.select(F.col("key").alias(by), F.lit(None).cast("int").alias("step"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("y_hat"), F.lit(too_short(lookback)).alias("error"))
    return rolled.unionByName(none)


def too_short(lookback: int) -> str:
    return f"fewer than {lookback} rows of history"


def enough_history(df: DataFrame, by: str, lookback: int = 36) -> DataFrame:
    """(by, n, error): error says which keys have too few rows."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("error", F.when(F.col("n") < lookback, F.lit(too_short(lookback))))


def confidence(n: Column) -> tuple[Column, Column]:
    """Score min(0.95, 0.7 + 0.25 n / 100) and level of a forecast from ``n`` rows."""
    score = F.least(F.lit(0.95), 0.7 + n / 100 * 0.25)
    return score, F.when(score > 0.85, "High").when(score > 0.7, "Medium").otherwise("Low")


def by_horizon(forecast: DataFrame, steps: dict[str, int] = STEPS) -> DataFrame:
    """Forecast rows with ``horizon``: each row once for every horizon that reaches its step."""
    names = F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(v).alias("last")) for k, v in steps.items()))
    return forecast.withColumn("__h", F.explode(names)).where(F.col("step") <= F.col("__h.last")).select(*forecast.columns, "__h.horizon")


def horizon_ends(forecast: DataFrame, by: str, steps: dict[str, int] = STEPS) -> DataFrame:
    """(by, horizon, feature, y_hat): the last step of each horizon."""
    return by_horizon(forecast, steps).groupBy(by, "horizon", "feature").agg(F.max_by("y_hat", "step").alias("y_hat"))


def forecast_ranges(forecast: DataFrame, by: str, steps: dict[str, int] = STEPS) -> DataFrame:
    """(by, horizon, feature, n, min, max)."""
    return by_horizon(forecast, steps).groupBy(by, "horizon", "feature").agg(F.count("*").alias("n"), F.min("y_hat").alias("min"), F.max("y_hat").alias("max"))


def _lags(df: DataFrame, by: str, on: str | list[str], col: str, names: dict[str, int], bucket: str | None) -> DataFrame:
    """``df`` with the values so many rows before as ``names``, where all are known; ``bucket`` cuts long keys into periods."""
    d, period, own = (df, "", "") if bucket is None else with_halo(df, by, on, max(names.values()), bucket)
    w = series(by if bucket is None else [by, period], on)
    d = d.withColumns({name: F.lag(col, k).over(w) for name, k in names.items()})
    return (d if bucket is None else d.where(F.col(own)).drop(own, period)).dropna(subset=list(names))


def persistence(df: DataFrame, by: str, on: str | list[str], col: str, bucket: str | None = None) -> DataFrame:
    """``df`` with y (the value) and y_hat (the value before it); first rows are left out."""
    return _lags(df.withColumn("y", F.col(col)), by, on, col, {"y_hat": 1}, bucket)


def lag_features(df: DataFrame, by: str, on: str | list[str], col: str, lags: int, bucket: str | None = None) -> DataFrame:
    """``df`` with lag_1 .. lag_``lags``; rows that lack one are left out."""
    return _lags(df, by, on, col, {f"lag_{k}": k for k in range(1, lags + 1)}, bucket)


def regression_baseline(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str = "ridge", seed: int = 42) -> DataFrame:
    """``test`` with y_hat of a model fitted on ``train``: ridge, elastic_net, forest or boosting."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    models = {
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "elastic_net": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.5),
        "forest": lambda: RandomForestRegressor(numTrees=20, seed=seed),
        "boosting": lambda: GBTRegressor(maxIter=20, seed=seed),
    }
    vectors = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    model = models[kind]().setFeaturesCol("__x").setLabelCol(target).setPredictionCol("y_hat").fit(vectors.transform(train))
    return model.transform(vectors.transform(test)).drop("__x")


