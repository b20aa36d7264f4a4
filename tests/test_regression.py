"""Ridge regressions by key against numpy: a hot key, null keys and values, dependent features, names that clash."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephemera.operators.regression import predict_by_key, ridge_by_key

FEATURES = ["g", "n.1", "m"]


def plain(rows, alpha):
    out = {}
    for key in {r[0] for r in rows}:
        own = np.array([r[1:5] for r in rows if r[0] == key and all(v is not None and not math.isnan(v) for v in r[1:5])], float).reshape(-1, 4)
        if len(own):
            x, y = own[:, :3], own[:, 3]
            c = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))
            out[key] = (len(own), y.mean() - x.mean(0) @ c, *c)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    out = []
    for k in range(3000):
        key = "hot" if k % 3 else r.choice(["a", "b", "c", None])
        x = [r.gauss(1e4, 3), r.uniform(-2, 2), r.gauss(0, 1)]
        out.append((key, *x, 2 * x[0] - x[1] + 0.5 * x[2] + r.gauss(0, 0.1) + (100 if key == "a" else 0)))
    out += [("hot", None, 1.0, 1.0, 1.0), ("hot", 1.0, float("nan"), 1.0, 1.0), ("b", 1.0, 1.0, 1.0, None), ("one", 1.0, 2.0, 3.0, 4.0), ("none", None, None, None, None)]
    return out


SCHEMA = "key string, g double, `n.1` double, m double, y double"


@pytest.mark.parametrize("alpha", [1.0, 25.0])
def test_equals_normal_equations(spark, rows, alpha):
    got = {r.key: (r.n, r.intercept, *r.coefficients) for r in ridge_by_key(spark.createDataFrame(rows, SCHEMA).repartition(5), "key", FEATURES, "y", alpha).collect()}
    want = plain(rows, alpha)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-7), k


@pytest.mark.parametrize("most", [None, 0])
def test_forecasts(spark, rows, most):
    df = spark.createDataFrame([*rows, ("unseen", 1.0, 1.0, 1.0, 1.0)], SCHEMA).withColumn("y_hat", F.lit("taken")).repartition(4)
    models = ridge_by_key(df.where("key <> 'unseen' or key is null"), "key", FEATURES, "y")
    got = predict_by_key(df, models, "key", FEATURES, most=most)
    assert got.columns == [*df.columns, "y_hat_"]
    found, want = got.collect(), plain(rows, 1.0)
    assert len(found) == len(rows) + 1
    for r in found:
        x = [r.g, r["n.1"], r.m]
        if r.key not in want or any(v is None or math.isnan(v) for v in x):
            assert r.y_hat_ is None
        else:
            n, b, *c = want[r.key]
            assert r.y_hat_ == pytest.approx(b + sum(map(lambda p, q: p * q, c, x)), rel=1e-7, abs=1e-5)


def test_singular_and_empty(spark):
    d = spark.createDataFrame([("k", float(i), 2.0 * i, 0.0, float(i)) for i in range(9)], SCHEMA)
    (plain_ridge,), (none,) = ridge_by_key(d, "key", FEATURES, "y").collect(), ridge_by_key(d, "key", FEATURES, "y", 0.0).collect()
    assert plain_ridge.coefficients[2] == 0.0 and plain_ridge.intercept is not None
    assert none.intercept is None and none.n == 9
    assert ridge_by_key(d.limit(0), "key", FEATURES, "y").count() == 0
    assert predict_by_key(d.limit(0), ridge_by_key(d, "key", FEATURES, "y"), "key", FEATURES).count() == 0
