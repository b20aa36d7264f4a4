"""The native normality tests against plain ones: Shapiro-Wilk at every branch of the approximation, Anderson-Darling with heavy tails."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephemera.operators import evaluate


def test_quantiles(spark):
    us = [1e-10, 1e-6, 0.00125, 0.05, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9251, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(evaluate.normal_quantile(F.col("u"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(u) for u in us], rel=1e-13, abs=1e-15)


def test_equals_the_plain_test(spark):
    rng = np.random.default_rng(8)
    groups = {f"n{n}": rng.normal(3, 2, n) for n in (1, 2, 3, 4, 5, 6, 7, 11, 12, 40, 700)}
    groups |= {f"e{n}": rng.exponential(1, n) for n in (3, 5, 9, 30, 2000)} | {"ties": rng.integers(0, 4, 60).astype(float), "same": np.full(9, 2.5), "line": np.arange(8.0), "far": np.array([0.0] * 30 + [1e9])}
    groups[None] = rng.normal(size=25)
    rows = [(g, k, float(v), 1) for g, x in groups.items() for k, v in enumerate(x)] + [("n40", 99, None, 1), ("empty", 1, None, 1)]
    got = evaluate.shapiro_wilk(spark.createDataFrame(rows, "g string, i int, r double, n int").repartition(5), ["g", "n"], ["i"], most=1500)
    assert got.columns == ["g", "n", "n", "w", "p", "normal"]
    found = {r[0]: tuple(r)[2:] for r in got.collect()}
    assert found.keys() == groups.keys()
    for g, x in groups.items():
        w, p = evaluate.shapiro_statistic(x[:1500])
        n, w_, p_, normal = found[g]
        assert n == min(1500, len(x)) and normal == (p > 0.05), g
        if np.isnan(w):
            assert w_ is None and p_ is None and not normal
        else:
            assert w_ == pytest.approx(w, rel=1e-9) and p_ == pytest.approx(p, rel=1e-6, abs=1e-12), g


def log_tail(v):
    """log of the normal distribution function at v; by its asymptotic series where that underflows."""
    return math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v > -30 else -v * v / 2 - math.log(-v * math.sqrt(2 * math.pi)) + math.log1p(-1 / v**2 + 3 / v**4)


def plain_anderson(x):
    n, z = len(x), np.sort((x - x.mean()) / x.std(ddof=1))
    return -n - sum((2 * i + 1) * log_tail(z[i]) + (2 * (n - i) - 1) * log_tail(-z[i]) for i in range(n)) / n


@pytest.mark.parametrize("most", [None, 1])
def test_anderson_darling_with_far_outliers_ties_and_hubs(spark, most):
    rng = np.random.default_rng(4)
    groups = {"far": np.append(rng.normal(size=4000), 1e9), "ties": np.append(rng.integers(0, 3, 900).astype(float), 40.0), "plain": rng.normal(5, 3, 700), None: rng.exponential(size=300), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v), 1) for g, x in groups.items() for v in x] + [("plain", None, 1), ("same", 2.0, 1), ("same", 2.0, 1), ("one", 1.0, 1)]
    d = spark.createDataFrame(rows, "g string, r double, n int").repartition(6)
    out = evaluate.anderson_darling(d, ["g"], levels=6, most=most)
    found = {r[0]: r for r in out.collect()}
    assert found.keys() == groups.keys()
    for g, x in groups.items():
        assert found[g].n == len(x) and found[g].a2 == pytest.approx(plain_anderson(x), rel=1e-6, abs=1e-9), g
    assert found["plain"].normal and not found["far"].normal
    # 64 ranges of 4,001 rows: an outlier at 1e9 puts no more rows into one than its share and the sketch's error
    per = evaluate.in_ranges(d.select(F.struct("g").alias("g"), "r"), 6, most).where("g.g = 'far'").groupBy("slot").agg(F.sum("c").alias("c"))
    assert per.count() == 64 and per.agg(F.max("c")).first()[0] <= 2 * 4001 / 64
    assert evaluate.anderson_darling(d.limit(0), ["g"]).count() == 0
