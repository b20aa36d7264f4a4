import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ephemera.operators import evaluate, filters, forecast, prep, profile, sequences, windows

T0 = datetime(2025, 7, 6)
COLS = ["orbit_error_m", "clock_error_ns", "radial_error_m", "ephemeris_age_hours"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(1)
    rows = []
    for s in ("G01", "G02", "G03"):
        for k in range(120 if s != "G03" else 7):
            v = rng.normal(10, 3)
            rows.append((s, T0 + timedelta(minutes=15 * k), v if k % 11 else None, float(rng.normal()), 5.0, float(k % 5) / 2))
    return pd.DataFrame(rows, columns=["satellite", "timestamp", *COLS])


@pytest.fixture(scope="module")
def errors(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    rows = [(r[0], r[1].to_pydatetime(), *r[2:]) for r in rows]
    d = spark.createDataFrame(rows, "satellite string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in COLS))
    return d.repartition(3).cache()


def test_statistics(errors, pdf):
    r = profile.dataset_statistics(errors).first()
    x = pdf.orbit_error_m.dropna()
    assert (r.total_records, r.unique_keys) == (247, 3) and r.duration_hours == pytest.approx(119 / 4)
    s = r.orbit_error_m
    for got, want in ((s.mean, x.mean()), (s.std, x.std()), (s.median, x.median()), (s.percentile_95, x.quantile(0.95)), (s.min, x.min())):
        assert got == pytest.approx(want)
    per = {r.satellite: r.records for r in profile.key_statistics(errors).collect()}
    assert per == {"G01": 120, "G02": 120, "G03": 7}
    d = {r.column: r for r in profile.describe(errors, COLS).collect()}
    assert d["orbit_error_m"].q25 == pytest.approx(x.quantile(0.25)) and d["orbit_error_m"]["count"] == len(x)


def test_profile_tables(errors, pdf):
    assert {r.column: r.n_null for r in profile.missing(errors, COLS).collect()}["orbit_error_m"] == pdf.orbit_error_m.isna().sum()
    h = profile.histogram(errors, ["clock_error_ns", "radial_error_m"], 10).collect()
    want = np.histogram(pdf.clock_error_ns, 10)[0]
    got = {r.bin: r.n for r in h if r.column == "clock_error_ns"}
    assert [got.get(k, 0) for k in range(10)] == want.tolist()
    assert [(r.bin, r.n) for r in h if r.column == "radial_error_m"] == [(0, 247)]
    c = {(r.a, r.b): r["corr"] for r in profile.correlation(errors, COLS).collect()}
    assert c["orbit_error_m", "clock_error_ns"] == pytest.approx(pdf.corr(numeric_only=True).loc["orbit_error_m", "clock_error_ns"])
    b = {r.column: r for r in profile.iqr_report(errors, COLS).collect()}["clock_error_ns"]
    q1, q3 = pdf.clock_error_ns.quantile([0.25, 0.75])
    out = pdf.clock_error_ns[(pdf.clock_error_ns < q1 - 1.5 * (q3 - q1)) | (pdf.clock_error_ns > q3 + 1.5 * (q3 - q1))]
    assert b.n_outliers == len(out) and b.lower == pytest.approx(q1 - 1.5 * (q3 - q1))
    flagged = profile.flag_outliers(errors, COLS[:3])
    assert profile.outlier_total(flagged).first().n_outliers >= len(out)
    assert {r.bucket: r.n for r in profile.bucket_share(errors, "ephemeris_age_hours").collect()} == {"0": 50, "(0, 0.5]": 50, "(0.5, 1]": 49, "(1, 2]": 98}
    assert profile.sample_per_value(errors, "ephemeris_age_hours", ["satellite", "timestamp"], 3, 2).count() == 6
    assert profile.infinite(errors, COLS).where("n_infinite > 0").count() == 0
    u = profile.utilisation(errors, "satellite", "timestamp").first()
    assert (u.n_keys, u.n_days) == (3, 2)
    q = profile.quality_report(errors, "satellite", "timestamp", ["clock_error_ns"]).first()
    assert q.critical_complete and q.monotonic and q.n_keys == 3
    assert not profile.quality_report(errors.union(errors), "satellite", "timestamp", ["orbit_error_m"]).first().monotonic


def test_coverage(spark):
    want = spark.createDataFrame([(d, p) for d in (187, 188) for p in ("SP3", "CLK")], "day int, product string")
    got = profile.coverage_table(want.where("day = 187 or product = 'CLK'"), want, ["SP3", "CLK"]).orderBy("day").collect()
    assert [(r.SP3, r.CLK) for r in got] == [(True, True), (False, True)]
    assert profile.same_keys(want, want.where("day = 187"), "day").collect()[0].side == "left"


def test_filters(errors, spark):
    assert filters.min_rows(errors, "satellite", 100).select("satellite").distinct().count() == 2
    r = filters.retention_report(errors, ["orbit_error_m"]).first()
    assert r.n_after == filters.drop_missing(errors, ["orbit_error_m"]).count() == r.n_before - r.n_removed
    d = filters.convert_units(errors.limit(1))
    assert "orbit_error_km" in d.columns and "clock_error_us" in d.columns
    assert filters.time_column(errors) == "timestamp" and filters.numeric_columns(errors) == COLS
    bad = spark.createDataFrame([(0.999999999999,), (1e-6,)], "clock_bias double")
    assert filters.drop_bad_clock(bad).count() == 1 and filters.keep_prefix(errors).count() == 247 and filters.keep_keys(errors, "satellite", ["G03"]).count() == 7
    s = filters.serving_features(spark.createDataFrame([(T0, "G01", 10.0, None)], "timestamp timestamp_ntz, satellite_id string, pos_error_m double, clock_error_ns double")).first()
    assert (s.radial_error_m, s.clock_error_ns, s.ephemeris_age_hours) == (8.0, 0.0, 2.0)
    n = filters.replace_nonfinite(spark.createDataFrame([(math.nan,), (None,)], "x double"), ["x"])
    assert [r.x for r in n.collect()] == [0.0, 0.0]


@pytest.mark.parametrize("bucket", [None, "hour", "day"])
def test_rolling(errors, pdf, bucket):
    got = windows.rolling_stats(errors, "satellite", "timestamp", ["clock_error_ns"], 12, bucket).toPandas().sort_values(["satellite", "timestamp"], ignore_index=True)
    g = pdf.groupby("satellite").clock_error_ns
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got.clock_error_ns_ma, g.transform(lambda s: s.rolling(12, 1).mean()), rtol=1e-9)
    np.testing.assert_allclose(got.clock_error_ns_std, g.transform(lambda s: s.rolling(12, 1).std()).fillna(0), rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got.clock_error_ns_diff, g.diff().fillna(0), rtol=1e-9)


def test_adaptive_and_fill(errors, pdf):
    got = windows.adaptive_rolling(errors, "satellite", "timestamp", ["clock_error_ns"]).toPandas().sort_values(["satellite", "timestamp"], ignore_index=True)
    want = pdf.groupby("satellite").clock_error_ns.transform(lambda s: s.rolling(max(1, min(12, len(s) // 4)), 1).mean())
    np.testing.assert_allclose(got.clock_error_ns_ma, want, rtol=1e-9)
    std = pdf.groupby("satellite").clock_error_ns.transform(lambda s: s.rolling(max(1, min(12, len(s) // 4)), 1).std()).fillna(0)
    np.testing.assert_allclose(got.clock_error_ns_std, std, rtol=1e-7, atol=1e-9)
    filled = windows.fill_gaps(errors, "satellite", "timestamp", ["orbit_error_m"]).toPandas().sort_values(["satellite", "timestamp"], ignore_index=True)
    want = pdf.groupby("satellite").orbit_error_m.transform(lambda s: s.interpolate("linear").bfill().ffill())
    np.testing.assert_allclose(filled.orbit_error_m, want, rtol=1e-9)


def test_time_features_and_tail(errors):
    r = windows.time_features(errors, satellite="satellite").where("timestamp = '2025-07-06 06:15:00'").first()
    assert (r.hour, r.day, r.day_of_year, r.minute_of_day, r.satellite_block) == (6, 6, 187, 375, 0) and r.day_sin == pytest.approx(1)
    assert windows.tail(errors, "satellite", "timestamp", 50).count() == 107
    assert windows.not_monotonic(errors, "satellite", "timestamp", ["timestamp"]).count() == 0


@pytest.mark.parametrize(("lookback", "horizon", "stride"), [(6, 1, 1), (24, 4, 1), (36, 4, 2)])
def test_windows(errors, lookback, horizon, stride):
    w = sequences.make_windows(errors, "satellite", "timestamp", COLS, COLS[:2], lookback, horizon, stride).cache()
    got = {r.satellite: r.n for r in sequences.windows_per_key(w, "satellite").collect()}
    want = {s: math.ceil((n - lookback - horizon + 1) / stride) for s, n in (("G01", 120), ("G02", 120), ("G03", 7)) if n >= lookback + horizon}
    assert got == want
    r = w.first()
    assert len(r.x) == lookback and len(r.y) == horizon and len(r.x[0]) == 4 and len(r.y[0]) == 2
    assert sequences.drop_incomplete(w).where(F.exists(F.flatten("x"), lambda v: v.isNull())).count() == 0
    assert sequences.long_rows(sequences.flat(w).select("satellite", F.array("x").alias("x")).limit(1), ["satellite"]).count() == lookback * 4


def test_nested(errors):
    w = sequences.make_windows(errors, "satellite", "timestamp", COLS[:3], COLS[:1], 12, 1)
    n = sequences.nested_windows(w, "satellite", 10).where("satellite = 'G01'")
    assert n.count() == 120 - 12 - 9 and len(n.first().x) == 10 and len(n.first().x[0]) == 36


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust"])
def test_scalers(errors, pdf, kind):
    params = prep.fit_scaler(errors, COLS, kind)
    scaled = prep.transform(errors, params, COLS)
    back = prep.inverse(scaled, params, COLS).agg(F.sum("clock_error_ns")).first()[0]
    assert back == pytest.approx(pdf.clock_error_ns.sum())
    p = {r.column: r for r in params.collect()}
    assert p["radial_error_m"].scale == 1.0
    want = {"standard": pdf.clock_error_ns.std(ddof=0), "minmax": np.ptp(pdf.clock_error_ns), "robust": pdf.clock_error_ns.quantile(0.75) - pdf.clock_error_ns.quantile(0.25)}
    assert p["clock_error_ns"].scale == pytest.approx(want[kind])
    if kind == "standard":
        assert prep.scaling_check(scaled, COLS[:2]).first().ok
    long = profile.long_form(scaled, COLS).withColumnRenamed("column", "feature")
    assert prep.inverse_long(long, params, ["value"]).count() == 4 * 247


def test_labels(errors, spark):
    labels = prep.fit_labels(errors, "satellite")
    assert [(r.label, r["index"]) for r in labels.orderBy("index").collect()] == [("G01", 0), ("G02", 1), ("G03", 2)]
    assert prep.encode_labels(errors, labels, "satellite", "id").where("id = 1").count() == 120
    other = spark.createDataFrame([("X",)], "satellite string")
    assert prep.encode_labels(other, labels, "satellite", "id", "keep").first().id is None
    with pytest.raises(Exception, match="not fitted"):
        prep.encode_labels(other, labels, "satellite", "id").collect()
    hot = prep.one_hot(errors, labels, "satellite")
    assert hot.agg(F.sum("satellite_G03")).first()[0] == 7
    r = prep.preparation_report(prep.fit_scaler(errors, COLS), labels, 36, 4).first()
    assert r.labels == {"G01": 0, "G02": 1, "G03": 2} and set(r.scalers) == set(COLS)


def test_splits(errors):
    got = prep.split_fraction(errors, "timestamp", "satellite", [0.7, 0.15, 0.15], ["train", "val", "test"]).toPandas().sort_values(["timestamp", "satellite"])
    assert got.split.tolist() == ["train"] * 172 + ["val"] * 37 + ["test"] * 38
    day = prep.split_last_day(errors, "timestamp")
    assert day.where("split = 'test'").count() == 48
    assert prep.split_last_day(errors, "timestamp", "2025-07-06").where("split = 'test'").count() == 96 * 2 + 7
    a, b = (prep.split_random(errors.repartition(k), ["satellite", "timestamp"]).where("split = 'test'").select("satellite", "timestamp") for k in (2, 5))
    assert a.exceptAll(b).count() == 0 and 20 < a.count() < 80
    parts = prep.split_fraction(errors, "timestamp", "satellite", [0.8, 0.2], ["train", "test"])
    assert profile.no_overlap(parts.where("split = 'train'"), parts.where("split = 'test'"), "timestamp").first().disjoint in (True, False)


def test_noise(errors):
    d = prep.augment_noise(errors, ["clock_error_ns"], 0.005, keys=["satellite", "timestamp"])
    assert d.count() == 494
    diff = d.groupBy("satellite", "timestamp").agg((F.max("clock_error_ns") - F.min("clock_error_ns")).alias("d")).agg(F.sqrt(F.avg(F.col("d") ** 2))).first()[0]
    assert diff == pytest.approx(0.005, rel=0.2)


def test_metrics(spark):
    rng = np.random.default_rng(2)
    y, e = rng.normal(5, 2, 200), rng.normal(0, 1, 200)
    rows = [("a", k % 4 + 1, float(y[k]), float(y[k] + e[k])) for k in range(200)] + [("flat", 1, 3.0, 3.5), ("flat", 2, 3.0, 2.5), ("a", 1, None, 1.0)]
    d = spark.createDataFrame(rows, "feature string, step int, y double, y_hat double").cache()
    m = {r.feature: r for r in evaluate.metrics(d, ["feature"]).collect()}
    assert m["a"].n == 200 and m["a"].mae == pytest.approx(np.abs(e).mean()) and m["a"].rmse == pytest.approx(math.sqrt((e**2).mean()))
    assert m["a"].r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()) and m["flat"].r2 is None
    assert evaluate.overall(evaluate.metrics(d, ["feature"])).first().mean_r2 == pytest.approx(m["a"].r2)
    h = evaluate.horizon_metrics(d)
    assert {(r.horizon, r.feature) for r in h.collect()} == {("15min", "a"), ("30min", "a"), ("1hr", "a"), ("15min", "flat"), ("30min", "flat")}
    assert h.where("feature = 'flat'").first().r2 == 0.0 and evaluate.horizon_averages(h).count() == 3
    r = evaluate.residual_moments(d.where("feature = 'a'"), ["feature"]).first()
    z = (e - e.mean()) / e.std()
    assert r.skewness == pytest.approx((z**3).mean()) and r.kurtosis == pytest.approx((z**4).mean() - 3)
    w = {r.feature: r.pct_within for r in evaluate.within_tolerance(d, ["feature"]).collect()}
    assert w["a"] == pytest.approx(100 * (np.abs(e) <= 0.05 * np.abs(y)).mean()) and w["flat"] == 0


def test_normality(spark):
    rng = np.random.default_rng(3)
    rows = [("n", k, float(v)) for k, v in enumerate(rng.normal(size=300))] + [("e", k, float(v)) for k, v in enumerate(rng.exponential(size=300))]
    d = spark.createDataFrame(rows, "g string, k int, r double")
    a = {r.g: r for r in evaluate.anderson_darling(d, ["g"]).collect()}
    assert a["n"].normal and not a["e"].normal
    x = np.sort([v for g, _, v in rows if g == "e"])
    z = (x - x.mean()) / x.std(ddof=1)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, 301)
    want = -300 - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).mean()
    assert a["e"].a2 == pytest.approx(want, rel=1e-6)
    s = {r.g: r for r in evaluate.shapiro_wilk(d, ["g"], ["k"], most=200).collect()}
    assert s["n"].normal and not s["e"].normal and s["n"].n == 200


def test_shapiro_published_example():
    # weights of 11 men, a published example: W = 0.79, p < 0.01
    w, p = evaluate.shapiro_statistic(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01
    assert math.isnan(evaluate.shapiro_statistic(np.array([1.0, 1.0, 1.0]))[0])


def test_log_cdf(spark):
    zs = [-30.0, -8.0, -5.0, -3.5, -2.9, -1.0, 0.0, 0.5, 2.9, 4.0, 7.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(evaluate.log_normal_cdf(F.col("z"))).collect()]
    for z, v in zip(zs, got, strict=True):
        want = math.log(0.5 * math.erfc(-z / math.sqrt(2)))
        assert v == pytest.approx(want, rel=1e-8, abs=1e-15)


def test_classes(spark):
    rows = [("a", float(k), float(k if k % 10 else 99 - k)) for k in range(100)]
    d = evaluate.tercile_classes(spark.createDataFrame(rows, "feature string, y double, y_hat double"), ["feature"]).cache()
    c = {r.true_class: r for r in evaluate.confusion(d, ["feature"]).collect()}
    assert sum(sum(r[k] for k in ("low", "medium", "high")) for r in c.values()) == 100
    r = {x["class"]: x for x in evaluate.class_report(d, ["feature"]).collect()}
    hits = sum(c[k][k] for k in c)
    assert r["accuracy"].recall == pytest.approx(hits / 100) and r["low"].support == sum(c["low"][k] for k in ("low", "medium", "high"))
    assert r["weighted avg"].recall == pytest.approx(hits / 100)


def test_forecasts(errors):
    t = forecast.multi_horizon_targets(errors, "satellite", "timestamp", "clock_error_ns", [1, 4, 96])
    assert {r.step: r["count"] for r in t.groupBy("step").count().collect()} == {1: 244, 4: 235, 96: 48}
    roll = forecast.recursive_forecast(errors.na.fill(0.0), "satellite", "timestamp", COLS, 2, lambda x: x[:, -1, :2] + 1, steps=8, lookback=36).cache()
    ok = roll.where("error is null")
    assert ok.count() == 2 * 8 * 2 and roll.where("error is not null").first().satellite == "G03"
    ends = {(r.satellite, r.horizon): r.y_hat for r in forecast.horizon_ends(ok, "satellite", {"15min": 1, "2hr": 8}).where("feature = 'clock_error_ns'").collect()}
    assert ends["G01", "2hr"] - ends["G01", "15min"] == pytest.approx(7)
    rg = forecast.forecast_ranges(ok, "satellite", {"2hr": 8}).first()
    assert rg.n == 8 and rg["max"] - rg["min"] == pytest.approx(7)
    assert {r.satellite: r.error is None for r in forecast.enough_history(errors, "satellite").collect()} == {"G01": True, "G02": True, "G03": False}
    score, level = forecast.confidence(F.col("n"))
    assert errors.sparkSession.createDataFrame([(36,), (200,)], "n int").select(score, level).collect() == [(0.7 + 0.36 * 0.25, "Medium"), (0.95, "High")]


@pytest.mark.parametrize("kind", ["ridge", "boosting"])
def test_regression(errors, kind):
    d = forecast.lag_features(errors, "satellite", "timestamp", "clock_error_ns", 3)
    parts = prep.split_last_day(d, "timestamp")
    out = forecast.regression_baseline(parts.where("split = 'train'"), parts.where("split = 'test'"), ["lag_1", "lag_2", "lag_3"], "clock_error_ns", kind)
    assert out.where("y_hat is not null").count() == 48
    assert forecast.persistence(errors, "satellite", "timestamp", "clock_error_ns").count() == 244


@pytest.mark.parametrize("margin", [profile.BRACKET_MARGIN, -0.2])
def test_percentiles_are_exact_also_where_brackets_miss(spark, monkeypatch, margin):
    monkeypatch.setattr(profile, "BRACKET_MARGIN", margin)
    rng = np.random.default_rng(5)
    cols = {
        "smooth": rng.normal(size=5000),
        "outlier": np.concatenate([rng.normal(size=4999), [1e300]]),
        "ties": rng.integers(0, 4, 5000).astype(float),
        "constant": np.full(5000, 2.5),
        "endless": np.where(rng.random(5000) < 0.4, np.inf, rng.random(5000)),
        "few": np.array([3.0, 1.0, 2.0] + [np.nan] * 4997),
    }
    d = spark.createDataFrame(pd.DataFrame(cols)).replace(float("nan"), None).withColumn("none", F.lit(None).cast("double"))
    q = {"lowest": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "highest": 1.0}
    got = {r.column: r for r in profile.percentiles(d, [*cols, "none"], q, slots=16).collect()}
    assert set(got) == set(cols)
    want = d.agg(*(F.percentile(c, F.lit(x)).alias(f"{c}_{n}") for c in cols for n, x in q.items())).first()
    for c in cols:
        for n in q:
            assert got[c][n] == pytest.approx(want[f"{c}_{n}"], rel=1e-12), (c, n)
    assert profile.percentiles(d.limit(0), list(cols), q).count() == 0
