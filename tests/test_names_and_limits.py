"""Columns whose names an operator uses itself, NaN in histograms, and texts longer than any line should be."""

import math

from pyspark.sql import functions as F

from ephemera.operators import prep, profile
from ephemera.sources.sp3 import parse_sp3, parse_sp3_header


def test_columns_named_like_results(spark):
    d = spark.createDataFrame([(1, None, "a"), (None, 2.0, "b"), (3, 4.0, "a")], "n int, column double, c0 string")
    assert {r.column: r.n_null for r in profile.missing(d, ["n", "column", "c0"]).collect()} == {"n": 1, "column": 1, "c0": 0}
    long = spark.createDataFrame([("x", 1.0, 7.0, "keep"), ("y", 2.0, 8.0, "keep"), ("z", 1.0, 1.0, "no parameters")], "feature string, center double, scale double, p string")
    params = spark.createDataFrame([("x", 10.0, 2.0), ("y", 20.0, 3.0)], "column string, center double, scale double")
    got = prep.inverse_long(long, params, ["scale"])
    assert got.columns == long.columns and sorted(map(tuple, got.collect())) == [("x", 1.0, 24.0, "keep"), ("y", 2.0, 44.0, "keep")]


def test_labels(spark):
    d = spark.createDataFrame([("b", 9, "x"), ("a", 8, "y"), (None, 7, "z"), ("b", 6, "w")], "label string, index int, found string")
    labels = prep.fit_labels(d, "label")
    assert labels.dtypes == [("label", "string"), ("index", "int")] and sorted(map(tuple, labels.collect())) == [("a", 0), ("b", 1)]
    got = prep.encode_labels(d, labels, "label", "index")
    assert got.columns == ["label", "found", "index"]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "y", 0), ("b", "w", 1), ("b", "x", 1), (None, "z", None)]
    assert prep.encode_labels(spark.createDataFrame([("q",)], "label string"), labels, "label", "at", unseen="keep").collect()[0].at is None


def test_histogram_leaves_out_what_has_no_place(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, math.nan, None, math.inf, -math.inf]
    got = profile.histogram(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], 4).orderBy("bin").collect()
    assert [(r.bin, r.lo, r.hi, r.n) for r in got] == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (2, 2.0, 3.0, 1), (3, 3.0, 4.0, 2)]


def test_long_lines_of_orbits_are_read_whole(spark):
    gap = " " * 300
    head = f"#cP2025  7  6  0  0  0.00000000{gap}96 ORBIT IGS20 HLM  IGS\n##{gap}2374{gap}0.0   900.0\n+   40   " + "".join(f"G{k:02d}" for k in range(1, 41)) + "\n"
    text = head + "".join(f"*  2025  7  6  {k // 60:2d} {k % 60:2d}  0.00000000\nPG01  {gap}13000.5 {gap}-20000.25 {gap}9000.0 {gap}123.5\n" for k in range(1000))
    files = spark.createDataFrame([("a", text)], "file string, value string")
    orbit, clock = parse_sp3(files)
    assert orbit.count() == clock.count() == 1000 and orbit.select("x").distinct().collect()[0].x == 13000500.0
    (h,) = parse_sp3_header(files).collect()
    assert (h.num_epochs, h.gps_week, h.epoch_interval, len(h.satellites)) == (96, 2374, 900.0, 40)
    assert orbit.agg(F.max("timestamp")).first()[0].hour == 16
