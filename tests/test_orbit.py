import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ephemera.functions import errors as E
from ephemera.functions.orbit import eccentric_anomaly, with_clock_correction, with_position
from ephemera.functions.scalars import finite_or, fortran_double, gps_seconds, satellite_block, since_reference
from ephemera.operators.states import broadcast_states, error_dataset, published

T0 = datetime(2025, 7, 6, 12, 0, 0)
TOE = 12 * 3600.0  # 2025-07-06 is a Sunday
NAV = "satellite string, timestamp timestamp_ntz, a double, e double, i0 double, omega0 double, omega double, m0 double, toe double, cuc double, af0 double, af1 double, af2 double"


def nav(spark, rows=None):
    base = ("G01", T0, 26560000.0, 0.01, math.radians(55), 0.0, 0.0, 0.0, TOE, None, 1e-6, 0.0, 0.0)
    return spark.createDataFrame(rows or [base], NAV)


def test_kepler_residual(spark):
    d = spark.createDataFrame([(math.pi / 4, 0.01), (3.0, 0.3), (0.0, 0.02), (-2.0, 0.7)], "m double, e double")
    for r in d.select("m", "e", eccentric_anomaly(F.col("m"), F.col("e")).alias("x")).collect():
        assert abs(r.x - r.e * math.sin(r.x) - r.m) < 1e-10


def test_radius_at_reference_and_closed_form(spark):
    p = with_position(nav(spark)).first()
    assert math.sqrt(p.x_broadcast**2 + p.y_broadcast**2 + p.z_broadcast**2) == pytest.approx(26560000 * 0.99, rel=1e-12)
    angle = -7.2921151467e-5 * TOE  # the node at perigee, where x' = r
    assert p.x_broadcast == pytest.approx(26294400 * math.cos(angle), abs=1e-4)
    assert p.z_broadcast == pytest.approx(0, abs=1e-6)
    assert with_clock_correction(nav(spark)).first().clock_broadcast == pytest.approx(1e-6, abs=1e-15)


def test_incomplete_ephemerides_are_dropped(spark):
    base = ["G01", T0, 26560000.0, 0.01, 1.0, 0.0, 0.0, 0.0, TOE, None, 0.0, 0.0, 0.0]
    rows = [tuple(base), tuple(base[:7] + [None] + base[8:]), tuple(base[:2] + [-1.0] + base[3:])]
    assert with_position(nav(spark, rows)).count() == 1
    assert with_clock_correction(nav(spark, rows)).count() == 3


def test_week_modes(spark):
    d = nav(spark)
    week, epoch = (d.select(since_reference(F.col("timestamp"), F.col("toe"), m).alias("t")).first().t for m in ("week", "epoch"))
    assert week == 0
    assert epoch == (T0 - datetime(1980, 1, 6)).total_seconds() - TOE - 604800
    with pytest.raises(ValueError):
        since_reference(F.col("a"), F.col("a"), "day")


def test_gps_seconds_keeps_microseconds(spark):
    t = datetime(1980, 1, 6, 0, 0, 1, 250000)
    assert spark.createDataFrame([(t,)], "t timestamp_ntz").select(gps_seconds(F.col("t"))).first()[0] == 1.25


def test_error_vectors(spark):
    d = spark.createDataFrame([(26560000.0, 1000000.0, 0.0, 26560100.0, 1000200.0, 50.0, 1.23e-6, 1.25e-6)], "bx double, by double, bz double, px double, py double, pz double, b double, p double")
    b, p = (tuple(F.col(f"{k}{a}") for a in "xyz") for k in "bp")
    r = d.select(E.orbit_error(b, p), E.clock_error_ns(F.col("b"), F.col("p"))).first()
    assert r[0] == pytest.approx(229.128784747792, rel=1e-9) and r[1] == pytest.approx(-20, rel=1e-6)


def test_rac_components_have_the_length_of_the_error(spark):
    d = spark.createDataFrame([(10.0, 3.0, -2.0, 8.0, 0.0, 0.0, 0.0, 5.0, 0.0)], "bx double, by double, bz double, px double, py double, pz double, vx double, vy double, vz double")
    b, p, v = (tuple(F.col(f"{k}{a}") for a in "xyz") for k in "bpv")
    along, across = E.along_cross_errors(b, p, v)
    r = d.select(E.radial_error(b, p), along, across, E.orbit_error(b, p)).first()
    assert (r[0], r[1], r[2]) == (2.0, 3.0, -2.0)
    assert math.hypot(*r[:3]) == pytest.approx(r[3])


def test_scalars(spark):
    rows = [("1.5D-04",), ("-.12D-04",), (" 2.0E+01",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(fortran_double(F.col("s"))).collect()]
    assert got == [1.5e-4, -1.2e-5, 20.0, 0.0, 0.0]
    rows = [(math.nan,), (math.inf,), (-math.inf,), (None,), (2.0,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x double").select(finite_or(F.col("x"))).collect()] == [0.0, 1.0, -1.0, 0.0, 2.0]
    assert spark.createDataFrame([("G17",)], "s string").select(satellite_block(F.col("s"))).first()[0] == 2


def test_error_dataset_of_exact_states_is_zero(spark):
    times = spark.createDataFrame([(T0 + timedelta(minutes=15 * k),) for k in range(9)], "timestamp timestamp_ntz")
    states = broadcast_states(nav(spark), times)
    assert states.count() == 9  # up to two hours inclusive
    assert broadcast_states(nav(spark), times.select((F.col("timestamp") + F.expr("interval 1 microsecond")).alias("timestamp"))).count() == 8
    orbit = states.select("timestamp", "satellite", F.col("x_broadcast").alias("x"), F.col("y_broadcast").alias("y"), F.col("z_broadcast").alias("z"))
    clock = states.select("timestamp", "satellite", F.col("clock_broadcast").alias("clock_bias"))
    for velocity in (False, True):
        rows = error_dataset(states, orbit, clock, velocity=velocity).collect()
        assert len(rows) == 9 and all(abs(r.orbit_error_m) < 1e-6 and abs(r.clock_error_ns) < 1e-6 for r in rows)
        assert all((r.along_track_error_m is not None) == velocity for r in rows)
    assert error_dataset(states, orbit, clock.limit(1)).where("clock_error_ns is not null").count() == 0
    assert published(error_dataset(states, orbit, clock)).columns == ["satellite_id", "timestamp", "orbit_error_m", "clock_error_ns", "radial_error_m", "ephemeris_age_hours"]
