"""Broadcast states and the error data set."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ephemera.functions import errors as E
from ephemera.functions.orbit import with_clock_correction, with_position
from ephemera.operators.asof import Samples, cross_times, interpolate_many, nearest_asof, nearest_on_grid
from ephemera.operators.filters import first_of_repeats
from ephemera.sources.nav import SOURCE


def first_ephemerides(nav: DataFrame) -> DataFrame:
    """One ephemeris for each satellite and time: the first of the first file, by name, where ``nav`` tells file and record (``read_nav(source=True)``).

    Both columns are dropped; a table without them stays as it is.
    """
    if not set(SOURCE) <= set(nav.columns):
        return nav
    return first_of_repeats(nav, ["satellite", "timestamp"], SOURCE).drop(*SOURCE)


def ephemeris_at(nav: DataFrame, targets: DataFrame, tolerance_h: float = 2.0, how: str = "inner", bucket: str | None = None) -> DataFrame:
    """(satellite, timestamp) rows with the nearest ephemeris within ``tolerance_h`` and its age in hours.

    Daily files repeat ephemerides: of several for one satellite and time the first file's is taken (see
    ``first_ephemerides``), without ``file`` and ``record`` the one with the least values.
    """
    found = nearest_asof(targets, first_ephemerides(nav).drop("epoch"), "satellite", "timestamp", tolerance_h * 3600, how, bucket=bucket)
    return found.withColumn("ephemeris_age", F.col("age_s") / 3600).drop("age_s", "timestamp_right")


def broadcast_states(nav: DataFrame, times: DataFrame, week_mode: str = "week", bucket: str | None = None) -> DataFrame:
    """Position, clock and ephemeris age of every GPS satellite of ``nav`` at every time of ``times``."""
    gps = nav.where(F.col("satellite").startswith("G"))
    at = ephemeris_at(gps, cross_times(times, gps), bucket=bucket)
    full = with_clock_correction(with_position(at, week_mode=week_mode), week_mode=week_mode)
    return full.select("timestamp", "satellite", "x_broadcast", "y_broadcast", "z_broadcast", "clock_broadcast", "ephemeris_age")


def broadcast_states_on_grid(nav: DataFrame, start: datetime, end: datetime, step_s: float, tolerance_h: float = 2.0, week_mode: str = "week") -> DataFrame:
    """``broadcast_states`` at the times of a grid: each ephemeris emits its own times, so only ephemerides are exchanged."""
    gps = first_ephemerides(nav.where(F.col("satellite").startswith("G"))).drop("epoch")
    at = nearest_on_grid(gps, "satellite", "timestamp", start, end, step_s, tolerance_h * 3600).withColumn("ephemeris_age", F.col("age_s") / 3600)
    full = with_clock_correction(with_position(at, week_mode=week_mode), week_mode=week_mode)
    return full.select("timestamp", "satellite", "x_broadcast", "y_broadcast", "z_broadcast", "clock_broadcast", "ephemeris_age")


def error_dataset(broadcast: DataFrame, orbit: DataFrame, clock: DataFrame, velocity: bool = False, bucket: str | None = None, times: DataFrame | None = None) -> DataFrame:
    """Orbit, radial, along, cross and clock errors per satellite and time.

    Precise positions are interpolated to the broadcast times (rows outside them or without a position are dropped);
    clocks need two valid samples and are null outside those.  With ``velocity`` the precise positions' finite
    differences give along-track and cross-track errors, else they are null.  With ``bucket``, ``times`` may give the
    (satellite, timestamp) rows that ``broadcast`` was computed for, so that it is computed once.
    """
    precise = E.with_velocity(orbit) if velocity else orbit
    axes = ["x", "y", "z", *(["vx", "vy", "vz"] if velocity else [])]
    products = [Samples(precise, axes), Samples(clock, ["clock_bias"], "null", skip_null=True, min_points=2)]
    d = interpolate_many(broadcast, products, "satellite", "timestamp", bucket, times).dropna(subset=["x", "y", "z"])
    b, p = tuple(F.col(f"{c}_broadcast") for c in "xyz"), tuple(F.col(c) for c in "xyz")
    along, across = E.along_cross_errors(b, p, tuple(F.col(f"v{c}") for c in "xyz")) if velocity else (F.lit(None).cast("double"),) * 2
    return d.select(
        "timestamp",
        "satellite",
        E.orbit_error(b, p).alias("orbit_error_m"),
        E.radial_error(b, p).alias("radial_error_m"),
        along.alias("along_track_error_m"),
        across.alias("cross_track_error_m"),
        E.clock_error_ns(F.col("clock_broadcast"), F.col("clock_bias")).alias("clock_error_ns"),
        F.col("ephemeris_age").alias("ephemeris_age_hours"),
    )


def published(errors: DataFrame) -> DataFrame:
    """The columns of the published error table; optional ones only if they are there."""
    names = ["orbit_error_m", "clock_error_ns", "radial_error_m", "ephemeris_age_hours"]
    return errors.select(F.col("satellite").alias("satellite_id"), "timestamp", *(c for c in names if c in errors.columns))
