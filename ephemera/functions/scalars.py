"""Time, cleaning and unit expressions. All take and return Columns, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of GPS time; timestamps are naive GPS time (TIMESTAMP_NTZ).
GPS_EPOCH = "1980-01-06 00:00:00"
WEEK_S = 604_800.0


def micros(ts: Column) -> Column:
    """Whole microseconds since the GPS epoch, exact for naive timestamps."""
    return F.timestamp_diff("MICROSECOND", F.lit(GPS_EPOCH).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def gps_seconds(ts: Column) -> Column:
    """Seconds since the GPS epoch, fraction included."""
    return micros(ts) / 1e6


def wrap_half_week(dt: Column) -> Column:
    """A time difference moved by one week if it is beyond half a week."""
    return F.when(dt > WEEK_S / 2, dt - WEEK_S).when(dt < -WEEK_S / 2, dt + WEEK_S).otherwise(dt)


def since_reference(ts: Column, reference: Column, week_mode: str = "week") -> Column:
    """Seconds from ``reference`` (seconds of week) to ``ts``, wrapped.

    ``week_mode="week"`` reduces ``ts`` to seconds of week first; ``"epoch"`` subtracts from seconds since the epoch
    as they are, which leaves all whole weeks but one in the result.
    """
    if week_mode not in ("week", "epoch"):
        raise ValueError("week_mode is 'week' or 'epoch'")
    t = gps_seconds(ts)
    return wrap_half_week((F.pmod(t, F.lit(WEEK_S)) if week_mode == "week" else t) - reference)


def epoch_timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A naive timestamp from its parts; seconds are cut to microseconds; null if a part is not a number."""
    number = [F.trim(x).try_cast("int") for x in (year, month, day, hour, minute)]
    seconds = F.trim(second).try_cast("double")
    whole = F.floor(seconds).cast("int")
    base = F.try_make_timestamp_ntz(*number, F.lit(0).cast("decimal(16,6)"))
    return F.timestamp_add("MICROSECOND", F.floor((seconds - whole) * 1e6 + 1e-3).cast("long"), F.timestamp_add("SECOND", whole, base))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or(c: Column, nan: float = 0.0, pos: float = 1.0, neg: float = -1.0, null: float | None = 0.0) -> Column:
    """``c`` with NaN, infinities and null replaced."""
    out = F.when(F.isnan(c), nan).when(c == math.inf, pos).when(c == -math.inf, neg).otherwise(c)
    return out if null is None else F.coalesce(out, F.lit(null))


def fortran_double(text: Column) -> Column:
    """A number written with a D or E exponent; anything else is 0.0."""
    return F.coalesce(F.regexp_replace(F.trim(text), "[Dd]", "E").try_cast("double"), F.lit(0.0))


def day_cycle(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour on a 24-hour circle."""
    angle = F.hour(ts) * (2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def satellite_block(satellite: Column, size: int = 8) -> Column:
    """Number of the block of ``size`` satellites that an id such as G17 belongs to."""
    return F.floor(F.substring(satellite, 2, 100).try_cast("int") / size).cast("int")
