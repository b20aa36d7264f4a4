"""Differences between broadcast and precise states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def difference(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def orbit_error(broadcast: Vector, precise: Vector) -> Column:
    """Length of the difference, metres."""
    return norm(difference(broadcast, precise))


def radial_error(broadcast: Vector, precise: Vector) -> Column:
    """Difference along the precise position; null at the origin."""
    return F.when(norm(precise) > 0, dot(difference(broadcast, precise), precise) / norm(precise))


def along_cross_errors(broadcast: Vector, precise: Vector, velocity: Vector) -> tuple[Column, Column]:
    """Differences along the velocity, and across it and the position; null where velocity is null or zero."""
    d, speed, across = difference(broadcast, precise), norm(velocity), cross(precise, velocity)
    return F.when(speed > 0, dot(d, velocity) / speed), F.when(norm(across) > 0, dot(d, across) / norm(across))


def clock_error_ns(broadcast: Column, precise: Column) -> Column:
    """Clock difference in nanoseconds; null if either is."""
    return (broadcast - precise) * 1e9


def with_velocity(df: DataFrame, by: str = "satellite", on: str = "timestamp", axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """``df`` with v<axis>: central differences of a series (one-sided at its ends, null for single rows)."""
    from ephemera.functions.scalars import micros

    w = Window.partitionBy(by).orderBy(on)
    t = F.col("__us") / 1e6
    first = lambda c: F.coalesce(F.lag(c).over(w), c)
    last = lambda c: F.coalesce(F.lead(c).over(w), c)
    d = df.withColumn("__us", micros(F.col(on)))
    span = last(t) - first(t)
    return d.withColumns({f"v{a}": F.when(span > 0, (last(F.col(a)) - first(F.col(a))) / span) for a in axes}).drop("__us")
