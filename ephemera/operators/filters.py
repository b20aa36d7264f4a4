"""Row filters, unit conversion and schema inspection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.functions.names import quoted
from ephemera.functions.scalars import finite_or

#: Clock value of SP3 files for "no clock": 999999.999999 microseconds, in seconds.
BAD_CLOCK_S = 0.999999999999


def keep_prefix(df: DataFrame, col: str = "satellite", prefix: str = "G") -> DataFrame:
    """Rows of one constellation."""
    return df.where(F.col(col).startswith(prefix))


def satellite_clocks(records: DataFrame) -> DataFrame:
    return _clocks(records, "AS", "satellite")


def station_clocks(records: DataFrame) -> DataFrame:
    return _clocks(records, "AR", "station")


def _clocks(records: DataFrame, kind: str, name: str) -> DataFrame:
    return records.where(F.col("type") == kind).drop("type").withColumnRenamed("id", name)


def drop_bad_clock(df: DataFrame, col: str = "clock_bias", sentinel: float = BAD_CLOCK_S, tolerance: float = 1e-10) -> DataFrame:
    return df.where(F.abs(F.col(col) - sentinel) > tolerance)


def missing_any(cols: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a null in ``cols``."""
    return df.dropna(subset=cols)


def retention_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: n_before, n_after, n_removed, retention_pct of ``drop_missing``."""
    n, kept = F.count("*"), F.count_if(~missing_any(cols))
    return df.agg(n.alias("n_before"), kept.alias("n_after")).select(
        "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"), (F.lit(100.0) * F.col("n_after") / F.col("n_before")).alias("retention_pct")
    )


def first_of_repeats(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each key (a null is a key of its own): the first in ``order``, of ties there the one with the least values.

    Repeats are thinned out before the exchange, so a key that repeats without end is no hot task.
    """
    rest = [c for c in df.columns if c not in (*by, *order)]
    row = F.struct(*(quoted(c).alias(f"o{i}") for i, c in enumerate(order)), *(quoted(c).alias(f"v{i}") for i, c in enumerate(rest)))
    d = df.select(F.struct(*(quoted(c).alias(f"k{i}") for i, c in enumerate(by))).alias("g"), row.alias("row")).groupBy("g").agg(F.min("row").alias("row"))
    found = {c: f"{place}{i}" for place, names in (("g.k", by), ("row.o", order), ("row.v", rest)) for i, c in enumerate(names)}
    return d.select(*(F.col(found[c]).alias(c) for c in df.columns))


def keep_keys(df: DataFrame, by: str, keys: Iterable) -> DataFrame:
    return df.where(F.col(by).isin(list(keys)))


def min_rows(df: DataFrame, by: str, n: int = 100) -> DataFrame:
    """Rows of keys with ``n`` rows at least: counts are aggregated first, so no key is gathered in a window."""
    enough = df.groupBy(by).count().where(F.col("count") >= n).select(by)
    return df.join(enough, by, "left_semi")


def convert_units(df: DataFrame, rules: dict[str, tuple[float, str]] | None = None) -> DataFrame:
    """Columns whose name contains a key of ``rules``, scaled and renamed: by default metres to km and ns to µs.

    Derived columns (means, deviations, differences) carry the name of their source and are converted with it.
    """
    rules = rules or {"error_m": (1e-3, "error_km"), "error_ns": (1e-3, "error_us")}
    out = []
    for c in df.columns:
        rule = next(((k, v) for k, v in rules.items() if k in c), None)
        out.append(F.col(c) if rule is None else (F.col(c) * rule[1][0]).alias(c.replace(rule[0], rule[1][1])))
    return df.select(*out)


def replace_nonfinite(df: DataFrame, cols: list[str], nan: float = 0.0, pos: float = 1.0, neg: float = -1.0, null: float | None = 0.0) -> DataFrame:
    return df.withColumns({c: finite_or(F.col(c).cast("double"), nan, pos, neg, null) for c in cols})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def time_column(df: DataFrame) -> str | None:
    """The first column whose name contains "time" or "date"."""
    return next((c for c in df.columns if "time" in c.lower() or "date" in c.lower()), None)


def serving_features(df: DataFrame, age_h: float = 2.0, radial_share: float = 0.8) -> DataFrame:
    """Request fields in the feature schema: missing errors are 0, radial is a share of the orbit error, age is constant."""
    orbit = F.coalesce(F.col("pos_error_m"), F.lit(0.0))
    return df.select(
        "timestamp", "satellite_id", orbit.alias("orbit_error_m"), F.coalesce(F.col("clock_error_ns"), F.lit(0.0)).alias("clock_error_ns"),
        (orbit * radial_share).alias("radial_error_m"), F.lit(age_h).alias("ephemeris_age_hours"),
    )
