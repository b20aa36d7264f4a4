"""Rolling features, gap filling and time features of keyed series.

All frames are bounded, and all operators of a series want the same layout (key, then time), so Catalyst plans one
exchange and one sort for a chain of them.  ``bucket`` cuts long keys into periods; rows that a period's first frames
reach back to are copied into it (a halo of ``n - 1`` rows) and dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephemera.functions.names import free_name, quoted
from ephemera.functions.scalars import day_cycle, micros, satellite_block
from ephemera.operators.periods import gaps_by_period, rolling_by_places


def series(by: str | list[str], on: str | list[str]):
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (by, on))
    return Window.partitionBy(*keys).orderBy(*order)


def with_halo(df: DataFrame, by: str, on: str | list[str], rows: int, bucket: str) -> tuple[DataFrame, str, str]:
    """``df`` with two columns, and their names: the period, and whether the row is its own; each period also holds the last ``rows`` rows before it.

    The rows to copy are the last of their period; a period with fewer rows reaches further back.  The table of
    periods tells each which later ones lack how many rows before them (``rows`` of them at most), so a row is joined
    to its own period alone and copied from there.
    """
    order = [on] if isinstance(on, str) else list(on)
    period, own = free_name(df, "period"), free_name(df, "own")
    d = df.select(quoted(by).alias("k"), F.date_trunc(bucket, quoted(order[0])).alias("p"), F.struct(*map(quoted, df.columns)).alias("row"))
    n = d.groupBy("k", "p").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("k").orderBy("p")
    ends = n.withColumn("end", F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("later", F.collect_list(F.struct("p", (F.col("end") - F.col("n")).alias("start"))).over(so_far.rowsBetween(1, rows)))
    # a row that is ``back`` from the end of its period is needed by a later one if fewer than ``rows`` rows lie between
    needs = F.transform("later", lambda x: F.struct(x["p"].alias("p"), (rows - (x["start"] - F.col("end"))).alias("most")))
    needs = ends.select("k", "p", F.filter(needs, lambda x: x["most"] > 0).alias("needs"))
    back = F.row_number().over(Window.partitionBy("k", "p").orderBy(*(F.col("row").getField(c).desc() for c in order)))
    last = d.withColumn("back", back).where(F.col("back") <= rows)
    halo = last.join(needs, ["k", "p"]).select("row", "back", F.explode("needs").alias("to")).where("back <= to.most")
    both = d.select("row", "p", F.lit(True).alias("own")).unionByName(halo.select("row", F.col("to.p").alias("p"), F.lit(False).alias("own")))
    return both.select(*(F.col("row").getField(c).alias(c) for c in df.columns), F.col("p").alias(period), F.col("own").alias(own)), period, own


def rolling_stats(df: DataFrame, by: str, on: str | list[str], cols: list[str], n: int = 12, bucket: str | None = None) -> DataFrame:
    """``df`` with <col>_ma, <col>_std and <col>_diff over the last ``n`` rows of the key (fewer at its start).

    Deviations are sample deviations, 0 for a single row; the first difference is 0.
    """
    d, period, own = (df, "", "") if bucket is None else with_halo(df, by, on, max(1, n - 1), bucket)
    w = series(by if bucket is None else [by, period], on)
    frame = w.rowsBetween(-(n - 1), 0)
    new: dict[str, Column] = {}
    for c in cols:
        new[f"{c}_ma"] = F.avg(c).over(frame)
        new[f"{c}_std"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
        new[f"{c}_diff"] = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    d = d.withColumns(new)
    return d if bucket is None else d.where(F.col(own)).drop(own, period)


def adaptive_rolling(df: DataFrame, by: str, on: str | list[str], cols: list[str], most: int = 12, share: int = 4, bucket: str | None = None) -> DataFrame:
    """Rolling mean and deviation over min(``most``, rows of the key // ``share``) rows, one at least.

    The frame is the last ``most`` rows (a literal); the key's own length cuts a slice of it.  With ``bucket`` long keys
    are cut into periods and frames of any length are differences of prefix sums (see ``periods.rolling_by_places``).
    """
    if bucket is not None:
        return rolling_by_places(df, by, on, cols, F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / share))), bucket)
    w = series(by, on)
    sizes = df.groupBy(by).agg(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.count("*") / share))).cast("int").alias("__n"))
    d = df.join(sizes, by)
    new: dict[str, Column] = {}
    for c in cols:
        last = F.collect_list(F.col(c).cast("double")).over(w.rowsBetween(-(most - 1), 0))
        new[f"__w_{c}"] = F.slice(last, F.greatest(F.lit(1), F.size(last) - F.col("__n") + 1), F.col("__n"))
    d = d.withColumns(new)
    out: dict[str, Column] = {}
    for c in cols:
        x = F.col(f"__w_{c}")
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
        out[f"{c}_ma"] = mean
    d = d.withColumns(out)
    for c in cols:
        x, mean = F.col(f"__w_{c}"), F.col(f"{c}_ma")
        d = d.withColumn(f"{c}_std", F.when(F.size(x) > 1, F.sqrt(_squares(x, mean) / (F.size(x) - 1))).otherwise(0.0))
    return d.drop("__n", *(f"__w_{c}" for c in cols))


def _squares(x: Column, mean: Column) -> Column:
    return F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)


def fill_gaps(df: DataFrame, by: str, on: str, cols: list[str], bucket: str | None = None) -> DataFrame:
    """Nulls filled linearly in time between known values; before the first and after the last known value with it.

    The next known value comes from a descending window, whose frame grows like the ascending one, so both are linear.
    ``bucket`` cuts long keys into periods (see ``periods.gaps_by_period``) with the same result.
    """
    if bucket is not None:
        return gaps_by_period(df, by, on, cols, bucket)
    up = Window.partitionBy(by).orderBy(F.col(on).asc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy(F.col(on).desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = micros(F.col(on))
    new, out = {}, {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).cast("double").alias("v")))
        new[f"__p_{c}"], new[f"__n_{c}"] = F.last(known, ignorenulls=True).over(up), F.last(known, ignorenulls=True).over(down)
        p, q = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        line = p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / (q["t"] - p["t"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(line)
    return df.withColumns(new).withColumns(out).drop(*new)


def time_features(df: DataFrame, on: str = "timestamp", satellite: str | None = None) -> DataFrame:
    """``df`` with hour, day, day_of_year, minute_of_day, day_sin, day_cos and, for a satellite column, satellite_block."""
    ts = F.col(on)
    sin, cos = day_cycle(ts)
    new = {"hour": F.hour(ts), "day": F.dayofmonth(ts), "day_of_year": F.dayofyear(ts), "minute_of_day": F.hour(ts) * 60 + F.minute(ts), "day_sin": sin, "day_cos": cos}
    if satellite:
        new["satellite_block"] = satellite_block(F.col(satellite))
    return df.withColumns(new)


def tail(df: DataFrame, by: str, on: str | list[str], k: int = 1) -> DataFrame:
    """The last ``k`` rows of each key."""
    order = [on] if isinstance(on, str) else list(on)
    w = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    place = free_name(df, "place")
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= k).drop(place)


def head(df: DataFrame, by: str, on: str | list[str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key."""
    place = free_name(df, "place")
    return df.withColumn(place, F.row_number().over(series(by, on))).where(F.col(place) <= k).drop(place)


def first_rows(df: DataFrame, on: str | list[str], k: int = 5, last: bool = False) -> DataFrame:
    """The first (or ``last``) ``k`` rows of the table in order: each task offers its own ``k``, so nothing is sorted whole."""
    order = [on] if isinstance(on, str) else list(on)
    return df.orderBy(*(F.col(c).desc() if last else F.col(c).asc() for c in order)).limit(k)


def not_monotonic(df: DataFrame, by: str, on: str, order: list[str]) -> DataFrame:
    """(key, n): how often the time does not rise from one row to the next in ``order``; keys in order are left out."""
    before = F.lag(on).over(series(by, order))
    return df.select(by, (F.col(on) <= before).alias("bad")).groupBy(by).agg(F.count_if("bad").alias("n")).where("n > 0")
