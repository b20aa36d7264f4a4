"""Look-back windows for forecasting, as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ephemera.functions.names import quoted
from ephemera.operators.periods import with_following, within
from ephemera.operators.windows import series


def make_windows(
    df: DataFrame, by: str, on: str | list[str], features: list[str], targets: list[str], lookback: int, horizon: int, stride: int = 1, bucket: str | None = None
) -> DataFrame:
    """(by, window_start, x, y): ``lookback`` rows of features, then ``horizon`` rows of targets, every ``stride`` rows of a key.

    A key of n rows has ceil((n - lookback - horizon + 1) / stride) windows; none crosses a key.  Starts are chosen
    before the arrays are kept, so skipped windows cost no memory beyond the frame.  ``bucket`` cuts long keys into
    periods, which borrow the rows that their last windows reach; the stride goes on over the periods of a key, so the
    result is the same.
    """
    first = on if isinstance(on, str) else on[0]
    if bucket is not None:
        own = lambda cols: F.array(*(F.col("row").getField(c).cast("double") for c in cols))
        w = within(on)
        arrays = {
            "x": F.collect_list(own(features)).over(w.rowsBetween(0, lookback - 1)),
            "y": F.collect_list(own(targets)).over(w.rowsBetween(lookback, lookback + horizon - 1)),
        }
        used = list(dict.fromkeys([by, *([on] if isinstance(on, str) else on), *features, *targets]))
        d = with_following(df.select(*map(quoted, used)), by, on, lookback + horizon - 1, bucket, arrays)
        d = d.where(((F.col("place") - 1) % stride == 0) & (F.size("y") == horizon))
        return d.select(F.col("row").getField(by).alias(by), F.col("row").getField(first).alias("window_start"), "x", "y")
    w = series(by, on)
    numbers = lambda cols: F.array(*(F.col(c).cast("double") for c in cols))
    d = df.select(by, *([on] if isinstance(on, str) else on), numbers(features).alias("__f"), numbers(targets).alias("__t"))
    d = d.select(
        by,
        F.col(first).alias("window_start"),
        F.row_number().over(w).alias("__k"),
        F.collect_list("__f").over(w.rowsBetween(0, lookback - 1)).alias("x"),
        F.collect_list("__t").over(w.rowsBetween(lookback, lookback + horizon - 1)).alias("y"),
    )
    return d.where(((F.col("__k") - 1) % stride == 0) & (F.size("y") == horizon)).drop("__k")


def nested_windows(windows: DataFrame, by: str, outer: int, on: str = "window_start", bucket: str | None = None) -> DataFrame:
    """(by, window_start, x, y): ``outer`` consecutive windows of a key as one flat feature row each, and the last one's y.

    x has ``outer`` rows of lookback * features numbers; ``flat(x)`` gives the tabular form.  ``bucket`` cuts long keys
    into periods with the same result.
    """
    if bucket is not None:
        w = within(on)
        row = lambda c: F.col("row").getField(c)
        arrays = {"x": F.collect_list(F.flatten(row("x"))).over(w.rowsBetween(0, outer - 1)), "y": F.lead(row("y"), outer - 1).over(w)}
        d = with_following(windows.select(*map(quoted, (by, on, "x", "y"))), by, on, outer - 1, bucket, arrays)
        return d.where(F.size("x") == outer).select(row(by).alias(by), row(on).alias(on), "x", "y")
    w = series(by, on)
    d = windows.select(by, on, F.collect_list(F.flatten("x")).over(w.rowsBetween(0, outer - 1)).alias("x"), F.lead("y", outer - 1).over(w).alias("y"))
    return d.where(F.size("x") == outer)


def flat(df: DataFrame, col: str = "x") -> DataFrame:
    """``df`` with the rows of an array of arrays joined."""
    return df.withColumn(col, F.flatten(col))


def long_rows(df: DataFrame, keep: list[str], col: str = "x") -> DataFrame:
    """(keep, step, feature, value): the numbers of a window, one per row."""
    d = df.select(*keep, F.posexplode(col).alias("step", "__row"))
    return d.select(*keep, "step", F.posexplode("__row").alias("feature", "value"))


def drop_incomplete(df: DataFrame, cols: list[str] = ("x", "y")) -> DataFrame:
    """Windows without null or NaN."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & ~F.exists(F.flatten(c), lambda v: v.isNull() | F.isnan(v))
    return df.where(keep)


def windows_per_key(df: DataFrame, by: str) -> DataFrame:
    """(by, n, pct): windows of each key and their share of all."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(by, "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct"))  # one row
