"""Feature preparation: scalers, encoders, splits and augmentation. Fitted parameters are small tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephemera.functions.names import free_name, quoted
from ephemera.operators.order import global_rank
from ephemera.operators.profile import long_form, percentiles

#: Distinct labels that one_hot may turn into columns.
MOST_LABELS = 1000


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard", accuracy: int | None = None) -> DataFrame:
    """(column, center, scale, kind): scaled value = (x - center) / scale.

    standard: mean and population deviation; minmax: minimum and range; robust: median and interquartile range.  A
    scale of 0 becomes 1.  Nulls are left out.
    """
    if kind == "robust":
        fitted = percentiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, accuracy)
        fitted = fitted.select("column", F.col("q50").alias("center"), (F.col("q75") - F.col("q25")).alias("scale"))
    else:
        center, scale = {"standard": (F.avg("value"), F.stddev_pop("value")), "minmax": (F.min("value"), F.max("value") - F.min("value"))}[kind]
        fitted = long_form(df, cols).groupBy("column").agg(center.alias("center"), scale.alias("scale"))
    return fitted.select("column", "center", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")).alias("scale"), F.lit(kind).alias("kind"))


def _apply(df: DataFrame, params: DataFrame, cols: list[str], expr, suffix: str) -> DataFrame:
    row = params.where(F.col("column").isin(cols)).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("center", "scale")))).alias("__params"))
    d = df.crossJoin(F.broadcast(row))  # one row, with an entry per column
    p = lambda c: F.element_at("__params", F.lit(c))
    return d.withColumns({f"{c}{suffix}": expr(F.col(c), p(c)["center"], p(c)["scale"]) for c in cols}).drop("__params")


def transform(df: DataFrame, params: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """``cols`` scaled by fitted parameters (in place, or as new columns with ``suffix``)."""
    return _apply(df, params, cols, lambda x, center, scale: (x - center) / scale, suffix)


def inverse(df: DataFrame, params: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    return _apply(df, params, cols, lambda x, center, scale: x * scale + center, suffix)


def inverse_long(df: DataFrame, params: DataFrame, values: list[str], feature: str = "feature") -> DataFrame:
    """Long (feature, ...) rows with ``values`` in original units."""
    p = params.select(F.struct(F.col("column").alias("of"), "center", "scale").alias("p"))
    row = F.struct(*map(quoted, df.columns))
    d = df.select(row.alias("row")).join(F.broadcast(p), F.col("row").getField(feature) == F.col("p.of"))  # a row per column
    cell = lambda c: F.col("row").getField(c)
    return d.select(*((cell(c) * F.col("p.scale") + F.col("p.center") if c in values else cell(c)).alias(c) for c in df.columns))


def scaling_check(df: DataFrame, cols: list[str], tolerance: float = 0.01) -> DataFrame:
    """One row over all cells: mean, std, min, max, n_nan, n_infinite and ok (mean near 0, deviation near 1)."""
    v, bad = F.col("value"), F.isnan("value") | (F.abs("value") == math.inf)
    fine = F.when(~bad, v)
    out = long_form(df, cols).agg(
        F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"), F.min(fine).alias("min"), F.max(fine).alias("max"), F.count_if(F.isnan("value")).alias("n_nan"), F.count_if(F.abs("value") == math.inf).alias("n_infinite")
    )
    return out.withColumn("ok", (F.abs("mean") < tolerance) & (F.abs(F.col("std") - 1) < tolerance))


def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """(label, index): distinct values in ascending order from 0, ranked by ranges."""
    labels = df.select(quoted(col).alias("label")).where("label is not null").distinct()
    return global_rank(labels, ["label"], "index").select("label", (F.col("index") - 1).cast("int").alias("index"))


def encode_labels(df: DataFrame, labels: DataFrame, col: str, out: str, unseen: str = "error") -> DataFrame:
    """``df`` with the index of ``col`` as ``out``, in place of a column of that name; a value without one is an error, or null with ``unseen="keep"``."""
    d = df.select(F.struct(*map(quoted, df.columns)).alias("row")).join(labels.select(F.struct("label", "index").alias("found")), F.col("row").getField(col) == F.col("found.label"), "left")
    value, index = F.col("row").getField(col), F.col("found.index")
    if unseen == "error":
        fail = F.raise_error(F.concat(F.lit(f"{col} has a label that was not fitted: "), value.cast("string")))
        index = F.when(index.isNull() & value.isNotNull(), fail).otherwise(index)
    return d.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != out.lower()), index.alias(out))


def label_map(labels: DataFrame) -> DataFrame:
    """One row with the map label -> index."""
    return labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "index")))).alias("labels"))


def one_hot(df: DataFrame, labels: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """``df`` with a column prefix + label per fitted label, 1.0 or 0.0 (MOST_LABELS at most)."""
    values = [r.label for r in labels.orderBy("index").limit(MOST_LABELS + 1).collect()]
    if len(values) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    prefix = f"{col}_" if prefix is None else prefix
    return df.withColumns({f"{prefix}{v}": F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in values})


def split_fraction(df: DataFrame, on: str, ties: str, fractions: list[float], names: list[str]) -> DataFrame:
    """``df`` with ``split``: rows in order of (``on``, ``ties``) cut at the floor of n times each cumulative fraction.

    Rows per time are counted, the counts are summed up over the (small) time table, and only times in which a cut
    falls rank their own rows: the whole table is never sorted in one task.
    """
    per = df.groupBy(on).agg(F.count("*").alias("__n"))
    # one row per time, and counts only: partial sums by day first keep the last window short
    day = per.groupBy(F.to_date(on).alias("__day")).agg(F.sum("__n").alias("__d"))
    day = day.withColumn("__db", F.coalesce(F.sum("__d").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__day").orderBy(on).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__day", F.to_date(on)).withColumn("__in", inside).join(day.select(F.col("__day").alias("__of"), "__db"), F.col("__day").eqNullSafe(F.col("__of")))
    per = per.select(F.col(on).alias("__on"), "__n", (F.col("__in") + F.col("__db")).alias("__before"))
    total = per.agg(F.sum("__n").alias("__total"))
    shares, cuts = 0.0, []
    for f in fractions[:-1]:
        shares += f
        cuts.append(shares)
    d = df.join(per, F.col(on).eqNullSafe(F.col("__on"))).crossJoin(F.broadcast(total))  # one row
    at = [F.floor(F.col("__total") * F.lit(c) + 1e-9) for c in cuts]
    straddles = F.lit(False)
    for a in at:
        straddles = straddles | ((F.col("__before") < a) & (F.col("__before") + F.col("__n") > a))
    # rows of other times get keys of their own by hash, so the ranking window is spread
    rank = F.row_number().over(Window.partitionBy(F.when(straddles, F.col(on)), F.when(~straddles, F.xxhash64(on, ties))).orderBy(ties))
    place = F.col("__before") + F.when(straddles, rank - 1).otherwise(0)
    split = F.lit(names[-1])
    for a, name in reversed(list(zip(at, names[:-1], strict=True))):
        split = F.when(F.col("__place") < a, name).otherwise(split)
    return d.withColumn("__place", place).withColumn("split", split).select(*df.columns, "split")


def hashed_unit(*parts: Column | str | int) -> Column:
    """A number between 0 and 1 from a hash (MD5) of ``parts``: the same in any engine and at any partitioning."""
    text = F.concat_ws("|", *(F.lit(str(p)) if isinstance(p, int) else F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def shuffled(df: DataFrame, keys: list[str], seed: int = 42, place: str = "place") -> DataFrame:
    """``df`` with ``place``, from 1, in an order that a hash of ``keys`` and ``seed`` decides: the same at any partitioning.

    Ranges of the hash are dealt out and sorted (see ``order.global_rank``), so no task holds the whole table; rows
    that repeat all keys follow each other.  ``order.write_ordered`` by ``place`` gives files in that order.
    """
    at = free_name(df, "at")
    return global_rank(df.withColumn(at, hashed_unit(seed, *keys)), [at, *keys], place).drop(at)


def split_random(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``, decided by a hash of the key: the same at any partitioning."""
    return df.withColumn("split", F.when(hashed_unit(seed, *keys) < test_share, "test").otherwise("train"))


def split_last_day(df: DataFrame, on: str, day: str | None = None) -> DataFrame:
    """``df`` with ``split``: the given or else the last calendar day is test."""
    if day is not None:
        return df.withColumn("split", F.when(F.to_date(on) == F.lit(day).cast("date"), "test").otherwise("train"))
    last = df.agg(F.max(F.to_date(on)).alias("__last"))
    return df.crossJoin(F.broadcast(last)).select(*df.columns, F.when(F.to_date(on) == F.col("__last"), "test").otherwise("train").alias("split"))  # one row


def augment_noise(train: DataFrame, cols: list[str], sigma: float = 0.005, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """``train`` and a copy with Gaussian noise, marked in ``augmented``. Split first: only training rows belong here.

    With ``keys`` the noise comes from a hash of them (Box-Muller), so it does not depend on partitioning.
    """
    def noise(k: int) -> Column:
        if keys is None:
            return F.randn(seed + k)
        return F.sqrt(-2 * F.log(hashed_unit(seed, 2 * k, *keys))) * F.cos(2 * math.pi * hashed_unit(seed, 2 * k + 1, *keys))

    noisy = train.withColumns({c: F.col(c) + sigma * noise(k) for k, c in enumerate(cols)})
    return train.withColumn("augmented", F.lit(False)).unionByName(noisy.withColumn("augmented", F.lit(True)))


def preparation_report(params: DataFrame, labels: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """One row: method, lookback, horizon, labels (map) and scalers (map column -> center and scale)."""
    scalers = params.agg(F.first("kind").alias("method"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.struct("center", "scale"))))).alias("scalers"))
    return scalers.crossJoin(label_map(labels)).select("method", F.lit(lookback).alias("lookback"), F.lit(horizon).alias("horizon"), "labels", "scalers")
