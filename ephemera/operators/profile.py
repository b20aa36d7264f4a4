"""Profiles of tables and series. Every result comes from partial aggregations; no key is gathered whole."""

from __future__ import annotations

import math
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephemera.functions.names import free_name, quoted
from ephemera.sources.text import scratch

#: Accuracy of the sketch that brackets exact percentiles, and how far beyond its error the brackets reach.
BRACKET_ACCURACY, BRACKET_MARGIN = 10_000, 2 / 10_000
#: Tables of up to so many groups are broadcast; beyond, those of the groups with more than 1 / HUBS of the rows each.
MOST_GROUPS, HUBS = 100_000, 1_000


def long_form(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """(``keep``, column, value): one row for each cell."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols)))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.column", "p.value")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; for tables with a row for each group."""
    path = f"{scratch(df.sparkSession)}/groups-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Groups:
    """A kept table with one row (g, n, ...) for each group of n rows; joins rows to tables of groups without a hot task.

    Up to MOST_GROUPS groups such tables are broadcast.  Beyond, the groups that hold more than 1 / HUBS of all rows,
    fewer than HUBS of them, are broadcast, so their rows stay where they are, and the others are joined by a shuffle.
    """

    def __init__(self, table: DataFrame, most: int | None = None):
        self.table = kept(table)
        groups, total = self.table.agg(F.count("*"), F.sum("n")).first()
        self.few = groups <= (MOST_GROUPS if most is None else most)
        self.hubs = self.table.where(F.col("n") * HUBS > (total or 0)).select("g")

    def attach(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        if self.few:
            return rows.join(F.broadcast(groups), "g")
        hot = rows.join(F.broadcast(groups.join(F.broadcast(self.hubs), "g", "left_semi")), "g")
        return hot.unionByName(rows.join(F.broadcast(self.hubs), "g", "left_anti").join(groups, "g"))


def percentiles(df: DataFrame, cols: list[str], q: dict[str, float], accuracy: int | None = None, slots: int = 4096, by: list[str] = (), most: int | None = None) -> DataFrame:
    """(``by``, column, one column for each name in ``q``): linear percentiles of each of ``cols`` with a value; nulls are left out.

    Exact, and no group's values meet in one task: a sketch of bounded size brackets each percentile, rows are counted
    in ``slots`` ranges of each bracket and one beyond on each side, and only the values of the range that the wanted
    rank falls into are put in order.  A bracket that misses costs time, not exactness.  All groups (of ``by``; null is
    a value of its own) and columns go through the same three readings of ``df``, so store it if it is costly to
    compute; with ``accuracy`` the sketch itself answers, in one pass.
    """
    keys = [f"k{i}" for i in range(len(by))]
    named = df.select(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True)), *map(quoted, cols))
    cells = long_form(named, cols, keys).where("value is not null")
    cells = cells.select((F.struct(*keys, "column") if by else F.col("column")).alias("g"), "value")
    names = [F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)] + [(F.col("g.column") if by else F.col("g")).alias("column")]
    if accuracy is not None:
        return cells.groupBy("g").agg(*(F.percentile_approx("value", x, accuracy).alias(name) for name, x in q.items())).select(*names, *q)
    near = [min(1.0, max(0.0, x + d)) for x in q.values() for d in (-BRACKET_MARGIN, BRACKET_MARGIN)]
    brackets = cells.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("value", near, BRACKET_ACCURACY).alias("ends"))
    if by:
        groups = Groups(brackets, most)
        brackets, attach = groups.table, groups.attach
    else:
        attach = lambda rows, table: rows.join(F.broadcast(table), "g")  # noqa: E731  (a row per column)

    def slot(i: int) -> Column:
        v, lo, hi = F.col("value"), F.col("ends")[2 * i], F.col("ends")[2 * i + 1]
        inside = F.least(F.lit(slots - 1), F.floor((v - lo) / (hi - lo) * slots))
        return F.when(v < lo, -1).when(v > hi, slots).when((hi - lo > 0) & (hi - lo < math.inf), inside).otherwise(0).cast("int")

    # slots rise with the value, so a group has at most len(q) * (slots + 2) different arrays of them
    placed = attach(cells, brackets).select("g", "n", "value", F.array(*map(slot, range(len(q)))).alias("at"))
    per = placed.groupBy("g", "n", "at").agg(F.count("*").alias("c")).select("g", "n", F.posexplode("at").alias("i", "slot"), "c")
    per = per.groupBy("g", "n", "i", "slot").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "i").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.get(F.array(*map(F.lit, q.values())), F.col("i")) * (F.col("n") - 1)
    wanted = per.withColumn("upto", upto).where((F.col("upto") - F.col("c") <= F.ceil(rank)) & (F.col("upto") > F.floor(rank)))
    wanted = wanted.groupBy("g", "i").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.min(F.col("upto") - F.col("c")).alias("before"))
    wanted = wanted.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "first", "last", "before"))).alias("want"))  # len(q) entries
    hit = [F.col("at")[i].between(F.col("want")[i]["first"], F.col("want")[i]["last"]) for i in range(len(q))]
    few = attach(placed, kept(wanted) if by else wanted).where(reduce(or_, hit)).groupBy("g", "n", "at", "want", "value").agg(F.count("*").alias("c"))
    few = few.select("g", "n", "value", "c", "at", F.explode("want").alias("w")).where(F.get("at", F.col("w.i")).between(F.col("w.first"), F.col("w.last")))
    upto = F.sum("c").over(Window.partitionBy("g", "w").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    few = few.select("g", "n", "value", F.col("w.i").alias("i"), (F.col("w.before") + upto).alias("upto"))
    low, high = (F.min(F.when(F.col("upto") > place(rank), F.col("value"))) for place in (F.floor, F.ceil))
    found = few.groupBy("g", "n", "i").agg(low.alias("low"), high.alias("high"))
    between = (F.ceil(rank) - rank) * F.col("low") + (rank - F.floor(rank)) * F.col("high")
    found = found.select("g", "i", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))
    return found.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(q))).select(*names, *q)


def with_percentiles(df: DataFrame, by: list[str], col: str, q: dict[str, float], name: str, most: int | None = None) -> DataFrame:
    """``df`` with the struct ``name`` of the percentiles ``q`` of ``col`` in each row's group (null where the group has no value)."""
    rows = df.select(F.struct(*(quoted(c).alias(f"k{i}") for i, c in enumerate(by))).alias("g"), F.struct(*map(quoted, df.columns)).alias("row"))
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    found = percentiles(df, [col], q, by=by, most=most)
    found = found.select(F.struct(*(quoted(c).alias(f"k{i}") for i, c in enumerate(by))).alias("g"), F.struct(*q).alias("found"))
    groups = Groups(n.join(found, "g", "left"), most)
    return groups.attach(rows, groups.table.drop("n")).select(*(F.col("row").getField(c).alias(c) for c in df.columns), F.col("found").alias(name))


def dataset_statistics(df: DataFrame, by: str = "satellite", on: str = "timestamp", cols: list[str] = ("orbit_error_m", "clock_error_ns"), accuracy: int | None = None) -> DataFrame:
    """One row: rows, distinct keys, first and last time, hours between, and a struct of statistics for each column."""
    q = {"median": 0.5, "percentile_95": 0.95}
    ranked = percentiles(df, cols, q, accuracy).agg(*(F.max(F.when(F.col("column") == c, F.struct(*q))).alias(f"__q{i}") for i, c in enumerate(cols)))

    def stats(c: str) -> Column:
        return F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c)

    out = df.agg(F.count("*").alias("total_records"), F.countDistinct(by).alias("unique_keys"), F.min(on).alias("start"), F.max(on).alias("end"), *map(stats, cols))
    hours = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")) / 3.6e9
    whole = (F.struct(f"{c}.*", *(F.col(f"__q{i}.{x}").alias(x) for x in q)).alias(c) for i, c in enumerate(cols))
    return out.crossJoin(F.broadcast(ranked)).select("total_records", "unique_keys", "start", "end", hours.alias("duration_hours"), *whole)  # one row


def key_statistics(df: DataFrame, by: str = "satellite", cols: list[str] = ("orbit_error_m", "clock_error_ns")) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("records"), *(F.avg(c).alias(f"{c}_mean") for c in cols))


def counts_by(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def describe(df: DataFrame, cols: list[str], accuracy: int | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of each column, nulls left out."""
    q = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    out = long_form(df, cols).groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.join(F.broadcast(percentiles(df, cols, q, accuracy)), "column", "left").select("column", "count", "mean", "std", "min", *q, "max")  # a row per column


def missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_null, pct) of each column."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(cols))))
    return row.select("n", cells.alias("p")).select("p.column", "p.n_null", (F.lit(100.0) * F.col("p.n_null") / F.col("n")).alias("pct"))


def infinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_infinite) of each column."""
    return long_form(df, cols).groupBy("column").agg(F.count_if(F.abs("value") == math.inf).alias("n_infinite"))


def ranges(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by, column, min, max)."""
    return long_form(df, cols, list(by)).groupBy(*by, "column").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def histogram(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """(column, bin, lo, hi, n): ``bins`` bins of equal width over each column's range, the last one closed; empty bins have no row.

    Nulls, NaN and infinities belong to no bin.
    """
    cells = long_form(df, cols).where("value is not null and not isnan(value)").where(F.abs("value") < math.inf)
    bounds = cells.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    width = (F.col("max") - F.col("min")) / bins
    at = F.when(F.col("max") == F.col("min"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("min")) / width)))
    counted = cells.join(F.broadcast(bounds), "column").groupBy("column", "min", "max", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # a row per column
    return counted.select("column", "bin", (F.col("min") + F.col("bin") * width).alias("lo"), (F.col("min") + (F.col("bin") + 1) * width).alias("hi"), "n")


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr): Pearson correlation of each pair over the rows where both are there, null for constants, in one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}

    def corr(a: str, b: str) -> Column:
        x, y = F.when(clean[b].isNotNull(), clean[a]), F.when(clean[a].isNotNull(), clean[b])
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = df.agg(*(corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs))))
    return row.select(cells.alias("p")).select("p.*")


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """(column, q25, q75, lower, upper) of each column."""
    q = percentiles(df, cols, {"q25": 0.25, "q75": 0.75}, accuracy)
    iqr = F.col("q75") - F.col("q25")
    return q.select("column", "q25", "q75", (F.col("q25") - k * iqr).alias("lower"), (F.col("q75") + k * iqr).alias("upper"))


def iqr_report(df: DataFrame, cols: list[str], k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """``iqr_bounds`` with min, max, the number and share of outliers and their range."""
    bounds = iqr_bounds(df, cols, k, accuracy)
    cells = long_form(df, cols).where("value is not null").join(F.broadcast(bounds), "column")  # a row per column
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    value = F.when(out, F.col("value"))
    return cells.groupBy("column", "q25", "q75", "lower", "upper").agg(
        F.count_if(out).alias("n_outliers"), (F.lit(100.0) * F.count_if(out) / F.count("*")).alias("pct"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(value).alias("outlier_min"), F.max(value).alias("outlier_max"),
    )


def flag_outliers(df: DataFrame, cols: list[str], k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """``df`` with has_outlier: any of ``cols`` outside its bounds (nulls are inside)."""
    names = [free_name(df, f"bounds{i}") for i in range(len(cols))]
    bounds = iqr_bounds(df, cols, k, accuracy).agg(*(F.max(F.when(F.col("column") == c, F.struct("lower", "upper"))).alias(x) for c, x in zip(cols, names, strict=True)))
    flag = F.lit(False)
    for c, x in zip(cols, names, strict=True):
        flag = flag | F.coalesce((F.col(c) < F.col(x)["lower"]) | (F.col(c) > F.col(x)["upper"]), F.lit(False))
    return df.crossJoin(F.broadcast(bounds)).select(*df.columns, flag.alias("has_outlier"))  # one row


def outlier_total(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count_if("has_outlier").alias("n_outliers"), (F.lit(100.0) * F.count_if("has_outlier") / F.count("*")).alias("pct"))


def bucket_share(df: DataFrame, col: str, edges: list[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """(bucket, n, pct): value 0, then (0, e1], (e1, e2], ... and beyond the last edge; nulls are left out of the counts but not of the share."""
    c, last = F.col(col), edges[-1]
    name = F.when(c == 0, "0")
    for lo, hi in zip([0.0, *edges[:-1]], edges, strict=True):
        name = name.when((c > lo) & (c <= hi), f"({lo:g}, {hi:g}]")
    name = name.when(c > last, f"> {last:g}")
    counted = df.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).where("bucket is not null").select("bucket", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct"))  # one row


def sample_per_value(df: DataFrame, col: str, order: list[str], values: int = 10, rows: int = 2) -> DataFrame:
    """The first ``rows`` rows (by ``order``) of each of the first ``values`` distinct values of ``col`` in that order."""
    first = df.groupBy(col).agg(F.min(F.struct(*order)).alias("__first")).orderBy("__first").limit(values).select(col)
    few = df.join(F.broadcast(first), col)  # at most ``values`` rows
    w = Window.partitionBy(col).orderBy(*order)
    return few.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= rows).drop("__k").select(*df.columns)


def file_line_counts(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(file, n_lines, one column per kind): lines of each file that match a kind's regular expression. Needs file and value."""
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), *(F.count_if(F.col("value").rlike(p)).alias(k) for k, p in kinds.items()))


def utilisation(df: DataFrame, by: str, on: str, expected_per_day: float = 96.0) -> DataFrame:
    """One row: rows, keys, days, rows per day, rows per key and day, and their share of what is expected (percent)."""
    out = df.agg(F.count("*").alias("rows"), F.countDistinct(by).alias("n_keys"), F.countDistinct(F.to_date(on)).alias("n_days"))
    per_day, per_key = F.col("rows") / F.col("n_days"), F.col("rows") / F.col("n_days") / F.col("n_keys")
    return out.select("rows", "n_keys", "n_days", per_day.alias("rows_per_day"), per_key.alias("rows_per_key_day"), (100 * per_key / expected_per_day).alias("pct_of_expected"))


def coverage(found: DataFrame, expected: DataFrame, day: str = "day", product: str = "product") -> DataFrame:
    """``expected`` (day, product) pairs with ``present``: whether ``found`` has them."""
    have = found.select(day, product).distinct().withColumn("present", F.lit(True))
    return expected.select(day, product).distinct().join(have, [day, product], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def coverage_table(found: DataFrame, expected: DataFrame, products: list[str], day: str = "day", product: str = "product") -> DataFrame:
    """A row per day, a Boolean column per product."""
    return coverage(found, expected, day, product).groupBy(day).pivot(product, products).agg(F.bool_or("present")).na.fill(False, products)


def quality_report(df: DataFrame, by: str, on: str, critical: list[str]) -> DataFrame:
    """One row: n_rows, n_columns, n_keys, critical_complete (no null there), monotonic (no key has a time twice).

    Rows of a table have no order of their own; times rise strictly within each key exactly if none repeats.
    """
    per = df.groupBy(by, on).agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in critical))
    bad = sum((F.sum(f"__{c}") for c in critical), F.lit(0))
    return per.agg(
        F.sum("n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.countDistinct(by).alias("n_keys"), (bad == 0).alias("critical_complete"), (F.max("n") <= 1).alias("monotonic")
    )


def same_keys(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(key, side) of keys that only one of two tables has."""
    x, y = a.select(by).distinct(), b.select(by).distinct()
    return x.join(y, by, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, by, "left_anti").withColumn("side", F.lit("right")))


def no_overlap(train: DataFrame, test: DataFrame, on: str) -> DataFrame:
    """One row: train_end, test_start and disjoint (train ends before test begins)."""
    return train.agg(F.max(on).alias("train_end")).crossJoin(test.agg(F.min(on).alias("test_start"))).withColumn("disjoint", F.col("train_end") < F.col("test_start"))
