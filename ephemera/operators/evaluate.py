"""Forecast evaluation on long rows (feature, step, y, y_hat)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephemera.functions.names import free_name, quoted
from ephemera.operators.profile import BRACKET_ACCURACY, Groups, with_percentiles

#: Steps of 15 minutes ahead.
HORIZONS = {"15min": 1, "30min": 2, "1hr": 4, "2hr": 8, "24hr": 96}
# Coefficients, highest power first, of Royston's approximation to the Shapiro-Wilk test (weights of the last
# and second last value; mean and log deviation for up to 11 values and for more).
ROYSTON_LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
ROYSTON_SECOND = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
ROYSTON_SMALL = ([-0.0006714, 0.025054, -0.39978, 0.5440], [-0.0020322, 0.062767, -0.77857, 1.3822])
ROYSTON_LARGE = ([0.0038915, -0.083751, -0.31082, -1.5861], [0.0030302, -0.082676, -0.4803])
# Wichura's rational functions of the normal quantile, near the centre and in the tails.
QUANTILE_CENTRE = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080],
    [5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0],
)
QUANTILE_TAIL = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0],
)


def _r2(n: Column, sse: Column, var: Column, flat: float | None) -> Column:
    return F.when(var * n > 0, 1 - sse / (var * n)).otherwise(F.lit(flat))


def metrics(df: DataFrame, by: list[str], y: str = "y", y_hat: str = "y_hat", eps: float = 1e-7, flat: float | None = None) -> DataFrame:
    """Per group: n, mae, mse, rmse, r2 (``flat`` where the truth is constant), mape, gain over the mean (percent), ranges.

    Rows with a null on either side are left out.
    """
    d = df.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    e = F.col(y_hat) - F.col(y)
    out = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("__var"), F.sum(e * e).alias("__sse"),
        (100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(eps)))).alias("mape"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.min(y_hat).alias("y_hat_min"), F.max(y_hat).alias("y_hat_max"),
        F.count_if(F.isnan(y_hat)).alias("n_nan"), F.count_if(F.abs(y_hat) == math.inf).alias("n_infinite"),
    )
    gain = F.when(F.col("__var") > 0, (F.col("__var") - F.col("mse")) / F.col("__var") * 100)
    return out.select(
        *by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), _r2(F.col("n"), F.col("__sse"), F.col("__var"), flat).alias("r2"), "mape", gain.alias("gain_pct"),
        "y_min", "y_max", "y_hat_min", "y_hat_max", "n_nan", "n_infinite",
    )


def overall(per_feature: DataFrame) -> DataFrame:
    """One row: mean r2 over features that have one, mean mae and rmse, and the grade."""
    return per_feature.agg(F.avg("r2").alias("mean_r2"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse")).withColumn("grade", grade(F.col("mean_r2")))


def grade(r2: Column, cuts: tuple[float, float, float] = (0.95, 0.85, 0.75)) -> Column:
    return F.when(r2 >= cuts[0], "excellent").when(r2 >= cuts[1], "good").when(r2 >= cuts[2], "fair").when(r2.isNotNull(), "poor")


def horizon_metrics(df: DataFrame, horizons: dict[str, int] = HORIZONS, step: str = "step") -> DataFrame:
    """``metrics`` of each (horizon, feature), where step k (from 1) is k steps ahead; r2 is 0 for a constant truth."""
    name = F.lit(None).cast("string")
    for k, v in horizons.items():
        name = F.when(F.col(step) == v, k).otherwise(name)
    return metrics(df.withColumn("horizon", name).where("horizon is not null"), ["horizon", "feature"], flat=0.0)


def horizon_averages(per: DataFrame) -> DataFrame:
    return per.groupBy("horizon").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2")).withColumn("grade", grade(F.col("r2"), (0.7, 0.5, 0.0)))


def residual_moments(df: DataFrame, by: list[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per group: n, mean, std (population), skewness and excess kurtosis of y_hat - y."""
    d = df.select(*by, (F.col(y_hat) - F.col(y)).alias("r")).where("r is not null")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"))


def log_normal_tails(x: Column) -> Column:
    """(below, above): logs of the standard normal distribution function at -x and x, for x >= 0, in built-in functions.

    Up to 3 it is 1/2 -+ pdf * (x + x^3/3 + x^5/15 + ...), a series of positive terms; beyond, the tail is the continued
    fraction pdf / (x + 1 / (x + 2 / (x + ...))).
    """
    pdf = F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
    start = F.struct(x.alias("term"), x.alias("total"))
    odd = F.array(*(F.lit(2.0 * k + 1) for k in range(1, 40)))
    series = F.aggregate(odd, start, lambda a, m: F.struct((a["term"] * x * x / m).alias("term"), (a["total"] + a["term"] * x * x / m).alias("total")), lambda a: pdf * a["total"])
    fraction = F.aggregate(F.array(*(F.lit(float(k)) for k in range(40, 0, -1))), x, lambda a, k: x + k / a)
    part = F.when(x < 3, series).otherwise(-0.5 * x * x - 0.5 * math.log(2 * math.pi) - F.log(fraction))
    # one higher-order step binds the part, so that it is computed once for both tails
    return F.transform(F.array(part), lambda v: F.struct(F.when(x < 3, F.log(F.lit(0.5) - v)).otherwise(v).alias("below"), F.when(x < 3, F.log(F.lit(0.5) + v)).otherwise(F.log1p(-F.exp(v))).alias("above")))[0]


def log_normal_cdf(z: Column) -> Column:
    """log of the standard normal distribution function."""
    tails = log_normal_tails(F.abs(z))
    return F.when(z < 0, tails["below"]).otherwise(tails["above"])


def in_ranges(d: DataFrame, levels: int, most: int | None = None) -> DataFrame:
    """(g, n, z, slot, c) of (g, r) rows: standardised distinct values, how many rows have each, and their range in the group."""
    ranges = 1 << levels
    d = d.where("r is not null")
    cuts = F.percentile_approx("r", [i / ranges for i in range(1, ranges)], BRACKET_ACCURACY)
    stats = d.groupBy("g").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), cuts.alias("cuts")).where("n > 1 and s > 0")
    groups = Groups(stats, most)
    counted = groups.attach(d.groupBy("g", "r").agg(F.count("*").alias("c")), groups.table)
    # how many cuts lie below the value, by halving steps
    halves = F.array(*(F.lit(ranges >> i) for i in range(1, levels + 1)))
    slot = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("cuts", at + step - 1) < F.col("r"), at + step).otherwise(at))
    return counted.select("g", "n", ((F.col("r") - F.col("m")) / F.col("s")).alias("z"), slot.alias("slot"), "c")


def anderson_darling(df: DataFrame, by: list[str], value: str = "r", levels: int = 10, most: int | None = None) -> DataFrame:
    """Per group: n, a2, critical (5 %, mean and deviation estimated) and normal; nulls are left out, a null key is a group.

    A group is never sorted whole: equal residuals are counted, a sketch cuts each group into ``2 ** levels`` ranges of
    about as many rows each, however its values lie (a few far outliers stretch no range), counts of ranges are summed
    up (the only window over a group, with a row for each range), and ranks are found within (group, range).  Groups
    of one value or without spread are left out.  ``most``: see ``profile.Groups``.
    """
    keys = [f"k{i}" for i in range(len(by))]
    g = F.struct(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True)))
    counted = in_ranges(df.select(g.alias("g"), quoted(value).cast("double").alias("r")), levels, most)
    per = counted.groupBy("g", "slot").agg(F.sum("c").alias("in"))
    before = Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("g", "slot", F.coalesce(F.sum("in").over(before), F.lit(0)).alias("upto"))
    inside = Window.partitionBy("g", "slot").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("k", F.sum("c").over(inside)).join(per, ["g", "slot"])
    # ranks a + 1 .. b have the weights 2 i - 1, which sum to b^2 - a^2, and 2 (n - i) + 1
    n, b, c = F.col("n").cast("double"), (F.col("upto") + F.col("k")).cast("double"), F.col("c").cast("double")
    low = b * b - (b - c) * (b - c)
    ranked = ranked.select("g", "n", "z", low.alias("low"), (2 * n * c - low).alias("high"), log_normal_tails(F.abs("z")).alias("t"))
    below, above = F.col("t.below"), F.col("t.above")
    term = F.when(F.col("z") < 0, F.col("low") * below + F.col("high") * above).otherwise(F.col("low") * above + F.col("high") * below)
    out = ranked.select("g", "n", term.alias("t")).groupBy("g", "n").agg(F.sum("t").alias("s"))
    names = [F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)]
    out = out.select(*names, F.col("n"), (-n - F.col("s") / n).alias("a2"), (F.lit(0.787) / (1 + 4 / n - 25 / (n * n))).alias("critical"))
    return out.withColumn("normal", F.col("a2") < F.col("critical"))


def shapiro_statistic(x: np.ndarray) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test by Royston's approximation (3 to 5,000 values)."""
    n = len(x)
    x = np.sort(x)
    if n < 3 or x[-1] == x[0]:
        return math.nan, math.nan
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq, u = float(m @ m), 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0.0, math.sqrt(0.5))
    else:
        last = m[-1] / math.sqrt(ssq) + np.polyval(ROYSTON_LAST, u)
        if n > 5:
            second = m[-2] / math.sqrt(ssq) + np.polyval(ROYSTON_SECOND, u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = -math.log(gamma - math.log1p(-w)) if gamma > math.log1p(-w) else math.inf
        mu, sigma = np.polyval(ROYSTON_SMALL[0], n), math.exp(np.polyval(ROYSTON_SMALL[1], n))
    else:
        y, ln = math.log1p(-w), math.log(n)
        mu, sigma = np.polyval(ROYSTON_LARGE[0], ln), math.exp(np.polyval(ROYSTON_LARGE[1], ln))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def _poly(coefficients: list[float], x: Column) -> Column:
    """Highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile of 0 < u < 1 to full precision, for tails down to 1e-11 (Wichura's rational functions)."""
    q = u - 0.5
    r = F.sqrt(-F.log(F.least(u, 1 - u))) - 1.6
    centre = F.lit(0.180625) - q * q
    tail = F.signum(q) * _poly(QUANTILE_TAIL[0], r) / _poly(QUANTILE_TAIL[1], r)
    return F.when(F.abs(q) <= 0.425, q * _poly(QUANTILE_CENTRE[0], centre) / _poly(QUANTILE_CENTRE[1], centre)).otherwise(tail)


def shapiro_wilk(df: DataFrame, by: list[str], order: list[str], value: str = "r", most: int = 5000) -> DataFrame:
    """Per group: n, w, p and normal (p > 0.05) of the first ``most`` residuals in ``order``, in built-in functions.

    Royston's approximation, for 3 to 5,000 values: rows are cut to ``most`` per group before the shuffle, each value
    is weighted by the normal quantile of its rank, and the rest are sums by group.  Fewer than 3 values, or equal
    ones, have no w and p and are not normal.
    """
    keys = [f"k{i}" for i in range(len(by))]
    few = df.select(F.struct(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True))).alias("g"), quoted(value).cast("double").alias("v"), *(quoted(c).alias(f"o{i}") for i, c in enumerate(order))).where("v is not null")
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(*(f"o{i}" for i in range(len(order)))))).where(F.col("at") <= most).select("g", "v")
    few = few.withColumns({"i": F.row_number().over(Window.partitionBy("g").orderBy("v")), "n": F.count("*").over(Window.partitionBy("g"))})
    few = few.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    at = lambda c, k: F.max(F.when(F.col("i") == k, F.col(c)))
    n = F.col("n").cast("double")
    edges = {"1": F.lit(1), "2": F.lit(2), "y": F.col("n") - 1, "z": F.col("n")}
    d = few.groupBy("g", "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("ssq"), F.sum(F.col("m") * F.col("v")).alias("mv"), (F.var_pop("v") * n).alias("spread"), *(at(c, k).alias(f"{c}{name}") for name, k in edges.items() for c in "mv"),
    )
    u, m, v = 1 / F.sqrt(n), {k: F.col(f"m{k}") for k in edges}, {k: F.col(f"v{k}") for k in edges}
    d = d.withColumns({"last": F.try_divide(m["z"], F.sqrt("ssq")) + _poly(ROYSTON_LAST, u), "second": F.when(n > 5, F.try_divide(m["y"], F.sqrt("ssq")) + _poly(ROYSTON_SECOND, u)).otherwise(0.0)})
    last, second, two = F.col("last"), F.col("second"), F.when(n > 5, 1.0).otherwise(0.0)
    phi = (F.col("ssq") - 2 * m["z"] * m["z"] - two * 2 * m["y"] * m["y"]) / (1 - 2 * last * last - 2 * second * second)
    middle = F.col("mv") - m["z"] * v["z"] - m["1"] * v["1"] - two * (m["y"] * v["y"] + m["2"] * v["2"])
    top = F.when(n == 3, math.sqrt(0.5) * (v["z"] - v["1"])).otherwise(last * (v["z"] - v["1"]) + second * (v["y"] - v["2"]) + middle / F.sqrt(phi))
    w = F.when((n >= 3) & (v["z"] > v["1"]), F.least(F.lit(1.0), top * top / F.col("spread")))
    d = d.select("g", "n", w.alias("w"))
    w, ln, gamma = F.col("w"), F.log(n), 0.459 * n - 2.273
    y = F.log1p(-w)
    small = (-F.log(gamma - y) - _poly(ROYSTON_SMALL[0], n)) / F.exp(_poly(ROYSTON_SMALL[1], n))
    z = F.when(n <= 11, F.when(gamma > y, small).otherwise(math.inf)).otherwise((y - _poly(ROYSTON_LARGE[0], ln)) / F.exp(_poly(ROYSTON_LARGE[1], ln)))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    # beyond 38 the tail is 0, and w = 1 leaves no finite z
    d = d.withColumn("z", F.when(w < 1, F.greatest(F.lit(-38.0), F.least(F.lit(38.0), z))).when(w == 1, -38.0))
    p = F.when(w.isNotNull(), F.when(n == 3, three).otherwise(F.exp(log_normal_cdf(-F.col("z")))))
    return d.withColumn("p", p).select(*(F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)), "n", "w", "p", F.coalesce(F.col("p") > 0.05, F.lit(False)).alias("normal"))


def tercile_classes(df: DataFrame, by: list[str], y: str = "y", y_hat: str = "y_hat", cuts: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """``df`` with true_class and predicted_class (low, medium, high) by exact percentiles of the truth in each group.

    Groups have any number of rows: see ``profile.percentiles``; ``df`` is read several times.
    """
    bounds = free_name(df, "bounds")
    d = with_percentiles(df, by, y, {"low": cuts[0], "high": cuts[1]}, bounds)
    name = lambda c: F.when(F.col(c) <= F.col(bounds)["low"], "low").when(F.col(c) <= F.col(bounds)["high"], "medium").when(F.col(c).isNotNull(), "high")
    return d.select(*df.columns, name(y).alias("true_class"), name(y_hat).alias("predicted_class"))


def confusion(df: DataFrame, by: list[str], classes: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """(by, true_class, one count column per predicted class)."""
    return df.groupBy(*by, "true_class").pivot("predicted_class", list(classes)).agg(F.count(F.lit(1))).na.fill(0, list(classes))


def class_report(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, precision, recall, f1, support): each class, then 'macro avg', 'weighted avg' and 'accuracy'."""
    d = df.where("true_class is not null and predicted_class is not null")
    cells = d.groupBy(*by, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    each = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("true_class").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted_class").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("hit")),
            )
        ).alias("p"),
    ).groupBy(*by, "p.class").agg(F.sum("p.support").alias("support"), F.sum("p.said").alias("said"), F.sum("p.hit").alias("hit"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    each = each.select(*by, "class", share("hit", "said").alias("precision"), share("hit", "support").alias("recall"), "support", "hit")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    each = each.withColumn("f1", f1)
    weigh = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    macro = each.groupBy(*by).agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weighted = each.groupBy(*by).agg(F.lit("weighted avg").alias("class"), *map(weigh, ("precision", "recall", "f1")), F.sum("support").alias("support"))
    rate = (F.sum("hit") / F.sum("support")).alias("recall")
    accuracy = each.groupBy(*by).agg(F.lit("accuracy").alias("class"), rate, F.sum("support").alias("support"))
    accuracy = accuracy.select(*by, "class", F.col("recall").alias("precision"), "recall", F.col("recall").alias("f1"), "support")
    names = [*by, "class", "precision", "recall", "f1", "support"]
    return each.select(*names).unionByName(macro.select(*names)).unionByName(weighted.select(*names)).unionByName(accuracy.select(*names))


def within_tolerance(df: DataFrame, by: list[str], share: float = 0.05, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per group: n and the percentage of forecasts within ``share`` of the truth."""
    d = df.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    hit = F.abs(F.col(y_hat) - F.col(y)) <= share * F.abs(y)
    return d.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("pct_within"))


