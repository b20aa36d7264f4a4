"""Ridge regressions of many keys in one job: mergeable statistics per key, solved in closed form by built-in functions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ephemera.functions.names import free_name, quoted
from ephemera.operators.profile import Groups


def _number(name: str) -> Column:
    x = quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def _usable(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(reduce(and_, (_number(c).isNotNull() for c in names)))


def gram_by_key(df: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    """(g, n, m_<i>, m_y, s_<i>_<j>, s_<i>_y): counts, means and centred sums of products of each key.

    One aggregation whose partial results merge, so a key of any length is summed up where its rows are.  Rows that
    lack a feature or the target are left out; a null key is a key.
    """
    rows = _usable(df, [*features, target]).select(quoted(by).alias("key"), *(_number(c).alias(f"x_{i}") for i, c in enumerate(features)), _number(target).alias("x_y"))
    places = [*range(len(features)), "y"]
    n = F.count("*")
    means = [F.avg(f"x_{i}").alias(f"m_{i}") for i in places]
    sums = [(F.covar_pop(f"x_{i}", f"x_{j}") * n).alias(f"s_{i}_{j}") for i in range(len(features)) for j in [*range(i + 1), "y"]]
    return rows.groupBy(F.struct("key").alias("g")).agg(n.alias("n"), *means, *sums)


def ridge_by_key(df: DataFrame, by: str, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(by, n, intercept, coefficients): the ridge regression of each key, the intercept unpenalised.

    The normal equations (centred X'X + ``alpha`` I) c = X'y are solved by Cholesky factors and two substitutions, one
    column at a time.  Where they are singular (``alpha`` 0 and features that depend on each other) coefficients are
    null.  Keys without a usable row are left out; an empty table gives an empty result.
    """
    p = len(features)
    d = gram_by_key(df, by, features, target)
    for j in range(p):
        rest = F.col(f"s_{j}_{j}") + alpha - _total(F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j))
        d = d.withColumn(f"l_{j}_{j}", F.when(rest > 0, F.sqrt(rest)))
        below = {f"l_{i}_{j}": (F.col(f"s_{i}_{j}") - _total(F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j))) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)}
        d = d.withColumns({f"z_{j}": (F.col(f"s_{j}_y") - _total(F.col(f"l_{j}_{k}") * F.col(f"z_{k}") for k in range(j))) / F.col(f"l_{j}_{j}"), **below})
    for j in reversed(range(p)):
        d = d.withColumn(f"c_{j}", (F.col(f"z_{j}") - _total(F.col(f"l_{i}_{j}") * F.col(f"c_{i}") for i in range(j + 1, p))) / F.col(f"l_{j}_{j}"))
    intercept = F.col("m_y") - _total(F.col(f"m_{j}") * F.col(f"c_{j}") for j in range(p))
    return d.select(F.col("g.key").alias(by), "n", intercept.alias("intercept"), F.array(*(F.col(f"c_{j}") for j in range(p))).alias("coefficients"))


def _total(terms) -> Column:
    return reduce(add, terms, F.lit(0.0))


def predict_by_key(df: DataFrame, models: DataFrame, by: str, features: list[str], name: str = "y_hat", most: int | None = None) -> DataFrame:
    """``df`` with the forecast of its key's model (``ridge_by_key``); null without a model or with a missing feature.

    Models are joined without a hot task: see ``profile.Groups``; ``most`` is its bound.
    """
    name = free_name(df, name)
    rows = df.select(F.struct(quoted(by).alias("key")).alias("g"), F.struct(*map(quoted, df.columns)).alias("row"))
    fitted = models.select(F.struct(F.col(by).alias("key")).alias("g"), F.struct("intercept", "coefficients").alias("m"))
    groups = Groups(rows.groupBy("g").agg(F.count("*").alias("n")).join(fitted, "g", "left"), most)
    x = lambda c: F.when(~F.isnan(F.col("row").getField(c).cast("double")), F.col("row").getField(c).cast("double"))
    y = F.col("m.intercept") + _total(F.col("m.coefficients")[i] * x(c) for i, c in enumerate(features))
    return groups.attach(rows, groups.table.drop("n")).select(*(F.col("row").getField(c).alias(c) for c in df.columns), y.alias(name))
