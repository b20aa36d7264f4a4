"""Series cut in time: a key's rows are worked on by period, whatever the length of the key.

The unit of work is (key, period).  What a period needs from others is lent to it row by row (``with_forward_halo``) or
handed on as one value for each period (``gaps_by_period``); the only window over a whole key has one row for each of
its periods.  Rows travel as structs, so columns may have any name; null keys and times are units like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ephemera.functions.names import quoted
from ephemera.functions.scalars import micros


def ordering(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def in_units(df: DataFrame, by: str, on: str | list[str], bucket: str) -> DataFrame:
    """(unit, row): unit is a struct of key and period, so that it is never null and joins like any value."""
    unit = F.struct(quoted(by).alias("k"), F.date_trunc(bucket, quoted(ordering(on)[0])).alias("p"))
    return df.select(unit.alias("unit"), F.struct(*map(quoted, df.columns)).alias("row"))


def within(on: str | list[str]) -> WindowSpec:
    """A unit's rows in order."""
    return Window.partitionBy("unit").orderBy(*(F.col("row").getField(c) for c in ordering(on)))


def _periods() -> WindowSpec:
    """The units of a key in order: one row each."""
    return Window.partitionBy("unit.k").orderBy("unit.p")


def with_forward_halo(df: DataFrame, by: str, on: str | list[str], rows: int, bucket: str) -> DataFrame:
    """(unit, place, row): all rows with their place in the key (from 1), and in each unit the ``rows`` rows after it, without a place.

    Counts of rows by unit, summed up over the periods of a key, tell how many rows stand before each unit.  The f-th
    row of a unit is lent to those earlier units from whose end it is ``rows`` places away at most; a unit looks back
    over ``rows`` units at most, since each holds a row.
    """
    d = in_units(df, by, on, bucket)
    ends = d.groupBy("unit").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(_periods().rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("start", F.col("end") - F.col("n"))
    before = F.collect_list(F.struct("unit", "end")).over(_periods().rowsBetween(-rows, -1)) if rows else F.array()
    ends = ends.withColumn("before", before)
    lends = F.transform("before", lambda x: F.struct(x["unit"].alias("unit"), (rows - F.col("start") + x["end"]).alias("most"))) if rows else None
    ends = ends.select("unit", "start", *([F.filter(lends, lambda x: x["most"] > 0).alias("lends")] if rows else []))
    placed = d.withColumn("front", F.row_number().over(within(on))).join(ends, "unit")
    own = F.array(F.struct("unit", (F.col("start") + F.col("front")).alias("place")))
    if rows:
        lent = F.transform(F.filter("lends", lambda x: F.col("front") <= x["most"]), lambda x: F.struct(x["unit"].alias("unit"), F.lit(None).cast("long").alias("place")))
        own = F.concat(own, lent)
    return placed.select(F.explode(own).alias("u"), "row").select("u.unit", "u.place", "row")


def with_following(df: DataFrame, by: str, on: str | list[str], rows: int, bucket: str, columns: dict[str, Column]) -> DataFrame:
    """(place, row, ``columns``): window expressions over a unit's rows (see ``within``) that look ahead ``rows`` rows at most."""
    found = with_forward_halo(df, by, on, rows, bucket)
    return found.select("place", "row", *(c.alias(name) for name, c in columns.items())).where("place is not null")


def gaps_by_period(df: DataFrame, by: str, on: str, cols: list[str], bucket: str) -> DataFrame:
    """``df`` with the gaps of ``cols`` filled as ``windows.fill_gaps`` does, in units of (key, period) and with one sort of the rows.

    Level one: within a unit each row takes the last known value up to it and the next one after it, both in the same
    order.  Level two: each unit hands on its first and last known value; over the periods of a key the last known
    value before a unit and the first one after it are found, and take the place of what level one has not found.
    """
    t = micros(F.col("row").getField(on))
    value = lambda c: F.col("row").getField(c).cast("double")
    known = {f"k{i}": F.when(value(c).isNotNull() & t.isNotNull(), F.struct(t.alias("t"), value(c).alias("v"))) for i, c in enumerate(cols)}
    d = in_units(df, by, on, bucket).withColumns(known)
    ends = [(name, k, edge(F.col(k)["t"]).alias("t"), by_edge(F.col(k)["v"], F.col(k)["t"]).alias("v")) for k in known for name, edge, by_edge in (("first", F.min, F.min_by), ("last", F.max, F.max_by))]
    ends = d.groupBy("unit").agg(*(F.struct(when, what).alias(f"{name}_{k}") for name, k, when, what in ends))
    ends = ends.select("unit", *(F.when(F.col(c)["t"].isNotNull(), F.col(c)).alias(c) for c in ends.columns[1:]))
    outer: dict[str, Column] = {}
    for k in known:
        outer[f"p_{k}"] = F.last(f"last_{k}", ignorenulls=True).over(_periods().rowsBetween(Window.unboundedPreceding, -1))
        outer[f"n_{k}"] = F.expr(f"lead(first_{k}) IGNORE NULLS OVER (PARTITION BY unit.k ORDER BY unit.p)")
    ends = ends.select("unit", *(c.alias(name) for name, c in outer.items()))
    up = within(on).rowsBetween(Window.unboundedPreceding, 0)
    order = "PARTITION BY unit ORDER BY row.`" + on.replace("`", "``") + "`"
    inner: dict[str, Column] = {}
    for k in known:
        inner[f"b_{k}"] = F.last(k, ignorenulls=True).over(up)
        inner[f"a_{k}"] = F.expr(f"lead({k}) IGNORE NULLS OVER ({order})")
    d = d.withColumns(inner).join(ends, "unit")
    out = {}
    at = F.col("at")
    for c, k in zip(cols, known, strict=True):
        p, q, v = F.coalesce(f"b_{k}", f"p_{k}"), F.coalesce(f"a_{k}", f"n_{k}"), value(c)
        line = p["v"] + (q["v"] - p["v"]) * (at - p["t"]) / (q["t"] - p["t"])
        out[c] = F.when(v.isNotNull(), v).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(line)
    d = d.withColumn("at", t)
    return d.select(*((out[c] if c in out else F.col("row").getField(c)).alias(c) for c in df.columns))


def rolling_by_places(df: DataFrame, by: str, on: str | list[str], cols: list[str], width: Column, bucket: str) -> DataFrame:
    """``df`` with <col>_ma and <col>_std over the last so many rows as ``width`` says of a key of ``n`` rows.

    A frame whose length depends on the data is a difference of prefix sums read at two places: at the row, and where
    the frame begins.  Values are taken from their key's mean, sums run within units and on over the periods of a key,
    and each row sends its sums to the place whose frame it ends before, a join on (key, place) in which no value is
    frequent.  Nulls and NaN count for nothing but their place; a frame of one value has deviation 0.
    """
    x = {i: F.when(~F.isnan(F.col("row").getField(c).cast("double")), F.col("row").getField(c).cast("double")) for i, c in enumerate(cols)}
    d = in_units(df, by, on, bucket)
    each = [f(v).alias(f"{name}{i}") for i, v in x.items() for name, f in (("c", F.count), ("a", F.avg), ("v", F.var_pop))]
    units = d.groupBy("unit").agg(F.count("*").alias("rows"), *each)
    key, before = Window.partitionBy("unit.k"), _periods().rowsBetween(Window.unboundedPreceding, -1)
    mean = {i: F.sum(F.col(f"a{i}") * F.col(f"c{i}")).over(key) / F.nullif(F.sum(f"c{i}").over(key), F.lit(0)) for i in x}
    units = units.withColumns({"n": F.sum("rows").over(key), "start": F.coalesce(F.sum("rows").over(before), F.lit(0)), **{f"m{i}": m for i, m in mean.items()}})
    base: dict[str, Column] = {}
    for i in x:
        off = F.coalesce(F.col(f"a{i}") - F.col(f"m{i}"), F.lit(0.0))
        totals = {"c": F.col(f"c{i}"), "s": F.col(f"c{i}") * off, "q": F.col(f"c{i}") * (F.coalesce(f"v{i}", F.lit(0.0)) + off * off)}
        base |= {f"{name}{i}": F.coalesce(F.sum(total).over(before), F.lit(0)) for name, total in totals.items()}
    units = units.select("unit", "start", width.cast("long").alias("width"), *(f"m{i}" for i in x), *(c.alias(f"before_{name}") for name, c in base.items()))
    so_far = within(on).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(units, "unit").withColumns({f"x{i}": v - F.col(f"m{i}") for i, v in x.items()})
    sums: dict[str, Column] = {"place": F.col("start") + F.row_number().over(within(on))}
    for i in x:
        own = {"c": F.count(f"x{i}"), "s": F.sum(f"x{i}"), "q": F.sum(F.col(f"x{i}") * F.col(f"x{i}"))}
        sums |= {f"{name}{i}": F.col(f"before_{name}{i}") + F.coalesce(f.over(so_far), F.lit(0)) for name, f in own.items()}
    d = d.select("unit.k", "row", "width", *(f"m{i}" for i in x), *(c.alias(name) for name, c in sums.items()))
    here = d.withColumn("at", F.struct("k", "place"))
    there = d.select(F.struct("k", (F.col("place") + F.col("width")).alias("place")).alias("at"), *(F.col(f"{name}{i}").alias(f"gone_{name}{i}") for i in x for name in "csq"))
    d = here.join(there, "at", "left")
    out: dict[str, Column] = {}
    for i, c in enumerate(cols):
        n, s, q = (F.col(f"{name}{i}") - F.coalesce(f"gone_{name}{i}", F.lit(0)) for name in "csq")
        out[f"{c}_ma"] = F.when(n > 0, F.col(f"m{i}") + s / F.nullif(n, F.lit(0)))
        out[f"{c}_std"] = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)))).when(n == 1, 0.0)
    return d.select(*(F.col("row").getField(c).alias(c) for c in df.columns), *(v.alias(name) for name, v in out.items()))
