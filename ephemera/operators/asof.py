"""Joins in time: nearest sample, linear interpolation between samples, grids.

One engine serves them all.  Samples become intervals (each with its successor), samples and targets are sorted
together once per key, and each target takes the last interval that began at or before it.  That is one exchange and
one sort, linear in the rows.  Keys are few and long, so ``bucket`` cuts the time line: samples find their successor
and targets their interval within (key, period), and the interval that is open where a period begins is a row of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephemera.functions.names import quoted
from ephemera.functions.scalars import micros

GPS_EPOCH = datetime(1980, 1, 6)  # what ``micros`` counts from
_BUCKETS = {"hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def cross_times(times: DataFrame, keys: DataFrame, on: str = "timestamp", by: str = "satellite") -> DataFrame:
    """Every distinct time with every distinct key."""
    return times.select(on).distinct().crossJoin(keys.select(by).distinct())


def _samples(right: DataFrame, by: list[str], on: str, values: list[str], size: int | None) -> DataFrame:
    """(k0, k1, ..., p, t, s): one row per key and time with its period and the sample (t, ts, v); of repeats the least values."""
    v = F.struct(*map(quoted, values)) if values else F.struct(F.lit(1).alias("one"))
    d = right.select(*_keys(by), quoted(on).alias("ts"), v.alias("v")).dropna(subset=[*_names(by), "ts"])
    d = d.groupBy(*_names(by), "ts").agg(F.min("v").alias("v")).withColumn("t", micros(F.col("ts")))
    return d.select(*_names(by), _period(size).alias("p"), "t", F.struct("t", "ts", "v").alias("s"))


def _names(by: list[str]) -> list[str]:
    return [f"k{i}" for i in range(len(by))]


def _keys(by: list[str]) -> list[Column]:
    return [quoted(c).alias(n) for c, n in zip(by, _names(by), strict=True)]


def _period(size: int | None) -> Column:
    return F.lit(0).cast("long") if size is None else F.floor(F.col("t") / size)


def bracket(left: DataFrame, right: DataFrame, by: str | list[str], on: str, values: list[str], bucket: str | None = None, times: DataFrame | None = None) -> DataFrame:
    """(row, b): the rows of ``left`` as structs, and the samples around each.

    b.s0 is the sample (t, ts, v) at or before the row, b.s1 the next one; either is null where there is none, and b is
    null for keys without samples, null keys and null times.  All other columns are inside structs, so no name of
    either table can meet one of this function's own.

    With ``bucket`` each (key, period) is worked on alone.  Only the table of periods, one row for each (key, period)
    with samples or rows, is put in order by key: it tells each period the last sample before it and the first behind.
    The periods of rows are read from ``times``, (by, on) rows of which each row of ``left`` has one, else from ``left``
    itself, which is then computed twice: nested joins should pass the ``times`` that they began with.
    """
    by = [by] if isinstance(by, str) else by
    size = None if bucket is None else _BUCKETS[bucket]
    ks = _names(by)
    samples = _samples(right, by, on, values, size)
    row = F.struct(*map(quoted, left.columns))
    asked = left.select(*_keys(by), micros(quoted(on)).alias("t"), row.alias("row")).select(*ks, _period(size).alias("p"), "t", "row")
    periods = (left if times is None else times).select(*_keys(by), micros(quoted(on)).alias("t")).select(*ks, _period(size).alias("p")).distinct()
    inside = Window.partitionBy(*ks, "p").orderBy("t")
    if size is None:
        known = samples.withColumn("next", F.lead("s").over(inside))
        first = samples.groupBy(*ks).agg(F.min_by("s", "t").alias("next"))
        seeds = first.select(*ks, F.lit(0).cast("long").alias("p"), F.lit(None).cast(samples.schema["s"].dataType).alias("s"), "next")
    else:
        per = samples.groupBy(*ks, "p").agg(F.min_by("s", "t").alias("first"), F.max_by("s", "t").alias("last"))
        none = F.lit(None).cast(samples.schema["s"].dataType)
        per = per.unionByName(periods.select(*ks, "p", none.alias("first"), none.alias("last")))
        per = per.groupBy(*ks, "p").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("first", "last")))
        up, down = (Window.partitionBy(*ks).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("p").asc(), F.col("p").desc()))
        per = per.withColumns({"before": F.last("last", ignorenulls=True).over(up), "behind": F.last("first", ignorenulls=True).over(down)})
        known = samples.withColumn("next", F.lead("s").over(inside)).join(per.select(*ks, "p", "behind"), [*ks, "p"])
        known = known.withColumn("next", F.coalesce("next", "behind"))
        seeds = per.select(*ks, "p", F.col("before").alias("s"), F.coalesce("first", "behind").alias("next")).where("s is not null or next is not null")
    pair = F.struct(F.col("s").alias("s0"), F.col("next").alias("s1"))
    kind, empty = known.select(pair.alias("b")).schema["b"].dataType, F.lit(None).cast(asked.schema["row"].dataType)
    both = known.select(*ks, "p", "t", pair.alias("b"), empty.alias("row"), F.lit(0).alias("kind"))
    both = both.unionByName(seeds.select(*ks, "p", F.lit(-(2**62)).alias("t"), pair.alias("b"), empty.alias("row"), F.lit(-1).alias("kind")))
    both = both.unionByName(asked.select(*ks, "p", "t", F.lit(None).cast(kind).alias("b"), "row", F.lit(1).alias("kind")))
    so_far = Window.partitionBy(*ks, "p").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("open", F.last("b", ignorenulls=True).over(so_far)).where("kind = 1")
    return out.select("row", F.when(F.col("t").isNotNull(), F.col("open")).alias("b"))


def _age_name(name: Callable[[str], str], values: list[str]) -> str:
    """``age_s`` by ``name``, made longer until no sample's column has it."""
    out, taken = name("age_s"), {name(c).lower() for c in values}
    while out.lower() in taken:
        out += "_"
    return out


def _of(struct: str, name: str) -> Column:
    return F.col(struct).getField(name)


def nearest_asof(
    left: DataFrame, right: DataFrame, by: str | list[str], on: str, tolerance_s: float, how: str = "inner", suffix: str = "_right", bucket: str | None = None
) -> DataFrame:
    """Rows of ``left`` with the sample of ``right`` that is nearest in time, within ``tolerance_s`` (inclusive).

    Of two equally near samples the earlier is taken.  Adds the sample's columns, its time as on + ``suffix`` and
    ``age_s``, the distance in seconds; names that ``left`` has get ``suffix``.  ``how="left"`` keeps rows without
    a sample, with nulls.  Null times and null keys match nothing.
    """
    keys = [by] if isinstance(by, str) else by
    values = [c for c in right.columns if c not in (*keys, on)]
    d = bracket(left, right, keys, on, values, bucket)
    t = micros(_of("row", on))
    before, after = t - F.col("b.s0.t"), F.col("b.s1.t") - t
    earlier = F.col("b.s0").isNotNull() & (F.col("b.s1").isNull() | (before <= after))
    age = F.when(earlier, before).otherwise(after)
    ok = age <= int(round(tolerance_s * 1e6))
    taken = {c.lower() for c in left.columns}
    name = lambda c: c + suffix if c.lower() in taken else c
    pick = lambda c: F.when(ok & earlier, F.col(f"b.s0.{c}")).when(ok, F.col(f"b.s1.{c}"))
    if how == "inner":
        d = d.where(ok)
    d = d.select("row", pick("ts").alias("ts"), pick("v").alias("v"), F.when(ok, age / 1e6).alias("age"))
    return d.select(*(_of("row", c).alias(c) for c in left.columns), F.col("ts").alias(on + suffix), *(_of("v", c).alias(name(c)) for c in values), F.col("age").alias(_age_name(name, values)))


def _floor_div(a: Column, b: int) -> Column:
    """a // b of whole numbers, exact."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def nearest_on_grid(
    right: DataFrame, by: str | list[str], on: str, start: datetime, end: datetime, step_s: float, tolerance_s: float, suffix: str = "_right"
) -> DataFrame:
    """``nearest_asof`` of every time of a grid with every key of ``right``, without making or joining those rows.

    The grid begins at ``start``, steps by ``step_s`` and ends at or before ``end``.  Each sample is valid from the
    midpoint to its predecessor (not included: of two equally near samples the earlier is taken) to that to its
    successor, ``tolerance_s`` away at most, and emits the times of the grid in that cell itself.  The samples are
    exchanged once, by key; the times are never sorted, exchanged or joined.  A key's samples are put in order in one
    task: this is for ephemerides, which are few and make many rows.

    Columns: ``by``, ``on``, ``on`` + ``suffix``, the sample's other columns, ``age_s``; of samples with one key and time
    the least values are taken, null keys and times match nothing.
    """
    keys = [by] if isinstance(by, str) else by
    ks = _names(keys)
    values = [c for c in right.columns if c not in (*keys, on)]
    step, tolerance = int(round(step_s * 1e6)), int(round(tolerance_s * 1e6))
    if step <= 0:
        raise ValueError("the grid needs a step of a microsecond at least")
    last = max(-1, round((end - start) / timedelta(microseconds=1)) // step)
    first = round((start - GPS_EPOCH) / timedelta(microseconds=1))
    # by key first: the samples of a time, and those of a key in order, then need no further exchange
    w = Window.partitionBy(*ks).orderBy("t")
    t = F.col("t") - first
    d = _samples(right.repartition(*map(quoted, keys)), keys, on, values, None).select(*ks, t.alias("t"), "s")
    d = d.withColumns({"before": F.lag("t").over(w), "behind": F.lead("t").over(w)})
    low = F.greatest(F.lit(0), -_floor_div(tolerance - F.col("t"), step), _floor_div(F.col("before") + F.col("t"), 2 * step) + 1)
    high = F.least(F.lit(last), _floor_div(F.col("t") + tolerance, step), _floor_div(F.col("t") + F.col("behind"), 2 * step))
    d = d.select(*ks, "t", "s", low.alias("low"), high.alias("high")).where("low <= high")
    d = d.select(*ks, "t", "s", F.explode(F.sequence("low", "high")).alias("k"))
    at = F.timestamp_add("MICROSECOND", F.col("k") * step, F.lit(start).cast("timestamp_ntz")).cast(right.schema[on].dataType)
    taken = {c.lower() for c in (*keys, on)}
    name = lambda c: c + suffix if c.lower() in taken else c
    return d.select(
        *(F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)), at.alias(on), F.col("s.ts").alias(on + suffix), *(_of("s", "v").getField(c).alias(name(c)) for c in values), (F.abs(F.col("k") * step - F.col("t")) / 1e6).alias(_age_name(name, values))
    )


def interpolate_asof(
    left: DataFrame,
    right: DataFrame,
    by: str | list[str],
    on: str,
    values: list[str],
    edge: str = "drop",
    skip_null: bool = False,
    min_points: int = 1,
    bucket: str | None = None,
    times: DataFrame | None = None,
) -> DataFrame:
    """``left`` with ``values`` of ``right`` interpolated linearly in time.

    Outside the samples: ``edge="drop"`` drops the row, ``"null"`` gives null, ``"clamp"`` gives the end value.  With
    ``skip_null`` samples with a null value are left out (one value column only); a key with fewer than ``min_points``
    samples gives null.  ``bucket`` and ``times``: see ``bracket``.
    """
    keys = [by] if isinstance(by, str) else by
    samples = right.select(*map(quoted, [*keys, on, *values]))
    if skip_null:
        samples = samples.dropna(subset=values)
    d = bracket(left, samples, keys, on, values, bucket, times)
    ok = F.lit(True)
    if min_points > 1:
        enough = samples.select(*_keys(keys), quoted(on).alias("ts")).where("ts is not null").distinct().groupBy(*_names(keys)).count()
        enough = enough.where(F.col("count") >= min_points).select(*_names(keys), F.lit(True).alias("ok"))
        d = d.select(*(_of("row", c).alias(n) for c, n in zip(keys, _names(keys), strict=True)), "row", "b").join(enough, _names(keys), "left")
        ok = F.coalesce("ok", F.lit(False))
    t = micros(_of("row", on))
    t0, t1 = F.col("b.s0.t"), F.col("b.s1.t")
    inside = t0.isNotNull() & (t1.isNotNull() | (t == t0))
    share = (t - t0) / (t1 - t0)

    def value(c: str) -> Column:
        a, b = F.col("b.s0.v").getField(c), F.col("b.s1.v").getField(c)
        line = F.when(t == t0, a).when(inside, a + (b - a) * share)
        if edge == "clamp":
            line = F.when(t0.isNull(), b).when(t1.isNull(), a).otherwise(line)
        return F.when(ok, line).alias(c)

    kept = d.where(inside) if edge == "drop" else d
    return kept.select(*(_of("row", c).alias(c) for c in left.columns if c not in values), *map(value, values))


def at_every_time(samples: DataFrame, times: DataFrame, by: str, on: str, values: list[str], keys: DataFrame | None = None, bucket: str | None = None) -> DataFrame:
    """(on, by, ``values``): every key at every time of ``times``, interpolated, the end values outside a key's samples.

    ``keys`` has the keys wanted, else all keys of ``samples`` are.  Samples with a null value are left out if there is
    one value column; keys without samples give null.
    """
    wanted = cross_times(times, samples if keys is None else keys, on, by)
    return interpolate_asof(wanted, samples, by, on, values, "clamp", skip_null=len(values) == 1, bucket=bucket)


def snap_to_grid(df: DataFrame, by: str, on: str, every_min: int = 15, tolerance_s: float = 60.0) -> DataFrame:
    """The nearest sample of each point of a uniform grid, at the grid's time.

    A key's grid starts at its first time with the minute floored to ``every_min`` within the hour, and ends at its
    last time.  Points without a sample within ``tolerance_s`` are left out; of equally near samples the earlier is
    taken.  With a tolerance below half a step each sample has one point, so no grid is built.
    """
    step = every_min * 60_000_000
    values = [c for c in df.columns if c not in (by, on)]
    rows = df.select(quoted(by).alias("k"), quoted(on).alias("ts"), micros(quoted(on)).alias("t"), (F.struct(*map(quoted, values)) if values else F.struct(F.lit(1).alias("one"))).alias("v"))
    start = F.timestamp_add("MINUTE", -(F.minute("first") % every_min), F.date_trunc("MINUTE", "first").cast("timestamp_ntz"))
    bounds = rows.groupBy("k").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    bounds = bounds.select("k", micros(start).alias("from"), micros(F.col("last")).alias("to"), start.alias("start"))
    at = F.timestamp_add("MINUTE", F.col("n") * every_min, F.col("start")).alias("at")
    if tolerance_s * 2e6 < step:
        d = rows.join(bounds, "k").withColumn("n", F.floor((F.col("t") - F.col("from")) / step + F.lit(0.5)).cast("long"))
        d = d.withColumn("off", F.col("t") - F.col("from") - F.col("n") * step)
        ok = (F.abs("off") <= tolerance_s * 1e6) & (F.col("from") + F.col("n") * step <= F.col("to"))
        best = d.where(ok).groupBy("k", "n", "start").agg(F.min(F.struct(F.abs("off").alias("far"), "off", "v")).alias("best"))
        return best.select(F.col("k").alias(by), at.alias(on), *(F.col("best.v").getField(c).alias(c) for c in values))
    grid = bounds.select("k", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("to") - F.col("from")) / step))).alias("n"))
    grid = grid.select(F.col("k").alias(by), at.alias(on))
    return nearest_asof(grid, df, by, on, tolerance_s).select(*map(quoted, [by, on, *values]))


@dataclass(frozen=True)
class Samples:
    """One right side of ``interpolate_many``; the fields mean what they mean in ``interpolate_asof``, ``min_points`` up to 2."""

    df: DataFrame
    values: list[str]
    edge: str = "drop"
    skip_null: bool = False
    min_points: int = 1


def interpolate_many(left: DataFrame, rights: list[Samples], by: str | list[str], on: str, bucket: str | None = None, times: DataFrame | None = None) -> DataFrame:
    """``interpolate_asof`` with each of ``rights`` in turn, but ``left`` and all samples are exchanged and put in order once.

    Rows of all tables stand in one order by time; each row of ``left`` takes each side's last sample at or before it
    and, in the reverse order, its next one.  With ``bucket`` one table of periods for all sides hands on the samples
    on either side of each (key, period).  ``bucket`` and ``times``: see ``bracket``.  Values of different sides need
    different names and replace columns of ``left`` of the same name; of samples with one key and time the least values are taken.
    """
    if any(r.min_points > 2 for r in rights):
        raise ValueError("min_points is 1 or 2 here")
    by = [by] if isinstance(by, str) else by
    size = None if bucket is None else _BUCKETS[bucket]
    ks, sides = _names(by), range(len(rights))
    samples = []
    for r in rights:
        d = r.df.dropna(subset=r.values) if r.skip_null else r.df
        d = d.select(*_keys(by), micros(quoted(on)).alias("t"), F.struct(*map(quoted, r.values)).alias("v")).dropna(subset=[*ks, "t"])
        samples.append(d.groupBy(*ks, _period(size).alias("p"), "t").agg(F.min("v").alias("v")).select(*ks, "p", "t", F.struct("t", "v").alias("s")))
    kinds = [d.schema["s"].dataType for d in samples]
    asked = left.select(*_keys(by), micros(quoted(on)).alias("t"), F.struct(*map(quoted, left.columns)).alias("row"))
    none = [F.lit(None).cast(k).alias(f"s{i}") for i, k in enumerate(kinds)]
    both = asked.select(*ks, _period(size).alias("p"), "t", "row", *none)
    for i, d in enumerate(samples):
        both = both.unionByName(d.select(*ks, "p", "t", F.lit(None).cast(asked.schema["row"].dataType).alias("row"), *(F.col("s").alias("s" + str(j)) if i == j else none[j] for j in sides)))
    # at one time samples stand before rows, so the last one so far is at or before a row, and in reverse behind it
    unit, is_row = Window.partitionBy(*ks, "p"), F.col("row").isNotNull()
    so_far = (unit.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((F.col("t").asc(), is_row.asc()), (F.col("t").desc(), is_row.desc())))
    for name, w in zip("ab", so_far, strict=True):
        both = both.withColumns({f"{name}{i}": F.last(f"s{i}", ignorenulls=True).over(w) for i in sides})
    if size is None:
        both = both.withColumns({f"many{i}": F.min(f"s{i}.t").over(unit) < F.max(f"s{i}.t").over(unit) for i in sides if rights[i].min_points > 1})
    d = both.where(is_row).select(*ks, "p", "t", "row", *(f"{n}{i}" for n in "ab" for i in sides), *(f"many{i}" for i in sides if size is None and rights[i].min_points > 1))
    if size is not None:
        asked_at = (left if times is None else times).select(*_keys(by), micros(quoted(on)).alias("t")).select(*ks, _period(size).alias("p")).dropna().distinct()
        ends = [F.lit(None).cast(k).alias(f"{n}{i}") for i, k in enumerate(kinds) for n in ("first", "last")]
        per = asked_at.select(*ks, "p", *ends)
        for i, x in enumerate(samples):
            own = x.groupBy(*ks, "p").agg(F.min_by("s", "t").alias(f"first{i}"), F.max_by("s", "t").alias(f"last{i}"))
            per = per.unionByName(own, allowMissingColumns=True)
        per = per.groupBy(*ks, "p").agg(*(F.first(f"{n}{i}", ignorenulls=True).alias(f"{n}{i}") for i in sides for n in ("first", "last")))
        key = Window.partitionBy(*ks)
        up, down = (key.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("p").asc(), F.col("p").desc()))  # a row for each period
        lent = [c for i in sides for c in (F.last(f"last{i}", ignorenulls=True).over(up).alias(f"before{i}"), F.last(f"first{i}", ignorenulls=True).over(down).alias(f"behind{i}"))]
        many = [(F.min(f"first{i}.t").over(key) < F.max(f"last{i}.t").over(key)).alias(f"many{i}") for i in sides if rights[i].min_points > 1]
        d = d.join(per.select(*ks, "p", *lent, *many), [*ks, "p"], "left")
        d = d.withColumns({f"{n}{i}": F.coalesce(f"{n}{i}", f"{m}{i}") for i in sides for n, m in (("a", "before"), ("b", "behind"))})
    keep, found = F.lit(True), []
    for i, r in enumerate(rights):
        a, b, t = F.col(f"a{i}"), F.col(f"b{i}"), F.col("t")
        ok = F.coalesce(F.col(f"many{i}"), F.lit(False)) if r.min_points > 1 else F.lit(True)
        exact, inside = a["t"] == t, a.isNotNull() & b.isNotNull()
        if r.edge == "drop":
            keep = keep & (F.coalesce(exact, F.lit(False)) | inside)
        for c in r.values:
            p, q = a["v"].getField(c), b["v"].getField(c)
            value = F.when(exact, p).when(inside, p + (q - p) * (t - a["t"]) / (b["t"] - a["t"]))
            if r.edge == "clamp":
                value = value.when(t.isNotNull(), F.when(a.isNull(), q).otherwise(p))
            found.append(F.when(ok, value).alias(c))
    taken = {c for r in rights for c in r.values}
    return d.where(keep).select(*(_of("row", c).alias(c) for c in left.columns if c not in taken), *found)
