"""Queries over the driver's tables by name, each with SQL that must give the same rows.

``events`` stands for a series (user_id is the satellite, ts the time, value the error); its nulls come from an
expression that both engines share.  Doubles are rounded to six places in both.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.functions import errors as E
from ephemera.functions.orbit import eccentric_anomaly, with_clock_correction, with_position
from ephemera.functions.scalars import finite_or, gps_seconds
from ephemera.operators import asof, evaluate, filters, forecast, order, prep, profile, regression, sequences, windows
from ephemera.operators.states import broadcast_states, error_dataset, first_ephemerides, published
from ephemera.sources import clk, nav, sp3, tables
from ephemera.sources.text import find_files, scratch
from ephemera.streaming import latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with x: value, null where event_id is a multiple of 7."""
    return events(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("value")))


GAPPY = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)"
ON = ["ts", "event_id"]


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# as-of joins

_PAIR = """
v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
c AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    return e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value")


def _nearest_sql(how: str) -> str:
    return f"""WITH {_PAIR}
SELECT v.event_id, v.user_id, v.ts, c.ts AS ts_right, c.value, CASE WHEN c.ts IS NOT NULL THEN epoch_us(greatest(v.ts, c.ts)) / 1e6 - epoch_us(least(v.ts, c.ts)) / 1e6 END AS age_s
FROM v {how} JOIN c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts - INTERVAL 2 HOUR AND v.ts + INTERVAL 2 HOUR
QUALIFY row_number() OVER (PARTITION BY v.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(c.ts)), c.ts) = 1"""


@query("nearest_asof", f"SELECT * REPLACE (round(age_s, 3) AS age_s) FROM ({_nearest_sql('INNER')})")
def _(spark, sf_dir):
    return rounded(asof.nearest_asof(*_pair(spark, sf_dir), "user_id", "ts", 7200), "age_s", places=3)


@query("nearest_asof_left_bucketed", f"SELECT * REPLACE (round(age_s, 3) AS age_s) FROM ({_nearest_sql('LEFT')})")
def _(spark, sf_dir):
    return rounded(asof.nearest_asof(*_pair(spark, sf_dir), "user_id", "ts", 7200, how="left", bucket="day"), "age_s", places=3)


def _interpolate_sql(edge: str, samples: str = "c") -> str:
    line = "CASE WHEN v.ts = b.ts THEN b.value WHEN b.ts IS NOT NULL AND a.ts IS NOT NULL THEN b.value + (a.value - b.value) * (epoch_us(v.ts) - epoch_us(b.ts)) / (epoch_us(a.ts) - epoch_us(b.ts))"
    clamp = " WHEN a.ts IS NULL THEN b.value WHEN b.ts IS NULL THEN a.value" if edge == "clamp" else ""
    where = "WHERE b.ts IS NOT NULL AND (a.ts IS NOT NULL OR v.ts = b.ts)" if edge == "drop" else ""
    return f"""WITH {_PAIR},
n AS (SELECT user_id, ts, min(value) AS value, count(*) OVER (PARTITION BY user_id) AS k FROM events WHERE event_type = 'click' AND event_id % 7 <> 0 GROUP BY user_id, ts)
SELECT v.event_id, v.user_id, v.ts, round({"CASE WHEN coalesce(b.k, a.k) >= 2 THEN " if samples == "n" else ""}{line}{clamp} END{" END" if samples == "n" else ""}, 6) AS value
FROM v ASOF LEFT JOIN {samples} b ON v.user_id = b.user_id AND v.ts >= b.ts ASOF LEFT JOIN {samples} a ON v.user_id = a.user_id AND v.ts < a.ts {where}"""


def _interpolate(edge: str) -> Query:
    return lambda spark, sf_dir: rounded(asof.interpolate_asof(*_pair(spark, sf_dir), "user_id", "ts", ["value"], edge), "value")


for _edge in ("drop", "null", "clamp"):
    query(f"interpolate_{_edge}", _interpolate_sql(_edge))(_interpolate(_edge))


@query("interpolate_valid_samples", _interpolate_sql("null", "n"))
def _(spark, sf_dir):
    left, _ = _pair(spark, sf_dir)
    right = gappy(spark, sf_dir).where("event_type = 'click'").select("user_id", "ts", F.col("x").alias("value"))
    return rounded(asof.interpolate_asof(left, right, "user_id", "ts", ["value"], "null", skip_null=True, min_points=2, bucket="week"), "value")


@query(
    "snap_to_grid",
    """WITH b AS (SELECT user_id, date_trunc('minute', min(ts)) - INTERVAL 1 MINUTE * (minute(min(ts)) % 15) AS lo, max(ts) AS hi FROM events GROUP BY 1),
d AS (SELECT e.user_id, e.event_id, e.value, e.ts, lo, hi, CAST(floor((epoch_us(ts) - epoch_us(lo)) / 900000000.0 + 0.5) AS BIGINT) AS k FROM events e JOIN b USING (user_id)),
g AS (SELECT *, epoch_us(ts) - epoch_us(lo) - k * 900000000 AS off FROM d)
SELECT user_id, lo + INTERVAL 15 MINUTE * k AS ts, event_id, value FROM g
WHERE abs(off) <= 60000000 AND epoch_us(lo) + k * 900000000 <= epoch_us(hi)
QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY abs(off), off, event_id, value) = 1""",
)
def _(spark, sf_dir):
    return asof.snap_to_grid(events(spark, sf_dir).select("user_id", "ts", "event_id", "value"), "user_id", "ts", 15, 60)


@query("nearest_on_grid", """WITH c AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'click' AND user_id IS NOT NULL GROUP BY ALL),
g AS (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM c), (SELECT max(ts) FROM c), INTERVAL 45 MINUTE)) AS ts)
SELECT user_id, g.ts, c.ts AS ts_right, value, round(abs(epoch_us(g.ts) - epoch_us(c.ts)) / 1e6, 3) AS age_s FROM g JOIN c ON c.ts BETWEEN g.ts - INTERVAL 6 HOUR AND g.ts + INTERVAL 6 HOUR
QUALIFY row_number() OVER (PARTITION BY user_id, g.ts ORDER BY abs(epoch_us(g.ts) - epoch_us(c.ts)), c.ts) = 1""")
def _(spark, sf_dir):
    """Every satellite at every 45 minutes; the bounds of the grid are one row."""
    clicks = events(spark, sf_dir).where("event_type = 'click'").select("user_id", "ts", "value")
    lo, hi = clicks.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz"), F.max("ts")).first()
    return rounded(asof.nearest_on_grid(clicks, "user_id", "ts", lo, hi, 2700, 6 * 3600), "age_s", places=3)


@query("cross_times", "SELECT d AS day, c_mktsegment AS segment FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders), (SELECT DISTINCT c_mktsegment FROM customer)")
def _(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("day"))
    return asof.cross_times(days, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")), "day", "segment")


# orbit mechanics on elements made from lineitem

_ELEMENTS = {
    "satellite": "concat('G', lpad(cast(l_linenumber AS string), 2, '0'))",
    "a": "26560000.0 + l_quantity * 100",
    "e": "0.005 + l_discount / 10",
    "i0": "0.9 + l_tax",
    "omega0": "l_extendedprice / 30000.0",
    "omega": "l_quantity / 20.0",
    "m0": "l_extendedprice / 40000.0 - 1",
    "toe": "cast(l_orderkey % 84 AS double) * 7200.0",
    "delta_n": "4.5e-9",
    "omega_dot": "-8.0e-9",
    "idot": "1.0e-10",
    "cuc": "1.0e-6",
    "cus": "8.0e-6",
    "crc": "200.0",
    "crs": "20.0",
    "cic": "1.0e-7",
    "cis": "-5.0e-8",
    "af0": "l_discount * 1e-4",
    "af1": "l_tax * 1e-11",
    "af2": "0.0",
}


_CONSTANTS = {k: float(v) for k, v in _ELEMENTS.items() if re.fullmatch("[0-9.e-]+", v)}


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {k: F.expr(v) for k, v in _ELEMENTS.items()}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("timestamp"), *(F.coalesce(c.cast("string" if k == "satellite" else "double")).alias(k) for k, c in e.items()))


_E_SQL = ", ".join(f"CAST({v.replace('AS string', 'AS VARCHAR')} AS {'VARCHAR' if k == 'satellite' else 'DOUBLE'}) AS {k}" for k, v in _ELEMENTS.items())
_WRAP = "CASE WHEN {0} > 302400 THEN {0} - 604800 WHEN {0} < -302400 THEN {0} + 604800 ELSE {0} END"
_DT = "((epoch_us(timestamp) - epoch_us(TIMESTAMP '1980-01-06 00:00:00')) / 1e6) % 604800.0 - toe"


def _kepler_ctes(source: str, mean: str, steps: int = 12, k: str = "k", x: str = "x") -> str:
    out = f"{k}0 AS (SELECT *, {mean} AS mean_{k}, {mean} AS {x}0 FROM {source})"
    for n in range(steps):
        out += f",\n{k}{n + 1} AS (SELECT * EXCLUDE ({x}{n}), {x}{n} - ({x}{n} - e * sin({x}{n}) - mean_{k}) / (1 - e * cos({x}{n})) AS {x}{n + 1} FROM {k}{n})"
    return out


@query(
    "kepler",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_E_SQL} FROM lineitem),
{_kepler_ctes("s", "m0")}
SELECT l_orderkey, l_linenumber, round(x12, 9) AS ecc_anom FROM k12""",
)
def _(spark, sf_dir):
    return _elements(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(eccentric_anomaly(F.col("m0"), F.col("e")), 9).alias("ecc_anom"))


@query(
    "broadcast_position",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate AS timestamp, {_E_SQL} FROM lineitem),
t AS (SELECT *, {_WRAP.format("(" + _DT + ")")} AS tk FROM s),
{_kepler_ctes("t", "m0 + (sqrt(3.986005e14 / pow(a, 3.0)) + delta_n) * tk")},
p AS (SELECT *, atan2(sqrt(1 - e * e) * sin(x12), cos(x12) - e) + omega AS phi FROM k12),
u AS (SELECT *, phi + cus * sin(2 * phi) + cuc * cos(2 * phi) AS uk, a * (1 - e * cos(x12)) + crs * sin(2 * phi) + crc * cos(2 * phi) AS rk,
  i0 + cis * sin(2 * phi) + cic * cos(2 * phi) + idot * tk AS ik, omega0 + (omega_dot - 7.2921151467e-5) * tk - 7.2921151467e-5 * toe AS node FROM p)
SELECT l_orderkey, l_linenumber, round(rk * cos(uk) * cos(node) - rk * sin(uk) * cos(ik) * sin(node), 2) AS x_broadcast,
  round(rk * cos(uk) * sin(node) + rk * sin(uk) * cos(ik) * cos(node), 2) AS y_broadcast, round(rk * sin(uk) * sin(ik), 2) AS z_broadcast FROM u""",
)
def _(spark, sf_dir):
    d = with_position(_elements(spark, sf_dir)).select("l_orderkey", "l_linenumber", "x_broadcast", "y_broadcast", "z_broadcast")
    return rounded(d, "x_broadcast", "y_broadcast", "z_broadcast", places=2)


@query(
    "broadcast_clock",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate AS timestamp, {_E_SQL} FROM lineitem),
t AS (SELECT *, {_WRAP.format("(" + _DT + ")")} AS dt FROM s),
{_kepler_ctes("t", "m0 + sqrt(3.986005e14 / pow(a, 3.0)) * dt")}
SELECT l_orderkey, l_linenumber, round((af0 + af1 * dt + af2 * dt * dt + -4.442807633e-10 * e * sqrt(a) * sin(x12)) * 1e9, 4) AS clock_ns FROM k12""",
)
def _(spark, sf_dir):
    d = with_clock_correction(_elements(spark, sf_dir))
    return d.select("l_orderkey", "l_linenumber", F.round(F.col("clock_broadcast") * 1e9, 4).alias("clock_ns"))


def _vectors() -> tuple[tuple[Column, ...], ...]:
    c = F.col
    b = (c("l_extendedprice"), c("l_quantity") * 100, c("l_orderkey").cast("double"))
    p = (c("l_extendedprice") - c("l_quantity"), c("l_quantity") * 99, c("l_orderkey") + c("l_tax"))
    v = (c("l_quantity"), c("l_discount") + 1, c("l_tax") - 2)
    return b, p, v


@query(
    "rac_errors",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS dx, l_quantity * 100 - l_quantity * 99 AS dy, l_orderkey - (l_orderkey + l_tax) AS dz,
 l_extendedprice - l_quantity AS px, l_quantity * 99 AS py, l_orderkey + l_tax AS pz, l_quantity AS vx, l_discount + 1 AS vy, l_tax - 2 AS vz FROM lineitem),
c AS (SELECT *, py * vz - pz * vy AS cx, pz * vx - px * vz AS cy, px * vy - py * vx AS cz FROM s)
SELECT l_orderkey, l_linenumber, round(sqrt(dx * dx + dy * dy + dz * dz), 5) AS orbit_error, round((dx * px + dy * py + dz * pz) / sqrt(px * px + py * py + pz * pz), 5) AS radial,
 round((dx * vx + dy * vy + dz * vz) / sqrt(vx * vx + vy * vy + vz * vz), 5) AS along, round((dx * cx + dy * cy + dz * cz) / sqrt(cx * cx + cy * cy + cz * cz), 5) AS across FROM c""",
)
def _(spark, sf_dir):
    b, p, v = _vectors()
    along, across = E.along_cross_errors(b, p, v)
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(n) for c, n in ((E.orbit_error(b, p), "orbit_error"), (E.radial_error(b, p), "radial"), (along, "along"), (across, "across"))))


@query("clock_error_join", "SELECT l_orderkey, l_linenumber, round((l_discount - o_totalprice / 1e6) * 1e9, 3) AS clock_error_ns, round(l_tax, 6) AS tax FROM lineitem LEFT JOIN orders ON l_orderkey = 2 * o_orderkey")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("l_orderkey"), "o_totalprice")  # lines of odd orders have no partner
    d = table(spark, sf_dir, "lineitem").join(o, "l_orderkey", "left")
    return d.select("l_orderkey", "l_linenumber", F.round(E.clock_error_ns(F.col("l_discount"), F.col("o_totalprice") / 1e6), 3).alias("clock_error_ns"), F.round("l_tax", 6).alias("tax"))


def _error_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Broadcast states at 01:00 of each day, precise samples at 00:00 and 02:00 from slightly larger orbits, and the states' times."""
    nav_rows = _elements(spark, sf_dir).drop("l_orderkey", "l_linenumber")
    times = nav_rows.select((F.col("timestamp") + F.expr("interval 1 hour")).alias("timestamp"))
    states = broadcast_states(nav_rows, times)
    ends = cross_ends(nav_rows)
    precise = with_clock_correction(with_position(ends.withColumn("a", F.col("a") + 50)))
    orbit = precise.select("timestamp", "satellite", F.col("x_broadcast").alias("x"), F.col("y_broadcast").alias("y"), F.col("z_broadcast").alias("z"))
    return states, orbit, precise.select("timestamp", "satellite", F.col("clock_broadcast").alias("clock_bias")), asof.cross_times(times, nav_rows)


def cross_ends(nav_rows: DataFrame) -> DataFrame:
    """The least ephemeris of each satellite and day, at 00:00 and at 02:00."""
    values = [c for c in nav_rows.columns if c not in ("satellite", "timestamp")]
    one = nav_rows.groupBy("satellite", "timestamp").agg(F.min(F.struct(*values)).alias("v")).select("satellite", "timestamp", "v.*")
    return one.unionByName(one.withColumn("timestamp", F.col("timestamp") + F.expr("interval 2 hour")))


_ORDERED = ", ".join(k for k in _ELEMENTS if k != "satellite")
_ERRORS_SQL = f"""WITH raw AS (SELECT {_E_SQL}, l_shipdate AS day FROM lineitem),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY satellite, day ORDER BY {_ORDERED}) = 1),
src AS (SELECT 'b' AS kind, day + INTERVAL 1 HOUR AS timestamp, * FROM one UNION ALL SELECT 'p', day, * REPLACE (a + 50 AS a) FROM one UNION ALL SELECT 'p', day + INTERVAL 2 HOUR, * REPLACE (a + 50 AS a) FROM one),
t AS (SELECT *, {_WRAP.format("(" + _DT + ")")} AS tk FROM src),
{_kepler_ctes("t", "m0 + (sqrt(3.986005e14 / pow(a, 3.0)) + delta_n) * tk")},
ph AS (SELECT *, atan2(sqrt(1 - e * e) * sin(x12), cos(x12) - e) + omega AS phi FROM k12),
u AS (SELECT *, phi + cus * sin(2 * phi) + cuc * cos(2 * phi) AS uk, a * (1 - e * cos(x12)) + crs * sin(2 * phi) + crc * cos(2 * phi) AS rk,
  i0 + cis * sin(2 * phi) + cic * cos(2 * phi) + idot * tk AS ik, omega0 + (omega_dot - 7.2921151467e-5) * tk - 7.2921151467e-5 * toe AS node FROM ph),
pos AS (SELECT *, rk * cos(uk) * cos(node) - rk * sin(uk) * cos(ik) * sin(node) AS x, rk * cos(uk) * sin(node) + rk * sin(uk) * cos(ik) * cos(node) AS y, rk * sin(uk) * sin(ik) AS z FROM u),
{_kepler_ctes("pos", "m0 + sqrt(3.986005e14 / pow(a, 3.0)) * tk", k="c", x="w")},
every AS (SELECT *, af0 + af1 * tk + af2 * tk * tk + -4.442807633e-10 * e * sqrt(a) * sin(w12) AS clock FROM c12),
g AS (SELECT satellite, timestamp, x, y, z, clock, coalesce(lag(x) OVER w, x) AS x1, coalesce(lead(x) OVER w, x) AS x2, coalesce(lag(y) OVER w, y) AS y1, coalesce(lead(y) OVER w, y) AS y2,
  coalesce(lag(z) OVER w, z) AS z1, coalesce(lead(z) OVER w, z) AS z2, (epoch_us(coalesce(lead(timestamp) OVER w, timestamp)) - epoch_us(coalesce(lag(timestamp) OVER w, timestamp))) / 1e6 AS span
  FROM every WHERE kind = 'p' WINDOW w AS (PARTITION BY satellite ORDER BY timestamp)),
v AS (SELECT *, (x2 - x1) / span AS vx, (y2 - y1) / span AS vy, (z2 - z1) / span AS vz FROM g),
j AS (SELECT b.timestamp, b.satellite, b.clock, b.x - (p.x + q.x) / 2 AS dx, b.y - (p.y + q.y) / 2 AS dy, b.z - (p.z + q.z) / 2 AS dz, (p.x + q.x) / 2 AS px, (p.y + q.y) / 2 AS py, (p.z + q.z) / 2 AS pz,
  (p.vx + q.vx) / 2 AS vx, (p.vy + q.vy) / 2 AS vy, (p.vz + q.vz) / 2 AS vz, (p.clock + q.clock) / 2 AS precise FROM every b JOIN v p ON p.satellite = b.satellite AND p.timestamp = b.day
  JOIN v q ON q.satellite = b.satellite AND q.timestamp = b.day + INTERVAL 2 HOUR WHERE b.kind = 'b'),
cr AS (SELECT *, py * vz - pz * vy AS cx, pz * vx - px * vz AS cy, px * vy - py * vx AS cz FROM j),
d AS (SELECT timestamp, satellite, sqrt(dx * dx + dy * dy + dz * dz) AS orbit_error_m, (dx * px + dy * py + dz * pz) / sqrt(px * px + py * py + pz * pz) AS radial_error_m, (dx * vx + dy * vy + dz * vz) / sqrt(vx * vx + vy * vy + vz * vz) AS along_track_error_m,
  (dx * cx + dy * cy + dz * cz) / sqrt(cx * cx + cy * cy + cz * cz) AS cross_track_error_m, (clock - precise) * 1e9 AS clock_error_ns, 1e0 AS ephemeris_age_hours FROM cr)"""


def _whole_metres(d: DataFrame, *cols: str) -> DataFrame:
    """Rounded values, with no sign on zero."""
    return d.withColumns({c: F.round(c) + 0.0 for c in cols})


_LENGTHS = ["orbit_error_m", "radial_error_m", "along_track_error_m", "cross_track_error_m", "clock_error_ns"]


@query("error_dataset", _ERRORS_SQL + " SELECT timestamp, satellite, ephemeris_age_hours, " + ", ".join(f"round({c}) + 0e0 AS {c}" for c in _LENGTHS) + " FROM d")
def _(spark, sf_dir):
    *frames, times = _error_frames(spark, sf_dir)
    return _whole_metres(error_dataset(*frames, velocity=True, bucket="week", times=times), *_LENGTHS)


_STATISTICS = "count(*) AS records, round(avg(orbit_error_m)) + 0e0 AS mean, round(quantile_cont(orbit_error_m, 0.95)) + 0e0 AS percentile_95, round(avg(clock_error_ns)) + 0e0 AS clock_mean FROM d"


@query("error_statistics", f"{_ERRORS_SQL} SELECT 'all' AS satellite, {_STATISTICS} UNION ALL SELECT satellite, {_STATISTICS} GROUP BY satellite")
def _(spark, sf_dir):
    """Mean and 95th percentile of orbit and clock errors, in all and by satellite; the errors are stored, as percentiles read them several times."""
    path = f"{scratch(spark)}/errors-{uuid.uuid4().hex}"
    error_dataset(*_error_frames(spark, sf_dir)[:3]).write.parquet(path)
    d = spark.read.parquet(path)
    every = profile.dataset_statistics(d).select(F.lit("all").alias("satellite"), F.col("total_records").alias("records"), "orbit_error_m.mean", "orbit_error_m.percentile_95", F.col("clock_error_ns.mean").alias("clock_mean"))
    ranked = profile.percentiles(d, ["orbit_error_m"], {"percentile_95": 0.95}, by=["satellite"]).drop("column")
    each = d.groupBy("satellite").agg(F.count("*").alias("records"), F.avg("orbit_error_m").alias("mean"), F.avg("clock_error_ns").alias("clock_mean"))
    each = each.join(ranked, "satellite", "left").select(every.columns)
    return _whole_metres(every.unionByName(each), "mean", "percentile_95", "clock_mean")


# text products written from rows and parsed back


@query("parse_clk_lines", "SELECT CASE WHEN event_id % 3 = 0 THEN 'AR' ELSE 'AS' END AS type, concat('U', user_id) AS id, date_trunc('second', ts) AS timestamp, round(round(value, 9), 6) AS clock_bias, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE 5e-1 END AS std_dev, 2 AS num_values FROM events WHERE event_id % 11 <> 0")
def _(spark, sf_dir):
    kind = F.when(F.col("event_id") % 11 == 0, "XX").when(F.col("event_id") % 3 == 0, "AR").otherwise("AS")
    tail = F.when(F.col("event_id") % 5 == 0, "").otherwise("5.0D-01")
    line = F.format_string("%s U%d  %s %f  2  %.9f  %s", kind, "user_id", F.date_format(F.col("ts"), "yyyy MM dd HH mm"), F.second("ts").cast("double"), "value", tail)
    return rounded(clk.parse_clk_lines(events(spark, sf_dir).select(line.alias("value"))), "clock_bias").select("type", "id", "timestamp", "clock_bias", "std_dev", "num_values")


@query("parse_sp3", "SELECT date_trunc('second', ts) AS timestamp, concat('G', lpad(CAST(user_id % 100 AS VARCHAR), 2, '0')) AS satellite, round(round(value, 6) * 1000, 3) AS x, round(event_id * 1e3, 3) AS y, -1e3 AS z, CASE WHEN event_id % 4 <> 0 THEN round(0.25e-6 * event_id, 9) END AS clock_bias FROM events WHERE event_id % 13 <> 0")
def _(spark, sf_dir):
    clock = F.when(F.col("event_id") % 13 == 0, "bad").when(F.col("event_id") % 4 == 0, "999999.999999").otherwise(F.format_string("%.6f", 0.25 * F.col("event_id")))
    epoch = F.format_string("*  %s %d.00000000", F.date_format("ts", "yyyy M d H m"), F.second("ts"))
    text = F.format_string("#cP2025\n%s\nPG%02d %.6f %.6f -1.0 %s\nEOF\n", epoch, F.col("user_id") % 100, "value", F.col("event_id").cast("double"), clock)
    orbit, bias = sp3.parse_sp3(events(spark, sf_dir).select(F.col("event_id").cast("string").alias("file"), text.alias("value")), keep_file=True)
    d = orbit.join(bias, ["file", "timestamp", "satellite"], "left")
    return d.select("timestamp", "satellite", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "z", F.round("clock_bias", 9).alias("clock_bias"))


@query("read_large_sp3", "SELECT DISTINCT date_trunc('minute', ts) AS timestamp, concat('G', lpad(CAST(user_id % 100 AS VARCHAR), 2, '0')) AS satellite, round(event_id * 1e3, 3) AS x, round(value * 1000, 3) AS y FROM events")
def _(spark, sf_dir):
    """One file of all epochs of a day, written in order and read by splits; minutes of a day are its epochs."""
    path = f"{scratch(spark)}/sp3-{uuid.uuid4().hex}"
    e = events(spark, sf_dir).select("event_id", F.date_trunc("minute", "ts").alias("t"), F.format_string("PG%02d %.6f %.6f -1.0 0.5", F.col("user_id") % 100, F.col("event_id").cast("double"), "value").alias("line"))
    heads = e.select("t").distinct().select("t", F.lit(-1).cast("long").alias("event_id"), F.format_string("*  %s 0.00000000", F.date_format("t", "yyyy M d H m")).alias("line"))
    d = e.unionByName(heads).withColumn("day", F.to_date("t"))
    d.repartition("day").sortWithinPartitions("day", "t", "event_id").select("line", "day").write.partitionBy("day").text(path)  # a file for each day
    orbit = sp3.read_large_sp3(spark, path, "*.txt")[0]
    return orbit.select("timestamp", "satellite", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _nav_record(rows: list[list[str | float | Column]], of: Callable[[str], Column] = F.col) -> Column:
    """The lines of a record: satellite, time, clock polynomial, and rows of columns or constants.  One format writes all numbers; constants stand in it."""
    numbers: list[Column] = []

    def field(c: str | float | Column) -> str:
        c = _CONSTANTS.get(c, c) if isinstance(c, str) else c
        if isinstance(c, float):
            return f"{c:19.12e}"
        numbers.append((of(c) if isinstance(c, str) else c).cast("double"))
        return "%19.12e"

    lines = ["".join(map(field, ["af0", "af1", "af2"])), *("    " + "".join(map(field, r)) for r in rows)]
    return F.replace(F.format_string("%s%s" + "\n".join(lines), of("satellite"), F.date_format(of("timestamp"), " yyyy MM dd HH mm ss"), *numbers), F.lit("e"), F.lit("D"))


@query("parse_nav", f"SELECT satellite, date_trunc('second', l_shipdate) AS timestamp, l_orderkey * 1e0 AS iode, round(a, 0) AS a, round(e, 9) AS e, round(m0, 9) AS m0, toe, round(af0 * 1e9, 6) AS af0_ns, l_linenumber * 1e0 AS iodc FROM (SELECT l_orderkey, l_linenumber, l_shipdate, {_E_SQL} FROM lineitem) WHERE l_linenumber <> 3")
def _(spark, sf_dir):
    d = _elements(spark, sf_dir)
    rows = [
        ["l_orderkey", "crs", "delta_n", "m0"], ["cuc", "e", "cus", F.sqrt("a")], ["toe", "cic", "omega0", "cis"], ["i0", "crc", "omega", "omega_dot"],
        ["idot", 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, "l_linenumber"], [0.0, 0.0],
    ]
    whole = _nav_record(rows)
    short = F.when(F.col("l_linenumber") == 3, F.substring_index(whole, "\n", 5)).otherwise(whole)
    text = F.concat(F.lit("header END OF HEADER\n"), short, F.lit("\n"))
    got = nav.parse_nav(d.select(F.lit("f").alias("file"), text.alias("value")))
    return got.select("satellite", "timestamp", "iode", F.round("a", 0).alias("a"), F.round("e", 9).alias("e"), F.round("m0", 9).alias("m0"), "toe", F.round(F.col("af0") * 1e9, 6).alias("af0_ns"), "iodc")


# filters and scalars


@query("finite_or", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 = 1 THEN 1.0 WHEN event_id % 4 = 2 THEN -1.0 ELSE value END AS x FROM events")
def _(spark, sf_dir):
    k = F.col("event_id") % 4
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return events(spark, sf_dir).select("event_id", finite_or(x).alias("x"))


@query("min_rows", "SELECT event_id, user_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id) >= 67")
def _(spark, sf_dir):
    return filters.min_rows(events(spark, sf_dir).select("event_id", "user_id"), "user_id", 67)


@query("retention", f"SELECT count(*) AS n_before, count(x) AS n_after, count(*) - count(x) AS n_removed, round(100.0 * count(x) / count(*), 6) AS retention_pct FROM {GAPPY}")
def _(spark, sf_dir):
    return rounded(filters.retention_report(gappy(spark, sf_dir), ["x"]), "retention_pct")


@query("convert_units", "SELECT event_id, round(value / 1000, 9) AS pos_error_km, round(value * 2 / 1000, 9) AS clk_error_us FROM events")
def _(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", F.col("value").alias("pos_error_m"), (F.col("value") * 2).alias("clk_error_ns"))
    return rounded(filters.convert_units(d), "pos_error_km", "clk_error_us", places=9)


@query("bad_clock", "SELECT event_id FROM events WHERE event_id % 6 <> 0")
def _(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("clock_bias", F.when(F.col("event_id") % 6 == 0, 0.999999999999).otherwise(F.col("value") * 1e-6 + 2))
    return filters.drop_bad_clock(d).select("event_id")


@query("time_features", "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '1980-01-06 00:00:00')) / 1e6, 3) AS gps_s, CAST(hour(ts) AS INT) AS hour, CAST(day(ts) AS INT) AS day, CAST(dayofyear(ts) AS INT) AS day_of_year, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute_of_day, round(sin(hour(ts) * 2 * pi() / 24), 9) + 0e0 AS day_sin, round(cos(hour(ts) * 2 * pi() / 24), 9) + 0e0 AS day_cos, CAST((user_id % 100) // 8 AS INT) AS satellite_block FROM events")
def _(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("sat", F.format_string("G%02d", F.col("user_id") % 100)).withColumn("gps_s", F.round(gps_seconds(F.col("ts")), 3))
    d = windows.time_features(d, "ts", "sat")
    return d.select("event_id", "gps_s", "hour", "day", "day_of_year", "minute_of_day", (F.round("day_sin", 9) + 0.0).alias("day_sin"), (F.round("day_cos", 9) + 0.0).alias("day_cos"), "satellite_block")


@query("keep_prefix", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '2')")
def _(spark, sf_dir):
    return filters.keep_prefix(table(spark, sf_dir, "orders"), "o_orderpriority", "2").select("o_orderkey")


def _clock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "AR").otherwise("AS")
    return events(spark, sf_dir).select("event_id", kind.alias("type"), F.col("event_type").alias("id"), "value")


@query("satellite_clocks", "SELECT event_id, event_type AS satellite, value FROM events WHERE event_id % 3 <> 0")
def _(spark, sf_dir):
    return filters.satellite_clocks(_clock_rows(spark, sf_dir))


@query("station_clocks", "SELECT event_id, event_type AS station, value FROM events WHERE event_id % 3 = 0")
def _(spark, sf_dir):
    return filters.station_clocks(_clock_rows(spark, sf_dir))


@query("drop_missing", f"SELECT event_id, x FROM {GAPPY} WHERE x IS NOT NULL")
def _(spark, sf_dir):
    return filters.drop_missing(gappy(spark, sf_dir).select("event_id", "x"), ["x"])


@query("keep_keys", "SELECT event_id, user_id FROM events WHERE user_id IN (3, 5, 8, 13)")
def _(spark, sf_dir):
    return filters.keep_keys(events(spark, sf_dir).select("event_id", "user_id"), "user_id", [3, 5, 8, 13])


@query("replace_nonfinite", f"SELECT event_id, coalesce(x, -9) AS x FROM {GAPPY}")
def _(spark, sf_dir):
    return filters.replace_nonfinite(gappy(spark, sf_dir).select("event_id", "x"), ["x"], null=-9.0)


@query("schema_inspection", "SELECT 'event_id,user_id,value' AS numbers, 'o_orderdate' AS time_column, count(*) AS n FROM events")
def _(spark, sf_dir):
    numbers, when = filters.numeric_columns(events(spark, sf_dir)), filters.time_column(table(spark, sf_dir, "orders"))
    return events(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(",".join(sorted(numbers))).alias("numbers"), F.lit(when).alias("time_column"), "n")


@query("serving_features", f"SELECT ts AS timestamp, concat('G', user_id) AS satellite_id, coalesce(x, 0) AS orbit_error_m, value AS clock_error_ns, round(coalesce(x, 0) * 0.8, 6) AS radial_error_m, 2e0 AS ephemeris_age_hours FROM {GAPPY}")
def _(spark, sf_dir):
    d = gappy(spark, sf_dir).select(F.col("ts").alias("timestamp"), F.concat(F.lit("G"), "user_id").alias("satellite_id"), F.col("x").alias("pos_error_m"), F.col("value").alias("clock_error_ns"))
    return rounded(filters.serving_features(d), "radial_error_m")


@query("published", "SELECT concat('G', user_id) AS satellite_id, ts AS timestamp, value AS orbit_error_m, value * 2 AS radial_error_m FROM events")
def _(spark, sf_dir):
    d = events(spark, sf_dir).select(F.concat(F.lit("G"), "user_id").alias("satellite"), F.col("ts").alias("timestamp"), (F.col("value") * 2).alias("radial_error_m"), F.col("value").alias("orbit_error_m"), "event_type")
    return published(d)


@query("clocks_at_every_time", f"""WITH t AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events), k AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, ts, min(x) AS value FROM {GAPPY} WHERE x IS NOT NULL GROUP BY 1, 2), g AS (SELECT * FROM t, k)
SELECT g.user_id, g.ts, round(CASE WHEN g.ts = b.ts THEN b.value WHEN b.ts IS NULL THEN a.value WHEN a.ts IS NULL THEN b.value ELSE b.value + (a.value - b.value) * (epoch_us(g.ts) - epoch_us(b.ts)) / (epoch_us(a.ts) - epoch_us(b.ts)) END, 6) AS x
FROM g ASOF LEFT JOIN n b ON g.user_id = b.user_id AND g.ts >= b.ts ASOF LEFT JOIN n a ON g.user_id = a.user_id AND g.ts < a.ts""")
def _(spark, sf_dir):
    e = gappy(spark, sf_dir)
    times = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    return rounded(asof.at_every_time(e.select("user_id", "ts", "x"), times, "user_id", "ts", ["x"], bucket="week"), "x")


@query("head", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def _(spark, sf_dir):
    return windows.head(events(spark, sf_dir), "user_id", ON, 3).select("event_id", "user_id")


@query("first_rows", "(SELECT event_id, 'first' AS side FROM events ORDER BY ts, event_id LIMIT 7) UNION ALL (SELECT event_id, 'last' FROM events ORDER BY ts DESC, event_id DESC LIMIT 7)")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    first, last = windows.first_rows(e, ON, 7), windows.first_rows(e, ON, 7, last=True)
    return first.select("event_id", F.lit("first").alias("side")).unionByName(last.select("event_id", F.lit("last").alias("side")))


# sources and sinks: products are written to the scratch folder from the tables and read back


def _written(spark: SparkSession, texts: DataFrame, suffix: str) -> str:
    """A new folder below the scratch folder with one product for each (name, value)."""
    folder = f"{scratch(spark)}/products-{uuid.uuid4().hex}"
    texts.select(F.concat("name", F.lit(suffix)).alias("name"), "value").repartition("name").write.partitionBy("name").text(folder)
    return folder


def _clk_head(name: Column, n: Column) -> Column:
    return F.concat(
        F.lit("     3.00           C                                       RINEX VERSION / TYPE\n"), F.format_string("%6d", n), F.lit(" " * 54 + "LEAP SECONDS\n"),
        F.lit("     2    AS    AR                                          # / TYPES OF DATA\n"), F.rpad(F.upper(name), 60, " "), F.lit("ANALYSIS CENTER\n"), F.lit(" " * 60 + "END OF HEADER"),
    )


def _clk_line() -> Column:
    return F.format_string("AS U%03d  %s %f  2   %.9e", "user_id", F.date_format("ts", "yyyy MM dd HH mm"), F.second("ts").cast("double"), F.col("value") * 1e-6)


def _clk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CLK product for each event type, with its events in order of id."""
    d = events(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", _clk_line().alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return d.select("name", F.concat(_clk_head(F.col("name"), F.col("n")), F.lit("\n"), "body", F.lit("\n")).alias("value"))


def _clk_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with a CLK product for each event type and day, written line by line in order of id."""
    folder = f"{scratch(spark)}/products-{uuid.uuid4().hex}"
    e = events(spark, sf_dir).select(F.col("event_type").alias("name"), F.to_date("ts").alias("day"), "event_id", _clk_line().alias("line"))
    head = F.posexplode(F.split(_clk_head(F.col("name"), F.col("n")), "\n")).alias("event_id", "line")
    heads = e.groupBy("name", "day").agg(F.count("*").alias("n")).select("name", "day", head)
    d = heads.withColumn("body", F.lit(False)).unionByName(e.withColumn("body", F.lit(True)))
    d.repartition("name", "day").sortWithinPartitions("name", "day", "body", "event_id", "line").select("line", "name", "day").write.partitionBy("name", "day").text(folder)
    return folder


@query("find_files", "SELECT event_type AS name, true AS has_bytes FROM events GROUP BY 1")
def _(spark, sf_dir):
    folder = _written(spark, _clk_texts(spark, sf_dir), "")
    found = find_files(spark, folder, "*.txt").select(F.regexp_extract("file", "name=([a-z]+)", 1).alias("name"), "size")
    return found.groupBy("name").agg((F.sum("size") > 100).alias("has_bytes"))


@query("read_clk_header", "SELECT upper(event_type) AS analysis_center, '3.00' AS version, CAST(count(*) AS INT) AS leap_seconds, CAST(2 AS INT) AS num_data_types, 'AS,AR' AS data_types FROM events GROUP BY 1")
def _(spark, sf_dir):
    d = clk.read_clk_header(spark, _written(spark, _clk_texts(spark, sf_dir), ""), "*.txt")
    return d.select("analysis_center", "version", "leap_seconds", "num_data_types", F.array_join("data_types", ",").alias("data_types"))


@query("read_many_clk", "SELECT printf('U%03d', user_id) AS id, date_trunc('second', ts) AS timestamp, round(value * 1e-6 * 1e9, 1) AS bias_ns FROM events")
def _(spark, sf_dir):
    d = clk.read_clk(spark, [_clk_files(spark, sf_dir)], "*.txt")
    return d.select("id", "timestamp", F.round(F.col("clock_bias") * 1e9, 1).alias("bias_ns"))


@query("read_sp3_header", "SELECT '#c' AS version, 'P' AS pos_vel_flag, CAST(count(*) AS INT) AS num_epochs, CAST(2300 + min(user_id) AS INT) AS gps_week, 900e0 AS epoch_interval, 'G01,G02' AS satellites FROM events GROUP BY event_type")
def _(spark, sf_dir):
    d = events(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.min("user_id").alias("u"))
    text = F.concat(F.format_string("#cP2025  7  6  0  0  0.00000000 %7d ORBIT IGS20 HLM  IGS\n## %d      0.00000000   900.00000000 60862 0.0\n", "n", F.col("u") + 2300), F.lit("+    2   G01G02  0  0\n*  2025  7  6  0  0  0.00000000\nPG01 1.0 2.0 3.0 4.0\nEOF\n"))
    got = sp3.read_sp3_header(spark, _written(spark, d.select("name", text.alias("value")), ""), "*.txt")
    return got.select("version", "pos_vel_flag", "num_epochs", "gps_week", "epoch_interval", F.array_join("satellites", ",").alias("satellites"))


def _nav_of_line(of: Callable[[str], Column] = F.col) -> Column:
    """A record for each line of an order, without a semi-major axis for line 2."""
    a = F.when(of("l_linenumber") == 2, 0.0).otherwise(F.sqrt(of("a")))
    rows = [["l_orderkey", "crs", "delta_n", "m0"], ["cuc", "e", "cus", a], ["toe", "cic", "omega0", "cis"], ["i0", "crc", "omega", "omega_dot"], ["idot", 0.0, "l_linenumber", 0.0], [0.0] * 4, [0.0, 4.0]]
    return F.concat(_nav_record(rows, of), F.lit("\n"))


def _nav_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A navigation product for each line of an order: one record each."""
    return _elements(spark, sf_dir).select(F.lit("f").alias("file"), F.concat(F.lit("header END OF HEADER\n"), _nav_of_line()).alias("value"))


@query("parse_nav_wide", f"SELECT satellite, timestamp, CAST(l_linenumber AS DOUBLE) AS week, 0e0 AS health, 4e0 AS fit_interval, ((epoch_us(timestamp) - epoch_us(TIMESTAMP '1980-01-06 00:00:00')) / 1e6) % 604800.0 AS toc FROM (SELECT l_linenumber, l_shipdate AS timestamp, {_E_SQL} FROM lineitem) WHERE l_linenumber <> 2")
def _(spark, sf_dir):
    return nav.parse_nav(_nav_texts(spark, sf_dir), wide=True).select("satellite", "timestamp", "week", "health", "fit_interval", "toc")


@query("parse_nav_clock", f"SELECT satellite, l_shipdate AS timestamp, round(af0 * 1e9, 6) AS af0_ns, round(af1 * 1e15, 6) AS af1_fs FROM (SELECT l_linenumber, l_shipdate, {_E_SQL} FROM lineitem)")
def _(spark, sf_dir):
    d = nav.parse_nav_clock(_nav_texts(spark, sf_dir))
    return d.select("satellite", "timestamp", F.round(F.col("af0") * 1e9, 6).alias("af0_ns"), F.round(F.col("af1") * 1e15, 6).alias("af1_fs"))


@query("first_ephemerides", f"""SELECT satellite, timestamp, iode, round(a, 0) AS a, round(af0 * 1e9, 6) AS af0_ns FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 1e0 AS iode, l_shipdate AS timestamp, {_E_SQL} FROM lineitem)
WHERE l_linenumber <> 2 QUALIFY row_number() OVER (PARTITION BY satellite, timestamp ORDER BY l_orderkey // 16, l_orderkey DESC, {_ORDERED}) = 1""")
def _(spark, sf_dir):
    """Products of up to sixteen orders that repeat satellites and days, within a file and from file to file; the first file's first record stays."""
    elements = [c for c in _ELEMENTS if c not in ("satellite", *_CONSTANTS)]
    record = F.struct((-F.col("l_orderkey")).alias("place"), *elements, "satellite", "timestamp", "l_linenumber", "l_orderkey")
    of = _elements(spark, sf_dir).groupBy(F.floor(F.col("l_orderkey") / 16).alias("sixteen")).agg(F.array_sort(F.collect_list(record)).alias("r"))  # elements are exchanged, their text is written behind
    text = F.concat(F.lit("header END OF HEADER\n"), F.array_join(F.transform("r", lambda x: _nav_of_line(lambda c: x[c])), ""))
    files = of.select(F.format_string("%015d.rnx", "sixteen").alias("file"), text.alias("value"))
    records = nav.parse_nav(files, wide=True, source=True)
    got = first_ephemerides(records.select("satellite", "timestamp", "iode", "a", "af0", *nav.SOURCE))  # columns are cut here: the aggregation takes rows whole
    return got.select("satellite", "timestamp", "iode", F.round("a", 0).alias("a"), F.round(F.col("af0") * 1e9, 6).alias("af0_ns"))


def _error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return gappy(spark, sf_dir).select(F.concat(F.lit("G"), "user_id").alias("satellite_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("x").alias("orbit_error_m"), v.alias("clock_error_ns"), v.alias("radial_error_m"), F.lit(2.0).alias("ephemeris_age_hours"))


_ERROR_TABLE = f"SELECT concat('G', user_id) AS satellite_id, date_trunc('second', ts) AS timestamp, x AS orbit_error_m, value AS clock_error_ns, value AS radial_error_m, 2e0 AS ephemeris_age_hours FROM {GAPPY}"


@query("errors_csv", _ERROR_TABLE)
def _(spark, sf_dir):
    path = f"{scratch(spark)}/errors-{uuid.uuid4().hex}"
    tables.write_errors(_error_table(spark, sf_dir), path, "csv")
    return tables.read_errors_csv(spark, path)


@query("errors_parquet", _ERROR_TABLE.replace(" FROM ", ", CAST(ts AS DATE) AS date FROM ", 1))
def _(spark, sf_dir):
    path = f"{scratch(spark)}/errors-{uuid.uuid4().hex}"
    tables.write_errors(_error_table(spark, sf_dir), path, sort=["satellite_id", "timestamp"])
    return spark.read.parquet(path)


_RANKED = "SELECT event_id, user_id, ts, value, row_number() OVER (ORDER BY ts, user_id, event_id) AS rank FROM events"


@query("global_rank", _RANKED)
def _(spark, sf_dir):
    """The whole table in the order of time, then satellite."""
    return order.global_rank(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["ts", "user_id", "event_id"])


@query("ordered_files", _RANKED)
def _(spark, sf_dir):
    """The same order, written as files and told from where each row stands in them."""
    path = f"{scratch(spark)}/ordered-{uuid.uuid4().hex}"
    order.write_ordered(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), path, ["ts", "user_id", "event_id"])
    return order.read_ordered(spark, path)


@query("observations_json", _ERROR_TABLE)
def _(spark, sf_dir):
    """Request bodies, one for each satellite and day, written as lines and read back."""
    path = f"{scratch(spark)}/bodies-{uuid.uuid4().hex}"
    d = _error_table(spark, sf_dir)
    d.groupBy("satellite_id", F.to_date("timestamp")).agg(F.collect_list(F.struct(*d.columns)).alias("data")).select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return tables.read_observations_json(spark, path)


@query("observations_in_a_column", _ERROR_TABLE)
def _(spark, sf_dir):
    d = _error_table(spark, sf_dir)
    return tables.parse_observations(d.select(F.to_json(F.struct(F.array(F.struct(*d.columns)).alias("data"))).alias("body")))


@query("statistics_document", f"""SELECT count(*) AS total_records, count(DISTINCT user_id) AS unique_keys, round(max(x), 6) AS most, count(DISTINCT user_id) AS keys_in_map, date_trunc('second', min(ts)) AS start FROM {GAPPY}""")
def _(spark, sf_dir):
    """The nested document, written, read back and taken apart again."""
    d, path = gappy(spark, sf_dir), f"{scratch(spark)}/statistics-{uuid.uuid4().hex}"
    tables.write_statistics_json(tables.statistics_json(profile.dataset_statistics(d, "user_id", "ts", ["x"]), profile.key_statistics(d, "user_id", ["x"]), "user_id"), path)
    kind = "total_records long, unique_keys long, x struct<max: double>, time_span struct<start: timestamp_ntz>, per_key map<string, struct<records: long>>"
    j = spark.read.text(path).select(F.from_json("value", kind).alias("j"))
    return j.select("j.total_records", "j.unique_keys", F.round("j.x.max", 6).alias("most"), F.size("j.per_key").cast("long").alias("keys_in_map"), F.date_trunc("second", "j.time_span.start").cast("timestamp_ntz").alias("start"))


# profiles


@query("dataset_statistics", f"""SELECT count(*) AS total_records, count(DISTINCT user_id) AS unique_keys, min(ts) AS start, max(ts) AS "end", round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS duration_hours,
 round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS percentile_95 FROM {GAPPY}""")
def _(spark, sf_dir):
    d = profile.dataset_statistics(gappy(spark, sf_dir), "user_id", "ts", ["x"])
    return rounded(d.select("total_records", "unique_keys", "start", "end", "duration_hours", "x.*"), "duration_hours", "mean", "std", "median", "percentile_95")


@query("key_statistics", f"SELECT user_id, count(*) AS records, round(avg(x), 6) AS x_mean, round(avg(value), 6) AS value_mean FROM {GAPPY} GROUP BY 1")
def _(spark, sf_dir):
    return rounded(profile.key_statistics(gappy(spark, sf_dir), "user_id", ["x", "value"]), "x_mean", "value_mean")


@query("counts_by", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return profile.counts_by(events(spark, sf_dir), "event_type", F.to_date("ts").alias("day"))


_CELLS = "(SELECT 'l_quantity' AS \"column\", l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_linenumber <> 3 THEN l_discount END FROM lineitem)"
_CELL_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))


@query("describe", f'SELECT "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM {_CELLS} GROUP BY 1')
def _(spark, sf_dir):
    return rounded(profile.describe(_cells(spark, sf_dir), _CELL_COLS), "mean", "std", "q25", "q50", "q75")


@query("missing", f'SELECT "column", count(*) - count(value) AS n_null, round(100.0 * (count(*) - count(value)) / count(*), 6) AS pct FROM {_CELLS} GROUP BY 1')
def _(spark, sf_dir):
    return rounded(profile.missing(_cells(spark, sf_dir), _CELL_COLS), "pct")


@query("infinite", "SELECT 'a' AS \"column\", count(*) FILTER (event_id % 9 = 0) AS n_infinite FROM events UNION ALL SELECT 'b', count(*) FILTER (event_id < 0) FROM events")
def _(spark, sf_dir):
    d = events(spark, sf_dir).select(F.when(F.col("event_id") % 9 == 0, float("-inf")).otherwise(F.col("value")).alias("a"), F.col("value").alias("b"))
    return profile.infinite(d, ["a", "b"])


@query("ranges", f'SELECT "column", min(value) AS min, max(value) AS max FROM {_CELLS} GROUP BY 1')
def _(spark, sf_dir):
    return profile.ranges(_cells(spark, sf_dir), _CELL_COLS)


@query("histogram", f"""WITH c AS (SELECT * FROM {_CELLS} WHERE value IS NOT NULL), b AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM c GROUP BY 1),
k AS (SELECT "column", lo AS l, (hi - lo) / 50 AS w, CAST(least(49, floor((value - lo) / ((hi - lo) / 50))) AS INT) AS bin FROM c JOIN b USING ("column"))
SELECT "column", bin, round(l + bin * w, 6) AS lo, round(l + (bin + 1) * w, 6) AS hi, count(*) AS n FROM k GROUP BY "column", bin, l, w""")
def _(spark, sf_dir):
    return rounded(profile.histogram(_cells(spark, sf_dir), _CELL_COLS), "lo", "hi")


@query("correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount FROM lineitem)" for a in _CELL_COLS for b in _CELL_COLS))
def _(spark, sf_dir):
    return rounded(profile.correlation(_cells(spark, sf_dir), _CELL_COLS), "corr")


_IQR = f'(SELECT "column", quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM {_CELLS} GROUP BY 1)'


@query("iqr_outliers", f"""WITH b AS (SELECT *, q25 - 0.6 * (q75 - q25) AS lower, q75 + 0.6 * (q75 - q25) AS upper FROM {_IQR}),
c AS (SELECT b.*, value, value < lower OR value > upper AS o FROM {_CELLS} JOIN b USING ("column") WHERE value IS NOT NULL)
SELECT "column", round(q25, 6) AS q25, round(q75, 6) AS q75, round(lower, 6) AS lower, round(upper, 6) AS upper, count(*) FILTER (o) AS n_outliers, round(100.0 * count(*) FILTER (o) / count(*), 6) AS pct, min(value) AS min, max(value) AS max,
 min(value) FILTER (o) AS outlier_min, max(value) FILTER (o) AS outlier_max FROM c GROUP BY ALL""")
def _(spark, sf_dir):
    return rounded(profile.iqr_report(_cells(spark, sf_dir), _CELL_COLS, 0.6), "q25", "q75", "lower", "upper", "pct")


@query("flag_outliers", """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b, quantile_cont(l_extendedprice, 0.25) AS c, quantile_cont(l_extendedprice, 0.75) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity < a - 0.4 * (b - a) OR l_quantity > b + 0.4 * (b - a) OR l_extendedprice < c - 0.4 * (d - c) OR l_extendedprice > d + 0.4 * (d - c) AS has_outlier FROM lineitem, q""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return profile.flag_outliers(d, ["l_quantity", "l_extendedprice"], 0.4).select("l_orderkey", "l_linenumber", "has_outlier")


@query("outlier_total", """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b, quantile_cont(l_extendedprice, 0.25) AS c, quantile_cont(l_extendedprice, 0.75) AS d FROM lineitem),
f AS (SELECT l_quantity < a - 0.4 * (b - a) OR l_quantity > b + 0.4 * (b - a) OR l_extendedprice < c - 0.4 * (d - c) OR l_extendedprice > d + 0.4 * (d - c) AS o FROM lineitem, q)
SELECT count(*) FILTER (o) AS n_outliers, round(100.0 * count(*) FILTER (o) / count(*), 6) AS pct FROM f""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    return rounded(profile.outlier_total(profile.flag_outliers(d, ["l_quantity", "l_extendedprice"], 0.4)), "pct")


@query("bucket_share", """SELECT CASE WHEN l_tax = 0 THEN '0' WHEN l_tax <= 0.02 THEN '(0, 0.02]' WHEN l_tax <= 0.04 THEN '(0.02, 0.04]' WHEN l_tax <= 0.06 THEN '(0.04, 0.06]' ELSE '> 0.06' END AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(profile.bucket_share(table(spark, sf_dir, "lineitem"), "l_tax", [0.02, 0.04, 0.06]), "pct")


@query("sample_per_value", """WITH f AS (SELECT l_tax, min((l_orderkey, l_linenumber)) AS k FROM lineitem GROUP BY 1 ORDER BY k LIMIT 5)
SELECT l_tax, l_orderkey, l_linenumber FROM lineitem WHERE l_tax IN (SELECT l_tax FROM f) QUALIFY row_number() OVER (PARTITION BY l_tax ORDER BY l_orderkey, l_linenumber) <= 2""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_tax", "l_orderkey", "l_linenumber")
    return profile.sample_per_value(d, "l_tax", ["l_orderkey", "l_linenumber"], 5, 2)


@query("file_line_counts", "SELECT source AS file, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '^[A-E]')) AS early, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits FROM documents GROUP BY 1")
def _(spark, sf_dir):
    return profile.file_line_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("text").alias("value")), {"early": "^[A-E]", "digits": "[0-9]"})


@query("utilisation", """WITH u AS (SELECT count(*) AS rows, count(DISTINCT user_id) AS n_keys, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events)
SELECT rows, n_keys, n_days, round(rows / n_days, 6) AS rows_per_day, round(rows / n_days / n_keys, 6) AS rows_per_key_day, round(100 * rows / n_days / n_keys / 96.0, 6) AS pct_of_expected FROM u""")
def _(spark, sf_dir):
    return rounded(profile.utilisation(events(spark, sf_dir), "user_id", "ts"), "rows_per_day", "rows_per_key_day", "pct_of_expected")


@query("coverage", """WITH w AS (SELECT * FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), (SELECT DISTINCT concat('U', user_id) AS product FROM events)),
h AS (SELECT DISTINCT CAST(ts AS DATE) AS day, concat('U', user_id) AS product, true AS present FROM events)
SELECT day, product, coalesce(present, false) AS present FROM w LEFT JOIN h USING (day, product)""")
def _(spark, sf_dir):
    e = events(spark, sf_dir).select(F.to_date("ts").alias("day"), F.concat(F.lit("U"), "user_id").alias("product"))
    return profile.coverage(e, asof.cross_times(e, e, "day", "product"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("coverage_table", f"SELECT day, {', '.join(f"bool_or(event_type = '{k}' AND value > 100) AS {k}" for k in _KINDS)} FROM (SELECT user_id, CAST(ts AS DATE) AS d, concat(user_id, ' ', CAST(ts AS DATE)) AS day, event_type, value FROM events) GROUP BY day")
def _(spark, sf_dir):
    """For each satellite's day, which kinds have an event above 100."""
    e = events(spark, sf_dir).select(F.concat_ws(" ", "user_id", F.to_date("ts")).alias("day"), F.col("event_type").alias("product"), "value")
    expected = e.select("day").distinct().select("day", F.explode(F.array(*map(F.lit, _KINDS))).alias("product"))
    return profile.coverage_table(e.where("value > 100"), expected, _KINDS)


@query("quality_report", f"SELECT count(*) AS n_rows, CAST(7 AS INT) AS n_columns, count(DISTINCT user_id) AS n_keys, count(x) = count(*) AS critical_complete, count(DISTINCT (user_id, ts)) = count(*) AS monotonic FROM {GAPPY}")
def _(spark, sf_dir):
    return profile.quality_report(gappy(spark, sf_dir), "user_id", "ts", ["x"])


_DAYS = "concat(user_id, ' ', CAST(ts AS DATE)) AS k"


@query("same_keys", f"WITH v AS (SELECT DISTINCT {_DAYS} FROM events WHERE event_type = 'view'), e AS (SELECT DISTINCT {_DAYS} FROM events WHERE event_type <> 'view') SELECT k, 'left' AS side FROM (SELECT * FROM v EXCEPT SELECT * FROM e) UNION ALL SELECT k, 'right' FROM (SELECT * FROM e EXCEPT SELECT * FROM v)")
def _(spark, sf_dir):
    """Days of a satellite with views only, and with other events only."""
    e = events(spark, sf_dir).select("event_type", F.concat_ws(" ", "user_id", F.to_date("ts")).alias("k"))
    return profile.same_keys(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), "k")


@query("no_overlap", "SELECT max(ts) FILTER (CAST(ts AS DATE) < d) AS train_end, min(ts) FILTER (CAST(ts AS DATE) >= d) AS test_start, max(ts) FILTER (CAST(ts AS DATE) < d) < min(ts) FILTER (CAST(ts AS DATE) >= d) AS disjoint FROM events, (SELECT max(CAST(ts AS DATE)) AS d FROM events)")
def _(spark, sf_dir):
    parts = prep.split_last_day(events(spark, sf_dir), "ts")
    return profile.no_overlap(parts.where("split = 'train'"), parts.where("split = 'test'"), "ts")


# windows

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_ROLL = f"""SELECT event_id, round(avg(value) {_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS value_ma, round(coalesce(stddev_samp(value) {_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0), 6) AS value_std,
 round(coalesce(value - lag(value) {_W}), 0), 6) AS value_diff FROM events"""


def _rolling(bucket: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = windows.rolling_stats(events(spark, sf_dir), "user_id", ON, ["value"], 12, bucket)
        return rounded(d.select("event_id", "value_ma", "value_std", "value_diff"), "value_ma", "value_std", "value_diff")

    return run


query("rolling_stats", _ROLL)(_rolling(None))
query("rolling_stats_bucketed", _ROLL)(_rolling("week"))


_ADAPTIVE_SQL = f"""WITH n AS (SELECT *, greatest(1, least(12, count(*) OVER (PARTITION BY user_id) // 4)) AS k, list(value) {_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l FROM events)
SELECT event_id, round(list_avg(list_slice(l, greatest(1, len(l) - k + 1), len(l))), 6) AS value_ma, round(coalesce(list_stddev_samp(list_slice(l, greatest(1, len(l) - k + 1), len(l))), 0), 6) AS value_std FROM n"""


def _adaptive(most: int, share: int, bucket: str | None, places: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = windows.adaptive_rolling(events(spark, sf_dir), "user_id", ON, ["value"], most, share, bucket)
        return rounded(rounded(d.select("event_id", "value_ma", "value_std"), "value_ma", places=places), "value_std")

    return run


query("adaptive_rolling", _ADAPTIVE_SQL)(_adaptive(12, 4, None))
query("adaptive_rolling_bucketed", _ADAPTIVE_SQL)(_adaptive(12, 4, "week"))
query("adaptive_rolling_wide", f"""WITH n AS (SELECT *, greatest(1, least(1000, count(*) OVER (PARTITION BY user_id) // 2)) - 1 AS k FROM events)
SELECT event_id, round(avg(value) {_W} ROWS BETWEEN k PRECEDING AND CURRENT ROW), 9) AS value_ma, round(coalesce(stddev_samp(value) {_W} ROWS BETWEEN k PRECEDING AND CURRENT ROW), 0), 6) AS value_std FROM n""")(_adaptive(1000, 2, "day", 9))  # means of 32 values in hundredths have 7 digits


_FILL_SQL = f"""WITH d AS (SELECT event_id, user_id, min(ts) OVER (PARTITION BY user_id, ts) AS ts, x FROM {GAPPY} QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
p AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t0, last_value(x IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t1, first_value(x IGNORE NULLS) OVER b AS v1 FROM d
 WINDOW a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN x IS NOT NULL THEN x WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 6) AS x FROM p"""


def _filled(bucket: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = gappy(spark, sf_dir).groupBy("user_id", "ts").agg(F.min_by(F.struct("event_id", "x"), "event_id").alias("r")).select("user_id", "ts", "r.*")
        return rounded(windows.fill_gaps(one, "user_id", "ts", ["x"], bucket).select("event_id", "x"), "x")

    return run


query("fill_gaps", _FILL_SQL)(_filled(None))
query("fill_gaps_bucketed", _FILL_SQL)(_filled("day"))


@query("tail", "SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(spark, sf_dir):
    return windows.tail(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ON, 5).select("event_id", "user_id", "value")


@query("latest_rows", "SELECT event_type, event_id, user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 36")
def _(spark, sf_dir):
    """The last 36 events of each type, kept by a stream that reads the whole table in batches, in no order of time."""
    latest.state_store(spark)
    root = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    d = events(spark, sf_dir).select("event_type", "event_id", "user_id", "ts", "value")
    d.repartition(8, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
    latest.write_latest(latest.latest_rows(stream, "event_type", "ts", 36, ["event_id"]), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return latest.read_latest(spark, f"{root}/out")


@query("not_monotonic", "SELECT user_id, n FROM (SELECT user_id, count(*) FILTER (ts <= before) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS before FROM events) GROUP BY 1) WHERE n > 0")
def _(spark, sf_dir):
    return windows.not_monotonic(events(spark, sf_dir), "user_id", "ts", ["value", "event_id"])


def _window_sql(lookback: int, horizon: int, stride: int) -> str:
    ahead = f"ROWS BETWEEN {lookback} FOLLOWING AND {lookback + horizon - 1} FOLLOWING"
    here = f"ROWS BETWEEN CURRENT ROW AND {lookback - 1} FOLLOWING"
    return f"""SELECT user_id, window_start, n_x, round(sum_x, 4) AS sum_x, n_y, round(sum_y, 4) AS sum_y FROM (SELECT user_id, ts AS window_start, row_number() {_W}) AS k, CAST(2 * count(*) {_W} {here}) AS INT) AS n_x,
 sum(value + event_id) {_W} {here}) AS sum_x, CAST(count(*) {_W} {ahead}) AS INT) AS n_y, sum(value) {_W} {ahead}) AS sum_y FROM events) WHERE (k - 1) % {stride} = 0 AND n_y = {horizon}"""


def _windows(lookback: int, horizon: int, stride: int, bucket: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = sequences.make_windows(events(spark, sf_dir), "user_id", ON, ["value", "event_id"], ["value"], lookback, horizon, stride, bucket)
        total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + v), 4)
        return d.select("user_id", "window_start", F.size(F.flatten("x")).alias("n_x"), total("x").alias("sum_x"), F.size(F.flatten("y")).alias("n_y"), total("y").alias("sum_y"))

    return run


for _l, _h, _s in ((36, 4, 2), (12, 1, 1)):
    query(f"windows_{_l}_{_h}_{_s}", _window_sql(_l, _h, _s))(_windows(_l, _h, _s))
    query(f"windows_{_l}_{_h}_{_s}_bucketed", _window_sql(_l, _h, _s))(_windows(_l, _h, _s, "week"))


_NESTED_SQL = f"SELECT user_id, ts AS window_start, CAST(120 AS INT) AS n, round(s, 4) AS sum_x FROM (SELECT user_id, ts, row_number() {_W}) AS k, count(*) OVER (PARTITION BY user_id) AS n, " + " + ".join(f"sum(value) {_W} ROWS BETWEEN {j} FOLLOWING AND {j + 11} FOLLOWING)" for j in range(10)) + " AS s FROM events) WHERE k <= n - 12 - 9"


def _nested(bucket: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = sequences.make_windows(events(spark, sf_dir), "user_id", ON, ["value"], ["value"], 12, 1, bucket=bucket)
        d = sequences.flat(sequences.nested_windows(w, "user_id", 10, bucket=bucket))
        return d.select("user_id", "window_start", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("sum_x"))

    return run


query("nested_windows", _NESTED_SQL)(_nested(None))
query("nested_windows_bucketed", _NESTED_SQL)(_nested("week"))


@query("long_rows", f"""WITH r AS (SELECT *, row_number() {_W}) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, first_value(ts) OVER (PARTITION BY user_id, k // 4 ORDER BY k) AS window_start, CAST(k % 4 AS INT) AS step, value, event_id FROM r WHERE (k // 4) * 4 + 5 <= n)
SELECT user_id, window_start, step, CAST(0 AS INT) AS feature, value FROM s UNION ALL SELECT user_id, window_start, step, CAST(1 AS INT), CAST(event_id AS DOUBLE) FROM s""")
def _(spark, sf_dir):
    """The numbers of windows that follow one another, one per row."""
    w = sequences.make_windows(events(spark, sf_dir), "user_id", ON, ["value", "event_id"], ["value"], 4, 1, 4, "week")
    return sequences.long_rows(w, ["user_id", "window_start"])


@query("windows_complete", f"SELECT user_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT user_id, count(*) {_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n_all, count(x) {_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n_x FROM {GAPPY}) WHERE n_all = 6 AND n_x = 6 GROUP BY 1")
def _(spark, sf_dir):
    w = sequences.make_windows(gappy(spark, sf_dir), "user_id", ON, ["x"], ["x"], 5, 1)
    return rounded(sequences.windows_per_key(sequences.drop_incomplete(w), "user_id"), "pct")


# preparation

_SCALE = {
    "standard": ("avg(value)", "stddev_pop(value)"),
    "minmax": ("min(value)", "max(value) - min(value)"),
    "robust": ("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"),
}


def _scaler(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir).withColumn("one", F.lit(1.0))
        params = prep.fit_scaler(e, ["value", "one"], kind)
        scaled = prep.transform(e, params, ["value", "one"], "_s")
        return rounded(scaled.select("event_id", "value_s", "one_s"), "value_s", "one_s")

    return run


for _kind, (_c, _d) in _SCALE.items():
    query(f"scaler_{_kind}", f"SELECT event_id, round((value - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value_s, 0e0 AS one_s FROM events, (SELECT {_c} AS c, {_d} AS s FROM events)")(_scaler(_kind))


@query("scaler_inverse", "SELECT event_id, round(value, 6) AS value FROM events")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    params = prep.fit_scaler(e, ["value"], "robust")
    return rounded(prep.inverse(prep.transform(e, params, ["value"]), params, ["value"]).select("event_id", "value"), "value")


@query("scaling_check", "SELECT 0e0 AS mean, 1e0 AS std, round(min(z), 6) AS min, round(max(z), 6) AS max, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_infinite, true AS ok FROM (SELECT (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events)")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    d = prep.scaling_check(prep.transform(e, prep.fit_scaler(e, ["value"]), ["value"]), ["value"])
    return rounded(d, "std", "min", "max").withColumn("mean", F.round("mean", 6) + 0.0)


@query("label_encoding", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS type_id, CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END AS type_view FROM events")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    labels = prep.fit_labels(e, "event_type")
    return prep.one_hot(prep.encode_labels(e, labels, "event_type", "type_id"), labels, "event_type", "type_").select("event_id", "type_id", "type_view")


@query("split_fraction", "SELECT event_id, CASE WHEN k <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN k <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events)")
def _(spark, sf_dir):
    return prep.split_fraction(events(spark, sf_dir), "ts", "event_id", [0.7, 0.15, 0.15], ["train", "val", "test"]).select("event_id", "split")


@query("split_last_day", "SELECT event_id, CASE WHEN CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) THEN 'test' ELSE 'train' END AS split FROM events")
def _(spark, sf_dir):
    return prep.split_last_day(events(spark, sf_dir), "ts").select("event_id", "split")


def _unit_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query("shuffled_order", f"SELECT event_id, row_number() OVER (ORDER BY u, event_id) AS place FROM (SELECT event_id, {_unit_sql("concat_ws('|', '7', event_id)")} AS u FROM events)")
def _(spark, sf_dir):
    """The order in which a training run would meet the rows."""
    return prep.shuffled(events(spark, sf_dir).select("event_id", "value"), ["event_id"], seed=7).select("event_id", "place")


@query("split_random", f"SELECT event_id, CASE WHEN {_unit_sql("concat_ws('|', 42, event_id)")} < 0.2 THEN 'test' ELSE 'train' END AS split FROM events")
def _(spark, sf_dir):
    return prep.split_random(events(spark, sf_dir), ["event_id"], 0.2, 42).select("event_id", "split")


@query("augment_noise", f"SELECT event_id, value, false AS augmented FROM events UNION ALL SELECT event_id, round(value + 0.005 * sqrt(-2 * ln({_unit_sql("concat_ws('|', 42, 0, event_id)")})) * cos(2 * pi() * {_unit_sql("concat_ws('|', 42, 1, event_id)")}), 6), true FROM events")
def _(spark, sf_dir):
    d = prep.augment_noise(events(spark, sf_dir).select("event_id", "value"), ["value"], 0.005, keys=["event_id"])
    return d.withColumn("value", F.when(F.col("augmented"), F.round("value", 6)).otherwise(F.col("value")))


@query("label_map", "SELECT event_type AS label, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS index FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, sf_dir):
    return prep.label_map(prep.fit_labels(events(spark, sf_dir), "event_type")).select(F.explode("labels").alias("label", "index"))


@query("preparation_report", "SELECT 'standard' AS method, CAST(24 AS INT) AS lookback, CAST(4 AS INT) AS horizon, CAST(count(DISTINCT event_type) AS INT) AS n_labels, round(avg(value), 6) AS center, round(stddev_pop(value), 6) AS scale FROM events")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    d = prep.preparation_report(prep.fit_scaler(e, ["value"]), prep.fit_labels(e, "event_type"), 24, 4)
    return d.select("method", "lookback", "horizon", F.size("labels").alias("n_labels"), F.round(F.col("scalers")["value"]["center"], 6).alias("center"), F.round(F.col("scalers")["value"]["scale"], 6).alias("scale"))


# evaluation: a value is forecast by the one before it


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = forecast.persistence(events(spark, sf_dir), "user_id", ON, "value")
    return d.select("event_id", F.col("event_type").alias("feature"), (F.col("event_id") % 5 + 1).cast("int").alias("step"), "y", "y_hat")


_F = f"(SELECT event_id, event_type AS feature, CAST(event_id % 5 + 1 AS INT) AS step, value AS y, lag(value) {_W}) AS y_hat FROM events QUALIFY y_hat IS NOT NULL)"
_M = """count(*) AS n, round(avg(abs(y_hat - y)), 6) AS mae, round(avg((y_hat - y) ** 2), 5) AS mse, round(sqrt(avg((y_hat - y) ** 2)), 6) AS rmse, round(1 - sum((y_hat - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
 round(100 * avg(abs(y_hat - y) / greatest(abs(y), 1.0)), 5) AS mape, round((var_pop(y) - avg((y_hat - y) ** 2)) / var_pop(y) * 100, 5) AS gain_pct"""


def _metric_columns(d: DataFrame, by: list[str], *more: str) -> DataFrame:
    d = d.select(*by, "n", "mae", "mse", "rmse", "r2", "mape", "gain_pct", *more)
    return rounded(rounded(d, "mae", "rmse", "r2"), "mse", "mape", "gain_pct", places=5)


_RANGES = "min(y) AS y_min, max(y) AS y_max, min(y_hat) AS y_hat_min, max(y_hat) AS y_hat_max, count(*) FILTER (isnan(y_hat)) AS n_nan, count(*) FILTER (isinf(y_hat)) AS n_infinite"


@query("metrics", f"SELECT feature, {_M}, {_RANGES} FROM {_F} GROUP BY 1")
def _(spark, sf_dir):
    d = evaluate.metrics(_forecasts(spark, sf_dir), ["feature"], eps=1.0)
    return _metric_columns(d, ["feature"], "y_min", "y_max", "y_hat_min", "y_hat_max", "n_nan", "n_infinite")


@query("overall", f"SELECT round(avg(r2), 6) AS mean_r2, round(avg(mae), 6) AS mean_mae, round(avg(rmse), 6) AS mean_rmse, CASE WHEN avg(r2) >= 0.95 THEN 'excellent' WHEN avg(r2) >= 0.85 THEN 'good' WHEN avg(r2) >= 0.75 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT avg(abs(y_hat - y)) AS mae, sqrt(avg((y_hat - y) ** 2)) AS rmse, 1 - sum((y_hat - y) ** 2) / (var_pop(y) * count(*)) AS r2 FROM {_F} GROUP BY feature)")
def _(spark, sf_dir):
    return rounded(evaluate.overall(evaluate.metrics(_forecasts(spark, sf_dir), ["feature"])), "mean_r2", "mean_mae", "mean_rmse")


@query("horizon_averages", f"""WITH h AS (SELECT CASE step WHEN 1 THEN '15min' WHEN 2 THEN '30min' WHEN 4 THEN '1hr' END AS horizon, avg(abs(y_hat - y)) AS mae, sqrt(avg((y_hat - y) ** 2)) AS rmse, coalesce(1 - sum((y_hat - y) ** 2) / nullif(var_pop(y) * count(*), 0), 0) AS r2 FROM {_F} WHERE step IN (1, 2, 4) GROUP BY step, feature)
SELECT horizon, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2, CASE WHEN avg(r2) >= 0.7 THEN 'excellent' WHEN avg(r2) >= 0.5 THEN 'good' WHEN avg(r2) >= 0 THEN 'fair' ELSE 'poor' END AS grade FROM h GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(evaluate.horizon_averages(evaluate.horizon_metrics(_forecasts(spark, sf_dir))), "mae", "rmse", "r2")


@query("original_units", "WITH p AS (SELECT avg(value) AS c, stddev_pop(value) AS s FROM events) SELECT event_id, 'value' AS feature, round(value, 6) AS y, round((value / 2 - c) + c, 6) AS y_hat FROM events, p")
def _(spark, sf_dir):
    """Scaled forecasts (here half the value, less the mean, in deviations) taken back to original units."""
    e = events(spark, sf_dir)
    params = prep.fit_scaler(e, ["value"])
    half = prep.transform(e.withColumn("half", F.col("value") / 2), params.withColumn("column", F.lit("half")).unionByName(params), ["value", "half"])
    rows = half.select("event_id", F.lit("value").alias("feature"), F.col("value").alias("y"), F.col("half").alias("y_hat"))
    return rounded(prep.inverse_long(rows, params, ["y", "y_hat"]).select("event_id", "feature", "y", "y_hat"), "y", "y_hat")


@query("horizon_metrics", f"SELECT CASE step WHEN 1 THEN '15min' WHEN 2 THEN '30min' WHEN 4 THEN '1hr' END AS horizon, feature, round(avg(abs(y_hat - y)), 6) AS mae, round(sqrt(avg((y_hat - y) ** 2)), 6) AS rmse, round(coalesce(1 - sum((y_hat - y) ** 2) / nullif(var_pop(y) * count(*), 0), 0), 6) AS r2 FROM {_F} WHERE step IN (1, 2, 4) GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(evaluate.horizon_metrics(_forecasts(spark, sf_dir)).select("horizon", "feature", "mae", "rmse", "r2"), "mae", "rmse", "r2")


@query("residual_moments", f"""WITH r AS (SELECT feature, y_hat - y AS r, avg(y_hat - y) OVER (PARTITION BY feature) AS m FROM {_F})
SELECT feature, count(*) AS n, round(avg(r), 6) AS mean, round(sqrt(avg((r - m) ** 2)), 6) AS std, round(avg((r - m) ** 3) / pow(avg((r - m) ** 2), 1.5), 5) AS skewness, round(avg((r - m) ** 4) / pow(avg((r - m) ** 2), 2) - 3, 5) AS kurtosis FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(rounded(evaluate.residual_moments(_forecasts(spark, sf_dir), ["feature"]), "mean", "std"), "skewness", "kurtosis", places=5)


def _tails_sql() -> str:
    """(below, above) of |z| = x: a series of 60 terms up to 3, then a continued fraction."""
    series = "exp(-0.5 * x * x) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: exp((2 * k + 1) * ln(greatest(x, 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    fraction = "x"
    for k in range(40, 0, -1):
        fraction = f"(x + {k} / {fraction})"
    return f"CASE WHEN x < 3 THEN ln(0.5 - {series}) ELSE -0.5 * x * x - 0.5 * ln(2 * pi()) - ln({fraction}) END AS below, CASE WHEN x < 3 THEN ln(0.5 + {series}) ELSE ln(1 - exp(-0.5 * x * x - 0.5 * ln(2 * pi()) - ln({fraction}))) END AS above"


_AD = f"""WITH r AS (SELECT feature, y_hat - y AS r FROM {_F}), m AS (SELECT feature, count(*)::DOUBLE AS n, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY 1),
z AS (SELECT feature, n, (r - m) / s AS z, abs((r - m) / s) AS x, row_number() OVER (PARTITION BY feature ORDER BY r) AS i FROM r JOIN m USING (feature)), t AS (SELECT *, {_tails_sql()} FROM z),
a AS (SELECT feature, n, -n - sum((2 * i - 1) * CASE WHEN z < 0 THEN below ELSE above END + (2 * (n - i) + 1) * CASE WHEN z < 0 THEN above ELSE below END) / n AS a2, 0.787 / (1 + 4 / n - 25 / (n * n)) AS critical FROM t GROUP BY feature, n)
SELECT feature, n::BIGINT AS n, round(a2, 5) AS a2, round(critical, 9) AS critical, a2 < critical AS normal FROM a"""


@query("anderson_darling", _AD)
def _(spark, sf_dir):
    d = evaluate.anderson_darling(_forecasts(spark, sf_dir).withColumn("r", F.col("y_hat") - F.col("y")), ["feature"])
    return rounded(rounded(d, "a2", places=5), "critical", places=9)


def _poly_sql(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _ratio_sql(pair: tuple[list[float], list[float]], x: str) -> str:
    return f"{_poly_sql(pair[0], x)} / {_poly_sql(pair[1], x)}"


_SW = f"""WITH f AS (SELECT feature, y_hat - y AS r FROM {_F} QUALIFY row_number() OVER (PARTITION BY feature ORDER BY event_id) <= 5000),
i AS (SELECT feature, r, row_number() OVER (PARTITION BY feature ORDER BY r) AS i, (count(*) OVER (PARTITION BY feature))::DOUBLE AS n FROM f),
u AS (SELECT *, (i - 0.375) / (n + 0.25) - 0.5 AS q FROM i),
c AS (SELECT *, 0.180625 - q * q AS c, sqrt(-ln(0.5 - abs(q))) - 1.6 AS t FROM u),
m AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql(evaluate.QUANTILE_CENTRE, "c")} ELSE sign(q) * {_ratio_sql(evaluate.QUANTILE_TAIL, "t")} END AS m FROM c),
s AS (SELECT feature, n, sum(m * m) AS ssq, sum(m * r) AS mr, var_pop(r) * n AS spread, max(m) AS mz, min(m) AS m1, max(r) AS rz, min(r) AS r1, max(CASE WHEN i = n - 1 THEN m END) AS my, max(CASE WHEN i = 2 THEN m END) AS m2,
 max(CASE WHEN i = n - 1 THEN r END) AS ry, max(CASE WHEN i = 2 THEN r END) AS r2, 1 / sqrt(n) AS u FROM m GROUP BY feature, n),
a AS (SELECT *, mz / sqrt(ssq) + {_poly_sql(evaluate.ROYSTON_LAST, "u")} AS l1, my / sqrt(ssq) + {_poly_sql(evaluate.ROYSTON_SECOND, "u")} AS l2 FROM s),
w AS (SELECT feature, n, pow(l1 * (rz - r1) + l2 * (ry - r2) + (mr - mz * rz - m1 * r1 - my * ry - m2 * r2) / sqrt((ssq - 2 * mz * mz - 2 * my * my) / (1 - 2 * l1 * l1 - 2 * l2 * l2)), 2) / spread AS w FROM a),
z AS (SELECT *, (ln(1 - w) - {_poly_sql(evaluate.ROYSTON_LARGE[0], "ln(n)")}) / exp({_poly_sql(evaluate.ROYSTON_LARGE[1], "ln(n)")}) AS z FROM w),
t AS (SELECT *, {_tails_sql()} FROM (SELECT *, abs(z) AS x FROM z)),
p AS (SELECT *, exp(CASE WHEN z > 0 THEN below ELSE above END) AS p FROM t)
SELECT feature, n::BIGINT AS n, round(w, 6) AS w, round(p, 6) AS p, p > 0.05 AS normal FROM p"""


@query("shapiro_wilk", _SW)
def _(spark, sf_dir):
    d = evaluate.shapiro_wilk(_forecasts(spark, sf_dir).withColumn("r", F.col("y_hat") - F.col("y")), ["feature"], ["event_id"])
    return rounded(d, "w", "p")


_T = f"""q AS (SELECT feature, quantile_cont(y, 0.33) AS a, quantile_cont(y, 0.66) AS b FROM {_F} GROUP BY 1),
t AS (SELECT f.feature, CASE WHEN y <= a THEN 'low' WHEN y <= b THEN 'medium' ELSE 'high' END AS t, CASE WHEN y_hat <= a THEN 'low' WHEN y_hat <= b THEN 'medium' ELSE 'high' END AS p FROM {_F} f JOIN q USING (feature))"""


@query("confusion", f"WITH {_T} SELECT feature, t AS true_class, count(*) FILTER (p = 'low') AS low, count(*) FILTER (p = 'medium') AS medium, count(*) FILTER (p = 'high') AS high FROM t GROUP BY 1, 2")
def _(spark, sf_dir):
    return evaluate.confusion(evaluate.tercile_classes(_forecasts(spark, sf_dir), ["feature"]), ["feature"])


@query("class_report", f"""WITH {_T}, c AS (SELECT feature, t AS class, count(*) AS support, count(*) FILTER (t = p) AS hit FROM t GROUP BY 1, 2), s AS (SELECT feature, p AS class, count(*) AS said FROM t GROUP BY 1, 2)
SELECT feature, class, round(hit / said, 6) AS precision, round(hit / support, 6) AS recall, round(2.0 * hit / (said + support), 6) AS f1, support FROM c JOIN s USING (feature, class)
UNION ALL SELECT feature, 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c GROUP BY 1
UNION ALL SELECT feature, 'macro avg', round(avg(hit / said), 6), round(avg(hit / support), 6), round(avg(2.0 * hit / (said + support)), 6), CAST(sum(support) AS BIGINT) FROM c JOIN s USING (feature, class) GROUP BY 1
UNION ALL SELECT feature, 'weighted avg', round(sum(hit / said * support) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(2.0 * hit / (said + support) * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c JOIN s USING (feature, class) GROUP BY 1""")
def _(spark, sf_dir):
    d = evaluate.class_report(evaluate.tercile_classes(_forecasts(spark, sf_dir), ["feature"]), ["feature"])
    return rounded(d, "precision", "recall", "f1")


@query("within_tolerance", f"SELECT feature, count(*) AS n, round(100.0 * count(*) FILTER (abs(y_hat - y) <= 0.05 * abs(y)) / count(*), 6) AS pct_within FROM {_F} GROUP BY 1")
def _(spark, sf_dir):
    return rounded(evaluate.within_tolerance(_forecasts(spark, sf_dir), ["feature"]), "pct_within")


# forecasts


_TARGETS_SQL = f"SELECT event_id, CAST(s AS INT) AS step, target FROM (" + " UNION ALL ".join(f"SELECT event_id, {s} AS s, lead(value, {s}) {_W}) AS target FROM events" for s in (1, 2, 4, 8, 16, 32)) + ") WHERE target IS NOT NULL"


def _targets(bucket: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
        return forecast.multi_horizon_targets(d, "user_id", ON, "value", [1, 2, 4, 8, 16, 32], bucket).select("event_id", "step", "target")

    return run


query("multi_horizon_targets", _TARGETS_SQL)(_targets(None))
query("multi_horizon_targets_bucketed", _TARGETS_SQL)(_targets("week"))


def _last_value(x):
    return x[:, -1, :1]



@query("recursive_forecast", "SELECT user_id, h.horizon, CAST(h.n AS BIGINT) AS n, v AS first, v AS last FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1 HAVING count(*) >= 36), (VALUES ('15min', 1), ('1hr', 4), ('24hr', 96)) h(horizon, n)")
def _(spark, sf_dir):
    """Persistence as the model: every step repeats the last value, so SQL can tell the result."""
    roll = forecast.recursive_forecast(events(spark, sf_dir), "user_id", ON, ["value"], 1, _last_value, 96).where("error is null")
    d = forecast.by_horizon(roll, {"15min": 1, "1hr": 4, "24hr": 96})
    return d.groupBy("user_id", "horizon").agg(F.count("*").alias("n"), F.min_by("y_hat", "step").alias("first"), F.max_by("y_hat", "step").alias("last"))


_HORIZONS = {"15min": 1, "1hr": 4, "2hr": 8}
_LAST = "(SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1 HAVING count(*) >= 36), (VALUES ('15min', 1), ('1hr', 4), ('2hr', 8)) h(horizon, n)"


def _next_half(x):
    return x[:, -1, :1] / 2


def _halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose every step is half the step before, so that SQL can tell what each step gives."""
    return forecast.recursive_forecast(events(spark, sf_dir), "user_id", ON, ["value"], 1, _next_half, 8).where("error is null")


@query("horizon_ends", f"SELECT user_id, h.horizon, 'value' AS feature, round(v / pow(2, h.n), 6) AS y_hat FROM {_LAST}")
def _(spark, sf_dir):
    return rounded(forecast.horizon_ends(_halving(spark, sf_dir), "user_id", _HORIZONS), "y_hat")


@query("forecast_ranges", f"SELECT user_id, h.horizon, 'value' AS feature, CAST(h.n AS BIGINT) AS n, round(least(v / 2, v / pow(2, h.n)), 6) AS min, round(greatest(v / 2, v / pow(2, h.n)), 6) AS max FROM {_LAST}")
def _(spark, sf_dir):
    return rounded(forecast.forecast_ranges(_halving(spark, sf_dir), "user_id", _HORIZONS), "min", "max")


@query("enough_history", "SELECT user_id, count(*) AS n, CASE WHEN count(*) < 60 THEN 'fewer than 60 rows of history' END AS error, round(least(0.95, 0.7 + count(*) / 100.0 * 0.25), 6) AS score, CASE WHEN least(0.95, 0.7 + count(*) / 100.0 * 0.25) > 0.85 THEN 'High' WHEN least(0.95, 0.7 + count(*) / 100.0 * 0.25) > 0.7 THEN 'Medium' ELSE 'Low' END AS level FROM events GROUP BY 1")
def _(spark, sf_dir):
    score, level = forecast.confidence(F.col("n"))
    return forecast.enough_history(events(spark, sf_dir), "user_id", 60).select("user_id", "n", "error", F.round(score, 6).alias("score"), level.alias("level"))


@query("regression_baseline")
def _(spark, sf_dir):
    d = forecast.lag_features(events(spark, sf_dir), "user_id", ON, "value", 3)
    parts = prep.split_last_day(d, "ts")
    out = forecast.regression_baseline(parts.where("split = 'train'"), parts.where("split = 'test'"), ["lag_1", "lag_2", "lag_3"], "value")
    return out.select("event_id", "value", "y_hat")


_LAGGED = f"(SELECT event_id, user_id, value AS y, lag(value, 1) {_W}) AS x0, lag(value, 2) {_W}) AS x1, lag(value, 3) {_W}) AS x2 FROM events QUALIFY x2 IS NOT NULL)"
#: The normal equations of three features, solved by Cholesky factors.
_RIDGE_SQL = f"""d AS (SELECT * FROM {_LAGGED} WHERE event_id % 5 <> 0),
g AS (SELECT user_id, count(*) AS n, avg(y) AS my, {", ".join(f"avg(x{i}) AS m{i}, covar_pop(x{i}, y) * count(*) AS b{i}" for i in range(3))}, {", ".join(f"covar_pop(x{i}, x{j}) * count(*) AS s{i}{j}" for i in range(3) for j in range(i + 1))} FROM d GROUP BY 1),
c0 AS (SELECT *, sqrt(s00 + 1) AS l00 FROM g),
c1 AS (SELECT *, s10 / l00 AS l10, s20 / l00 AS l20, b0 / l00 AS z0 FROM c0),
c2 AS (SELECT *, sqrt(s11 + 1 - l10 * l10) AS l11 FROM c1),
c3 AS (SELECT *, (s21 - l20 * l10) / l11 AS l21, (b1 - l10 * z0) / l11 AS z1 FROM c2),
c4 AS (SELECT *, sqrt(s22 + 1 - l20 * l20 - l21 * l21) AS l22 FROM c3),
c5 AS (SELECT *, (b2 - l20 * z0 - l21 * z1) / l22 / l22 AS k2 FROM c4),
c6 AS (SELECT *, (z1 - l21 * k2) / l11 AS k1 FROM c5),
m AS (SELECT *, my - m0 * k0 - m1 * k1 - m2 * k2 AS intercept FROM (SELECT *, (z0 - l10 * k1 - l20 * k2) / l00 AS k0 FROM c6))"""
_LAG_NAMES = ["lag_1", "lag_2", "lag_3"]


def _ridge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = forecast.lag_features(events(spark, sf_dir), "user_id", ON, "value", 3)
    return regression.ridge_by_key(d.where("event_id % 5 <> 0"), "user_id", _LAG_NAMES, "value"), d


@query("ridge_by_key", f"WITH {_RIDGE_SQL} SELECT user_id, n, round(intercept, 6) AS intercept, round(k0, 6) AS c1, round(k1, 6) AS c2, round(k2, 6) AS c3 FROM m")
def _(spark, sf_dir):
    d = _ridge(spark, sf_dir)[0]
    return rounded(d.select("user_id", "n", "intercept", *(F.col("coefficients")[i].alias(f"c{i + 1}") for i in range(3))), "intercept", "c1", "c2", "c3")


@query("ridge_forecasts", f"WITH {_RIDGE_SQL} SELECT event_id, user_id, y AS value, round(intercept + k0 * x0 + k1 * x1 + k2 * x2, 6) AS y_hat FROM {_LAGGED} t LEFT JOIN m USING (user_id) WHERE event_id % 5 = 0")
def _(spark, sf_dir):
    """Forecasts of each satellite's own model for the rows that it was not fitted on."""
    models, d = _ridge(spark, sf_dir)
    out = regression.predict_by_key(d.where("event_id % 5 = 0"), models, "user_id", _LAG_NAMES)
    return rounded(out.select("event_id", "user_id", "value", "y_hat"), "y_hat")


@query("features_and_statistics", f"SELECT user_id, count(*) AS n, round(avg(value_ma), 5) AS mean_ma, round(max(value_std), 5) AS max_std, round(avg(value), 6) AS value_mean FROM (SELECT user_id, value, avg(value) {_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS value_ma, coalesce(stddev_samp(value) {_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0) AS value_std FROM events) GROUP BY 1")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling features of each series and their summary by key."""
    d = windows.rolling_stats(events(spark, sf_dir), "user_id", ON, ["value"], 12)
    out = d.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value_ma").alias("mean_ma"), F.max("value_std").alias("max_std"), F.avg("value").alias("value_mean"))
    return rounded(rounded(out, "mean_ma", "max_std", places=5), "value_mean")

