"""Broadcast ephemerides from RINEX 3 navigation text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.functions.scalars import epoch_timestamp, fortran_double
from ephemera.sources.splits import behind_header, numbered_lines, records
from ephemera.sources.text import END_OF_HEADER, after_header, field, read_files

#: Fixed order of the numbers on the seven orbit lines of a GPS record ("-": not used).
ORBIT_FIELDS = [
    "iode", "crs", "delta_n", "m0", "cuc", "e", "cus", "sqrt_a", "toe", "cic", "omega0", "cis", "i0", "crc", "omega", "omega_dot",
    "idot", "-", "gps_week", "-", "-", "health", "tgd", "iodc", "-", "fit_interval",
]
#: Columns of the plain table, and those that a row of the wide table must have.
NAV_COLUMNS = [
    "satellite", "timestamp", "epoch", "a", "e", "i0", "omega0", "omega", "m0", "delta_n", "omega_dot", "idot", "cuc", "cus", "crc", "crs",
    "cic", "cis", "toe", "af0", "af1", "af2", "iode", "gps_week", "tgd", "iodc",
]
RECORD = "^[A-Z][0-9 ][0-9] "  # how a record's first line begins
NUMBER = "(?:(?:[ +-][0-9]| [ +-])\\.[0-9]{12}[DEe][+-][0-9]{2})"  # a number of 19 characters as the format has it
SOURCE = ["file", "record"]  # where a record was read: its file, and its place (split, number) there
REQUIRED = ["toe", "m0", "delta_n", "e", "a", "omega0", "i0", "omega", "omega_dot", "idot"]


def parse_orbit_line(line: Column) -> Column:
    """The numbers of one orbit line: four fields of 19 characters from column 4, else whatever looks like a number."""
    fixed = F.filter(F.transform(F.array(*(F.substring(line, 5 + 19 * k, 19) for k in range(4))), lambda x: F.trim(x)), lambda x: x != "")
    found = F.regexp_extract_all(line, F.lit("[+-]?[0-9]*\\.?[0-9]+(?:[DdEe][+-]?[0-9]+)?"), F.lit(0))
    number = "^[+-]?[0-9]*\\.?[0-9]*([DdEe][+-]?[0-9]+)?$"
    good = (F.size(fixed) > 0) & F.forall(fixed, lambda x: x.rlike(number))
    return F.transform(F.when(good, fixed).otherwise(found), fortran_double)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _records(files: DataFrame, constellations: tuple[str, ...], source: bool) -> DataFrame:
    """One row per record: its lines, satellite and time.

    A file is split at its line ends only, which needs no regular expression; lines that begin a record are told apart one by one.
    """
    named = ["file"] if source else []
    value = F.col("value")
    at = F.instr(value, END_OF_HEADER)
    behind = F.split(F.when(at > 0, F.substring(value, at, F.lit(2**31 - 1))).otherwise(value), "\n")
    filled = F.filter(behind, lambda x, k: (F.trim(x) != "") & ((k > 0) | (at == 0)))  # the first line ends the header
    begins = lambda x, k: (k == 0) | ((x >= "A") & (x < "[") & x.rlike(RECORD))
    starts = lambda lines: F.array_compact(F.transform(lines, lambda x, k: F.when(begins(x, k), k)))
    one = lambda lines, starts, k, n: F.struct(n.cast("long").alias("number"), F.slice(lines, k + 1, F.coalesce(F.get(starts, n + 1), F.size(lines)) - k).alias("lines"))
    found = _once(filled, lambda lines: _once(starts(lines), lambda starts: F.transform(starts, lambda k, n: one(lines, starts, k, n))))
    d = files.select(*named, F.explode(found).alias("r"))
    return _heads(d.select(*named, F.struct(F.lit(0).cast("long").alias("block"), F.col("r.number")).alias("record"), "r.lines"), constellations, source)


def _heads(records: DataFrame, constellations: tuple[str, ...], source: bool) -> DataFrame:
    """Records whose first line has a satellite and a time.

    The numbers of a record whose fields all are in their places are cut where they are needed (see ``_number``); of any
    other, ``v`` holds them all.  What an array's only element holds is computed once: no filter moves ahead of ``explode``.
    """
    named = SOURCE if source else []
    first = F.get("lines", F.lit(0))
    d = records.select(*named, "lines").where(F.substring(first, 1, 1).isin(*constellations) & (F.size("lines") >= 8))
    when = epoch_timestamp(field(first, 4, 8), field(first, 9, 11), field(first, 12, 14), field(first, 15, 17), field(first, 18, 20), F.floor(field(first, 21, 23).try_cast("double")).cast("string"))
    regular = F.forall(F.slice("lines", 2, 6), lambda x: x.rlike(f"^.{{4}}{NUMBER}{{4}}")) & F.col("lines")[7].rlike(f"^.{{4}}{NUMBER}{{2}}(?:{NUMBER}{{2}}|{NUMBER}? *\\z)")
    others = F.flatten(F.transform(F.slice("lines", 2, 7), parse_orbit_line))
    d = d.select(*named, "lines", F.explode(F.array(F.struct(when.alias("timestamp"), F.when(~regular, others).alias("v")))).alias("h"))
    d = d.select(*named, F.trim(F.substring(first, 1, 3)).alias("satellite"), first.alias("first"), "lines", "h.*")
    return d.dropna(subset=["timestamp"])


def _number(k: int) -> Column:
    """The k-th number of a record's orbit lines."""
    cut = F.substring(F.get("lines", F.lit(1 + k // 4)), 5 + 19 * (k % 4), 19)
    return F.when(F.col("v").isNull(), F.replace(cut, F.lit("D"), F.lit("E")).try_cast("double")).otherwise(F.get("v", F.lit(k)))


def parse_nav(files: DataFrame, wide: bool = False, constellations: tuple[str, ...] = ("G",), source: bool = False) -> DataFrame:
    """Ephemerides of (file, value) rows; with ``wide`` also toc, week, health and fit_interval, and no row without a required element.

    A record is a header line and seven orbit lines with 26 numbers at least; shorter ones are left out.  With
    ``source`` also ``file`` and ``record``, a place that rises within the file.
    """
    return _elements(_records(files, constellations, source), wide, source)


def parse_nav_lines(lines: DataFrame, wide: bool = False, constellations: tuple[str, ...] = ("G",), source: bool = False) -> DataFrame:
    """``parse_nav`` of ``splits.numbered_lines``: files of any size, read in splits of any size."""
    found = records(behind_header(lines), RECORD)
    return _elements(_heads(found.withColumn("lines", F.filter("lines", lambda x: F.trim(x) != "")), constellations, source), wide, source)


def read_large_nav(spark: SparkSession, path: str | list[str], pattern: str = "*.rnx", wide: bool = False, constellations: tuple[str, ...] = ("G",), source: bool = False) -> DataFrame:
    """``read_nav`` for files of any size."""
    return parse_nav_lines(numbered_lines(spark, path, pattern), wide, constellations, source)


def _elements(d: DataFrame, wide: bool, source: bool) -> DataFrame:
    columns = [*NAV_COLUMNS, *(SOURCE if source else [])]
    d = d.where(F.col("v").isNull() | (F.size("v") >= 26)).select(
        *(SOURCE if source else []), "satellite", "timestamp", F.col("timestamp").alias("epoch"), *(fortran_double(field(F.col("first"), 23 + 19 * k, 42 + 19 * k)).alias(f"af{k}") for k in range(3)),
        *(_number(k).alias(n) for k, n in enumerate(ORBIT_FIELDS) if n != "-"),
    )
    d = d.withColumn("a", F.col("sqrt_a") * F.col("sqrt_a"))
    if not wide:
        return d.select(*columns)
    from ephemera.functions.scalars import WEEK_S, gps_seconds

    d = d.withColumns({"toc": F.pmod(gps_seconds(F.col("timestamp")), F.lit(WEEK_S)), "week": F.col("gps_week")})
    return d.where("a > 0").dropna(subset=REQUIRED).select(*columns, "toc", "week", "health", "fit_interval")


def parse_nav_clock(files: DataFrame, constellations: tuple[str, ...] = ("G", "R", "E", "C", "J")) -> DataFrame:
    """(timestamp, satellite, af0, af1, af2) of every record, whatever its orbit lines hold."""
    return _records_any(files, constellations).select("timestamp", "satellite", "af0", "af1", "af2")


def _records_any(files: DataFrame, constellations: tuple[str, ...]) -> DataFrame:
    lines = files.select(F.explode(F.split(after_header(F.col("value")), "\n")).alias("line"))
    lines = lines.where(F.substring("line", 1, 1).isin(*constellations) & F.col("line").rlike("^[A-Z][0-9 ][0-9] "))
    c = F.col("line")
    when = epoch_timestamp(field(c, 4, 8), field(c, 9, 11), field(c, 12, 14), field(c, 15, 17), field(c, 18, 20), F.floor(field(c, 21, 23).try_cast("double")).cast("string"))
    d = lines.select(F.trim(F.substring(c, 1, 3)).alias("satellite"), when.alias("timestamp"), *(fortran_double(field(c, 23 + 19 * k, 42 + 19 * k)).alias(f"af{k}") for k in range(3)))
    return d.dropna(subset=["timestamp"])


def read_nav(spark: SparkSession, path: str | list[str], pattern: str = "*.rnx", wide: bool = False, constellations: tuple[str, ...] = ("G",), source: bool = False) -> DataFrame:
    return parse_nav(read_files(spark, path, pattern), wide, constellations, source)


def read_nav_clock(spark: SparkSession, path: str | list[str], pattern: str = "*.rnx", constellations: tuple[str, ...] = ("G", "R", "E", "C", "J")) -> DataFrame:
    return parse_nav_clock(read_files(spark, path, pattern), constellations)
