"""Precise orbits and clocks from SP3 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.functions.scalars import epoch_timestamp
from ephemera.operators.filters import drop_bad_clock
from ephemera.sources.splits import numbered_lines, with_heads
from ephemera.sources.text import parts, read_files


def _from(line: str | Column, at: int) -> Column:
    """A line from the character ``at`` (from 1) to its end."""
    c = F.col(line) if isinstance(line, str) else line
    return F.substring(c, F.lit(at), F.char_length(c))


def parse_sp3(files: DataFrame, keep_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(orbit, clock) of (file, value) rows: metres and seconds per satellite and epoch, with ``keep_file`` also the file.

    An epoch line starts a block; position lines of the block take its time.  A line with a missing or malformed
    coordinate or clock is left out of both tables, a clock with the bad-clock value out of the second.
    """
    file = ["file"] if keep_file else []
    blocks = files.select(*file, F.split("value", "(?m)^\\*").alias("epochs")).select(*file, F.explode(F.slice(F.col("epochs"), F.lit(2), F.size("epochs"))).alias("block"))
    lines = blocks.select(*file, F.split("block", "\n").alias("lines"))
    return _tables(lines.select(*file, parts(F.col("lines")[0]).alias("t"), F.explode(F.filter("lines", lambda x: x.startswith("P"))).alias("line")), file)


def parse_sp3_lines(lines: DataFrame, keep_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """``parse_sp3`` of ``splits.numbered_lines``: files of any size, read in splits of any size."""
    used = lines.where(F.col("value").startswith("*") | F.col("value").startswith("P"))
    found = with_heads(used, F.col("value").startswith("*")).where(F.col("value").startswith("P"))
    file = ["file"] if keep_file else []
    return _tables(found.select(*([F.col("unit.file").alias("file")] if keep_file else []), parts(_from("head", 2)).alias("t"), F.col("value").alias("line")), file)


def _tables(head: DataFrame, file: list[str]) -> tuple[DataFrame, DataFrame]:
    """Orbit and clock rows of position lines with the parts of their epoch."""
    p = parts(_from("line", 5))
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    rows = head.select(
        *file,
        epoch_timestamp(*(F.get("t", F.lit(k)) for k in range(6))).alias("timestamp"), F.trim(F.substring("line", 2, 3)).alias("satellite"),
        (num(0) * 1000).alias("x"), (num(1) * 1000).alias("y"), (num(2) * 1000).alias("z"), (num(3) * 1e-6).alias("clock_bias"),
    ).dropna()
    return rows.drop("clock_bias"), drop_bad_clock(rows.select(*file, "timestamp", "satellite", "clock_bias"))


def parse_sp3_header(files: DataFrame) -> DataFrame:
    """One row per file: version, pos_vel_flag, start, num_epochs, gps_week, seconds_of_week, epoch_interval, satellites."""
    lines = F.split(F.split("value", "(?m)^\\*")[0], "\n")
    d = files.select("file", lines.alias("lines"))
    one = lambda p: F.get(F.filter("lines", lambda x: x.rlike(p)), F.lit(0))
    d = d.select("file", one("^#[a-z]").alias("a"), one("^##").alias("b"), F.filter("lines", lambda x: x.rlike("^\\+ ")).alias("s"))
    a = F.split(F.trim(_from("a", 4)), "\\s+")
    b = F.split(F.trim(_from("b", 3)), "\\s+")
    # ids stand in groups of three characters behind the count
    ids = F.flatten(F.transform("s", lambda x: F.regexp_extract_all(_from(x, 10), F.lit("[A-Z ][0-9 ][0-9]"), F.lit(0))))
    ids = F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.rlike("^[A-Z]"))
    return d.select(
        "file", F.substring("a", 1, 2).alias("version"), F.substring("a", 3, 1).alias("pos_vel_flag"), epoch_timestamp(*(F.get(a, F.lit(k)) for k in range(6))).alias("start"),
        F.get(a, F.lit(6)).try_cast("int").alias("num_epochs"), F.get(b, F.lit(0)).try_cast("int").alias("gps_week"), F.get(b, F.lit(1)).try_cast("double").alias("seconds_of_week"),
        F.get(b, F.lit(2)).try_cast("double").alias("epoch_interval"), ids.alias("satellites"),
    )


def read_sp3(spark: SparkSession, path: str | list[str], pattern: str = "*.SP3") -> tuple[DataFrame, DataFrame]:
    return parse_sp3(read_files(spark, path, pattern))


def read_large_sp3(spark: SparkSession, path: str | list[str], pattern: str = "*.SP3") -> tuple[DataFrame, DataFrame]:
    """``read_sp3`` for files of any size."""
    return parse_sp3_lines(numbered_lines(spark, path, pattern))


def read_sp3_header(spark: SparkSession, path: str | list[str], pattern: str = "*.SP3") -> DataFrame:
    return parse_sp3_header(read_files(spark, path, pattern))
