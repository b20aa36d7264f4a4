"""Precise clocks from CLK text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.functions.scalars import epoch_timestamp
from ephemera.sources.splits import behind_header, numbered_lines
from ephemera.sources.text import END_OF_HEADER, after_header, field, header_lines, labelled, parts, read_files


def parse_clk_lines(lines: DataFrame) -> DataFrame:
    """clock_records of (value) lines: timestamp, type (AS or AR), id, clock_bias, std_dev, num_values.

    Each line stands alone, so this also runs on a stream of lines.  Missing bias or deviation is 0.0; lines of other
    types, or with a malformed time, are left out.
    """
    d = lines.where(F.col("value").startswith("AS ") | F.col("value").startswith("AR ")).select(parts(F.col("value")).alias("p"))
    num = lambda k: F.coalesce(F.regexp_replace(F.get("p", F.lit(k)), "[Dd]", "E").try_cast("double"), F.lit(0.0))
    d = d.select(
        epoch_timestamp(*(F.get("p", F.lit(k)) for k in range(2, 8))).alias("timestamp"), F.col("p")[0].alias("type"), F.get("p", F.lit(1)).alias("id"),
        num(9).alias("clock_bias"), num(10).alias("std_dev"), F.get("p", F.lit(8)).try_cast("int").alias("num_values"),
    )
    return d.dropna(subset=["timestamp"])


def parse_clk(files: DataFrame) -> DataFrame:
    """``parse_clk_lines`` of what follows each file's header."""
    return parse_clk_lines(files.select(F.explode(F.split(after_header(F.col("value")), "\n")).alias("value")))


def parse_clk_header(files: DataFrame) -> DataFrame:
    """One row per file: version, file_type, program, run_by, date, leap_seconds, num_data_types, data_types, analysis_center, num_stations, reference_frame, stations."""
    d = files.select("file", header_lines(F.col("value")).alias("h"))
    line = lambda label: F.get(labelled(F.col("h"), label), F.lit(0))
    version, program, leap = line("RINEX VERSION"), line("PGM / RUN BY / DATE"), line("LEAP SECONDS")
    types = parts(F.regexp_replace(line("# / TYPES OF DATA"), "#.*$", ""))
    frame = parts(F.regexp_replace(line("# OF SOLN STA / TRF"), "# OF.*$", ""))
    number = lambda s, a, b: F.coalesce(field(s, a, b).try_cast("double"), F.lit(0.0))
    stations = F.transform(
        labelled(F.col("h"), "SOLN STA NAME / NUM"),
        lambda s: F.struct(field(s, 0, 4).alias("name"), field(s, 5, 14).alias("domes"), number(s, 15, 29).alias("x"), number(s, 30, 44).alias("y"), number(s, 45, 59).alias("z")),
    )
    return d.select(
        "file", field(version, 0, 20).alias("version"), field(version, 20, 40).alias("file_type"), field(program, 0, 20).alias("program"), field(program, 20, 40).alias("run_by"),
        field(program, 40, 60).alias("date"), F.get(parts(leap), F.lit(0)).try_cast("int").alias("leap_seconds"), F.get(types, F.lit(0)).try_cast("int").alias("num_data_types"),
        F.slice(types, F.lit(2), F.greatest(F.size(types) - 1, F.lit(0))).alias("data_types"), field(line("ANALYSIS CENTER"), 0, 60).alias("analysis_center"),
        F.get(frame, F.lit(0)).try_cast("int").alias("num_stations"), F.array_join(F.slice(frame, F.lit(2), F.greatest(F.size(frame) - 1, F.lit(0))), " ").alias("reference_frame"), stations.alias("stations"),
    )


def read_clk(spark: SparkSession, path: str | list[str], pattern: str = "*.CLK") -> DataFrame:
    """Clock records of files of any size: lines stand alone, so files are read by splits, and only the end of each header is looked for."""
    lines = numbered_lines(spark, path, pattern)
    used = lines.where(F.col("value").startswith("AS ") | F.col("value").startswith("AR ") | F.col("value").contains(END_OF_HEADER))
    return parse_clk_lines(behind_header(used).select("value"))


def read_clk_header(spark: SparkSession, path: str | list[str], pattern: str = "*.CLK") -> DataFrame:
    return parse_clk_header(read_files(spark, path, pattern))
