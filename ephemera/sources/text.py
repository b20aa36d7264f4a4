"""Shared steps of the text readers: one row per file, headers and blocks by built-in string functions.

A product file is at most tens of megabytes and a job reads many, so a file is the unit of parallelism: whole files are
split into their blocks (epochs, records) in one expression, without a window or a shuffle.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END_OF_HEADER = "END OF HEADER"


def read_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, value): whole files below ``path`` whose name fits ``pattern``."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def find_files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """(file, size) of the products below ``path``, by name; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size")).orderBy("file")


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, value): the lines below ``path``; large files split."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def scratch(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of this machine only if none is named and all tasks run here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-scratch-")


def after_header(value: Column) -> Column:
    """The text behind the line that ends the header; all of it if there is none."""
    at = F.instr(value, END_OF_HEADER)
    rest = F.substring(value, at, F.char_length(value))
    return F.when(at > 0, F.substring(rest, F.instr(rest, "\n") + 1, F.char_length(rest))).otherwise(value)


def header_lines(value: Column) -> Column:
    """The lines up to the end of the header."""
    at = F.instr(value, END_OF_HEADER)
    return F.split(F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value), "\n")


def labelled(lines: Column, label: str) -> Column:
    return F.filter(lines, lambda x: x.contains(label))


def field(line: Column, start: int, end: int) -> Column:
    """Characters ``start`` up to ``end`` (from 0), trimmed."""
    return F.trim(F.substring(line, start + 1, end - start))


def parts(line: Column) -> Column:
    return F.split(F.trim(line), "\\s+")
