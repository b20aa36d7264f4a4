"""Total orders: a dense rank over a whole table, and files whose concatenation is sorted.

Rows are dealt out by ranges of the order columns (Spark samples the bounds) and sorted within; places in a partition
plus the rows of the partitions before give the rank.  No task sees more than a range, and only one count for each
partition is put in order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ephemera.functions.names import free_name, quoted
from ephemera.sources.text import scratch


def by_ranges(df: DataFrame, on: list[str], parts: int | None = None, salt: str | None = None) -> DataFrame:
    """``df`` in ``parts`` ranges of ``on`` (session's number if none), sorted within; ``salt`` lets rows that tie in all of ``on`` part."""
    order = [*map(quoted, on), *([quoted(salt)] if salt else [])]
    dealt = df.repartitionByRange(*([parts] if parts else []), *order)
    return dealt.sortWithinPartitions(*order)


def global_rank(df: DataFrame, on: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its dense rank from 1 in the order of ``on``; rows that tie in all of ``on`` are ranked anyhow, each with a rank of its own.

    The sorted rows are stored once in the shared folder: ranges are drawn from a sample, and all that follows must
    see the same ranges.  Nulls come first; an empty table gives an empty result.  A group of ties of any size is
    dealt out by the place its rows were read from.
    """
    salt, place = free_name(df, "salt"), free_name(df, "place")
    path = f"{scratch(df.sparkSession)}/ordered-{uuid.uuid4().hex}"
    dealt = by_ranges(df.withColumn(salt, F.monotonically_increasing_id()), on, parts, salt)
    dealt.drop(salt).withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftright(quoted(place), 33)  # the partition stands above the row's place in it
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    counts = counts.select(F.struct("part", before.alias("before")).alias("of"))
    d = rows.select(F.struct(*map(quoted, df.columns)).alias("row"), quoted(place).alias("place")).join(F.broadcast(counts), F.shiftright("place", 33) == F.col("of.part"))
    rank = F.col("of.before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return d.select(*(F.col("row").getField(c).alias(c) for c in df.columns), rank.alias(name))


def write_ordered(df: DataFrame, path: str, on: list[str], fmt: str = "parquet", parts: int | None = None, mode: str = "error") -> None:
    """Files in the order of their names and sorted within, so that one after another they are sorted by ``on``."""
    options = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"} if fmt == "csv" else {}
    by_ranges(df, on, parts).write.mode(mode).format(fmt).options(**options).save(path)


def read_ordered(spark: SparkSession, path: str, name: str = "rank") -> DataFrame:
    """Parquet files with the place of each row, from 1, when they are read one after another by name."""
    rows = spark.read.parquet(path)
    at = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = at.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    counts = counts.select("__file", before.alias("__before"))
    return at.join(F.broadcast(counts), "__file").select(*rows.columns, (F.col("__before") + F.col("__row") + 1).alias(name))
