"""Large text products read by splits: lines that belong to a line before them find it over the ends of splits.

Whole-file rows end at two gigabytes; here a file is read like any text, in splits of any size.  Spark tells in which
split a line stands, and lines of a split keep their order.  What a line needs from before (its epoch, its record) is
found in two levels: within the split, and, for lines ahead of a split's first head, from a table with one row for
each split, which hands on the last head of the splits before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ephemera.sources.text import END_OF_HEADER


def numbered_lines(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(unit, at, value): unit is (file, first byte of the split), ``at`` rises within it."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    unit = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return reader.text(path).select(unit.alias("unit"), F.monotonically_increasing_id().alias("at"), "value")


def with_heads(lines: DataFrame, is_head: Column) -> DataFrame:
    """(unit, place, value, head, record): each line's last head line at or before it in the file, and that head's (split, number).

    Lines before the first head of a file are left out; ``place`` numbers a split's lines.
    """
    inside = Window.partitionBy("unit").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    d = lines.select("unit", "at", "value", F.when(is_head, F.col("value")).alias("h"))
    # one aggregation: the number of heads of each split and the last of them
    ends = d.groupBy("unit").agg(F.count("h").alias("n"), F.max_by("h", F.when(F.col("h").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("unit.file").orderBy("unit.block").rowsBetween(Window.unboundedPreceding, -1)
    handed = F.when(F.col("n") > 0, F.struct(F.col("last").alias("head"), F.col("unit.block").alias("block"), F.col("n").alias("number")))
    ends = ends.select("unit", F.last(handed, ignorenulls=True).over(before).alias("from"))
    d = d.withColumns({"place": F.row_number().over(inside), "number": F.count("h").over(so_far), "head": F.last("h", ignorenulls=True).over(so_far)})
    d = d.join(ends, "unit")
    own = F.struct(F.col("head"), F.col("unit.block").alias("block"), F.col("number"))
    d = d.select("unit", "place", "value", F.when(F.col("number") > 0, own).otherwise(F.col("from")).alias("of")).where("of is not null")
    return d.select("unit", "place", "value", "of.head", F.struct("of.block", "of.number").alias("record"))


def behind_header(lines: DataFrame) -> DataFrame:
    """Lines behind the first line of a file that ends its header; all of a file without one."""
    ends = F.col("value").contains(END_OF_HEADER)
    so_far = Window.partitionBy("unit").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    per = lines.groupBy("unit").agg(F.count_if(ends).alias("n"))
    file = Window.partitionBy("unit.file")
    before = file.orderBy("unit.block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(file).alias("all"))
    d = lines.withColumn("seen", F.coalesce(F.count_if(ends).over(so_far), F.lit(0))).join(per, "unit")
    return d.where("all = 0 or before + seen > 0").select("unit", "at", "value")


def records(lines: DataFrame, head: str) -> DataFrame:
    """(file, record, lines): the lines from each one that fits ``head`` up to the next, in order."""
    d = with_heads(lines, F.col("value").rlike(head))
    line = F.struct(F.col("unit.block").alias("block"), "place", "value")
    d = d.groupBy(F.col("unit.file").alias("file"), "record").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return d.select("file", "record", F.transform("l", lambda x: x["value"]).alias("lines"))
