"""Clock records as a stream: lines stand alone, so the batch parser runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.sources.clk import parse_clk_lines


def stream_clocks(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """clock_records of CLK files as they arrive below ``path``."""
    lines = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.CLK").text(path)
    return parse_clk_lines(lines)


def clock_rates(records: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(window, type, id, n, mean_bias): counts and means per event-time window; later records than ``delay`` are dropped.

    Event-time windows need zoned timestamps: GPS time is read as UTC.
    """
    d = records.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    return d.groupBy(F.window("event_time", window), "type", "id").agg(F.count("*").alias("n"), F.avg("clock_bias").alias("mean_bias"))
