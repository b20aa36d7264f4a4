"""Error tables and observations, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.operators.order import by_ranges, write_ordered

ERRORS = "satellite_id string, timestamp timestamp_ntz, orbit_error_m double, clock_error_ns double, radial_error_m double, ephemeris_age_hours double"
OBSERVATIONS = "timestamp timestamp_ntz, satellite_id string, orbit_error_m double, clock_error_ns double, radial_error_m double, ephemeris_age_hours double"
_NUMBERS = ["orbit_error_m", "clock_error_ns", "radial_error_m", "ephemeris_age_hours"]


def _no_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _NUMBERS if c in df.columns})


def read_errors_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The published error table; NaN becomes null."""
    return _no_nan(spark.read.schema(ERRORS).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def read_observations_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of request bodies {"data": [...]}, one body per line."""
    bodies = spark.read.schema("data array<struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split(" ") for x in OBSERVATIONS.split(", "))) + ">>").json(path)
    return _no_nan(bodies.select(F.explode("data").alias("d")).select("d.*"))


def parse_observations(df: DataFrame, col: str = "body") -> DataFrame:
    """``read_observations_json`` for bodies in a column."""
    kind = "struct<data: array<struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split(" ") for x in OBSERVATIONS.split(", "))) + ">>>"
    return _no_nan(df.select(F.explode(F.from_json(F.col(col), kind)["data"]).alias("d")).select("d.*"))


def write_errors(df: DataFrame, path: str, fmt: str = "parquet", sort: list[str] | None = None, mode: str = "error") -> None:
    """CSV with a header, or Parquet in folders by date.

    With ``sort`` the table is in a total order: CSV files one after another, and the files of each date.  Ranges of
    the order columns are dealt out to tasks, which sort them (see ``order``).
    """
    if fmt == "csv" and sort:
        write_ordered(df, path, sort, fmt, mode=mode)
    elif fmt == "csv":
        df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)
    else:
        dated = df.withColumn("date", F.to_date("timestamp"))
        # the writer sorts by date unless rows are in that order already
        dated = by_ranges(dated, ["date", *sort]) if sort else dated
        dated.write.mode(mode).partitionBy("date").format(fmt).save(path)


def statistics_json(stats: DataFrame, per_key: DataFrame, by: str, most: int = 100_000) -> DataFrame:
    """One row (value): the statistics as nested JSON, keys as a map; an error if there are more than ``most`` keys."""
    fields = [c for c in per_key.columns if c != by]
    keys = per_key.limit(most + 1).agg(F.count("*").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).cast("string").alias("k"), F.struct(*fields).alias("v"))))).alias("m"))
    keys = keys.select(F.when(F.col("n") <= most, F.col("m")).otherwise(F.raise_error(F.lit("too many keys for one document"))).alias("per_key"))
    names = [c for c in stats.columns if c not in ("start", "end", "duration_hours")]
    d = stats.crossJoin(keys)
    return d.select(F.to_json(F.struct(*names, F.struct("start", "end", "duration_hours").alias("time_span"), "per_key")).alias("value"))


def write_statistics_json(document: DataFrame, path: str, mode: str = "error") -> None:
    document.write.mode(mode).text(path)
