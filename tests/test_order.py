"""Total orders: ranks, ties, hot values, files one after another."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from ephemera.operators import prep
from ephemera.operators.order import by_ranges, global_rank, read_ordered, write_ordered
from ephemera.sources.tables import write_errors


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    out = [(r.choice([None, "a", "b", "c.d"]), 7 if k % 3 else r.randrange(500), k, f"x{k % 9}") for k in range(3000)]
    return spark.createDataFrame(out, "k string, v int, id int, place string").repartition(5).cache()


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_rank(rows, parts):
    got = global_rank(rows, ["v", "k", "id"], "salt", parts)
    assert got.columns == [*rows.columns, "salt"]
    key = lambda r: (r.v, r.k is not None, r.k or "", r.id)
    want = {r.id: n for n, r in enumerate(sorted(rows.collect(), key=key), 1)}
    assert {r.id: r.salt for r in got.collect()} == want


def test_ties_get_ranks_of_their_own_and_are_dealt_out(rows):
    tied = rows.withColumn("v", F.lit(1))
    assert sorted(r.rank for r in global_rank(tied, ["v"], "rank", 8).collect()) == list(range(1, 3001))
    dealt = by_ranges(tied.withColumn("salt", F.monotonically_increasing_id()), ["v"], 8, "salt")
    assert dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 1500


def test_empty(rows):
    assert global_rank(rows.limit(0), ["v"]).count() == 0


def test_files_one_after_another(spark, rows, tmp_path):
    path = str(tmp_path / "o")
    write_ordered(rows, path, ["v", "id"], parts=6)
    assert len(glob.glob(f"{path}/part-*.parquet")) > 3
    got = [(r.v, r.id) for r in read_ordered(spark, path).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 3000


def test_error_tables_are_in_order(spark, tmp_path):
    r = random.Random(1)
    out = [(f"G{r.randrange(1, 33):02d}", f"2025-07-{r.randrange(6, 10):02d} {r.randrange(24):02d}:00:00", float(k)) for k in range(800)]
    d = spark.createDataFrame(out, "satellite_id string, t string, orbit_error_m double").select("satellite_id", F.to_timestamp_ntz("t").alias("timestamp"), "orbit_error_m").repartition(4)
    write_errors(d, str(tmp_path / "csv"), "csv", ["timestamp", "satellite_id"])
    lines = [line for f in sorted(glob.glob(f"{tmp_path}/csv/part-*.csv")) for line in open(f).read().splitlines()[1:]]
    keys = [(x.split(",")[1], x.split(",")[0]) for x in lines]
    assert keys == sorted(keys) and len(keys) == 800
    write_errors(d, str(tmp_path / "pq"), sort=["timestamp", "satellite_id"])
    for day in glob.glob(f"{tmp_path}/pq/date=*"):
        got = [(x.timestamp, x.satellite_id) for x in read_ordered(spark, day).orderBy("rank").collect()]
        assert got == sorted(got) and got


def test_shuffles_do_not_depend_on_partitioning(spark, rows):
    a, b = (prep.shuffled(d, ["id"], 3) for d in (rows, rows.repartition(11, "v")))
    got = {r[2]: r[-1] for r in a.collect()}
    assert got == {r[2]: r[-1] for r in b.collect()} and sorted(got.values()) == list(range(1, 3001))
    other = {r[2]: r[-1] for r in prep.shuffled(rows, ["id"], 4).collect()}
    assert sum(got[k] == other[k] for k in got) < 30 and [got[k] for k in range(50)] != sorted(got[k] for k in range(50))
