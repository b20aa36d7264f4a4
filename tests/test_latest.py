"""The latest rows kept by a stream against the last rows of the whole table."""

import random
import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pytest

from ephemera.operators import windows
from ephemera.streaming import latest

SCHEMA = "id string, ts timestamp_ntz, n int, value double"


def rows_of(seed, n=600):
    rng = random.Random(seed)
    start = datetime(2025, 7, 6)
    # one key holds half of the rows; some values are null
    return [(rng.choice(["hot", "hot", "G01", "G02"]), start + timedelta(minutes=rng.randrange(5000)), i, None if i % 7 == 0 else rng.random()) for i in range(n)] + [("G09", start, n, 0.5), (None, start, n + 1, 1.0), ("G01", None, n + 2, 1.0)]


def stream_of(spark, rows, batches):
    path = tempfile.mkdtemp(prefix="spark-")
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(2).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(path)


@pytest.mark.parametrize("seed,batches,k", [(1, 1, 3), (2, 4, 5), (3, 3, 1)])
def test_any_order_of_batches_equals_tail(spark, seed, batches, k):
    latest.state_store(spark)
    rows = rows_of(seed)
    random.Random(seed).shuffle(rows)
    out, check = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    query = latest.write_latest(latest.latest_rows(stream_of(spark, rows, batches), "id", "ts", k, ["n"]), out, check)
    query.awaitTermination()
    got = latest.read_latest(spark, out)
    assert got.columns == ["id", "ts", "n", "value"] and [f.dataType.simpleString() for f in got.schema] == ["string", "timestamp_ntz", "int", "double"]
    want = windows.tail(spark.createDataFrame(rows, SCHEMA).where("id is not null and ts is not null"), "id", ["ts", "n"], k)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_clashing_names_repeated_rows_and_rerun_batches(spark):
    latest.state_store(spark)
    schema = "k string, t timestamp_ntz, kept int, c0 double"
    row = ("a", datetime(2025, 7, 6), 1, 2.0)
    rows = [row, row, row, ("b", datetime(2025, 7, 7), None, None)]
    source, out, check = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{source}/0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    for _ in range(2):  # nothing new the second time
        latest.write_latest(latest.latest_rows(stream, "k", "t", 2, ["kept"]), out, check).awaitTermination()
    got = latest.read_latest(spark, out)
    assert got.columns == ["k", "t", "kept", "c0"] and Counter(map(tuple, got.collect())) == Counter([row, row, rows[3]])
    spark.createDataFrame([("a", datetime(2025, 7, 5), 5, 1.0), ("b", datetime(2025, 7, 8), 7, 1.0)], schema).write.mode("append").parquet(f"{source}/1")
    latest.write_latest(latest.latest_rows(stream, "k", "t", 2, ["kept"]), out, check).awaitTermination()  # state lives on
    assert sorted(r.kept or 0 for r in latest.read_latest(spark, out).collect()) == [0, 1, 1, 7]


def test_idle_keys_give_up_their_state(spark):
    latest.state_store(spark)
    source, out, check = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
    start = datetime(2025, 7, 6)

    def send(*rows):
        spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(f"{source}/{rows[0][2]:03d}")
        latest.write_latest(latest.latest_rows(stream, "id", "ts", 3, ["n"], idle="2 days"), out, check).awaitTermination()
        return {(r.id, r.n) for r in latest.read_latest(spark, out).collect()}

    assert send(("a", start, 0, 1.0), ("b", start, 1, 1.0)) == {("a", 0), ("b", 1)}
    # the watermark passes "b" and its state is given up; its rows stay in the results until it comes again
    assert ("b", 1) in send(("a", start + timedelta(days=10), 2, 1.0))
    send(("a", start + timedelta(days=20), 3, 1.0))
    got = send(("b", start + timedelta(days=21), 4, 1.0))
    assert ("b", 4) in got and ("b", 1) not in got
