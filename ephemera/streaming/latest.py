"""The latest rows of each key, kept up by a stream.

State is held by key and bounded: ``k`` rows each, whatever has come.  Tasks thin out their own rows before the
exchange, so a hot key sends at most ``k`` rows for each task and flush, and rows that come late or in any order of
batches take their place as if they had come in time: what is kept equals ``windows.tail`` of all rows.  State needs
the RocksDB store (``state_store``); checkpoints and the table of results lie in folders that all machines share, and
a batch that runs again writes its own folder anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, TimestampType

from ephemera.functions.names import quoted

#: A task hands on the rows it has kept once there are so many (keys are many then, and thinning out gains little).
FLUSH_ROWS = 100_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, for streams started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def newest(rows: pd.DataFrame, by: list[str], order: list[str], k: int) -> pd.DataFrame:
    """The last ``k`` rows of each key; nulls are oldest, as in Spark's order."""
    return rows.sort_values(order, na_position="first", kind="stable").groupby(by, sort=False).tail(k)


class _Latest(StatefulProcessor):
    """Keeps ``k`` rows of a key; with ``idle_ms``, forgets a key whose last row is that much older than the watermark."""

    def __init__(self, rows: StructType, order: list[str], k: int, idle_ms: int | None):
        self.rows, self.order, self.k, self.idle_ms = rows, order, k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", self.rows)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.rows.names
        had = pd.DataFrame([tuple(r) for r in self.kept.get()], columns=names)
        came = [f[names] for f in rows]
        held = pd.concat([f for f in (had, *came) if len(f)]).sort_values(self.order, na_position="first", kind="stable").tail(self.k)
        held = held.astype(object).where(held.notna(), None)
        self.kept.put([tuple(r) for r in held.itertuples(index=False)])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(held["t"].max() // 1000) + self.idle_ms)
        yield pd.DataFrame({"k": [key[0]], "kept": [[dict(zip(names, r, strict=True)) for r in held.itertuples(index=False)]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_rows(stream: DataFrame, by: str, on: str, k: int = 1, ties: list[str] = (), idle: str | None = None) -> DataFrame:
    """(``by``, kept): after each batch, for each key with new rows, its last ``k`` rows by ``on`` and ``ties``, oldest first.

    Rows without a key or a time are left out; repeated rows count as often as they come; of rows that tie in all of
    ``on`` and ``ties`` those that came first stay behind.  Output mode is update.  Without ``idle`` nothing is ever
    dropped.  With ``idle`` (an interval like "2 days") rows older than the watermark by it are dropped and a key that
    has had no row for so long gives up its state; the rows it had stay in the results.
    """
    names = [c for c in stream.columns if c != by]
    t = F.unix_micros(quoted(on).cast("timestamp"))
    d = stream.where(quoted(by).isNotNull() & quoted(on).isNotNull())
    # names of our own, so that columns may have any name; times as whole microseconds
    d = d.select(quoted(by).alias("k"), t.alias("t"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(names)))
    order = ["t", *(f"c{names.index(c)}" for c in ties)]
    held = StructType([f for f in d.schema if f.name != "k"])

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in frames:
            kept = newest(f if kept is None else pd.concat([kept, f]), ["k"], order, k)
            if len(kept) > FLUSH_ROWS:
                yield kept
                kept = None
        if kept is not None:
            yield kept

    thinned = d.mapInPandas(thin, d.schema)
    idle_ms = None
    if idle is not None:
        thinned = thinned.withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", idle)
        idle_ms = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {idle})").first()[0])
    out = StructType([d.schema["k"], StructField("kept", ArrayType(held))])
    states = thinned.groupBy("k").transformWithStateInPandas(_Latest(held, order, k, idle_ms), out, "Update", "None" if idle is None else "EventTime")
    fields = F.transform("kept", lambda r: F.struct(*(r[f"c{i}"].alias(c) for i, c in enumerate(names))))
    return states.select(F.col("k").alias(by), fields.alias("kept"))


def write_latest(latest: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream: each batch is a folder of its own below ``path``, so one that is run again leaves no double rows."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows now kept, one for each row and key: each key's entry of its last batch."""
    saved = spark.read.parquet(path)
    by = next(c for c in saved.columns if c not in ("kept", "batch"))
    last = saved.groupBy(quoted(by).alias("k")).agg(F.max_by("kept", "batch").alias("kept"))
    return last.select("k", F.inline("kept")).withColumnRenamed("k", by)
