"""Shared helpers: shared-folder checkpoints, word hashing and Arrow batch utilities."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers for combining word hashes by place; part of the hash's definition.
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(64)], dtype=U64)
_MIX = U64(0x9E3779B97F4A7C15)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results; a folder of this machine is made only if none is named and all tasks run here."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared checkpoint folder and cut from its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again (columnar, compressed)."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_left_join(left: DataFrame, right: DataFrame, key: str, hot: int = 1_000) -> DataFrame:
    """``left`` joined to ``right`` (one row for each key): keys of more than 1 / ``hot`` of all rows by broadcast.

    There are fewer than ``hot`` such keys, and their rows stay where they are; other keys are joined by a shuffle.
    ``left`` is read three times, so it should be stored.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_of_key"))
    most = left.count() / hot
    hubs = checkpointed(counts.where(F.col("n_of_key") > most).select(key))
    known = F.broadcast(hubs.join(right, key, "left"))
    return left.join(known, key).unionByName(left.join(F.broadcast(hubs), key, "left_anti").join(right, key, "left"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, made longer until no column of ``df`` has that name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale or script of the rest."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHash(dict):
    """Cache of 64-bit word hashes; emptied when it holds ``limit`` words, so its memory is bounded."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * _MIX
    return x ^ (x >> U64(29))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null becomes empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def word_ids(words: Iterable[bytes], cache: WordHash, n: int) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), U64, n)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` ids (``len(ids) - n + 1`` of them)."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    total = ids[:m] * _PLACES[0]
    for k in range(1, n):
        total = total + ids[k : k + m] * _PLACES[k]
    return mix(total)


def sequence_hash(ids: np.ndarray) -> int:
    """Hash of a whole sequence that is shorter than a window; differs by length."""
    return xxhash.xxh3_64_intdigest(ids.tobytes(), seed=len(ids))


def shingle_sets(texts: list[bytes], n: int, cache: WordHash) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words are runs without ASCII white space, A-Z lower-cased."""
    parts = []
    for t in texts:  # words are hashed text by text: as objects they take many times the memory of the text
        words = t.lower().split()
        parts.append(word_ids(words, cache, len(words)))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ids = np.concatenate(parts) if parts else np.empty(0, U64)
    windows = window_hashes(ids, n)
    starts = np.cumsum(sizes) - sizes
    out = []
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size >= n:
            out.append(np.unique(windows[start : start + size - n + 1]))
        elif size:
            out.append(np.array([sequence_hash(ids[start : start + size])], U64))
        else:
            out.append(np.empty(0, U64))
    return out


_KEPT: dict[str, object] = {}  # while a worker process lives


def kept(key: str, make: Callable[[str], object]):
    """``make(key)``, made once for the tasks of a worker process, until a task without ``keep=key`` begins its flushes."""
    if key not in _KEPT:
        _KEPT[key] = make(key)
    return _KEPT[key]


def flushes(batches: Iterable[pa.RecordBatch], text: str, limit: int, rows: int | None = 2000, keep: str | None = None) -> Iterator[pa.Table]:
    """Batches joined, ``rows`` at a time, until their text exceeds ``limit`` bytes, so work is vectorised in bounded memory.

    With ``rows`` None a piece ends with the row that reaches the limit.  What other tasks of this process have left
    under another key than ``keep`` is given up.
    """
    others = [k for k in _KEPT if k != keep]
    for k in others:
        del _KEPT[k]
    if others:
        release_memory()
    held, size = [], 0
    for batch in batches:
        at, column = 0, batch.schema.get_field_index(text)
        if rows is None:
            ends = offsets_of(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False) + 4)
        while at < batch.num_rows:
            piece = batch.slice(at, rows or int(np.searchsorted(ends, ends[at] + limit - size)) - at)
            at += piece.num_rows
            held.append(piece)
            size += piece.column(column).nbytes if rows else int(ends[at] - ends[at - piece.num_rows])
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    held = []
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: worker processes live on, and share an executor's memory with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets_of(counts).astype(np.int32)), pa.array(values, kind))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + counts[i] - 1`` for every i, joined."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of the one column of ``keys`` (1 <= k <= count), by counting in ever narrower bins."""
    col = F.col(keys.columns[0])
    lo, hi = keys.agg(F.min(col), F.max(col)).first()
    while True:
        width = (hi - lo) / bins
        inside = keys.where((col >= lo) & (col <= hi))
        if width == 0 or lo + width == lo:
            return hi
        counts = inside.groupBy(F.least(F.lit(bins - 1), F.floor((col - lo) / width)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")
        )
        for row in sorted(counts.collect(), key=lambda r: -r.bin):
            if row.n >= k:
                lo, hi = row.lo, row.hi
                break
            k -= row.n
