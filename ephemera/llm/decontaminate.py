"""Benchmark decontamination with an FM-index per shard of training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.llm.common import _PLACES, U64, flushes, free_name, offsets_of, ragged, stored, texts_of
from ephemera.llm.fm_index import FMIndex

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20  # benchmark text that is broadcast at once; takes about 30 times as much on the driver
BLOCKS = 4  # blocks that are searched in one stage
_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of 0-9, a-z and every character past ASCII."""
    return text.translate(_FOLD).split()


class Phrases:
    """Windows of benchmark items as integer rows by length, and the items of each window, as arrays.

    A window may have two rows; each then has some of its items.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                size = min(n, len(ids))
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                rows.setdefault(size, []).append(windows)
                owners.setdefault(size, []).append(np.full(len(windows), number[item], np.int32))
        self.least = min(rows, default=0)
        self.groups = []
        for length in sorted(rows):
            every, owner = np.concatenate(rows.pop(length)), np.concatenate(owners.pop(length))
            hashes = (every.astype(U64) * _PLACES[:length]).sum(axis=1, dtype=U64) if length <= len(_PLACES) else every[:, 0].astype(U64)
            order = np.lexsort((owner, hashes))
            every, owner = every[order], owner[order]
            fresh = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
            one = np.concatenate([[True], fresh[1:] | (owner[1:] != owner[:-1])])  # an item once for each window
            first = np.flatnonzero(fresh)
            counts = np.add.reduceat(one.astype(np.int64), first)
            self.groups.append((every[first].astype(np.int64), counts, owner[one].astype(np.int64)))


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, each text's first word in the shard, flags of the shard's hit words, and (text, item) pairs."""
    parts, end = [], np.zeros(1, np.int32)
    for t in texts:  # words become numbers text by text: as objects they take many times the memory of the text
        w = words_of(t)
        parts += [np.fromiter(map(phrases.vocabulary.get, w, repeat(0)), np.int32, len(w)), end]
    n_words = np.fromiter(map(len, parts[::2]), np.int64, len(texts))
    starts = offsets_of(n_words)
    ids = np.concatenate(parts) if parts else end
    word_at = np.arange(len(ids)) - np.repeat(np.arange(len(texts)), n_words + 1)
    # runs of known words; other words occur in no window, and a run shorter than the shortest window holds none
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    long = length >= max(1, phrases.least)
    begin, length = begin[long], length[long]
    diff = np.zeros(starts[-1] + 1, np.int64)
    pairs = [np.empty((0, 2), np.int64)]
    if len(begin) and phrases.groups:
        places = ragged(begin, length + 1)  # with the 0, or other word, that follows
        s = ids[places].astype(np.int64)
        s[np.cumsum(length + 1) - 1] = 0
        index = FMIndex(s, len(phrases.vocabulary))
        for windows, counts, items in phrases.groups:
            which, at = index.occurrences(windows)
            first = word_at[places[at]]
            np.add.at(diff, first, 1)
            np.add.at(diff, first + windows.shape[1], -1)
            text = np.searchsorted(starts, first, side="right") - 1
            one = np.unique(text * len(windows) + which)
            text, which = one // len(windows), one % len(windows)
            own = items[ragged((np.cumsum(counts) - counts)[which], counts[which])]
            pairs.append(np.unique(np.stack([np.repeat(text, counts[which]), own], axis=1), axis=0))
    return n_words, starts, np.cumsum(diff[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point spans of runs of hit words, joined over what lies between two hit words that follow each other."""
    out: list[dict[str, int]] = []
    last = -2
    for k, m in enumerate(_WORD.finditer(text.decode("utf-8", "replace"))):
        if hit[k]:
            if last == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(shared, text: str, schema: list[str], shard_bytes: int, again: bool):
    """Adds the last five columns; with ``again`` they are there from another block of the benchmark and grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for table in flushes(batches, text, shard_bytes):
            texts = texts_of(table[text])
            n_words, starts, hit, pairs = shard_hits(texts, phrases)
            items = [[] for _ in texts]
            if again:
                items = table.column(table.num_columns - 3).to_pylist()
                for k, flags in enumerate(table.column(table.num_columns - 1).to_pylist()):
                    if flags:
                        hit[starts[k] : starts[k + 1]] |= np.frombuffer(flags, bool)
            for k, i in pairs.tolist():
                if phrases.names[i] not in items[k]:
                    items[k].append(phrases.names[i])
            before = np.concatenate([[0], np.cumsum(hit)])
            n_hit = before[starts[1:]] - before[starts[:-1]]
            own = [hit[starts[k] : starts[k + 1]] if n_hit[k] else None for k in range(len(texts))]
            spans = [[] if h is None else _spans(t, h) for t, h in zip(texts, own, strict=True)]
            flags = [None if h is None else h.tobytes() for h in own]
            rest = range(table.num_columns - 5 * again)
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in rest), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN), pa.array(flags, pa.binary())],
                names=schema,
            )

    return run


def _phrases(benchmark: DataFrame, text_col: str, item_col: str, n: int, block_bytes: int) -> Iterator[Phrases]:
    """Blocks of the benchmark of about ``block_bytes`` each; every block is searched in every shard."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == k).collect()
        yield Phrases([("" if r.item is None else r.item, r.text.encode()) for r in rows], n)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    item_col: str = "item_id",
    n: int = 13,
    share: tuple[int, int] = (1, 20),
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array of ids as strings), spans (code points to remove) and contaminated.

    A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window.  Words are
    runs of 0-9, a-z and characters past ASCII, A-Z lower-cased.  A word inside any occurrence of a window is hit; a
    text is contaminated if a word is hit and the share of hit words is ``share`` or more.  Each task builds an
    FM-index of the benchmark's words in a shard of its texts, searches all windows backwards and locates them by
    sampled suffixes; there is no shuffle.  The benchmark is searched in blocks of bounded size.

    Null texts have no words; null items are left out, and a null item id counts as ''.  Repeated rows are judged
    alike.  An empty table, of either kind, gives rows without hits.  Result columns whose names are taken get a
    trailing '_'.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": span, "flags": T.BinaryType()}
    names = [free_name(docs, wanted) for wanted in kinds]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(a, b) for a, b in zip(names, kinds.values(), strict=True))])
    out = docs
    for k, phrases in enumerate(_phrases(benchmark, item_text_col, item_col, n, block_bytes)):
        if k and k % BLOCKS == 0:
            out = stored(out)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        out = out.mapInArrow(_pass(shared, text_col, schema.names, shard_bytes, k > 0), schema)
    bad = (F.col(names[1]) > 0) & (F.col(names[1]) * share[1] >= F.col(names[0]) * share[0])
    return out.drop(names[4]).withColumn(free_name(docs, "contaminated"), bad)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without its (sorted, disjoint) code-point spans."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    return F.concat_ws("", F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"])))
