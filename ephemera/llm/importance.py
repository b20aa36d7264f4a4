"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.llm.common import U64, WordHash, flushes, free_name, kth_largest, offsets_of, stored, texts_of, window_hashes, word_ids

BUCKETS = 1 << 15  # of word 1-grams and 2-grams together, and again of character-class 4-grams
LABELS = 20_000  # labelled rows of each kind that may be used, chosen by hash
FALSE_REJECTS = 0.005  # of the labelled good documents that set k, at most
LENGTH = 300  # n-grams of a passage: longer texts weigh as their average passage of this length
SCALE = 1 << 20  # log ratios are whole multiples of 1 / SCALE, so that sums do not depend on their order
FLUSH_BYTES = 2 << 20
#: Character classes: letters by case, digits, white space, line ends, other ASCII marks one by one, the rest.
_CLASS = np.array(
    [1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 0x80 else 3 if 48 <= b <= 57 else 4 if b == 10 else 5 if b in (9, 11, 12, 13, 32) else 6 + b % 32 if b >= 32 else 0 for b in range(256)],
    np.int32,
)


def feature_ids(texts: list[bytes], cache: WordHash) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the buckets of its word 1-grams and 2-grams, and those of its character-class 4-grams."""
    words, marks = [], []
    for t in texts:
        parts = t.lower().split()
        ids = word_ids(parts, cache, len(parts))
        grams = np.concatenate([ids * U64(0x9E3779B97F4A7C15), window_hashes(ids, 2)])
        words.append((grams >> U64(49)).astype(np.int64) % BUCKETS)
        c = _CLASS[np.frombuffer(t, np.uint8)]
        code = (c[:-3] * 64 + c[1:-2]) * 4096 + c[2:-1] * 64 + c[3:] if len(c) > 3 else np.empty(0, np.int32)
        marks.append(BUCKETS + ((code.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) % BUCKETS)
    return words, marks


def _count(target, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, chosen = WordHash(), target.value
        raw, good = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for table in flushes(batches, text_col, FLUSH_BYTES, None):
            words, marks = feature_ids(texts_of(table[text_col]), cache)
            ids = table[id_col].to_pylist()
            for kind in (words, marks):
                raw += np.bincount(np.concatenate(kind), minlength=2 * BUCKETS)
                own = [x for x, i in zip(kind, ids, strict=True) if i in chosen]
                if own:
                    good += np.bincount(np.concatenate(own), minlength=2 * BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "target"])

    return run


def _score(ratios, text_col: str, seed: int, names: list[str], at_id: int, carry_text: bool):
    """Rows with the log importance weight of their text and their Gumbel noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table_of = WordHash(), ratios.value
        for table in flushes(batches, text_col, FLUSH_BYTES, None):
            weight, texts = np.zeros(table.num_rows), texts_of(table[text_col])
            for kind in feature_ids(texts, cache):
                total = np.concatenate([[0], np.cumsum(table_of[np.concatenate(kind)])])
                n = np.fromiter(map(len, kind), np.int64, len(kind))
                at = offsets_of(n)
                weight += (total[at[1:]] - total[at[:-1]]) / SCALE * np.minimum(1.0, LENGTH / np.maximum(n, 1))
            names_of = map(repr, table.column(at_id).to_pylist())
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(t, seed=xxhash.xxh3_64_intdigest(i, seed=seed)) for i, t in zip(names_of, texts, strict=True)), U64, len(texts))
            u = ((hashes >> U64(12)).astype(np.float64) + 0.5) / float(1 << 52)
            kept = [c.combine_chunks() for c, n in zip(table.columns, table.column_names, strict=True) if carry_text or n != text_col]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight), pa.array(-np.log(-np.log(u)))], names=names)

    return run


def log_ratios(docs: DataFrame, good_ids: set, text_col: str, id_col: str, smooth: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) with additive smoothing, for both kinds of n-grams, times SCALE.

    Counts cover all documents; each task adds up its own before the shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(good_ids)
    counts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_count(shared, "id", "text"), "bucket int, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(2 * BUCKETS, smooth), np.full(2 * BUCKETS, smooth)
    raw[rows.bucket] += rows.raw
    target[rows.bucket] += rows.target
    out = np.empty(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        out[half] = np.log(target[half] / target[half].sum()) - np.log(raw[half] / raw[half].sum())
    return np.rint(out * SCALE).astype(np.int64)


def _labelled(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, label) of good (1) and bad (0) rows, ``most`` of each at most, in order of a hash."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    order = [F.xxhash64(F.col("id").cast("string")), "id"]
    return rows.where("label = 1").orderBy(*order).limit(most).unionByName(rows.where("label = 0").orderBy(*order).limit(most))


def cut_score(good: np.ndarray, bad: np.ndarray, most: float) -> float:
    """The cut that rejects most bad scores for each good one, with at most a share ``most`` of the good below it."""
    if not len(good):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    values = np.unique(np.concatenate([bad, good]))
    cuts = np.concatenate([values[:1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    won = np.searchsorted(bad, cuts) / max(1, len(bad))
    gain = np.where(lost <= most, won - 5 * lost, -np.inf)
    return float(cuts[np.flatnonzero(gain == gain.max())[-1] if len(bad) else 0])


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    label_id_col: str = "doc_id",
    share: float | None = None,
    false_rejects: float = FALSE_REJECTS,
    seed: int = 7,
    carry_text: bool = True,
) -> DataFrame:
    """``docs`` with score, the log importance weight of each text, and kept, the choice of a Gumbel top-k.

    The weight is log p(text | target) - log p(text | raw) of two bag-of-n-gram models over hashed buckets: a product
    over the words and word pairs, and over the character classes, of the text.  Models rank passages of one length, so
    a text of more than LENGTH n-grams has the weight of its average passage of LENGTH n-grams.  The target model is fitted on three quarters of
    the labelled good rows (LABELS at most, chosen by hash), the raw model on all documents.  Each document's key is
    its weight plus standard Gumbel noise, so the k largest keys are a sample of k documents without replacement in
    proportion to their weights.  k is ``share`` of the documents, or else as many as have a key above the cut that
    the other labelled good rows and the bad ones (LABELS of each at most) support, with at most ``false_rejects`` of
    these good rows below it.  All documents whose key ties with the last one stay.

    The noise is a hash of id and text, and weights are sums of whole numbers: repeated rows, and equal texts, get the
    same weight whatever the partitioning.  Null text has weight 0; null and repeated labels count for nothing more; a
    label other than 0 and 1 is left out; without good labels all stay with score 0; an empty table gives an empty
    result.  Result columns whose names are taken get a trailing '_'.  Texts are read twice, and scored rows are stored
    once, without the text unless ``carry_text``.
    """
    spark = docs.sparkSession
    score, kept, noise = (free_name(docs, x) for x in ("score", "kept", "noise"))
    known = _labelled(labels, label_id_col, label_col, LABELS)
    known = known.withColumn("fit", (F.col("label") == 1) & (F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string")), F.lit(4)) > 0))
    rows = known.collect()  # 2 * LABELS at most
    known, target = spark.createDataFrame(rows, known.schema), {r.id for r in rows if r.fit}
    if not target:
        plain = docs if carry_text else docs.drop(text_col)
        return plain.withColumn(score, F.lit(0.0)).withColumn(kept, F.lit(True))
    ratios = spark.sparkContext.broadcast(log_ratios(docs, target, text_col, id_col))
    fields = [f for f in docs.schema.fields if carry_text or f.name != text_col]
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(noise, T.DoubleType())])
    scored = stored(docs.mapInArrow(_score(ratios, text_col, seed, schema.names, docs.columns.index(id_col), carry_text), schema))
    key = F.col(score) + F.col(noise)
    keys = scored.select(F.col(id_col).alias("id"), key.alias("key"))
    if share is None:
        # of each labelled row that is not in the target model, one key; at most 2 * LABELS rows
        seen = keys.join(F.broadcast(known.where("not fit")), "id").groupBy("id", "label").agg(F.avg("key").alias("key")).toPandas()
        good, bad = (seen.key[seen.label == v].to_numpy() for v in (1, 0))
        cut = cut_score(good, bad, false_rejects)
        total, k = keys.agg(F.count("*"), F.count_if(F.col("key") >= cut)).first()
    else:
        total = keys.count()
        k = round(share * total)
    least = kth_largest(keys.select("key"), k) if k else float("inf")
    return scored.withColumn(kept, key >= least).drop(noise)
