"""Cross-tokenizer alignment: overlaps by as-of merges of token starts, groups at common ends, link counts of the corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.llm.common import checkpointed, flushes, free_name, kth_largest, list_array, offsets_of, ragged, stored, texts_of
from ephemera.llm.packing import _OTHER, Encoder, _Units

FLUSH_BYTES = 1 << 19
CHUNK = 1 << 19  # bytes whose tokens are merged at once
LONG = 1 << 18  # bytes; longer texts go through tokenizers
HEAD = 1_000_000  # id pairs whose counts are broadcast
_BLANK = "▁"
_UNIT = re.compile(r" +[^ ]*")
#: The library's splitting pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = (b",", b"|", b";", b"")  # within a side of a group, between its sides, between groups, at the end


class ByteLevel:
    """Ids of byte-level tokenizers, special strings as plain text, and the bytes of each id.

    Where the file's merges make ids in rising order, the tokenizer's own splitting pattern is in use and characters
    are of the kinds on whose classes all libraries agree, the same vocabulary is applied by tiktoken, which is faster;
    all else goes through tokenizers.
    """

    def __init__(self, path: str):
        plain = Encoder(path)
        self.tokenizer = plain.tokenizer
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in plain.alphabet.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        model = json.loads(self.tokenizer.to_str())["model"]
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]] if plain.by_unit else []
        self.fast = None
        if merged and all(a < b for a, b in zip(merged, merged[1:], strict=False)) and all(len(self.bytes[i]) == 1 for i in model["vocab"].values() if i < merged[0]):
            import tiktoken

            special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("from " + path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if self.fast is not None and len(raw) <= LONG and not _OTHER.search(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self._encode(t), np.int64) for t in texts]
        return np.concatenate([*found, np.empty(0, np.int64)]), np.fromiter(map(len, found), np.int64, len(found))


class Pieces:
    """Ids of a sentencepiece model, and the bytes of each id: U+2581 is a space, byte pieces are their byte.

    Where blanks stand only at the start of pieces and the model adds a blank before a text, no piece reaches over the
    start of a run of blanks.  So each run of blanks with what follows it is a unit of its own; the model is asked once
    for each distinct unit, less the blank that it adds again.  Units are remembered within ``limit`` of them.
    """

    limit = 150_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in own]
        self.bytes = [bytes([int(names[i][3:5], 16)]) if self.model.is_byte(i) else names[i].replace(_BLANK, " ").encode() for i in own]
        self.adds_blank = self.model.encode("a", out_type=str)[0].startswith(_BLANK)
        self.by_unit = self.adds_blank and _BLANK in names and self.model.encode("a  b ", out_type=str)[-1] == _BLANK and not any(_BLANK in n.lstrip(_BLANK) for n in names)
        self.blank = names.index(_BLANK) if self.by_unit else -1
        self._clear()

    def _clear(self) -> None:
        self.units = _Units()
        self.flat, self.start = np.empty(0, np.int64), np.zeros(1, np.int64)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a blank, joined, and the number of each."""
        if not self.by_unit:
            found = self.model.encode([(t[1:] if self.adds_blank else t).decode("utf-8", "replace") for t in texts], num_threads=1)
            return np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))
        parts, known = [], self.units.__getitem__
        for t in texts:
            units = _UNIT.findall(t.decode("utf-8", "replace"))
            parts.append(np.fromiter(map(known, units), np.int64, len(units)))
        if fresh := self.units.fresh:
            found = [x or [self.blank] for x in self.model.encode([u[1:] for u in fresh], num_threads=1)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.units.fresh = []
        keys = np.concatenate([*parts, np.empty(0, np.int64)])
        counts = self.start[keys + 1] - self.start[keys]
        of_text, before = offsets_of(np.fromiter(map(len, parts), np.int64, len(parts))), offsets_of(counts)
        out = self.flat[ragged(self.start[keys], counts)], before[of_text[1:]] - before[of_text[:-1]]
        if self.units.total > self.limit:
            self._clear()
        return out


class Side:
    """One tokenizer, with the bytes of all ids in a row and their numerals, each with every mark that may follow."""

    def __init__(self, path: str):
        self.source = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        self.lengths = np.fromiter(map(len, self.source.bytes), np.int64, len(self.source.bytes))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.source.bytes), np.uint8)
        self.numerals = [b"%d%s" % (i, m) for i in range(len(self.lengths)) for m in MARKS]

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids of each text, and which texts the ids' bytes give back."""
        ids, counts = self.source.ids(texts)
        before, own = offsets_of(self.lengths[ids]), offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)))
        at = before[offsets_of(counts)]
        joined = self.letters[ragged(self.first[ids], self.lengths[ids])].tobytes()
        raw = b"".join(texts)
        if joined == raw and (at == own).all():
            return ids, counts, np.ones(len(texts), bool)
        same = (joined[a:b] == raw[c:d] for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), own[:-1].tolist(), own[1:].tolist(), strict=True))
        return ids, counts, np.fromiter(same, bool, len(texts))


_SIDES: dict[str, Side] = {}  # by path, kept while a worker process lives


def side_of(path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def covering(left: pd.DataFrame, right: pd.DataFrame, chunk: int = CHUNK) -> Iterator[pd.DataFrame]:
    """For each token of ``left`` the token of ``right`` that covers its start: doc, start, end, at and start_r, end_r, at_r.

    Starts count through all documents, so both tables are in order as they are.  The tables are merged by ranges of
    starts, each with the one earlier token that may reach into it.
    """
    last = int(left["start"].iloc[-1]) if len(left) else -1
    own, other = left["start"].to_numpy(), right["start"].to_numpy()
    right = right.rename(columns={"end": "end_r", "at": "at_r"}).assign(start_r=other)
    for lo in range(0, last + 1, chunk):
        a, b = np.searchsorted(own, [lo, lo + chunk])
        c, d = max(0, int(np.searchsorted(other, lo, side="right")) - 1), int(np.searchsorted(other, lo + chunk))
        if a < b:
            yield pd.merge_asof(left.iloc[a:b], right.iloc[c:d], on="start", by="doc")


def overlaps(a: pd.DataFrame, b: pd.DataFrame, chunk: int = CHUNK) -> Iterator[pd.DataFrame]:
    """All pairs of tokens that share bytes, once each: doc, a, b, end_a, end_b.

    The later start of two such tokens lies in the other token, so the union of both directions has every pair; pairs
    with equal starts are found in both and taken from the first.
    """
    for found in covering(a, b, chunk):
        yield found[["doc", "at", "at_r", "end", "end_r"]].set_axis(["doc", "a", "b", "end_a", "end_b"], axis=1)
    for found in covering(b, a, chunk):
        fresh = found[found["start_r"] < found["start"]]
        yield fresh[["doc", "at_r", "at", "end_r", "end"]].set_axis(["doc", "a", "b", "end_a", "end_b"], axis=1)


def _table(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    size = lengths[ids]
    end = np.cumsum(size)
    return pd.DataFrame({"doc": np.repeat(np.arange(len(counts)), counts), "start": end - size, "end": end, "at": np.arange(len(ids))}, copy=False)


def _within(at: np.ndarray, many: int) -> np.ndarray:
    """Number of links that end before each token: its group."""
    closes = np.zeros(many, np.int64)
    closes[at] = 1
    return np.cumsum(closes) - closes


class Numerals:
    """Texts of group lists from (id, mark) codes of both sides, without a Python object for each token."""

    def __init__(self, a: Side, b: Side):
        every = a.numerals + b.numerals
        self.second = len(a.numerals)
        self.size = np.fromiter(map(len, every), np.int64, len(every))
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(every), np.uint8)

    def texts(self, codes: np.ndarray, at: np.ndarray) -> pa.Array:
        """One text for the codes between each two of ``at``."""
        size = self.size[codes]
        data = self.letters[ragged(self.first[codes], size)]
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets_of(size)[at].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def group_texts(ids_a: np.ndarray, counts_a: np.ndarray, ids_b: np.ndarray, counts_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, numerals: Numerals) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for each document: groups end where the linked tokens at_a, at_b do."""
    group_a, group_b = _within(at_a, len(ids_a)), _within(at_b, len(ids_b))
    many = len(at_a)
    in_a, in_b = np.cumsum(np.bincount(group_a, minlength=many)), np.bincount(group_b, minlength=many)
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[at_a], mark_b[at_b] = 1, 2
    mark_b[np.cumsum(counts_b)[counts_b > 0] - 1] = 3
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = ids_a << 2 | mark_a
    codes[np.arange(len(ids_b)) + in_a[group_b]] = (ids_b << 2 | mark_b) + numerals.second
    return numerals.texts(codes, offsets_of(counts_a + counts_b))


def _align(path_a: str, path_b: str, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side_of(path_a), side_of(path_b)
        numerals = Numerals(a, b)
        for table in flushes(batches, text, FLUSH_BYTES, 50):
            texts = texts_of(table[text])
            # an empty text is one blank to both sides, so its tokens are taken away with those of texts not given back
            spaced = [b" " + t for t in texts]
            ids_a, counts_a, whole = a.tokens(spaced)
            ids_b, counts_b, also = b.tokens(spaced)
            whole &= also & np.fromiter(map(bool, texts), bool, len(texts))
            if not whole.all():
                ids_a, ids_b = ids_a[np.repeat(whole, counts_a)], ids_b[np.repeat(whole, counts_b)]
                counts_a, counts_b = counts_a * whole, counts_b * whole
            pairs = [p[p["end_a"] == p["end_b"]] for p in overlaps(_table(ids_a, counts_a, a.lengths), _table(ids_b, counts_b, b.lengths))]
            joined = pd.concat(pairs).sort_values("a") if pairs else pd.DataFrame({"doc": [], "a": [], "b": []}, dtype=np.int64)
            at_a, at_b = joined["a"].to_numpy(), joined["b"].to_numpy()
            n_links = np.bincount(joined["doc"].to_numpy(), minlength=len(texts)).astype(np.int64)
            groups = group_texts(ids_a, counts_a, ids_b, counts_b, at_a, at_b, numerals)
            rest = [table.column(c).combine_chunks() for c in range(table.num_columns) if table.column_names[c] != text]
            links = [list_array(ids[at], n_links, pa.int32()) for ids, at in ((ids_a, at_a), (ids_b, at_b))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts_a), pa.array(counts_b), pa.array(n_links), groups, *links], names=names)

    return run


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, groups, link_a and link_b.

    Tokenizers are files: ``.model`` of sentencepiece, others byte-level ones of tokenizers; ids are without special
    tokens, whose strings within a text are plain text.  Both sides read one space and the text.  For each batch the
    token starts of each side are merged as of the other side's, within their document: each finds the token that
    covers it, and both directions together give all overlaps.  Overlapping tokens that end together are links (their
    ids in link_a and link_b, in order); common ends cut both sides into groups (``groups``: ``a1,a2|b1;a3|b2``).

    Texts that are null or empty, or whose joined token bytes differ from space and text on either side, have no
    tokens: zeros, '' and empty arrays.  Very long texts are encoded whole but merged by ranges of bytes.  Repeated
    rows are aligned alike; an empty table gives an empty result; result columns whose names are taken get a trailing
    '_'.  One pass, no shuffle.
    """
    numbers, ids = T.LongType(), T.ArrayType(T.IntegerType())
    kinds = {"n_a": numbers, "n_b": numbers, "n_groups": numbers, "groups": T.StringType(), "link_a": ids, "link_b": ids}
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, *(T.StructField(free_name(docs, x), t) for x, t in kinds.items())])
    return docs.mapInArrow(_align(path_a, path_b, text_col, schema.names), schema)


_REST = pa.struct([("pair", pa.int64()), ("times", pa.int64())])


def _known(shared, link_a: str, link_b: str, names: list[str]):
    """Sums over each row's links with the broadcast counts; pairs without one are left over as rows' (pair, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            at = [batch.schema.get_field_index(c) for c in (link_a, link_b)]
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
            key = a << 32 | b
            sizes = np.diff(batch.column(at[0]).offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
            found = pairs[place] == key if len(pairs) else np.zeros(len(key), bool)
            place, own = place[found], row[found]
            total, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, own, counts[place])
            np.add.at(n_best, own, best[place])
            # what is left, once for each row and pair
            key, row = key[~found], row[~found]
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(key)))
            items = pa.StructArray.from_arrays([pa.array(key[first], pa.int64()), pa.array(times, pa.int64())], fields=list(_REST))
            listed = pa.ListArray.from_arrays(pa.array(offsets_of(np.bincount(row[first], minlength=batch.num_rows)).astype(np.int32)), items)
            rest = [batch.column(k) for k in range(batch.num_columns) if k not in at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes), pa.array(n_best), pa.array(total), listed], names=names)

    return run


def link_counts(aligned: DataFrame, link_a: str = "link_a", link_b: str = "link_b", head: int = HEAD) -> DataFrame:
    """``aligned`` without its links, with n_links, n_best and count_sum.

    An id pair's count is the number of links of the whole table that hold it.  n_best are a row's links whose count is
    the highest of their second id, ties included; count_sum adds the counts over the row's links.  Pairs are counted
    by Spark; the highest count of each second id (at most as many rows as its vocabulary has ids) is broadcast, so
    are fewer than ``head`` of the most frequent pairs; rows' links with all other pairs are joined by a shuffle, in
    which no pair is frequent.

    Rows with null or empty links have zeros; repeated rows count again; an empty table gives an empty result; result
    columns whose names are taken get a trailing '_'.
    """
    spark = aligned.sparkSession
    rows = stored(aligned.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in (link_a, link_b)}))
    links = rows.select(F.explode(F.arrays_zip(F.col(link_a).alias("a"), F.col(link_b).alias("b"))).alias("l"))
    pairs = stored(links.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.count("*").alias("n")))
    highest = checkpointed(pairs.groupBy("b").agg(F.max("n").alias("most")))
    table = pairs.join(F.broadcast(highest), "b").select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).alias("best"))
    every = pairs.count()
    least = kth_largest(pairs.select("n"), head) if every >= head else 0
    top = table.where(F.col("n") > least).toArrow()
    keys = top["pair"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], top["best"].to_numpy()[order].astype(np.int64)))
    kept = [f for f in rows.schema.fields if f.name not in (link_a, link_b)]
    names = [free_name(aligned, x) for x in ("n_links", "n_best", "count_sum")]
    rest = free_name(aligned, "rest")
    kind = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([*kept, *(T.StructField(x, T.LongType()) for x in names), T.StructField(rest, kind)])
    out = rows.mapInArrow(_known(shared, link_a, link_b, schema.names), schema)
    if top.num_rows < every:
        key, more, more_best = (free_name(out, x) for x in ("row", "more", "more_best"))
        out = stored(out.withColumn(key, F.monotonically_increasing_id()))
        tail = out.select(key, F.explode(rest).alias("r")).select(key, "r.pair", "r.times").join(table.where(F.col("n") <= least), "pair")
        tail = tail.groupBy(key).agg(F.sum(F.col("times") * F.col("n")).alias(more), F.sum(F.col("times") * F.col("best").cast("long")).alias(more_best))
        out = out.join(tail, key, "left")
        out = out.withColumns({names[1]: F.col(names[1]) + F.coalesce(more_best, F.lit(0)), names[2]: F.col(names[2]) + F.coalesce(more, F.lit(0))}).drop(key, more, more_best)
    return out.drop(rest)
