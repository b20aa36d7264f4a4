"""Token counts per document: pieces counted once per distinct pre-token, joined to per-document frequencies.

The table of distinct pre-tokens is built by Spark and each is counted once.  Its most frequent part, of bounded size,
is broadcast; documents resolve those frequencies where they are read.  The remaining (rare) pre-tokens of each
document leave as rows and are joined to the table by a shuffle, so the result is whole for any vocabulary.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.llm.common import flushes, free_name, kth_largest, offsets_of, stored, texts_of

HEAD = 250_000  # pre-tokens that are broadcast
FLUSH_BYTES = 4 << 20
#: Latin-1 characters whose lower case, composition and white space are the same in Python and in the library.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0xA1, 0x100)])
#: The splitting pattern for which a word of plain lower-case text is split here, and its classes in Latin-1.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(_PATTERN.replace(r"[\p{L}]", f"[{_LETTER}]").replace(r"[\p{N}]", f"[{_NUMBER}]").replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}{_NUMBER}]"))


class PreTokens:
    """The pre-tokens of a text as the tokenizer's own normalizer and splitter give them.

    With the one normalizer and pattern that are known here (``by_word``), which drop white space, words of plain
    Latin-1 text between white space are split once each by the same pattern and remembered.  Other characters, and
    all texts of other tokenizers, go through the library.  Special strings are cut out first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"]) or (config["model"].get("dropout") or 0) > 0:
            raise ValueError("added tokens that take in their surroundings, or dropout: texts have no independent pre-tokens")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splitter = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        steps, before = (config["pre_tokenizer"] or {}).get("pretokenizers", []), (config["normalizer"] or {}).get("normalizers", [])
        pattern = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}]
        self.by_word = steps[:1] == pattern and [(s["type"], s["use_regex"]) for s in steps[1:]] == [("ByteLevel", False)] and [n["type"] for n in before] == ["NFC", "Replace", "Lowercase"]
        # how the byte alphabet writes each character
        self.letters = {c: "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) or chr(c) for c in range(33, 256)} if self.by_word else {}

    def split(self, text: str) -> list[str]:
        """The library's pre-tokens of a text without special strings."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text] if text else []
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def keys(self, raw: bytes) -> tuple[list[str], int]:
        """Words, and pre-tokens behind a NUL, in the order of the text, and how many special strings stand in it."""
        text = raw.decode("utf-8", "replace")
        parts = self.splitter.split(text) if self.splitter is not None else [text]
        out: list[str] = []
        for part in parts:
            try:
                plain = self.by_word and not part.encode("latin-1").translate(None, _PLAIN)
            except UnicodeEncodeError:
                plain = False
            found = part.split() if plain else ["\0" + p for p in self.split(part)]
            out = out + found if out else found
        return out, len(parts) - 1

    def pieces(self, key: str) -> list[str]:
        """The pre-tokens of a key."""
        if key[0] == "\0":
            return [key[1:]]
        found = _SPLIT.findall(key.lower())
        return found if key.isascii() else [p.translate(self.letters) for p in found]


_SOURCES: dict[str, PreTokens] = {}  # by path, kept while a worker process lives


def _source(path: str) -> PreTokens:
    if path not in _SOURCES:
        _SOURCES[path] = PreTokens(path)
    return _SOURCES[path]


def _distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _source(path)
        for table in flushes(batches, "text", FLUSH_BYTES):
            words: Counter[str] = Counter()
            for raw in texts_of(table["text"]):
                words.update(source.keys(raw)[0])
            found: dict[str, int] = {}
            for key, n in words.items():
                for p in source.pieces(key):
                    found[p] = found.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

    return run


def _pieces(path: str):
    """Number of pieces of each distinct pre-token (already in the form that the model takes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path).model
        for b in batches:
            counts = [len(model.tokenize(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int32())], names=["piece", "n", "pieces"])

    return run


class _Sizes(dict):
    """Tokens of each key's pre-tokens in the broadcast table; -1 - tokens if others are left.  Forgotten beyond ``limit``."""

    limit = 250_000

    def __init__(self, source: PreTokens, known: dict[str, int]):
        self.source, self.known = source, known

    def __missing__(self, key: str) -> int:
        each = [self.known.get(p) for p in self.source.pieces(key)]
        total = sum(n for n in each if n is not None)
        size = self[key] = -1 - total if None in each else total
        return size

    def left(self, key: str) -> list[str]:
        return [p for p in self.source.pieces(key) if p not in self.known]


_REST = pa.struct([("piece", pa.string()), ("times", pa.int64())])


def _counts(path: str, text: str, head, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, (pieces, numbers) = _source(path), head.value
        sizes = _Sizes(source, dict(zip(pieces.to_pylist(), numbers.tolist(), strict=True)))
        for table in flushes(batches, text, FLUSH_BYTES):
            n_bytes, n_tokens, n_rest = [], [], []
            rest: tuple[list[str], list[int]] = ([], [])
            for raw in texts_of(table[text]):
                keys, special = source.keys(raw)
                counts = Counter(keys)
                per = np.fromiter(map(sizes.__getitem__, counts), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.int64, len(counts))
                n_bytes.append(len(raw))
                n_tokens.append(special + int(np.where(per < 0, -1 - per, per) @ times))
                own: dict[str, int] = {}
                if (per < 0).any():
                    for key, size, n in zip(counts, per.tolist(), times.tolist(), strict=True):
                        if size < 0:
                            for p in sizes.left(key):
                                own[p] = own.get(p, 0) + n
                rest[0].extend(own)
                rest[1].extend(own.values())
                n_rest.append(len(own))
                if len(sizes) > sizes.limit:
                    sizes.clear()
            listed = pa.ListArray.from_arrays(pa.array(offsets_of(np.array(n_rest, np.int64)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(rest[0], pa.string()), pa.array(rest[1], pa.int64())], fields=list(_REST)))
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), listed], names=names)

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048, head: int = HEAD) -> DataFrame:
    """``docs`` without its text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Counts equal the length of the library's encoding without added tokens; special strings inside a text count as
    one token each.  Null text counts as empty.  Repeated rows are counted alike, an empty table gives an empty
    result, and result columns whose names are taken get a trailing '_'.  Fewer than ``head`` pre-tokens, the most
    frequent, are broadcast; the frequencies of all others are joined to their counts by a shuffle.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).alias("text"))
    distinct = text.mapInArrow(_distinct(path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    table = stored(distinct.mapInArrow(_pieces(path), "piece string, n long, pieces int"))
    every = table.count()
    # the count that pre-tokens of the head exceed: one with ``head`` others at or above it is not in the head
    most = kth_largest(table.select("n"), head) if every >= head else 0
    top = table.where(F.col("n") > most).select("piece", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((top["piece"].combine_chunks(), top["pieces"].to_numpy()))
    names = [free_name(docs, x) for x in ("n_bytes", "n_tokens", "over_limit")]
    rest = free_name(docs, "rest")
    kind = T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(rest, kind)])
    out = docs.mapInArrow(_counts(path, text_col, shared, schema.names), schema).drop(text_col)
    if top.num_rows < every:
        key, more = free_name(out, "row"), free_name(out, "more")
        out = stored(out.withColumn(key, F.monotonically_increasing_id()))
        tail = out.select(key, F.explode(rest).alias("r")).select(key, "r.piece", "r.times").join(table.where(F.col("n") <= most).select("piece", "pieces"), "piece")
        tail = tail.groupBy(key).agg(F.sum(F.col("times") * F.col("pieces")).alias(more))
        out = out.join(tail, key, "left").withColumn(names[1], F.col(names[1]) + F.coalesce(more, F.lit(0))).drop(key, more)
    return out.drop(rest).withColumn(names[2], F.col(names[1]) > limit)
