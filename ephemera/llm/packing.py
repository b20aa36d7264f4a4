"""Order-preserving packing of token streams by dynamic programming with monotone queues."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ephemera.llm.common import flushes, kept, offsets_of, ragged, texts_of

FLUSH_BYTES = 4 << 20
SENTENCE = 1.0  # cost of a cut after a sentence inside a document, in padded tokens
TRUNCATION = 4.0  # cost of a cut elsewhere
GAP = 24  # where no sentence ends for longer, cuts may fall at this distance
LONGEST = 256  # characters; longer pre-tokens are not remembered
#: Classes of letters and numbers in Latin-1 for the splitting pattern of byte-level tokenizers.
_LETTER, _NUMBER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
#: Bytes of ASCII and Latin-1 text, but for U+001C to U+001F, which are white space to Python alone.
_PLAIN = bytes([*range(0x1C), *range(0x20, 0xC4)])
#: Characters outside those that the pattern above classifies as the library does (Latin-1, some marks).
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\xff\u2010-\u2014\u2018-\u201e\u2022\u2026\u20ac]")


def _byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies write each byte: visible Latin-1 characters as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Token ids by the library: its model is asked once for each distinct pre-token.

    This holds for byte-level tokenizers with the library's own splitting pattern, no normalizer and plain special
    strings (``by_unit``).  Plain Latin-1 text is split by that pattern here, other text by the library's splitter.
    Texts with special strings, and all texts of other tokenizers, are encoded whole.  Pre-tokens are remembered within
    ``limit`` of them and ``limit_size`` characters and ids; whole texts and long pre-tokens never are.
    """

    limit, limit_size = 600_000, 16_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        config = json.loads(self.tokenizer.to_str())
        splitter, model = config["pre_tokenizer"] or {}, config["model"]
        own = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"])
        self.by_unit = bool(own and plain and not config["normalizer"] and model["type"] == "BPE" and not model["dropout"])
        self.model, self.splitter, self.alphabet = self.tokenizer.model, self.tokenizer.pre_tokenizer, _byte_alphabet()
        self.closing: np.ndarray | None = None
        self.clear()

    def clear(self) -> None:
        self.units = _Units()
        self.flat, self.start, self.uses = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _split(self, raw: bytes) -> list[str]:
        text = raw.decode("utf-8", "replace")
        if (raw.translate(None, _PLAIN) or "\x85" in text) and _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def _ids(self, units: list[str | list[int]]) -> list[list[int]]:
        """Ids of each unit; texts that were encoded whole have them already."""
        # no UTF-8 text holds the byte 0xFF, which the alphabet keeps
        names = b"\xff".join([b"" if isinstance(u, list) else u.encode() for u in units]).decode("latin-1").translate(self.alphabet).split("\xff")
        tokenize = self.model.tokenize
        return [u if isinstance(u, list) else [t.id for t in tokenize(x)] for u, x in zip(units, names, strict=True)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the number of ids of each text."""
        parts, known = [], self.units.__getitem__
        for raw in texts:
            if self.by_unit and not any(s in raw for s in self.special):
                units = self._split(raw)
                parts.append(np.fromiter(map(known, units), np.int64, len(units)))
            else:
                ids = self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
                parts.append(np.array([self.units.add(ids)], np.int64))
        if self.units.fresh:
            ids = self._ids(self.units.fresh)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.units.fresh = []
        keys = np.concatenate(parts) if parts else np.empty(0, np.int64)
        uses = np.bincount(keys, minlength=self.units.total)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        counts = self.start[keys + 1] - self.start[keys]
        of_text = offsets_of(np.fromiter(map(len, parts), np.int64, len(parts)))
        before = np.concatenate([[0], np.cumsum(counts)])
        out = self.flat[ragged(self.start[keys], counts)], before[of_text[1:]] - before[of_text[:-1]]
        if self.units.total > self.limit or self.units.size + len(self.flat) > self.limit_size:
            self._forget()
        return out

    def _forget(self) -> None:
        """Keep the pre-tokens with most uses, twice or more, as far as half of the limits goes; uses so far count half from now on."""
        keys = np.fromiter(self.units.values(), np.int64, len(self.units))
        size = np.fromiter(map(len, self.units), np.int64, len(keys)) + self.start[keys + 1] - self.start[keys]
        most = np.argsort(-self.uses[keys], kind="stable")[: self.limit // 2]
        most = most[(np.cumsum(size[most]) <= self.limit_size // 2) & (self.uses[keys[most]] > 1)]
        stays = np.zeros(len(keys), bool)
        stays[most] = True
        keys = keys[stays]
        counts = self.start[keys + 1] - self.start[keys]
        self.flat, self.start, self.uses = self.flat[ragged(self.start[keys], counts)], offsets_of(counts), self.uses[keys] // 2
        kept = _Units()
        for u in compress(self.units, stays.tolist()):
            kept[u] = kept.add(u)
        kept.fresh = []
        self.units = kept

    def sentence_ends(self) -> np.ndarray:
        """Flags of the ids whose text ends with a full stop, question or exclamation mark or a line break."""
        if self.closing is not None:
            return self.closing
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for t, i in vocabulary.items() if t.endswith((".", "!", "?", "Ċ"))]] = True
        self.closing = out
        return out


class _Units(dict):
    """Key of each unit; those that are met for the first time wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[str | list[int]] = []
        self.total = self.size = 0

    def add(self, unit: str | list[int]) -> int:
        self.fresh.append(unit)
        self.size += len(unit)
        self.total += 1
        return self.total - 1

    def __missing__(self, unit: str) -> int:
        k = self.add(unit)
        if len(unit) <= LONGEST:
            self[unit] = k
        return k


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int, truncation: float) -> tuple[np.ndarray, list[int]]:
    """Cost of the best way to cut at each place, and the place (by index) of the cut before it.

    A window from cut i to place j costs its padding ``size - (j - i)``; one of up to twice ``size`` is cut once more,
    at i + size, for ``truncation``.  Both minima slide over cost[i] + i, the windows' ``size`` and the penalties so
    far, in monotone queues: each place enters and leaves each queue once.  ``places`` starts with 0 and its gaps are
    at most ``size``.
    """
    n = len(places)
    near_from = np.searchsorted(places, places - size).tolist()  # the first place within one window
    far_from = np.searchsorted(places, places - 2 * size).tolist()
    extra = (penalties + size).tolist()
    more = size + truncation
    total, before = [0.0] * n, [0] * n
    near, far = [0], []  # places by index, with ascending totals: within one window, within two
    near_head = far_head = 0
    late = 0  # the next index that passes from reach of one window to reach of two
    for j in range(1, n):
        least = near_from[j]
        while near[near_head] < least:
            near_head += 1
        frm = near[near_head]
        t = total[frm]
        if least:
            while late < least:
                x = total[late]
                while len(far) > far_head and total[far[-1]] >= x:
                    far.pop()
                far.append(late)
                late += 1
            least = far_from[j]
            while far[far_head] < least:
                far_head += 1
            other = total[far[far_head]] + more
            if other < t:
                t, frm = other, far[far_head]
        before[j] = frm
        t = total[j] = t + extra[j]
        while len(near) > near_head and total[near[-1]] >= t:
            near.pop()
        near.append(j)
    return np.array(total) - places, before


def cut_stream(ends: np.ndarray, sentences: np.ndarray, total: int, size: int, last: bool) -> list[int]:
    """Ends of the sequences of a stream of ``total`` ids; without ``last``, an end part of less than ``size`` ids is left over.

    ``ends``: places after documents; ``sentences``: places after sentences.
    """
    places = np.unique(np.concatenate([[0], ends, sentences, [total]]))
    gaps = np.diff(places)
    fill = gaps // GAP * (gaps > GAP)
    extra = np.repeat(places[:-1], fill) + GAP * (ragged(np.zeros(len(fill), np.int64), fill) + 1)
    penalty = np.concatenate([np.full(len(places), SENTENCE), np.full(len(extra), TRUNCATION)])
    penalty[: len(places)][np.isin(places, ends) | (places == 0) | (places == total)] = 0.0
    places, first = np.unique(np.concatenate([places, extra]), return_index=True)
    cost, before = best_cuts(places, penalty[first], size, TRUNCATION)
    where = places.tolist()
    j = len(where) - 1
    if not last:
        # what follows the last cut is packed with the next documents
        low = int(np.searchsorted(places, total - size + 1))
        j = low + int(np.argmin(cost[low:]))
    cuts = []
    while j > 0:
        cuts.append(where[j])
        if where[j] - where[before[j]] > size:
            cuts.append(where[before[j]] + size)
        j = before[j]
    cuts.reverse()
    if last and cuts:
        # a power of two is not padded: the last sequence is split into powers of two if that costs less
        length = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
        if length & (length - 1) and (length.bit_count() - 1) * TRUNCATION < size - length:
            at = cuts.pop() - length
            for bit in range(length.bit_length() - 1, -1, -1):
                if length >> bit & 1:
                    at += 1 << bit
                    cuts.append(at)
    return cuts


def _pack(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(path, Encoder)  # so that the tasks of a worker process share the cache
        closes = encoder.sentence_ends()
        number = TaskContext.get().partitionId() << 36
        held = np.empty(0, np.uint32)
        rows = np.empty((0, 4), np.int64)  # document number, ids of it before, ids of it here, ids in all
        names: list = []

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal held, rows, names, number
            if not len(held):
                return None
            stops = np.cumsum(rows[:, 2])
            sentences = np.flatnonzero(closes[np.minimum(held, len(closes) - 1)]) + 1
            cuts = np.array(cut_stream(stops, sentences, len(held), size, last), np.int64)
            if not len(cuts):
                return None
            bounds = np.unique(np.concatenate([[0], cuts, stops[stops <= cuts[-1]]]))
            a, b = bounds[:-1], bounds[1:]
            doc = np.searchsorted(stops, a, side="right")
            seq = np.searchsorted(cuts, a, side="right")
            begin = np.concatenate([[0], cuts])[seq]
            raw = held.astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k] for k in doc.tolist()], pa.int64()),
                    pa.array(rows[doc, 1] + a - (stops[doc] - rows[doc, 2])),
                    pa.array(b - a),
                    pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                    pa.array(rows[doc, 3]),
                    pa.array(number + seq),
                    pa.array(a - begin),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            number += len(cuts)
            done = int(cuts[-1])
            k = int(np.searchsorted(stops, done, side="right"))
            rest = rows[k:].copy()
            if len(rest):
                used = done - (int(stops[k]) - rows[k, 2])
                rest[0, 1] += used
                rest[0, 2] -= used
            held, rows, names = held[done:], rest, names[k:]
            return out

        for table in flushes(batches, "text", FLUSH_BYTES, None, keep=path):
            ids, counts = encoder.encode(texts_of(table["text"]))
            ends = np.cumsum(counts)
            full = np.insert(ids, ends, np.uint32(end_id))
            fresh = np.stack([np.arange(len(counts)), np.zeros_like(counts), counts + 1, counts + 1], axis=1)
            held, rows = np.concatenate([held, full]), np.concatenate([rows, fresh])
            names = names + table["doc_id"].to_pylist()
            if (out := emit(False)) is not None:
                yield out
        if (out := emit(True)) is not None:
            yield out

    return run


def pack(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", size: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` ids, in the order of each partition.

    Columns: doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens (ids of the document, with the end id), sequence_id (unique, ascending in a partition), offset.
    Cuts fall at the ends of documents or sentences or, for a penalty, elsewhere, so that padding and penalties are
    least; each id lies in one piece.  Each partition is packed as a stream in bounded memory, without a shuffle.

    Null and empty texts have the end id alone.  Repeated rows are packed again; a null id stays null; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _pack(path, size, end_id), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
