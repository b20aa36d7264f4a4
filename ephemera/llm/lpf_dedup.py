"""Exact substring deduplication by longest-previous-factor arrays over shards of shared text.

Equal strings of ``length`` bytes choose the same *anchor*: the least hash of the ``GRAM``-byte strings in them.  So
only texts around anchors that occur twice can hold a repeat, and all occurrences of a string meet where their anchor
is dealt.  Each anchor occurrence owns the string starts that chose it; its context is the bytes of those strings.

1. Anchors leave as packed arrays, dealt by hash; those that occur twice return to their documents as places.
2. Contexts of such anchors leave, dealt by anchor hash.  A shard puts its contexts in text order (document, place) and
   builds their suffix order by rank doubling, the common prefixes of neighbours in it, and from the previous and next
   smaller places of each suffix its longest previous factor, all to depth ``length``.
3. Starts whose longest previous factor has ``length`` bytes return as ranges; documents merge them and cut the bytes
   covered.

Equal contexts need no suffix order: the earliest stays, later ones repeat it whole.  Tasks settle those of a flush
before the shuffle, so a passage in a third of all documents reaches a shard once per flush.

Anchors of more than ``HOT`` documents (a short phrase with different words around it) would fill one shard: their
string starts are dealt singly, by a 128-bit hash of the whole string, and all but the first of equal ones repeat.
A shard settles the other anchors in pieces of about ``PIECE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ephemera.llm.common import U64, flushes, list_array, mix, ragged, shuffle_partitions, stored, texts_of

GRAM = 32
FLUSH_BYTES = 8 << 20
HOT = 20_000  # documents of an anchor from which on its strings are dealt singly
PIECE_BYTES = 2 << 20  # contexts settled, or string starts compared, at once
HEAD = 64  # characters of a text by which the rows of one id are dealt out in order
RANGE_BYTES = 64 << 20  # text for each partition of the shuffles, at most, as an average
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], U64)
_OTHER = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=1) for b in range(256)], U64)


def gram_hashes(data: np.ndarray, n: int, of_byte: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of every ``n`` bytes, ``n`` a power of two, by doubling."""
    h, k = of_byte[data], 1
    while k < n:
        h = mix(h[:-k] * U64(0x9E3779B97F4A7C15) + h[k:] * U64(0xC2B2AE3D27D4EB4F)) if len(h) > k else h[:0]
        k *= 2
    return h


def string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of the ``length`` bytes from each of ``at``: two overlapping powers of two cover them."""
    n = 1 << (length.bit_length() - 1)
    out = []
    for of_byte in (_BYTE, _OTHER):
        g = gram_hashes(data, n, of_byte)
        out.append(mix(g[at] * U64(0xC2B2AE3D27D4EB4F) + g[at + length - n] * U64(0x9E3779B97F4A7C15)))
    return np.stack(out, axis=1)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value (leftmost of equals) in each run of ``w`` values, by van Herk's two scans over blocks."""
    m = len(h) - w + 1
    if m <= 0:
        return np.empty(0, np.int64)
    pad = -len(h) % w
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:m], left[w - 1 : w - 1 + m])
    # starts with one least value form a run; its occurrences in reach, in order, are where the run's starts look
    head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(head, m))
    reach = ragged(head, size + w - 1)
    run = np.repeat(np.arange(len(head)), size + w - 1)
    hit = h[reach] == least[head][run]
    at, run = reach[hit], run[hit]
    starts = np.repeat(np.arange(len(head)), size) * (len(h) + 1) + np.arange(m)
    return at[np.searchsorted(run * (len(h) + 1) + at, starts)]


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places of a text, the first and last start that chose each, and the anchors' hashes."""
    h = gram_hashes(data, GRAM)
    chosen = window_minima(h, length - GRAM + 1)
    if not len(chosen):
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, U64)
    head = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(head[1:], len(chosen)) - 1
    return chosen[head], head, last, h[chosen[head]]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * U64(0xD6E8FEB86659FD93)) >> U64(40)).astype(np.int64) % buckets


def _all_anchors(texts: list[bytes], length: int):
    """Anchors of a flush: row, place, first start, last start, hash."""
    parts = [anchors(np.frombuffer(t, np.uint8), length) for t in texts]
    n = np.fromiter((len(p[0]) for p in parts), np.int64, len(parts))
    cat = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4)]
    return np.repeat(np.arange(len(texts)), n), *cat


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Columns cut by bucket (already in bucket order)."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield int(bucket[a]), [c[a:b].tobytes() for c in columns]


def _emit_anchors(length: int, buckets: int):
    """Packed (hash, document key) of all anchors; the second and later in one document say so themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches, "body", FLUSH_BYTES):
            row, _, _, _, h = _all_anchors(texts_of(table["body"]), length)
            keys = np.array(table["key"].to_pylist(), np.int64)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, bool)
            first = np.flatnonzero(fresh)
            times = np.minimum(np.diff(np.append(first, len(h))), 2).astype(np.int8)
            h, row = h[first], row[first]
            b = _bucket(h, buckets)
            order = np.argsort(b, kind="stable")
            out = list(_blobs(b[order], [h[order], keys[row[order]], times[order]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[1][k] for x in out], pa.binary()) for k in range(3))],
                names=["bucket", "h", "key", "times"],
            )

    return run


def _shared_anchors(hot: int):
    """For each document the hashes of this range that occur twice or more in all, and those in over ``hot`` documents."""
    return lambda batches: _shared(batches, hot)


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    parts = [[np.frombuffer(x, t) for x in b.column(k).to_pylist()] for b in batches for k, t in ((0, U64), (1, np.int64), (2, np.int8))]
    if not parts:
        return
    h, key, times = (np.concatenate([x for p in parts[k::3] for x in p]) for k in range(3))
    order = np.argsort(h, kind="stable")
    h, key, times = h[order], key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    total = np.add.reduceat(times.astype(np.int64), first)
    size = np.diff(np.append(first, len(h)))
    many, often = np.repeat(total > 1, size), np.repeat(size > hot, size)
    h, key, often = h[many], key[many], often[many]
    if not len(h):
        return
    order = np.argsort(key, kind="stable")
    h, key, often = h[order], key[order], often[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts, n_often = np.diff(np.append(first, len(h))), np.add.reduceat(often.astype(np.int64), first)
    for a in range(0, len(first), 10_000):
        part = slice(first[a], first[a] + int(counts[a : a + 10_000].sum()))
        lists = [list_array(h[part].view(np.int64), counts[a : a + 10_000], pa.int64()), list_array(h[part][often[part]].view(np.int64), n_often[a : a + 10_000], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(key[first[a : a + 10_000]]), *lists], names=["key", "shared", "hot"])


def _copies(raw: list[bytes], keys: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of contexts in text order: the first of each content, and all its later copies."""
    seen: set[bytes] = set()
    first, later = [], []
    for k in np.lexsort((lo, keys)).tolist():
        (later if raw[k] in seen else first).append(k)
        seen.add(raw[k])
    return np.array(first, np.int64), np.array(later, np.int64)


def _pieces(own: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Indices cut, in order, where their sizes fill PIECE_BYTES."""
    filled = np.cumsum(sizes[own]) // PIECE_BYTES
    return np.split(own, np.flatnonzero(np.diff(filled)) + 1) if len(own) else []


def _repeated(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (two hashes, document, place): the first of each string in text order, and its later copies."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    copy = np.concatenate([[False], (rows[1:, :2] == rows[:-1, :2]).all(axis=1)])
    return rows[~copy], rows[copy]


def _starts(raw: list[bytes], keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """The string starts of contexts, dealt by their strings (without context), and those already settled here."""
    n = hi - lo + 1
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = n + length - 1
    hashes = string_hashes(data, ragged(np.cumsum(size) - size, n), length).view(np.int64)
    first, later = _repeated(np.column_stack([hashes, np.repeat(keys, n), ragged(lo, n)]))
    b = _bucket(first[:, 0].copy().view(U64), buckets)
    by = np.argsort(b, kind="stable")
    out = [(k, blobs[0], b"") for k, blobs in _blobs(b[by], [first[by]])]
    return [*out, (-1, later[:, [2, 3, 3, 3]].tobytes(), b"")] if len(later) else out


def _emit_contexts(length: int, buckets: int):
    """Packed contexts of shared anchors, and the starts already settled here, as ranges by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches, "body", FLUSH_BYTES):
            texts = texts_of(table["body"])
            keys = np.array(table["key"].to_pylist(), np.int64)
            row, place, lo, hi, h = _all_anchors(texts, length)
            n = np.bincount(row, minlength=len(texts))
            at = np.cumsum(n) - n

            def among(name: str, h: np.ndarray = h, at: list[int] = at.tolist(), n: list[int] = n.tolist(), table: pa.Table = table) -> np.ndarray:
                lists = (np.array([] if s is None else s, np.int64).view(U64) for s in table[name].to_pylist())
                return np.concatenate([np.isin(h[a : a + k], s) for a, k, s in zip(at, n, lists, strict=True)] or [np.empty(0, bool)])

            keep, hot = among("shared"), among("hot")
            row, place, lo, hi, h, hot = (x[keep] for x in (row, place, lo, hi, h, hot))
            if not len(row):
                continue
            raw = [texts[r][a : z + length] for r, a, z in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            first, later = _copies(raw, keys[row], lo)
            out = []
            for own in _pieces(first[hot[first]], hi - lo + length):
                out += _starts([raw[k] for k in own.tolist()], keys[row[own]], lo[own], hi[own], length, buckets)
            f = first[~hot[first]]
            b = _bucket(h[f], buckets)
            by = np.argsort(b, kind="stable")
            f, b = f[by], b[by]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = f[a:z]
                meta = np.stack([keys[row[own]], lo[own], hi[own], h[own].view(np.int64)], axis=1)
                out.append((int(b[a]), meta.tobytes(), b"".join(raw[k] for k in own.tolist())))
            if len(later):
                out.append((-1, np.stack([keys[row[later]], lo[later], hi[later], hi[later]], axis=1).tobytes(), b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
                names=["bucket", "meta", "context"],
            )

    return run


def suffix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(k, rank of the ``k`` bytes from each place) for k = 1, 2, 4, ... up to ``depth``, which is the last; by doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word, out = np.zeros(n, U64), []
    for k in range(min(8, depth)):
        word = (word << U64(8)) | padded[k : n + k].astype(U64)
        if k + 1 in (1, 2, 4):
            out.append((k + 1, word.astype(np.uint32)))
    rank, k = np.unique(word, return_inverse=True)[1].astype(np.int32), min(8, depth)
    out.append((k, rank))
    while k < depth:
        step = min(k, depth - k)
        pairs = np.zeros(n, np.int64)
        pairs[: n - step] = rank[: n - step].astype(np.int64) * n + rank[step:]
        pairs[n - step :] = rank[n - step :].astype(np.int64) * n
        rank, k = np.unique(pairs, return_inverse=True)[1].astype(np.int32), k + step
        out.append((k, rank))
    return out


def common_prefixes(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of the suffixes at ``a`` and ``b``, by halving steps over equal ranks."""
    out = np.zeros(len(a), np.int64)
    n = len(ranks[0][1])
    for k, rank in reversed(ranks):
        fits = np.flatnonzero((out + k <= most) & (np.maximum(a, b) + out < n))
        fits = fits[rank[a[fits] + out[fits]] == rank[b[fits] + out[fits]]]
        out[fits] += k
    return out


def nearest_smaller(places: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place, in suffix order, the prefix it shares with the nearest smaller place before it in that order.

    ``lcp[k]`` is the common prefix of entries k - 1 and k.  All entries follow the pointers of the larger places
    before them at once, with the least prefix on the way; each round at least halves what a falling run has left.
    """
    m = len(places)
    known = np.append(places, -1)  # a pointer of -1 meets this one and stops
    at, low = np.arange(m) - 1, lcp.copy()
    live = np.arange(m)
    while len(live := live[known[at[live]] > places[live]]):
        p = at[live]
        at[live], low[live] = at[p], np.minimum(low[live], low[p])
    low[at < 0] = 0
    return low


def previous_factors(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factors, up to ``length`` bytes, of contexts in text order, joined in ``data``.

    For each start the longest string from there that also begins earlier, among the starts from which ``length`` bytes
    fit in their context (0 for others): the larger of the prefixes shared with the previous and the next smaller
    place in suffix order, where equal strings stand in text order.
    """
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(len(data)) + length <= ends)
    out = np.zeros(len(data), np.int64)
    if len(starts) < 2:
        return out
    ranks = suffix_ranks(data, length)
    order = starts[np.argsort(ranks[-1][1][starts], kind="stable")]
    lcp = np.concatenate([[0], common_prefixes(ranks, order[:-1], order[1:], length)])
    before = nearest_smaller(order, lcp)
    behind = nearest_smaller(order[::-1], np.concatenate([[0], lcp[:0:-1]]))[::-1]
    out[order] = np.maximum(before, behind)
    return out


def _find_repeats(length: int):
    """Ranges of starts with a previous factor, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[bytes]]] = {}
        starts: list[np.ndarray] = []
        for b in batches:
            for bucket, meta, context in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = np.frombuffer(meta, np.int64).reshape(-1, 4)
                if bucket < 0:
                    yield _ranges(rows[:, 0], rows[:, 1], rows[:, 2])
                elif not context:
                    starts.append(rows)
                else:
                    own = held.setdefault(bucket, ([], []))
                    own[0].append(rows)
                    stops = np.cumsum(rows[:, 2] - rows[:, 1] + length).tolist()
                    own[1].extend(context[a:z] for a, z in zip([0, *stops[:-1]], stops, strict=True))
        deal = 1 + sum(map(len, starts)) // PIECE_BYTES
        for k in range(deal if starts else 0):
            _, later = _repeated(np.concatenate([x[x[:, 1].view(U64) % U64(deal) == k] for x in starts]))
            yield _ranges(later[:, 2], later[:, 3], later[:, 3])
        while held:
            _, (metas, raw) = held.popitem()
            meta = np.concatenate(metas)
            sizes = meta[:, 2] - meta[:, 1] + length
            by = np.argsort(meta[:, 3], kind="stable")
            # whole anchors: only contexts of one anchor can hold equal strings
            anchor = np.flatnonzero(np.concatenate([[True], np.diff(meta[by, 3]) != 0]))
            for group in _pieces(np.arange(len(anchor)), np.add.reduceat(sizes[by], anchor)):
                own = by[anchor[group[0]] : anchor[group[-1] + 1] if group[-1] + 1 < len(anchor) else len(by)]
                yield from settle(meta[own], [raw[k] for k in own.tolist()])

    def settle(meta: np.ndarray, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        first, later = _copies(raw, meta[:, 0], meta[:, 1])
        yield _ranges(meta[later, 0], meta[later, 1], meta[later, 2])
        # an anchor with one content left has no other occurrence to compare with
        _, group, size = np.unique(meta[first, 3], return_inverse=True, return_counts=True)
        first = first[size[group] > 1]
        if not len(first):
            return
        own = meta[first]
        sizes = own[:, 2] - own[:, 1] + length
        data = np.frombuffer(b"".join(raw[k] for k in first.tolist()), np.uint8)
        flags = previous_factors(data, sizes, length) >= length
        edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
        a, z = edge[::2], edge[1::2] - 1
        base = np.cumsum(sizes) - sizes
        which = np.searchsorted(base, a, side="right") - 1
        yield _ranges(own[which, 0], own[which, 1] + a - base[which], own[which, 1] + z - base[which])

    return run


def _ranges(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges of starts, one row for each document, merged where they touch."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    packed = np.stack([lo, hi], axis=1).astype(np.int64)
    blobs = [packed[a : a + n].tobytes() for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key[first], pa.int64()), pa.array(blobs, pa.binary())], names=["key", "ranges"])


def _cut(length: int, names: list[str]):
    """Texts without covered bytes, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_bytes, n_removed, spans = [], [], [], []
            for text, ranges in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                runs: list[tuple[int, int]] = []
                for lo, hi in sorted(tuple(x) for blob in ranges or [] for x in np.frombuffer(blob, np.int64).reshape(-1, 2).tolist()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], hi + length))
                    else:
                        runs.append((lo, hi + length))
                at, out = 0, []
                for lo, end in runs:
                    out.append(text[at:lo])
                    at = end
                kept.append(b"".join([*out, text[at:]]))
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": lo, "end": end} for lo, end in runs])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=names
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): each text as UTF-8 without the bytes that repeat an earlier one.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document of smaller id, or
    in its own, before.  Matches may overlap, never cross documents, and are judged on the input.  ``spans`` are the
    maximal removed runs, in bytes; ``kept`` is what remains, as bytes (a run may begin or end within a character).

    Null text counts as empty.  Rows that repeat an id are ordered by text, equal ones anyhow: then all rows, of any
    ids, are numbered in order by ranges, and stored once; rows with a null id are returned uncut.  An empty table gives an empty
    result; other columns are ignored.  Around anchors of more than ``hot`` documents strings are compared by 128-bit
    hashes, elsewhere by their bytes.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("body"))
    known = rows.where("key is not null")
    per = known.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("size"))
    most, size = (x or 0 for x in per.agg(F.max("n"), F.sum("size")).first())
    # a partition holds the anchors of so much text, whatever the session's number of partitions
    parts = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    doc_id = F.col("key").alias("doc_id")
    if most > 1:  # the order of documents needs a number for each row; starts of texts deal out the rows of one id
        known = known.withColumns({"doc_id": F.col("key"), "head": F.substring("body", 1, HEAD)}).repartitionByRange(parts, "key", "head")
        known = stored(known.sortWithinPartitions("key", "body").select(F.monotonically_increasing_id().alias("key"), "body", "doc_id"))
        doc_id = F.col("doc_id")
    known = known.repartition(parts, "key")
    packed = known.select("key", "body").mapInArrow(_emit_anchors(length, parts), "bucket int, h binary, key binary, times binary")
    shared = packed.repartitionById(parts, "bucket").select("h", "key", "times").mapInArrow(_shared_anchors(hot), "key long, shared array<long>, hot array<long>")
    shared = shared.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("shared", "hot")))
    contexts = known.join(shared, "key").select("key", "body", "shared", "hot").mapInArrow(_emit_contexts(length, parts), "bucket int, meta binary, context binary")
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("meta"), F.lit(parts)).cast("int")).otherwise(F.col("bucket"))
    found = contexts.withColumn("to", spread).repartitionById(parts, "to").drop("to").mapInArrow(_find_repeats(length), "key long, ranges binary")
    found = found.groupBy("key").agg(F.collect_list("ranges").alias("ranges"))
    joined = known.join(found, "key", "left").select(doc_id, "body", "ranges")
    joined = joined.unionByName(rows.where("key is null").select(F.col("key").alias("doc_id"), "body", F.lit(None).cast("array<binary>").alias("ranges")))
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    return joined.mapInArrow(_cut(length, names), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
