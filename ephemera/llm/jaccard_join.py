"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection.

Plan (all exact, for any data):

1. Each text becomes its set of word shingles; rows with the same set form one *class* (partial aggregation).
2. Two sets of Jaccard similarity ``t`` or more share many of their smallest hashes: of the first
   ``floor((1-t)n) + l`` hashes of a set, ``l`` at least are among its partner's first ones (``l`` grows with n).
   Those prefixes are shuffled by hash range as packed arrays; a reducer returns the hashes that two classes share.
3. Classes with too few shared hashes have no partner and are dropped.  Of the rest only the rarest
   ``s - l + 1`` shared hashes can be the first that a pair has in common; equal ones connect *candidates*.
4. Each connected set of candidates is cut into geometric size bands, large bands into blocks; compatible blocks
   form tiles of bounded size.  In a tile, hashed bitmaps bound each overlap from above by bit counts, and what remains
   is settled by intersecting sorted arrays.
5. A tile returns for each class how many documents its links lead to and one class that it is connected with, never
   the pairs, and equal texts are one class, so neither copies nor groups of near copies are expanded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ephemera.llm.common import (
    U64,
    WordHash,
    checkpointed,
    flushes,
    free_name,
    list_array,
    mix,
    offsets_of,
    ragged,
    release_memory,
    shingle_sets,
    shuffle_partitions,
    stored,
    texts_of,
)
from ephemera.llm.components import connected_components

FLUSH_BYTES = 4 << 20
PREFIX_SHARE = 10  # l(n) = n // PREFIX_SHARE, at least 1
BLOCK = 5_000  # classes in a block of a tile
BLOCK_SHINGLES = 4_000_000  # shingles in a block, about
RANGE_BYTES = 48 << 20  # packed prefixes that a reducer holds, on average


def _extra(n):
    return np.maximum(1, n // PREFIX_SHARE)


def _class_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for table in flushes(batches, "text", FLUSH_BYTES, None):
            sets = shingle_sets(texts_of(table["text"]), n, cache)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "cls"],
            )

    return run


def _prefixes(n: int, num: int, den: int, buckets: int):
    """Packed prefixes by hash bucket; each class once per flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for table in flushes(batches, "text", FLUSH_BYTES, None):
            classes = {}
            for s in shingle_sets(texts_of(table["text"]), n, cache):
                if len(s):
                    classes.setdefault(_class_of(s), s)
            if not classes:
                continue
            size = np.fromiter(map(len, classes.values()), np.int64, len(classes))
            take = np.minimum(size, size - (num * size + den - 1) // den + _extra(size))
            h = np.concatenate([s[:k] for s, k in zip(classes.values(), take.tolist(), strict=True)])
            owner = np.repeat(np.arange(len(size)), take)
            bucket = ((h * U64(0xD6E8FEB86659FD93)) >> U64(40)).astype(np.int64) % buckets
            order = np.lexsort((owner, bucket))
            h, owner, bucket = h[order], owner[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])]))
            counts = np.diff(np.append(new, len(h)))
            ids = np.fromiter(classes.keys(), np.int64, len(classes))
            rows = np.stack([ids[owner[new]], size[owner[new]], counts], axis=1)
            edges = np.flatnonzero(np.diff(bucket[new])) + 1
            heads = np.concatenate([[0], edges, [len(new)]])
            flat = np.append(new, len(h))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[new][heads[:-1]].astype(np.int32)),
                    pa.array([rows[a:b].tobytes() for a, b in zip(heads[:-1], heads[1:], strict=True)], pa.binary()),
                    pa.array([h[flat[a] : flat[b]].tobytes() for a, b in zip(heads[:-1], heads[1:], strict=True)], pa.binary()),
                ],
                names=["bucket", "owners", "hashes"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class the hashes of this range that another class has too, with the number of such classes."""
    owners, hashes = [], []
    for b in batches:
        owners += [np.frombuffer(x, np.int64).reshape(-1, 3) for x in b.column(0).to_pylist()]
        hashes += [np.frombuffer(x, U64) for x in b.column(1).to_pylist()]
    if not owners:
        return
    o, h = np.concatenate(owners), np.concatenate(hashes)
    ids, where = np.unique(o[:, 0], return_inverse=True)
    size = np.zeros(len(ids), np.int64)
    size[where] = o[:, 1]
    cls = np.repeat(where, o[:, 2])
    order = np.lexsort((cls, h))
    h, cls = h[order], cls[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])])
    h, cls = h[keep], cls[keep]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    runs = np.diff(np.append(first, len(h)))
    df = np.repeat(runs, runs)
    h, cls, df = h[df > 1], cls[df > 1], df[df > 1]
    if not len(h):
        return
    order = np.argsort(cls, kind="stable")
    h, cls, df = h[order], cls[order], df[order]
    first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    counts = np.diff(np.append(first, len(h)))
    for a in range(0, len(first), 5000):
        rows = slice(first[a], first[a] + int(counts[a : a + 5000].sum()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[cls[first[a : a + 5000]]]),
                pa.array(size[cls[first[a : a + 5000]]]),
                list_array(h[rows].view(np.int64), counts[a : a + 5000], pa.int64()),
                list_array(df[rows], counts[a : a + 5000], pa.int64()),
            ],
            names=["cls", "n", "h", "df"],
        )


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, as wide as the largest set needs (256 to 8,192)."""
    bits = 1 << min(13, max(8, math.ceil(math.log2(max(map(len, sets), default=1) + 1))))
    rows = []
    for at in range(0, len(sets), 1000):
        part = sets[at : at + 1000]
        out = np.zeros((len(part), bits), bool)
        for i, s in enumerate(part):
            out[i, (mix(s) >> U64(20)).astype(np.int64) & (bits - 1)] = True
        rows.append(np.packbits(out, axis=1))
    return np.concatenate(rows).view(U64)


def tile_links(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set (ascending by size) the least index of the sets that links lead to, and the weight of those it links with.

    With ``side`` only sets of different sides are compared.  Without ``weight`` pairs that are connected already are
    passed over, and the second result is 0.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    label, linked = np.arange(n), np.zeros(n, np.int64)
    bits = bitmaps(sets)
    # sorted arrays of places in the tile's own sorted vocabulary
    own = np.unique(np.concatenate(sets))
    every = np.concatenate([np.searchsorted(own, s).astype(np.int32) for s in sets])
    start, marks = offsets_of(size), np.zeros(len(own), bool)
    last = np.searchsorted(size, size * den // num, side="right")
    for i in range(n - 1):
        js = np.arange(i + 1, last[i])
        if side is not None:
            js = js[side[js] != side[i]]
        if weight is None:
            js = js[label[js] != label[i]]
        for at in range(0, len(js), 4096):
            part = js[at : at + 4096]
            only_i = np.bitwise_count(bits[i] & ~bits[part]).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(bits[part] & ~bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(size[i] - only_i, size[part] - only_j)
            # den * o >= num * (a + b - o)
            part = part[(den + num) * most >= num * (size[i] + size[part])]
            if not len(part):
                continue
            marks[every[start[i] : start[i + 1]]] = True
            for few in np.split(part, np.flatnonzero(np.diff(np.cumsum(size[part]) // BLOCK_SHINGLES)) + 1):
                common = np.add.reduceat(marks[every[ragged(start[few], size[few])]].astype(np.int64), offsets_of(size[few])[:-1])
                hits = few[(den + num) * common >= num * (size[i] + size[few])]
                if weight is not None:
                    linked[i] += weight[hits].sum()
                    linked[hits] += weight[i]
                for j in hits[label[hits] != label[i]].tolist():
                    if label[j] != label[i]:
                        a, b = sorted((label[i], label[j]))
                        label[label == b] = a
            marks[every[start[i] : start[i + 1]]] = False
    return label, linked


def _verify(n: int, num: int, den: int, count: bool):
    """Rows sorted by tile: links of each tile as (class, least linked class of the tile, documents that it links with there)."""

    def settle(rows: list[tuple[int, int, int, bytes]], cache: WordHash) -> list[list[int]]:
        found = {}
        while rows:  # texts are given up as their sets are made
            part = rows[-1000:]
            del rows[-1000:]
            for row, s in zip(part, shingle_sets([r[3] for r in part], n, cache), strict=True):
                if _class_of(s) == row[0]:  # a repeated id may carry another text
                    found.setdefault(row[0], (s, row[1], row[2]))
        items = sorted(found.items(), key=lambda x: len(x[1][0]))
        if len(items) < 2:
            return [[], [], []]
        side = np.array([v[1] for _, v in items])
        weight = np.array([v[2] for _, v in items], np.int64) if count else None
        label, linked = tile_links([v[0] for _, v in items], num, den, side if side.any() else None, weight)
        names = np.array([c for c, _ in items])
        some = np.flatnonzero((label != np.arange(len(items))) | (linked > 0))
        return [names[some].tolist(), names[label[some]].tolist(), linked[some].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, tile = WordHash(), [], None
        for b in batches:
            keys = b.column(0).to_pylist()
            out: list[list[int]] = [[], [], []]
            for key, side, cls, size, text in zip(keys, *(b.column(k).to_pylist() for k in (1, 2, 3)), texts_of(b.column(4)), strict=True):
                if key != tile:
                    for o, x in zip(out, settle(held, cache), strict=True):
                        o += x
                    held, tile = [], key
                held.append((cls, side, size, text))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v", "linked"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in settle(held, cache)], names=["u", "v", "linked"])
        del cache, held
        release_memory()

    return run


def _tiles(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(cls, tile, side): candidates of one component meet in a tile if their size bands are compatible; each pair meets once.

    Small components are one tile.  The bands of others are cut into blocks; a tile is a block alone (side 0) or two
    blocks (sides 0 and 1), whose classes are compared across only.
    """
    blocks_of = lambda rows: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias(rows)
    total = members.groupBy("component").agg(blocks_of("total"))
    bands = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9))
    blocks = bands.groupBy("component", "band").agg(blocks_of("blocks"))
    small = members.join(total.where("total <= 1"), "component").select(
        "cls", F.struct("component", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("a"), F.lit(0).alias("b")).alias("tile"), F.lit(0).alias("side")
    )
    large = bands.join(total.where("total > 1"), "component").join(blocks, ["component", "band"])
    mine = large.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    near = blocks.select("component", F.col("band").alias("other"), F.col("blocks").alias("others"))
    met = mine.join(near, "component").where(F.abs(F.col("band") - F.col("other")) <= 1)
    met = met.withColumn("its", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    x, y = F.struct(F.col("band").alias("k"), F.col("mine").alias("m")), F.struct(F.col("other").alias("k"), F.col("its").alias("m"))
    lo, hi = F.least(x, y), F.greatest(x, y)
    met = met.select(
        "cls",
        F.struct("component", lo["k"].cast("int").alias("i"), hi["k"].cast("int").alias("j"), lo["m"].cast("int").alias("a"), hi["m"].cast("int").alias("b")).alias("tile"),
        (x > y).cast("int").alias("side"),
    )
    return small.unionByName(met).select("cls", F.xxhash64("tile").alias("tile"), "side")


def jaccard_join(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, threshold: tuple[int, int] = (3, 4), block: int = BLOCK, links: bool = True
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row: the join of all texts with Jaccard >= num / den of word n-gram sets.

    n_links is the number of other rows that a row links with, and component_id the smallest id reachable by links.
    Words are runs without ASCII white space, A-Z lower-cased.  A text of fewer than ``n`` words has its whole
    sequence as one shingle.  Null or wordless text: n_shingles 0, component_id its own id, no links.  Repeated rows
    link with each other; rows with a null id are compared with nothing and get a null component.  An empty table gives
    an empty result; other columns are ignored, whatever their names.  Sets are compared by 64-bit hashes of their
    shingles.  Without ``links`` links are followed only until components are known, and n_links is left out.
    """
    spark, (num, den) = docs.sparkSession, threshold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classes = stored(rows.mapInArrow(_sets(n), "doc_id long, n_shingles long, cls long"))
    named = rows.where(F.col("doc_id").isNotNull())
    # rows without words or id belong to no one
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    sources = classes.where(~alone).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.max("n_shingles").alias("n"))
    sources = checkpointed(sources)
    # a reducer holds the prefixes of a range of hashes, whatever the session's number of partitions
    prefix = sources.agg(F.sum(F.col("n") * (den - num) / den + F.greatest(F.lit(1), F.col("n") / PREFIX_SHARE))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(8 * prefix / RANGE_BYTES))
    packed = named.select("text").mapInArrow(_prefixes(n, num, den, 8 * parts), "bucket int, owners binary, hashes binary")
    shared = packed.repartition(parts, "bucket").select("owners", "hashes").mapInArrow(_shared, "cls long, n long, h array<long>, df array<long>")
    # of the first floor((1-t)n) + l(n) hashes, l of the least size a partner can have are in common at least
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / den) / PREFIX_SHARE))
    mine = shared.groupBy("cls").agg(F.first("n").alias("n"), F.flatten(F.collect_list(F.arrays_zip("df", "h"))).alias("t"))
    mine = mine.where(F.size("t") >= least)
    rare = mine.select("cls", "n", F.explode(F.slice(F.sort_array("t"), F.lit(1), (F.size("t") - least + 1).cast("int"))).alias("t"))
    rare = checkpointed(rare.select("cls", "n", F.col("t.h").alias("h")))
    pivot = rare.groupBy("h").agg(F.min("cls").alias("p"))
    star = rare.join(pivot, "h").where("cls <> p").select("cls", "p").distinct()
    members = connected_components(star).select(F.col("id").alias("cls"), "component")
    members = checkpointed(members.join(sources.select("cls", "n"), "cls"))
    wanted = _tiles(members, num, den, block).join(sources.select("cls", "doc_id", "size"), "cls")
    texts = wanted.join(named, "doc_id").select("tile", "side", "cls", "size", "text").repartition(parts, "tile").sortWithinPartitions("tile")
    found = checkpointed(texts.mapInArrow(_verify(n, num, den, links), "u long, v long, linked long"))
    root = connected_components(found.select("u", "v")).select(F.col("id").alias("cls"), F.col("component").alias("root"))
    linked = found.groupBy(F.col("u").alias("cls")).agg(F.sum("linked").alias("linked"))
    per = sources.join(root, "cls", "left").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least_id = per.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    n_links = (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links")
    per = per.join(least_id, "root").select("cls", "component_id", n_links)
    names = ["doc_id", "n_shingles", "component_id", *(["n_links"] if links else [])]
    none = classes.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return classes.where(~alone).join(per, "cls").select(*names).unionByName(none.select(*names))


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays; of repeats of that id the first by its columns.

    Rows with a null id all stay.
    """
    found = jaccard_join(docs, text_col, id_col, links=False, **options).where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(found, id_col, "left_semi")
    return _one_per_id(kept, id_col).unionByName(docs.where(F.col(id_col).isNull()))


def _one_per_id(docs: DataFrame, id_col: str) -> DataFrame:
    rank = free_name(docs, "rank")
    order = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != id_col]
    ranked = docs.withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(*order, F.lit(0))))
    return ranked.where(F.col(rank) == 1).drop(rank)
