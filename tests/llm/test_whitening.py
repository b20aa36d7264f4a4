"""Embedding whitening against numpy, with nulls, other lengths, repeats, flat directions and clashing names."""

import math
import random

import numpy as np
import pytest

from ephemera.llm import whitening
from ephemera.llm.queries import op13_embedding_whitening
from ephemera.llm.symmetric_eigen import below, leading_pairs, tridiagonal
from ephemera.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=32):
    """Exact deviations, and whitening by numpy's eigenvectors."""
    kept = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[a - s / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, z = np.linalg.eigh(centred.T @ centred / n)
    e, z = e[::-1], z[:, ::-1]
    k = min(components, int((e > 1e-10 * e.sum()).sum()))
    return [i for i, _ in kept], n, deviation, centred @ z[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    base = (r.normal(size=(400, 12)) * np.linspace(0.1, 1, 12)).astype(np.float32)
    out = [(k, v) for k, v in enumerate(base.tolist())] + [(7, base[7].tolist()), (7, base[7].tolist()), (None, base[1].tolist())]
    bad = [base[0].tolist() for _ in range(3)]
    bad[0][3], bad[1][0], bad[2][11] = None, float("nan"), float("-inf")
    return out + [(1000, None)] + [(1001 + k, v) for k, v in enumerate(bad)]


@pytest.mark.parametrize("cells", [30, 1 << 21])
def test_equals_numpy(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(whitening, "CELLS", cells)
    found = whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5), components=9).collect()
    ids, n, deviation, white, explained = plain(rows, 9)
    key = lambda i, d, first: (i is None, i or 0, int(d), round(abs(first), 6))
    found.sort(key=lambda r: key(r.vec_id, r.deviation, r.whitened[0]))
    order = sorted(range(len(ids)), key=lambda k: key(ids[k], deviation[k], white[k, 0]))
    assert [(r.vec_id, int(r.deviation), r.n) for r in found] == [(ids[k], deviation[k], n) for k in order]
    got = np.array([r.whitened for r in found])
    signs = np.sign((got * white[order]).sum(axis=0))
    assert np.abs(got * signs - white[order]).max() < 1e-9
    assert np.allclose(found[0].explained, explained, rtol=1e-12) and found[0].identity_error < 1e-9


def test_tables_without_spread(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [None], 1)], SCHEMA)).collect() == []
    for many in (1, 5):
        got = whiten(spark.createDataFrame([(1, [0.5, -2.0], 1)] * many, SCHEMA)).collect()
        assert [(list(r.whitened), list(r.explained), r.deviation, r.n, r.identity_error) for r in got] == [([], [], 0, many, 0.0)] * many
    flat = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0], 1) for k in range(6)], SCHEMA)).collect()
    assert {len(r.whitened) for r in flat} == {1} and flat[0].identity_error < 1e-9


def test_other_lengths_and_names_that_are_taken(spark):
    rows = [(k, [float(k % 3), float(k % 5)], 1, "a", k) for k in range(20)] + [(50, [1.0], 1, "b", 0), (51, [1.0, 2.0, 3.0], 1, "c", 0)]
    got = whiten(spark.createDataFrame(rows, SCHEMA + ", whitened string, N int"))
    assert got.columns == ["vec_id", "embedding", "label", "whitened", "N", "deviation", "whitened_", "n_", "explained", "identity_error"]
    assert sorted(r.vec_id for r in got.collect()) == list(range(20))
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA))


def test_exact_sums_of_large_numbers(spark):
    r = random.Random(2)
    rows = [(k, [r.uniform(-1e13, 1e13), r.uniform(-1, 1)]) for k in range(30)]
    got = {x.vec_id: int(x.deviation) for x in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ids, _, deviation, _, _ = plain(rows)
    assert got == dict(zip(ids, deviation, strict=True))


def test_eigenpairs_with_clusters():
    r = np.random.default_rng(0)
    q = np.linalg.qr(r.normal(size=(40, 40)))[0]
    for spectrum in (np.repeat([5.0, 2.0, 1.0, 0.0], 10), 1 + np.arange(40) * 1e-9, np.arange(40.0), np.zeros(40)):
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        values, z = leading_pairs(v, 15)
        scale = max(1e-300, spectrum.max())
        assert np.abs(values - np.sort(spectrum)[::-1][:15]).max() < 1e-13 * scale + 1e-300
        assert np.abs(v @ z - z * values).max() < 1e-13 * scale + 1e-300 and np.abs(z.T @ z - np.eye(15)).max() < 1e-13
    a = r.normal(size=(9, 9))
    d, e, _ = tridiagonal(a + a.T)
    w = np.linalg.eigvalsh(a + a.T)
    assert below(d, e, (w[:-1] + w[1:]) / 2).tolist() == list(range(1, 9))


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, white, explained = plain(rows)
    got = op13_embedding_whitening(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    found = got.orderBy("component", "vec_id").collect()
    assert len(found) == len(ids) * white.shape[1] and max(r.identity_error for r in found) < 1e-9
    order = np.argsort(ids)
    for k in range(white.shape[1]):
        own = found[k * len(ids) : (k + 1) * len(ids)]
        sign = np.sign(own[0].whitened * white[order[0], k])
        assert np.abs(np.array([r.whitened for r in own]) * sign - white[order, k]).max() < 1e-6
        assert abs(own[0].explained - explained[k]) < 1e-10 and [r.deviation for r in own] == [deviation[j] for j in order]
