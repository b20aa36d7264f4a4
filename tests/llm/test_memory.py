"""What a worker process holds at once, and what it keeps between tasks."""

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from ephemera.llm import common, components, importance, jaccard_join, packing
from ephemera.llm.common import WordHash, flushes, shingle_sets


def batches(texts, rows=10_000):
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return table.to_batches(max_chunksize=rows)


def test_flushes_end_with_the_row_that_reaches_the_limit():
    rng = np.random.default_rng(5)
    texts = [None if k % 50 == 0 else "é" * int(rng.integers(0, 3000)) for k in range(3000)]
    got = list(flushes(batches(texts, 700), "text", 1 << 20, None))
    assert [x for t in got for x in t["text"].to_pylist()] == texts
    assert [x for t in got for x in t["doc_id"].to_pylist()] == list(range(3000))
    sizes = [sum(4 + len((x or "").encode()) for x in t["text"].to_pylist()) for t in got]
    assert all((1 << 20) <= s <= (1 << 20) + 6004 for s in sizes[:-1]) and sizes[-1] <= (1 << 20) + 6004
    assert not list(flushes(batches([]), "text", 9, None))
    assert [t.num_rows for t in flushes(batches(["a" * 100] * 3), "text", 9, None)] == [1, 1, 1]


@pytest.mark.parametrize("module", [importance, jaccard_join, packing])
def test_operators_work_in_pieces_of_their_limit(module, monkeypatch):
    """With texts of 5 KB, 2,000 rows were five to ten times the limit."""
    seen = []

    def spy(column, f=module.texts_of):
        seen.append(column.nbytes)
        return f(column)

    monkeypatch.setattr(module, "texts_of", spy)
    monkeypatch.setattr(module, "FLUSH_BYTES", 1 << 20)
    given = batches(["word " * 1000] * 1000)
    if module is importance:
        run = importance._count(type("Shared", (), {"value": {1}}), "doc_id", "text")
    elif module is jaccard_join:
        run = jaccard_join._sets(5)
    else:
        monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
        run = packing._pack(str(path("byte_bpe_50k.json")), 1024, 0)
    assert sum(b.num_rows for b in run(given))
    assert max(seen) <= (1 << 20) + 5100


def test_an_encoder_is_given_up_by_tasks_that_work_without_it(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    made = []
    assert common.kept("path", lambda k: made.append(k) or "encoder") == common.kept("path", made.append) == "encoder" and made == ["path"]
    list(flushes(batches(["a"]), "text", 9, None, keep="path"))
    assert list(common._KEPT) == ["path"]
    list(flushes(batches(["a"]), "text", 9))
    assert not common._KEPT


def test_tiles_of_over_a_thousand_texts():
    """Texts become sets a thousand at a time; the links are those of all."""
    texts = [f"{' '.join(f'w{k // 3}x{j}' for j in range(30))}{' tail' * (k % 3 == 1)}".encode() for k in range(2500)]
    names = [jaccard_join._class_of(s) for s in shingle_sets(texts, 5, WordHash())]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([7] * 2500), pa.array([0] * 2500), pa.array(names, pa.int64()), pa.array([1] * 2500), pa.array([t.decode() for t in texts])], names=["tile", "side", "cls", "size", "text"]
    )
    out = pa.Table.from_batches(list(jaccard_join._verify(5, 3, 4, True)(iter([rows])))).to_pydict()
    groups = {frozenset(names[k : k + 3]) for k in range(0, 2500, 3)}
    groups = {g for g in groups if len(g) > 1}
    assert {frozenset(p) for p in zip(out["u"], out["v"], strict=True) if p[0] != p[1]} == groups
    assert set(out["u"]) == set().union(*groups) and set(out["linked"]) == {1}


def test_rounds_on_few_edges_have_few_tasks(spark, monkeypatch):
    """A table of edges shrinks from round to round; its partitions, each a task that leaves files, follow."""
    before, parts = components._stars, []
    monkeypatch.setattr(components, "_stars", lambda pairs, *most: parts.append(pairs.rdd.getNumPartitions()) or before(pairs, *most))
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v").repartition(40)
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(k, 0) for k in range(301)}
    assert max(parts[::2]) <= 2
