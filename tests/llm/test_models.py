"""The trained operators: their models, weights and choices against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ephemera.llm import importance, pii
from ephemera.llm.common import WordHash

rnd = random.Random(12)
GOOD = ["the", "of", "and", "house", "green", "walks", "river", "to", "a", "stone", "Über", "naïve"]
BAD = ["BUY!!", "NOW!!", "| x |", "CLICK!!", "$$$"]


def prose(n, words=GOOD):
    return " ".join(rnd.choice(words) for _ in range(n))


# importance resampling


def plain_resample(rows, good, share, seed=7):
    """(id -> weight, kept ids) with the model counted by Counter and weights summed n-gram by n-gram."""
    grams = {}
    for i, t in rows:
        words, marks = importance.feature_ids([(t or "").encode()], WordHash())
        grams[i] = (words[0].tolist(), marks[0].tolist())
    weights = Counter()
    for k, base in ((0, 0), (1, importance.BUCKETS)):
        raw, target = Counter(), Counter()
        for i, _ in rows:
            raw.update(grams[i][k])
            if i in good:
                target.update(grams[i][k])
        n_raw, n_target = sum(raw.values()) + importance.BUCKETS, sum(target.values()) + importance.BUCKETS
        for i, _ in rows:
            for g in grams[i][k]:
                assert base <= g < base + importance.BUCKETS
                weights[i] += min(1.0, importance.LENGTH / len(grams[i][k])) * round((math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw)) * importance.SCALE) / importance.SCALE
    keys = {}
    for i, t in rows:
        h = xxhash.xxh3_64_intdigest((t or "").encode(), seed=xxhash.xxh3_64_intdigest(repr(i), seed=seed))
        keys[i] = weights[i] - math.log(-math.log(((h >> 12) + 0.5) / 2**52))
    best = sorted(keys, key=lambda i: -keys[i])[: round(share * len(rows))]
    return {i: weights[i] for i, _ in rows}, set(best)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_weights_and_choice_equal_plain(spark, kind):
    rows = [(k, prose(rnd.randrange(1, 60 if k % 9 else 400))) for k in range(150)] + [(200 + k, prose(30, BAD)) for k in range(40)] + [(300, None), (301, ""), (302, "x")]
    rows = [(i if kind == "long" else f"id{i}", t) for i, t in rows]
    labels = [(i, 1) for i, _ in rows[:80]] + [(i, 0) for i, _ in rows[150:170]]
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    lab = spark.createDataFrame(labels, f"doc_id {kind}, quality int")
    fitted = importance._labelled(lab, "doc_id", "quality", 10**6).where("label = 1").withColumn("half", F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string")), F.lit(4)))
    good = {r.id for r in fitted.where("half > 0").collect()}
    assert 40 < len(good) < 75
    for share in (0.2, 0.7):
        weights, best = plain_resample(rows, good, share)
        got = importance.importance_resample(d, lab, share=share).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(weights, abs=1e-9)
        assert {r.doc_id for r in got if r.kept} == best
    chosen = importance.importance_resample(d, lab, carry_text=False)
    assert chosen.columns == ["doc_id", "score", "kept"]
    lost = [r.doc_id for r in chosen.where("not kept").collect()]
    assert set(lost) >= {i for i, _ in rows[150:190]} and len(lost) <= 44


def test_equal_texts_weigh_the_same(spark):
    texts = [prose(40) for _ in range(30)]
    rows = [(k, texts[k % 30]) for k in range(300)] + [(1, texts[1]), (1, texts[1])]
    lab = spark.createDataFrame([(k, 1) for k in range(20)] + [(5, 1), (5, None), (6, 9)], "doc_id long, quality int")
    got = [importance.importance_resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), lab, share=0.5).collect() for n in (1, 7)]
    for part in got:
        assert all(len({r.score for r in part if r.text == t}) == 1 for t in texts)
        assert len({r.kept for r in part if r.doc_id == 1}) == 1
    assert {(r.doc_id, r.score, r.kept) for r in got[0]} == {(r.doc_id, r.score, r.kept) for r in got[1]}


# boosted trees for personal data


def labelled_texts(n):
    r = random.Random(3)
    digits = lambda k: "".join(r.choice("23456789") for _ in range(k))
    out = []
    for k in range(n):
        secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
        out += [
            f"plain words here then token = \"{secret}\" and words", f"the part name{k}_of_the_long-item here", f"call phone {digits(3)}-{digits(3)}-{digits(4)} now", f"stock of {digits(9)} pieces",
            f"write to u{k} [at] host{k} [dot] org today", f"look{k} [at] this [dot] thing{k} again",
        ]
    return out


def test_trees_equal_the_fitted_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    g = np.random.default_rng(5)
    x = g.normal(size=(400, 5)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    d = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").coalesce(1)
    model = GBTClassifier(maxIter=7, maxDepth=4, stepSize=0.3, seed=1).fit(d.select(array_to_vector("x").alias("features"), "label"))
    want = [r.probability[1] for r in model.transform(d.select(array_to_vector("x").alias("features"))).collect()]
    got = pii.Trees(model).probability(np.array([r.x for r in d.collect()]))
    assert got.tolist() == pytest.approx(want, abs=1e-12)


def test_fit_does_not_depend_on_partitioning_and_is_calibrated(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(labelled_texts(150))], "doc_id long, text string")
    a, b = pii.fit(d.repartition(2)), pii.fit(d.repartition(5))
    assert a.cuts == b.cuts and a.report == b.report
    assert {"secret", "number", "email"} <= set(a.report)
    for n, precision, recall in a.report.values():
        assert n >= 20 and precision >= pii.PRECISION and recall > 0.5
    assert pii.fit(d.where("text like 'the part%'")) is None


def test_fit_counts_the_candidates_of_all_documents(spark):
    """Held-out numbers, cut-offs, precision and recall equal those of a plain loop over every document of a larger table."""
    texts = labelled_texts(4000) + ["look [at] that [dot] org now"] * 500
    model = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    found = []
    for t in texts:
        for a, z, kind, label in pii.candidates(t, *pii.base_spans(t)) + pii.background(t):
            if label is not None:
                x = pii.features(t, a, z, kind)
                found.append((t[max(0, a - 24) : min(z, a + pii.CLIP) + 24], kind, label, x[: len(pii.FORMAT)] + [0.0] * len(pii.CONTEXT)))
    rows = spark.createDataFrame(found, "key string, kind string, label int, x array<double>").where("pmod(xxhash64(key), 10) < 3").collect()
    assert set(model.report) == {r.kind for r in rows}
    for kind, (n, precision, recall) in model.report.items():
        own = [r for r in rows if r.kind == kind]
        scored = list(zip(model.trees.probability(np.array([r.x for r in own])).tolist(), (r.label for r in own)))
        total, hits = dict.fromkeys(p for p, _ in scored), {}
        for cut in total:
            total[cut] = sum(p >= cut for p, _ in scored)
            hits[cut] = sum(y for p, y in scored if p >= cut)
        cut = min((max(0.5, p) for p in total if hits[p] >= pii.PRECISION * total[p]), default=1.1)
        passed = [y for p, y in scored if p >= cut]
        assert (n, model.cuts[kind]) == (len(own), cut)
        assert (precision, recall) == pytest.approx((sum(passed) / len(passed) if passed else 1.0, sum(passed) / max(1, sum(y for _, y in scored))))


def test_spans_have_any_length(spark):
    r = random.Random(1)
    random_text = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    long = [random_text(n) for n in (800, 100_000)]
    rows = list(enumerate(labelled_texts(100) + [f"password={x} and more" for x in long] + [f"see {x} too" for x in long] + [None, ""]))
    got = {x.doc_id: x.text for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), redact=True).collect()}
    at = 600
    assert [got[at + k] for k in range(4)] == ["password=<SECRET> and more"] * 2 + ["see <SECRET> too"] * 2
    assert got[at + 4] is None and got[at + 5] == ""
    spelled = "x" * 300 + " [at] " + "h" * 99 + " [dot] org"
    text = "9" * 5000 + " " + spelled
    found = pii.candidates(text, *pii.base_spans(text))
    assert (5001, len(text), "email", 1) in found and (0, 5000, "number", 0) in found
