"""Cases where an operator once did less than its whole job."""

import random
import string

import numpy as np
import pytest
from brute import repeats
from pyspark.sql import functions as F

from ephemera.llm import lpf_dedup
from ephemera.llm.license_scan import scan_licenses
from ephemera.llm.license_texts import license_texts
from ephemera.llm.pii import find_pii, outermost

# personal data


def secrets(k, n, alphabet=string.ascii_letters + string.digits + "-_"):
    r = random.Random(k)
    return "".join(r.choice(alphabet) for _ in range(n))


def test_long_secrets_are_covered_whole(spark):
    keyed = [f"note{k} password={k:04d}ab{k * 7919:x}f9c1 then plain words" for k in range(200)]
    jwt = [".".join(secrets(10 * k + j, n) for j, n in enumerate((40, 700, 60))) for k in range(5)]
    free = [secrets(k, 40 if k > 4 else 900, "0123456789abcdef") for k in range(100)]
    plain = [f"see part{k}of-the_long-name{k} end" for k in range(200)]
    rows = list(enumerate([f"see token={x} end" for x in jwt] + [f"see {x} end" for x in free] + keyed + plain))
    got = {r.doc_id: r.text for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), redact=True).collect()}
    assert [got[k] for k in range(5)] == ["see token=<SECRET> end"] * 5
    assert [got[k] for k in range(5, 10)] == ["see <SECRET> end"] * 5


def test_parts_do_not_replace_the_whole():
    passed = [(10, 60, 0.8, "secret"), (20, 40, 0.99, "secret"), (50, 70, 0.9, "secret"), (0, 5, 0.9, "number"), (80, 90, 0.7, "number"), (80, 90, 0.9, "secret")]
    assert outermost([(0, 5, "ip"), (12, 15, "email")], passed) == [(10, 60, "secret"), (50, 70, "secret"), (80, 90, "secret")]


def test_numbers_can_be_added(spark):
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    number = lambda k: f"{digits(3)}-{digits(3)}-{digits(4)}" if k % 2 else f"{digits(3)}-{digits(2)}-{digits(4)}"
    named = [f"note {k} {('phone', 'SSN', 'account', 'tel.')[k % 4]} {number(k)} and more" for k in range(150)]
    loose = [f"note {k} part {r.randrange(10**7, 10**9)} in stock, dated 20{k % 90 + 10}-{k % 3 + 10}-{k % 19 + 10} {k % 14 + 10}:30" for k in range(150)]
    asked = ["call 555-123-4567 or 555-123-4568 now", "has 123-45-6789 on file", "card 4111 1111 1111 1112 ok", "part 8723412 in stock", "dated 2024-01-02 10:30"]
    rows = list(enumerate(asked + named + loose))
    got = {x.doc_id: x.text for x in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), redact=True).collect()}
    assert [got[k] for k in range(3)] == ["call <NUMBER> or <NUMBER> now", "has <NUMBER> on file", "card <NUMBER> ok"]
    assert [got[3], got[4]] == asked[3:5]
    assert all(got[k] == rows[k][1] for k in range(5 + 150, len(rows)))


# licences


def test_licence_texts_and_notices(spark):
    r = random.Random(6)
    code = lambda n: " ".join(r.choice(["def", "return", "x", "value", "for", "the", "of", "and", "in", "self"]) + str(r.randrange(50)) for _ in range(n))
    wrap = lambda t: "\n".join(f"# {' '.join(w[k:k + 9])}" for w in [t.split()] for k in range(0, len(w), 9))
    known = license_texts()
    rows, want = [], {}
    for k, (tier, name, text) in enumerate(known):
        for j, body in enumerate([wrap("Copyright 2020 The Authors. " + text) + "\n" + code(300), f"/* {text} */ {code(80)}"]):
            rows.append((2 * k + j, f"d{k}/{j}/x.py", body))
            want[2 * k + j] = (name, "header")
    rows += [(900, "lic/notes", "MIT License\n\nCopyright (c) 2021 A B\n\n" + dict((n, t) for tier, n, t in known if tier == "text")["MIT"]), (901, "lic/a/x.py", code(30))]
    rows += [(902, "long/x.js", code(100) + " Licensed under the Apache License, Version 2.0. " + code(100)), (903, "wrapped/LICENSE", "Licensed under\nthe Apache License,\nVersion 2.0."), (904, "wrapped/a.py", code(20))]
    rows += [(905, "none/x.py", "All rights reserved, no licence. " + code(400)), (906, "none/y.py", "ask for permission to use the software " + code(40))]
    want |= {900: ("MIT", "header"), 901: ("MIT", "inherited"), 902: ("Apache-2.0", "header"), 903: ("Apache-2.0", "header"), 904: ("Apache-2.0", "inherited"), 905: (None, "none"), 906: (None, "none")}
    got = {x.doc_id: (x.license, x.origin) for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}


# substring deduplication


@pytest.mark.parametrize("hot", [0, 8, 10**6])
def test_repeats_around_a_common_phrase(spark, hot):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))
    phrase = "this footer of forty or more bytes is in every document, with"
    rows = [(k, f"{words(20)} {phrase} {words(20)}") for k in range(60)]
    rows += [(100 + k, words(9) + rows[3 * k][1][k : 190 + k] + words(9)) for k in range(15)] + [(-1, rows[7][1]), (200, rows[9][1] + rows[9][1]), (201, "ab" * 200)]
    got = lpf_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    want = sorted(repeats(rows))
    assert sorted(map(tuple, got.collect())) == want and sum(w[2] for w in want) > 1000


def test_repeated_ids_at_both_ends_of_64_bits(spark):
    r = random.Random(12)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))
    base = words(60)
    ids = [-(2**63), 2**63 - 1, 2**62, -(2**62), 0, 1]
    rows = [(i, words(5) + base[10 * k : 200 + 10 * k] + words(5)) for k, i in enumerate(ids)] + [(i, base[:150] + words(8)) for i in ids[:4]] + [(ids[1], base[:150] + words(8)), (2**62, None), (2**62, base[:150])]
    df = spark.createDataFrame(rows + [(None, base), (None, base)], "doc_id long, text string").repartition(3)
    got = lpf_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    want = sorted(repeats(rows))
    assert sorted(tuple(g) for g in got if g[0] is not None) == want and sum(w[2] for w in want) > 500
    assert [(g[1], g[2]) for g in got if g[0] is None] == [(len(base), 0)] * 2


def test_a_common_phrase_is_dealt_over_buckets_in_pieces(monkeypatch):
    raw = [secrets(k, 40).encode() + b"p" * 40 + secrets(k + 999, 60).encode() for k in range(200)]
    n = np.array([len(x) for x in raw])
    out = lpf_dedup._starts(raw, np.arange(200), np.zeros(200, np.int64), n - 100, 100, 16)
    sizes = [len(meta) // 32 for bucket, meta, context in out if bucket >= 0]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes) and sum(sizes) == int((n - 99).sum())
    monkeypatch.setattr(lpf_dedup, "PIECE_BYTES", 1000)
    most, plain = [], lpf_dedup.previous_factors
    monkeypatch.setattr(lpf_dedup, "previous_factors", lambda data, *rest: most.append(len(data)) or plain(data, *rest))
    meta = np.stack([np.arange(200), np.zeros(200, np.int64), n - 100, np.arange(200) // 4], axis=1).astype(np.int64)
    batch = lpf_dedup.pa.RecordBatch.from_pydict({"bucket": [0], "meta": [meta.tobytes()], "context": [b"".join(raw)]})
    list(lpf_dedup._find_repeats(100)(iter([batch])))
    assert len(most) > 20 and max(most) <= 2000
