"""Secret scans against plain patterns and windows; recall on random secrets, precision on what looks like them."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from ephemera.llm import secret_scan
from ephemera.llm.queries import op11_secret_scans
from ephemera.llm.secret_scan import CLASSES, KINDS, AllowList, entropies, find_secrets, scan

LETTERS = string.ascii_letters + string.digits


def token(n, seed, alphabet=LETTERS):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def plain_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def plain_windows(t):
    """Joined windows of every class by counting each window afresh."""
    flagged = []
    for kind in CLASSES:
        alphabet = set(kind.alphabet.decode())
        for k in range(len(t) - kind.window + 1):
            w = t[k : k + kind.window]
            if set(w) <= alphabet and set(w) & set(string.digits) and set(w) & set(string.ascii_letters):
                bits = -sum(c / kind.window * math.log2(c / kind.window) for c in Counter(w).values())
                if bits >= kind.bits:
                    flagged.append((k, k + kind.window))
    out = []
    for a, b in sorted(flagged):
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


TEXTS = [
    None, "", " \n", "plain words alone", "password = hunter2hunter2", "PassWord: 'abc'", 'api_key="' + token(30, 1) + '" and APIKEY=' + token(12, 2), "token: secret: " + token(20, 3),
    "AKIA" + token(16, 4, string.ascii_uppercase + string.digits), "AKIAAKIA" + "Z" * 9, "AKIASHORT", token(40, 5, "0123456789abcdef"), "ﬀ é 日本 " + token(16, 6, "0123456789abcdef") + "g",
    "see " + token(40, 7) + " end", "x" * 5000 + token(60, 8) + "y" * 5000, token(64, 9, "0123456789ABCDEF"), "a" * 16, "toKen=éabcdefghijklmnop", "ſecret=abcdefghijklmnop", "tokens=abcdefghijklmnop",
    "eyJ" + token(60, 10) + "." + token(200, 11) + "." + token(43, 12), "key " + token(44, 13, LETTERS + "+/") + "==", "secret==" + token(20, 14), "no 550e8400-e29b-41d4-a716-446655440000 id", "passwd:" + " " * 3000 + "x",
    ("word " * 50 + token(32, 15) + " ") * 40, "https://host.org/" + token(30, 16) + "?k=" + token(30, 17), token(30, 18) + "\n" + token(30, 19), "token=" + token(24, 20) + " token=" + token(24, 20),
]
ROWS = list(enumerate(TEXTS)) + [(13, TEXTS[13]), (13, TEXTS[13])]


@pytest.mark.parametrize("piece", [50, 1 << 16])
def test_spans_against_plain_versions(spark, monkeypatch, piece):
    monkeypatch.setattr(secret_scan, "PIECE", piece)
    rows = [(k, t) for k, t in ROWS if t is not None]
    base, every, entropy = scan([t.encode() for _, t in rows], AllowList())
    added = 0
    for (k, t), own, spans, bits in zip(rows, base, every, entropy, strict=True):
        assert own == plain_base(t), k
        more = [s for s in spans if s[2] == "entropy"]
        assert [s for s in spans if s[2] != "entropy"] == own and len(bits) == len(more)
        windows = plain_windows(t)
        for a, b in windows:  # every suspect window is covered, or held back by a rule
            covered = any(x <= a and b <= y for x, y, _ in spans)
            assert covered or "://" in t[:a] or AllowList().knows(t[a:b]) or "-e29b-" in t, (k, t[a:b])
        for x, y, _ in more:
            assert any(x <= a and b <= y for a, b in windows), (k, t[x:y])
        added += len(more)
    assert added > 40


def test_query_columns_and_edges(spark):
    got = find_secrets(spark.createDataFrame([(k, t, "a") for k, t in ROWS], "doc_id long, text string, SPANS string").repartition(3))
    assert got.columns == ["doc_id", "text", "SPANS", "base_spans", "spans_", "entropies"]
    found = sorted((r.doc_id, [(s.start, s.end, s.kind) for s in r.base_spans]) for r in got.collect())
    assert found == sorted((k, plain_base(t)) for k, t in ROWS)
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = find_secrets(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).collect()
    assert [(r.text, r.base_spans, r.spans) for r in only] == [(None, [], [])] * 2


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = plain_base(r.text)
        n = Counter(s[2] for s in own)
        want[r.doc_id] = (n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in own).encode()).hexdigest())
    got = op11_secret_scans(spark, sf)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.collect()} == want and any(w[0] for w in want.values())


def test_entropy_by_counts_equals_entropy_by_window():
    r = random.Random(1)
    strings = [bytes(r.choice(b"abcd0") for _ in range(n)) for n in (1, 19, 20, 21, 300, 7, 45)]
    codes = np.frombuffer(b"".join(strings), np.uint8)
    place = np.concatenate([np.arange(len(s)) for s in strings])
    want = []
    for s in strings:
        for k in range(len(s)):
            w = s[k - 19 : k + 1] if k >= 19 else None
            want.append(-1.0 if w is None else -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values()))
    assert np.abs(entropies(codes, place, 20) - np.array(want)).max() < 1e-8


def test_recall_on_random_secrets_and_no_false_ones():
    kinds = {"hex": (40, "0123456789ABCDEF", 0.99), "base62": (32, LETTERS, 0.95), "base64": (44, LETTERS + "+/", 0.97), "url": (48, LETTERS + "-_", 0.97), "one case": (32, string.ascii_lowercase + string.digits, 0.7)}
    for name, (n, alphabet, least) in kinds.items():
        texts = [f"see {token(n, f'{name}{k}', alphabet)} end" for k in range(400)]
        _, every, _ = scan([t.encode() for t in texts], AllowList())
        assert sum((4, 4 + n) in [(a, b) for a, b, _ in spans] for spans in every) >= least * 400, name
    innocent = [
        "internationalization-of-documents-2020", "/usr/local/lib/python3.13/site-packages/numpy/core", "550e8400-e29b-41d4-a716-446655440000", "2024-01-02T10:30:00Z", "https://cdn.x.org/a8Fj29dkQ0s8dKf93kdls02kd/img.png",
        "abcdefghijklmnopqrstuvwxyz0123456789", "someVeryLongVariableName2WithNumbers", "1234-5678-9012-3456-7890", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "file_name_2020_01_02_final_v2.txt",
        "Donaudampfschifffahrtsgesellschaft2000", "x1y2z3" * 10, "-" * 40, "example-key-a8Fj29dkQ0s8dKf93",
    ]
    _, every, _ = scan([t.encode() for t in innocent], AllowList())
    assert [t for t, spans in zip(innocent, every, strict=True) if spans] == []


def test_allow_list_holds_back_added_spans_only(spark):
    free, keyed = token(32, 30), token(32, 31, "0123456789abcdef")
    df = spark.createDataFrame([(1, f"see {free} and {keyed} end")], "doc_id long, text string")
    (both,), (base,) = find_secrets(df).collect(), find_secrets(df, allowed=(re.escape(free), re.escape(keyed))).collect()
    assert [s.kind for s in both.spans] == ["entropy", "hex"] and [s.kind for s in base.spans] == ["hex"]


def test_very_long_candidates_are_searched_whole():
    blob = token(300_000, 40)
    _, (spans,), _ = scan([("head " + blob + " tail").encode()], AllowList())
    covered = sum(b - a for a, b, k in spans if k == "entropy")
    assert covered > 0.999 * len(blob)
