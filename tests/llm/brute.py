"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD13 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(docs, items, n=13):
    windows = {}
    for i, t in items:
        w = WORD13.findall(low(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = WORD13.findall(low(t))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    found |= windows[x]
                    hit[k : k + size] = [True] * size
        out.append((i, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cov = [False] * len(w)
    for k in range(len(w) - 2):
        if c[w[k], w[k + 1], w[k + 2]] > 1:
            cov[k : k + 3] = [True] * 3
    n = sum(cov)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def luhn(s):
    return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(s[::-1])) % 10 == 0


def pii(t):
    t = t or ""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def shingles(t, n=5):
    w = WORD.findall(low(t))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets))


def links(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    return [(i, sum(1 for b, (_, y) in enumerate(sets) if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y))) for a, (i, x) in enumerate(sets)]


def repeats(docs, length=100):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                cov[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, v in zip(b, cov, strict=True) if not v)
        out.append((i, len(b), sum(cov), len([x for x in bytes(cov).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out
