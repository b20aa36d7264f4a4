"""Secrets: fixed patterns, and windows of high Shannon entropy in candidate strings, less what an allow-list knows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ephemera.llm.common import flushes, free_name, offsets_of, ragged, texts_of

FLUSH_BYTES = 4 << 20
PIECE = 1 << 16  # places of a candidate that are worked on as one; longer ones are cut with an overlap, which loses no window
KINDS = ("assign", "access", "hex", "entropy")
_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class CharacterClass(NamedTuple):
    """Runs of ``alphabet`` of at least ``window`` characters are candidates; a window of ``bits`` or more is suspect."""

    name: str
    alphabet: bytes
    window: int
    bits: float


#: The bits are about the first percentile of windows of random characters: of 16 hexadecimal digits, of 36 letters and
#: digits (one case, the poorest of its class), of the 64 of base64.
CLASSES = (
    CharacterClass("hex", _DIGITS + b"abcdefABCDEF", 16, 2.65),
    CharacterClass("alnum", _DIGITS + _LOWER + _UPPER, 20, 3.40),
    CharacterClass("base64", _DIGITS + _LOWER + _UPPER + b"+/_=-", 20, 3.65),
)
#: What is no secret though its entropy is high; a pattern must match the whole span.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"[0-9]+(?:[T_/=+-]+[0-9]+)*Z?",  # numbers, dates, times
    r"(?i:sha-?(?:1|224|256|384|512)|md5)[-_=/][A-Za-z0-9+/_=-]+",  # digests that say so
    r"(?i:.*(?:example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)).*)",  # stand-ins
)
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WORD = re.compile(r"(?![A-Z]?[a-z]*[b-df-hj-np-tv-xz]{6}|[A-Z]*[B-DF-HJ-NP-TV-XZ]{6})(?:[A-Z][a-z]{3,}|[a-z]{4,}|[A-Z]{4,})")
STRETCH = 20  # a span takes in the rest of its candidate if that is shorter
_TAIL = re.compile(rf"[A-Za-z0-9+/_=-]{{0,{STRETCH - 1}}}(?![A-Za-z0-9+/_=-])")
_VOWELS = set("aeiouyAEIOUY")
_ADDRESS = re.compile(r"://[^\s?#\"'<>]*")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of assignments and access keys that pass their checks (the hexadecimal ones come from ``hex_runs``)."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out


def _table(alphabet: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(alphabet)] = True
    return out


_HEX = _table(_DIGITS + b"abcdef")
_TABLES = {c.name: _table(c.alphabet) for c in CLASSES}
_IS_DIGIT = _table(_DIGITS)
_IS_LETTER = _table(_LOWER + _UPPER)


def runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True of at least ``least``; the last flag must be False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def window_sums(codes: np.ndarray, place: np.ndarray, window: int, weight: np.ndarray) -> np.ndarray:
    """For each place the sum over characters of weight[count] in the window that ends there.

    ``place`` counts from 0 in each string; windows that begin before their string are cut there.  When the window
    moves, one character enters and one leaves: how often each stands among its neighbours is counted, and the sum
    changes by the difference of two weights.  ``weight`` holds whole numbers, so the running sums are exact.
    """
    n = len(codes)
    enters, leaves = np.zeros(n, np.int32), np.zeros(n, np.int32)  # its likes among those that stay
    for k in range(1, window):
        enters[k:] += (codes[k:] == codes[:-k]) & (place[k:] >= k)
        if n > window:
            leaves[window:] += codes[: n - window] == codes[k : n - window + k]
    step = weight[enters + 1] - weight[enters]
    gone = place >= window
    step[gone] -= weight[leaves[gone] + 1] - weight[leaves[gone]]
    total = np.cumsum(step)
    first = np.flatnonzero(place == 0)
    before = np.concatenate([[0], total])[first]
    return total - np.repeat(before, np.diff(np.append(first, n)))


def entropies(codes: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Shannon entropy in bits of the window that ends at each place (of whole windows; the others give -1)."""
    counts = np.arange(window + 1)
    weight = np.rint(counts * np.log2(np.maximum(counts, 1)) * (1 << 32)).astype(np.int64)
    bits = np.log2(window) - window_sums(codes, place, window, weight) / (window * float(1 << 32))
    return np.where(place >= window - 1, bits, -1.0)


def suspects(buf: np.ndarray, kind: CharacterClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of joined suspect windows in the bytes ``buf``, and the greatest entropy in each.

    A window must hold a letter and a digit: words and plain numbers are not searched for.
    """
    start, end = runs(_TABLES[kind.name][buf], kind.window)
    step = max(1, PIECE - kind.window + 1)
    pieces = np.maximum(1, -(-(end - start - kind.window + 1) // step))
    a = np.repeat(start, pieces) + ragged(np.zeros(len(start), np.int64), pieces) * step
    b = np.minimum(a + PIECE, np.repeat(end, pieces))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(a):  # pieces of about 16 x PIECE places at a time
        size = np.cumsum(b[at:] - a[at:])
        upto = at + max(1, int(np.searchsorted(size, 16 * PIECE)))
        counts = b[at:upto] - a[at:upto]
        where = ragged(a[at:upto], counts)
        place = ragged(np.zeros(len(counts), np.int64), counts)
        codes = buf[where]
        bits = entropies(codes, place, kind.window)
        mixed = np.ones(len(codes), bool)
        for table in (_IS_DIGIT, _IS_LETTER):
            so_far = np.concatenate([[0], np.cumsum(table[codes])])
            mixed[kind.window - 1 :] &= so_far[kind.window :] > so_far[: -kind.window]
        hit = np.flatnonzero((bits >= kind.bits) & mixed)
        found.append((where[hit] + 1, bits[hit]))
        at = upto
    last = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    best = np.concatenate([f[1] for f in found]) if found else np.empty(0)
    first = last - kind.window
    if not len(last):
        return first, last, best
    fresh = np.concatenate([[True], first[1:] > last[:-1]])
    opens = np.flatnonzero(fresh)
    return first[opens], np.append(last[opens[1:] - 1], last[-1]), np.maximum.reduceat(best, opens)


class AllowList:
    """Knows what is no secret: fixed patterns, the caller's, words, sequences, and paths of addresses."""

    def __init__(self, more: tuple[str, ...] = ()):
        self.patterns = [re.compile(p, re.S) for p in (*ALLOWED, *more)]

    def knows(self, span: str) -> bool:
        if any(p.fullmatch(span) for p in self.patterns):
            return True
        if 2 * sum(len(w) for w in _WORD.findall(span) if _VOWELS.intersection(w)) >= sum(map(_plain, span)):  # words
            return True
        raw = np.frombuffer(span.encode("ascii"), np.uint8).astype(np.int64)
        return 2 * int((np.diff(raw) == 1).sum()) >= len(raw)  # abcdef, 012345

    def addresses(self, text: str) -> list[tuple[int, int]]:
        """Hosts and paths of addresses; what follows ? or # may be a secret."""
        return [m.span() for m in _ADDRESS.finditer(text)] if "://" in text else []


def secret_spans(text: str, hexes: list[tuple[int, int]], windows: list[tuple[int, int, float]], allow: AllowList) -> tuple[list[Span], list[Span], list[float]]:
    """Base spans, all spans, and the entropies of the added ones.

    ``hexes`` are runs of hexadecimal digits, ``windows`` joined suspect windows by start, both in code points.
    Overlapping windows make one span, which is stretched to the ends of its candidate, if they are near, else to whole
    runs of letters and digits; it is added unless it lies within a base span or the allow-list knows it.
    """
    base = sorted(base_spans(text) + [(a, b, "hex") for a, b in hexes], key=lambda s: (s[0], KINDS.index(s[2])))
    if not windows:
        return base, base, []
    joined: list[list] = []
    for a, b, bits in windows:
        if joined and a < joined[-1][1]:
            joined[-1][1], joined[-1][2] = max(b, joined[-1][1]), max(bits, joined[-1][2])
            continue
        least = joined[-1][1] if joined else 0
        joined.append([a, b, bits])
        joined[-1][0] = _left(text, a, least)
        joined[-1][1] = _right(text, b)
    for span in joined:
        span[1] = _right(text, span[1])
    addresses, added, bits = allow.addresses(text), [], []
    held = 0
    reach = -1  # the furthest end of base spans that begin at or before the candidate
    inside = 0
    for a, b, best in joined:
        while held < len(base) and base[held][0] <= a:
            reach = max(reach, base[held][1])
            held += 1
        while inside < len(addresses) and addresses[inside][1] < b:
            inside += 1
        in_address = inside < len(addresses) and addresses[inside][0] <= a
        if b > reach and not in_address and not allow.knows(text[a:b]):
            added.append((a, b, "entropy"))
            bits.append(best)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))), bits


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _left(text: str, a: int, least: int) -> int:
    """The start of the candidate, if fewer than a window's characters before, else of the run of letters and digits."""
    far = a
    while far > max(least, a - STRETCH) and (_plain(text[far - 1]) or text[far - 1] in "+/_-"):
        far -= 1
    if a - far < STRETCH:
        return far
    while a > least and _plain(text[a - 1]) and _plain(text[a]):
        a -= 1
    return a


def _right(text: str, b: int) -> int:
    if m := _TAIL.match(text, b):
        return m.end()
    while b < len(text) and _plain(text[b]) and _plain(text[b - 1]):
        b += 1
    return b


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _listed(spans: list[list[Span]]) -> pa.Array:
    flat = [s for own in spans for s in own]
    items = pa.StructArray.from_arrays([pa.array([k for _, _, k in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, b, _ in flat], pa.int64())], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets_of(np.array([len(s) for s in spans], np.int64)).astype(np.int32)), items)


def scan(texts: list[bytes], allow: AllowList) -> tuple[list[list[Span]], list[list[Span]], list[list[float]]]:
    """``secret_spans`` of every text: runs and windows are found in the joined bytes, then carried to code points."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
    hexes: dict[int, list[tuple[int, int]]] = {}
    windows: dict[int, list[tuple[int, int, float]]] = {}

    def deal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int]]:
        of = np.searchsorted(starts, a, side="right") - 1
        zero = points[starts[of]]
        return zip(of.tolist(), (points[a] - zero).tolist(), (points[b] - zero).tolist(), strict=True)

    for row, a, b in deal(*runs(_HEX[buf], 16)):
        hexes.setdefault(row, []).append((a, b))
    for kind in CLASSES:
        first, last, best = suspects(buf, kind)
        for (row, a, b), bits in zip(deal(first, last), best.tolist(), strict=True):
            windows.setdefault(row, []).append((a, b, bits))
    base, every, entropy = [], [], []
    for row, raw in enumerate(texts):
        found = secret_spans(raw.decode("utf-8", "replace"), hexes.get(row, []), sorted(windows.get(row, [])), allow)
        for out, part in zip((base, every, entropy), found, strict=True):
            out.append(part)
    return base, every, entropy


def _find(text: str, names: list[str], allowed: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = AllowList(allowed)
        for table in flushes(batches, text, FLUSH_BYTES):
            base, every, entropy = scan(texts_of(table[text]), allow)
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), _listed(base), _listed(every), pa.array(entropy, pa.list_(pa.float64()))], names=names)

    return run


def find_secrets(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with base_spans, spans (arrays of kind, start, end in code points, by start) and entropies.

    base_spans come from the fixed patterns: assignments of 12 or more characters to a key, access keys, lower-case
    hexadecimal runs of 16 or more.  spans has them all and the method's, of kind ``entropy``: in every run of a
    character class (``CLASSES``) a window slides over all characters, its entropy is kept by the counts of the
    character that enters and the one that leaves, and suspect windows are joined to spans of any length.  Spans within
    a base span are not repeated; the allow-list (``ALLOWED``, ``allowed``: patterns that match a whole span; words,
    sequences, paths of addresses) holds back added spans, never base ones.  entropies are the greatest of each added
    span, in their order.

    Every text is searched whole, in one pass without a shuffle or a model.  Null and empty texts have no spans;
    repeated rows are treated alike; an empty table gives an empty result; result columns whose names are taken get a
    trailing '_'.
    """
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = {"base_spans": span, "spans": span, "entropies": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, x), t) for x, t in kinds.items())])
    return docs.mapInArrow(_find(text_col, schema.names, allowed), schema)
