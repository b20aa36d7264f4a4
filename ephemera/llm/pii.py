"""Personal data: fixed patterns, high-recall candidate spans, boosted trees over format and context, calibrated cut-offs."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.llm.common import free_name

GRID = 32  # shares and entropies are multiples of 1 / GRID, so that like candidates have equal features and are counted together
TASK_ROWS = 100_000  # distinct training rows in a task of the trees, about
PRECISION = 0.95  # asked for on the held-out part, by kind
KINDS = ("email", "ip", "card", "phone", "secret", "number")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at the others too, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x20]?[=:][\x20]?([^\s]{6,})")
# an address in words: "bob [at] example [dot] com", "bob at example dot com"
_SPELLED = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+"
)
_WORDLIKE = re.compile(r"[A-Z]?[a-z]{3,}")
_BACKGROUND = re.compile(r"[A-Za-z]{6,}")
# national phone numbers, social security numbers, and cards in fours whose check digit may be wrong
_FORMATTED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![A-Za-z0-9]|[.-][0-9])"
)
_NEAR = re.compile(r"(?<![a-z])(?:(?:tele|cell)?phone|tel|fax|mobile|cell|call|card|visa|mastercard|account|acct|iban|ssn|social security)s?(?![a-z])")
_WORDS = ("pass", "pwd", "token", "secret", "key", "mail", "phone", "tel", "call", "card", "account", "iban", "ip", "host")
FORMAT = ["kind", "length", "digits", "upper", "lower", "marks", "distinct", "entropy", "groups", "hex", "runs", "formatted", "quoted", "edge_before", "edge_after", "line_start"]
CONTEXT = ["assigned", "named", "near"]  # what the weak labels look at: withheld from half of the training rows and all calibration
TOP_LEVEL = {"com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "ch", "at", "nl", "us", "ca", "au", "jp", "in", "br"}
CLIP = 1024  # characters of a span that its features look at

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each has one @, so only its surroundings are read."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed patterns that pass their checks, and matches that fail them."""
    good: list[Span] = []
    bad: list[Span] = []
    good += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a part of more than three digits may still be small if it has leading zeros
            (good if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split(".")) else bad).append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 7:
                (good if 12 <= len(digits) <= 19 and luhn(digits) else bad).append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (good if 9 <= n <= 15 else bad).append((m.start(), m.end(), "phone"))
    return good, bad


def _left(text: str, a: int) -> str:
    return text[max(0, a - 24) : a].lower()


def candidates(text: str, good: list[Span], bad: list[Span]) -> list[tuple[int, int, str, int | None]]:
    """Overlapping candidate spans (start, end, kind, weak label) besides the good base spans; no label where no evidence is at hand.

    Weak labels come from what stands around a candidate and from its meaning, not from the features of its format:
    a value assigned to a key such as "password" is a secret, a token made of words or of digits alone is none; a
    number named by a word such as "phone" is personal, others are not; a spelled-out address is one if it ends in a
    common top-level name.
    """
    numbers = {(a, b) for a, b, _ in bad}
    out: list[tuple[int, int, str, int | None]] = []
    if _DIGIT.search(text):
        taken = sorted((a, b) for a, b, _ in good)
        inside = lambda k: (i := bisect_right(taken, (k, math.inf))) > 0 and max(b for _, b in taken[:i][-8:]) > k
        numbers |= {m.span() for m in _FORMATTED.finditer(text) if not inside(m.start())}
        out += [(a, b, "number", _named_number(text, a, b)) for a, b in sorted(numbers)]
        out += [(m.start(), m.end(), "secret", _free_secret(m[0])) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0])]
    if "=" in text or ":" in text:
        out += [(m.start(1), m.end(1), "secret", 1) for m in _ASSIGNED.finditer(text)]
    low = text.lower()
    if "dot" in low or "at)" in low or "at]" in low:
        out += [(m.start(), m.end(), "email", int(re.split(r"[^A-Za-z0-9-]+", m[0])[-1].lower() in TOP_LEVEL)) for m in _SPELLED.finditer(text) if "@" not in text[m.start() : m.end() + 1]]
    return out


def _named_number(text: str, a: int, b: int) -> int:
    digits = sum(c.isdigit() for c in text[a:b])
    return int(7 <= digits <= 19 and _NEAR.search(_left(text, a)) is not None)


def _free_secret(t: str) -> int | None:
    """0 for tokens of words or digits, None for others: without a key nothing tells."""
    words = sum(len(w) for w in _WORDLIKE.findall(t) if set(w.lower()) & set("aeiouy"))
    return 0 if 2 * words >= len(t) or not any(c.isalpha() for c in t) else None


def background(text: str) -> list[tuple[int, int, str, int]]:
    """An ordinary word of the text, as an example of what is no secret."""
    m = _BACKGROUND.search(text)
    return [(m.start(), m.end(), "secret", 0)] if m and not _ASSIGNED.search(text, max(0, m.start() - 40), m.end()) else []


def _entropy(t: str) -> float:
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in Counter(t).values())


def _grid(x: float) -> float:
    return round(x * GRID) / GRID


def features(text: str, a: int, b: int, kind: str) -> list[float]:
    """FORMAT, then CONTEXT; of long spans the first CLIP characters count."""
    t, left = text[a : min(b, a + CLIP)], _left(text, a)
    digits = sum(c.isdigit() for c in t)
    upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
    n = max(1, len(t))
    return [
        float(KINDS.index(kind)), float(b - a), *map(_grid, (digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, len(set(t)) / n, _entropy(t))),
        float(len(re.split(r"[^A-Za-z0-9]+", t))), float(not t.strip("0123456789abcdefABCDEF")), float(len(re.findall(r"[0-9]+|[A-Z]+|[a-z]+", t))), float(_FORMATTED.fullmatch(t) is not None),
        float(text[a - 1 : a] in tuple("\"'`") if a else 0), float(left[-1:].isalnum()), float(text[b : b + 1].isalnum()), float(a == 0 or text[a - 1] == "\n"),
        float(left.rstrip(" \"'`")[-1:] in tuple("=:")), float(sum(w in left for w in _WORDS)), float(len(_NEAR.findall(left))),
    ]


class Trees:
    """A boosted ensemble as arrays, evaluated for many rows at once."""

    def __init__(self, model):
        self.weights, self.trees = list(model.treeWeights), []
        for tree in model.trees:
            rows: list[list[float]] = []
            self._walk(tree._call_java("rootNode"), rows)
            self.trees.append(np.array(rows))

    def _walk(self, node, rows: list[list[float]]) -> int:
        me = len(rows)
        rows.append([-1.0, 0.0, 0.0, 0.0, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[me][:2] = [float(split.featureIndex()), split.threshold()]
            rows[me][2] = float(self._walk(node.leftChild(), rows))
            rows[me][3] = float(self._walk(node.rightChild(), rows))
        return me

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, tree in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = tree[at, 0].astype(np.int64)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                left = x[inner, f[inner]] <= tree[at[inner], 1]
                at[inner] = np.where(left, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
            margin += weight * tree[at, 4]
        return 1 / (1 + np.exp(-2 * margin))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, labels, keys = [], [], []
        for text in b.column(0).to_pylist():
            good, bad = base_spans(text)
            for a, z, kind, label in candidates(text, good, bad) + background(text):
                if label is not None:
                    rows.append(features(text, a, z, kind))
                    labels.append(float(label))
                    keys.append(text[max(0, a - 24) : min(z, a + CLIP) + 24])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(keys, pa.string())], names=["x", "label", "key"]
        )


class Model(NamedTuple):
    trees: Trees
    cuts: dict[str, float]  # least score of each kind
    report: dict[str, tuple[int, float, float]]  # by kind: held-out candidates, precision and recall at the cut without context


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(0).to_pylist()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0].astype(np.int32)), pa.array(shared.value.probability(x)), b.column(1), b.column(2)], names=["kind", "score", "label", "weight"]
            )

    return run


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Model | None:
    """Boosted trees and a cut-off for each kind, from the labelled candidates of all documents.

    Labels are weak (see ``candidates``; an ordinary word of each document is a negative too).  Candidates of equal
    features and label are one row whose weight is their number, so the tables grow with the distinct ones.  The trees
    see each training row twice, with its context and without, so they cannot rest on what made the label; three
    tenths of the candidates, by hash, are held out, and the cut-off of a kind is the least that gives ``precision``
    there on formats alone (0.9 where fewer than 20 are held out, none passes if there is no such cut-off).  None if
    the labels have one class only.

    Up to TASK_ROWS distinct rows the trees do not depend on partitioning; of more, sums are added in the order in
    which tasks end, so equally good splits may change places.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    text = docs.select(F.col(text_col).alias("text")).where("text is not null")
    found = text.mapInArrow(_training_rows, "x array<double>, label double, key string")
    is_held = F.pmod(F.xxhash64("key"), F.lit(10)) < 3
    rows = found.groupBy("x", "label", is_held.alias("held")).agg(F.count("*").cast("double").alias("weight")).persist()
    try:
        alone = F.concat(F.slice("x", 1, len(FORMAT)), F.array_repeat(F.lit(0.0), len(CONTEXT)))
        train = rows.where("not held").select(F.explode(F.array("x", alone)).alias("x"), "label", "weight")
        train = train.groupBy("x", "label").agg(F.sum("weight").alias("weight"))
        n, classes = train.agg(F.count("*"), F.countDistinct("label")).first()
        if classes < 2:
            return None
        frame = train.repartition(-(-n // TASK_ROWS)).sortWithinPartitions("x", "label").select(array_to_vector("x").alias("features"), "label", "weight")
        # MLlib sets its split points from all rows if their number is at most the square of maxBins, else from a sample
        bins = max(32, math.isqrt(n) + 1)
        trees = Trees(GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=1, maxBins=bins, weightCol="weight").fit(frame))
        shared = docs.sparkSession.sparkContext.broadcast(trees)
        held = rows.where("held").select(alone.alias("x"), "label", "weight").mapInArrow(_scores(shared), "kind int, score double, label double, weight double")
        held = held.groupBy("kind", "score").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits"))
        kind = Window.partitionBy("kind")
        above = kind.orderBy(F.desc("score"))  # equal scores pass together
        held = held.withColumn("enough", F.sum("hits").over(above) >= precision * F.sum("n").over(above))
        least = F.min(F.when(F.col("enough"), F.col("score"))).over(kind)
        held = held.withColumn("cut", F.when(least.isNull(), 1.1).otherwise(F.greatest(F.lit(0.5), least)))
        passed = lambda c: F.coalesce(F.sum(F.when(F.col("score") >= F.col("cut"), F.col(c))), F.lit(0.0)).alias(f"passed_{c}")
        totals = held.groupBy("kind", "cut").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), passed("n"), passed("hits")).collect()
    finally:
        rows.unpersist()
    cuts, report = {k: 0.9 for k in KINDS}, {}
    for r in sorted(totals):
        if r.n >= 20:
            cuts[KINDS[r.kind]] = r.cut
            report[KINDS[r.kind]] = (int(r.n), r.passed_hits / r.passed_n if r.passed_n else 1.0, r.passed_hits / max(1, r.hits))
    return Model(trees, cuts, report)


def _find(shared, text_col: str, names: list[str], redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            at_text = b.schema.get_field_index(text_col)
            base, every, cleaned = [], [], []
            held: list[tuple[int, int, int, str]] = []  # row, start, end, kind
            xs = []
            texts = b.column(at_text).to_pylist()
            for row, text in enumerate(texts):
                good, bad = base_spans(text or "")
                base.append(sorted(good, key=lambda s: (s[0], KINDS.index(s[2]))))
                for a, z, kind, _ in candidates(text, good, bad) if model and text else []:
                    held.append((row, a, z, kind))
                    xs.append(features(text, a, z, kind))
            passed: dict[int, list[tuple[int, int, float, str]]] = {}
            if held:
                for p, (row, a, z, kind) in zip(model.trees.probability(np.array(xs)).tolist(), held, strict=True):
                    if p >= model.cuts[kind]:
                        passed.setdefault(row, []).append((a, z, p, kind))
            for row, spans in enumerate(base):
                added = outermost(spans, passed.get(row, []))
                every.append(sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2]))))
                if redact:
                    cleaned.append(redacted(texts[row], every[-1]))
            columns = [*b.columns]
            if redact:
                columns[at_text] = pa.array(cleaned, pa.string())
            as_rows = lambda spans: [[{"kind": k, "start": a, "end": z} for a, z, k in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(as_rows(base), _SPANS), pa.array(as_rows(every), _SPANS)], names=names)

    return run


def outermost(base: list[Span], passed: list[tuple[int, int, float, str]]) -> list[Span]:
    """Candidates (start, end, score, kind) that lie within no other span; of equal ones the base span or best score.

    A part of a secret never takes the place of the whole: what only the longer span covers would stay in the text.
    """
    out, reach = [], -1
    every = [(a, -z, -2.0, None) for a, z, _ in base] + [(a, -z, -p, kind) for a, z, p, kind in passed]
    for a, z, _, kind in sorted(every, key=lambda s: s[:3]):
        if kind is not None and -z > reach:
            out.append((a, -z, kind))
        reach = max(reach, -z)
    return out


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span, or group of overlapping ones, as <KIND> of the first."""
    if not spans:
        return text
    out, done = [], 0
    for a, z, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, z)
    return "".join([*out, text[done:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (kind, start, end) in code points, by start, then kind.

    base_spans come from the fixed patterns; spans has them all and those candidates whose score passes the cut-off
    of their kind and that lie within no other such span; spans may overlap, and have any length.  With ``redact`` each span of the text becomes <KIND>.
    Trees and cut-offs come from the candidates of all documents (see ``fit``), counted by a shuffle of distinct ones;
    every document is then searched whole, in one pass without a shuffle.

    Null text has no spans and stays null; repeated rows are treated alike; an empty table gives an empty result and
    no model; result columns whose names are taken get a trailing '_'.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    names = [free_name(docs, x) for x in ("base_spans", "spans")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, span) for x in names)])
    return docs.mapInArrow(_find(shared, text_col, schema.names, redact), schema)
