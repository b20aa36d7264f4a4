"""Records of navigation files: regular fields by position, all others by rule, each computed once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ephemera.plans import catalog
from ephemera.sources import nav

ODD = [" " * 19, "NaN", "1.5f", "1.5d", "0x1p3", ".", "E5", "1 2", " -.12D-04 ", "abc 12 d", "1e999", "--1", "+1.5E+05", "7", "1.0E", "\t1.0"]


def text(r, odd):
    def number():
        x = f"{r.uniform(-9, 9) * 10 ** r.randint(-12, 8):19.12e}".replace("e", r.choice("DEde" if odd else "DE"))
        return r.choice(ODD).rjust(19) if r.random() < odd else x

    lines = ["G01 before the end of the header", "     x END OF HEADER"]
    for k in range(3):
        lines.append(f"G{k + 1:02d} 2025 07 06 00 00 00" + "".join(number() for _ in range(3)))
        lines += ["    " + "".join(number() for _ in range(n)) for n in (4, 4, 4, 4, 4, 4, r.choice([2, 2, 3, 4, 1]))]
        lines += ["", "    "] if r.random() < 0.3 else []
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("odd", [0, 0.02, 0.3])
def test_numbers_are_those_of_the_lines(spark, odd):
    r = random.Random(int(odd * 100))
    texts = {str(k): text(r, odd) for k in range(60)}
    flat = F.flatten(F.transform(F.col("lines"), nav.parse_orbit_line))
    want = {}
    records = [(f, n, lines) for f, t in texts.items() for n, lines in enumerate(blocks(t))]
    for f, n, v in spark.createDataFrame(records, "file string, n int, lines array<string>").select("file", "n", flat).collect():
        if len(v) >= 26:
            want[f, n] = {c: x for c, x in zip(nav.ORBIT_FIELDS, v, strict=False) if c not in ("-", "sqrt_a", "health", "fit_interval")}
    got = {(x.file, x.record.number): x for x in nav.parse_nav(spark.createDataFrame(list(texts.items()), "file string, value string"), source=True).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k][c] == x for k, v in want.items() for c, x in v.items())


def blocks(t):
    """The orbit lines of each record."""
    lines = [x for x in t.split("END OF HEADER\n")[1].split("\n") if x.strip(" ")]
    heads = [*(k for k, x in enumerate(lines) if x.startswith("G")), len(lines)]
    return [lines[a + 1 : a + 8] if b - a >= 8 else [] for a, b in zip(heads, heads[1:], strict=False)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("wide", [False, True])
def test_what_costs_most_is_computed_once(spark, wide):
    """Filters on a record's numbers repeated all that they are made from."""
    p = plan(nav.parse_nav(spark.createDataFrame([("f", "x")], "file string, value string"), wide=wide))
    assert p.count("regexp_extract_all(") == 1 and p.count("split(") == 1


def test_elements_are_exchanged_without_their_text(spark):
    p = plan(catalog.QUERIES["first_ephemerides"](spark, "/root/testdata/sf0.001"))
    below = re.split("\n *\\+- ", p[p.index("collect_list") :])[1:]
    assert len(below) >= 2 and not any("format_string" in node for node in below)
