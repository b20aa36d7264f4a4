"""Products read by splits of any size equal those read whole."""

import random

import pytest
from pyspark.sql import functions as F

from ephemera.operators.filters import first_of_repeats
from ephemera.operators.states import broadcast_states, first_ephemerides
from ephemera.sources import nav, sp3
from ephemera.sources.splits import numbered_lines, with_heads

ORBIT = ["iode crs dn m0", "cuc e cus a", "toe cic om cis", "i0 crc w od", "id l2 week flag", "acc health tgd iodc", "tx fit"]


def sp3_text(epochs, seed):
    r = random.Random(seed)
    out = ["#cP2025  7  6  0  0  0.00000000", "PG09 1 2 3 4", "+    2   G01G02"]
    for k in range(epochs):
        out.append(f"*  2025  7  6 {k // 60:2d} {k % 60:2d}  0.{k % 7}0000000")
        out += [f"PG{s:02d} {r.uniform(-9e3, 9e3):.6f} {r.uniform(-9e3, 9e3):.6f} {r.uniform(-9e3, 9e3):.6f} {r.choice(['0.5', '999999.999999', 'bad', '-3.25'])}" for s in range(r.choice([0, 1, 3, 12]))] + ["V ignored"]
    return "\n".join([*out, "EOF", ""])


def nav_text(n, seed, header=True):
    r = random.Random(seed)
    number = lambda: f"{r.uniform(-9, 9):19.12e}".replace("e", r.choice("DE"))
    out = ["G01 looks like a record before the end of the header", "     x" * 9 + "END OF HEADER"] if header else []
    for k in range(n):
        out.append(f"{r.choice('GGGR')}{k % 32 + 1:02d} 2025 07 06 {k // 60:02d} {k % 60:02d} 00" + "".join(number() for _ in range(3)))
        out += ["    " + "".join(number() for _ in range(len(line.split()))) for line in ORBIT[: r.choice([7, 7, 7, 4])]] + ([""] if k % 5 == 0 else [])
    return "\n".join(out) + "\n"


@pytest.fixture
def split(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(request.param))
    yield request.param
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("split", [150, 1000, 10**8], indirect=True)
def test_orbits(spark, tmp_path, split):
    for k in range(3):
        (tmp_path / f"{k}.SP3").write_text(sp3_text(40 * k, k))
    assert split > 1000 or numbered_lines(spark, str(tmp_path)).select("unit").distinct().count() > 15
    for got, want in zip(sp3.read_large_sp3(spark, str(tmp_path)), sp3.read_sp3(spark, str(tmp_path)), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns and want.count() > 30


@pytest.mark.parametrize("split", [200, 3000, 10**8], indirect=True)
@pytest.mark.parametrize("wide", [False, True])
def test_ephemerides(spark, tmp_path, split, wide):
    for k in range(3):
        (tmp_path / f"{k}.rnx").write_text(nav_text(30 * k, k, header=k != 2))
    got, want = nav.read_large_nav(spark, str(tmp_path), wide=wide), nav.read_nav(spark, str(tmp_path), wide=wide)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns and want.count() > (5 if wide else 20)


@pytest.mark.parametrize("split", [200, 10**8], indirect=True)
def test_the_first_file_wins(spark, tmp_path, split):
    """Files that repeat satellites and times, within and between them: the first record of the first file by name stays."""
    texts = {f"{name}.rnx": nav_text(40, seed) + nav_text(12, seed + 50, header=False) for name, seed in (("b", 1), ("a", 2), ("c", 3))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    every = nav.read_nav(spark, str(tmp_path), source=True)
    want = {}
    for r in sorted(every.collect(), key=lambda r: (r.file, r.record.number)):
        want.setdefault((r.satellite, r.timestamp), r.af0)
    assert every.count() > len(want) > 30
    for d in (every, nav.read_large_nav(spark, str(tmp_path), source=True)):
        got = first_ephemerides(d)
        assert got.columns == nav.NAV_COLUMNS and {(r.satellite, r.timestamp): r.af0 for r in got.collect()} == want and got.count() == len(want)
        at = broadcast_states(d, got.select("timestamp"))
        assert at.count() == broadcast_states(got, got.select("timestamp")).count() and at.exceptAll(broadcast_states(got, got.select("timestamp"))).count() == 0
    assert first_ephemerides(got) is got and first_ephemerides(every.limit(0)).count() == 0


def test_first_of_repeats_with_nulls_and_clashing_names(spark):
    rows = [(None, 1, 2.0), (None, 1, 1.0), (None, 3, 0.0), ("a", None, 5.0), ("a", 0, 4.0), ("b", 7, None)]
    d = spark.createDataFrame(rows, "k0 string, g int, row double")
    assert sorted(map(str, (tuple(r) for r in first_of_repeats(d, ["k0"], ["g"]).collect()))) == sorted(map(str, [(None, 1, 1.0), ("a", None, 5.0), ("b", 7, None)]))


@pytest.mark.parametrize("split", [64], indirect=True)
def test_heads_are_carried_over_many_splits(spark, tmp_path, split):
    (tmp_path / "a.txt").write_text("before\nH1\n" + "".join(f"line {k}\n" for k in range(200)) + "H2\nH3\nlast\n")
    d = with_heads(numbered_lines(spark, str(tmp_path)), F.col("value").startswith("H"))
    rows = {r.value: r.head for r in d.collect()}
    assert rows.keys() == {"H1", "H2", "H3", "last", *(f"line {k}" for k in range(200))}
    assert {rows[f"line {k}"] for k in range(200)} == {"H1"} and rows["last"] == "H3" and d.select("unit").distinct().count() > 20
    assert with_heads(numbered_lines(spark, str(tmp_path)), F.lit(False)).count() == 0
