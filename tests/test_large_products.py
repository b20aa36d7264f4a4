"""Products of the queries at sizes that the smallest tables do not show."""

from datetime import datetime, timedelta

import duckdb

from ephemera.plans import catalog
from ephemera.sources import clk
from ephemera.sources.text import read_files


def events_of(spark, folder, rows):
    """A folder with an ``events`` table of (event_id, ts, user_id, event_type, value) rows."""
    d = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    d.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def equals_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).select(names).collect())) == sorted(found.fetchall())


def test_clock_ids_of_many_digits(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), user, "view", k / 4) for k, user in enumerate([7, 999, 1000, 1234, 987654321])]
    assert equals_sql(spark, events_of(spark, tmp_path, rows), "read_many_clk", "events")


CLOCKS = """     3.00           C                                       RINEX VERSION / TYPE
AS U999  2024 01 01 00 00 0.000000  2   9.0E-06             COMMENT
                                                            END OF HEADER
"""


def test_clock_files_are_read_by_splits(spark, tmp_path):
    """Files of many splits, with and without a header; a comment that looks like a record is none."""
    line = "{} U{:03d}  2024 01 01 {:02d} {:02d} 1.500000  2   {:.9e}\n"
    for f in range(3):
        body = "".join(line.format("AS" if k % 3 else "AR", f, k // 60, k % 60, k * 1e-6) for k in range(90 * f)) + "AS again END OF HEADER\n" + line.format("AS", 500, 1, 1, f)
        (tmp_path / f"{f}.CLK").write_text((CLOCKS if f else "") + body)
    want = sorted(map(tuple, clk.parse_clk(read_files(spark, str(tmp_path), "*.CLK")).collect()))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "300")
    got = clk.read_clk(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 270 and "U999" not in {r[2] for r in want}
    assert "explode(" not in got._jdf.queryExecution().optimizedPlan().toString()
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_clock_products_have_no_row_of_a_whole_file(spark, tmp_path, monkeypatch):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=7 * k), k % 40, ("view", "click")[k % 2], k / 4) for k in range(900)]
    made = []
    real = catalog.clk.read_clk
    monkeypatch.setattr(catalog.clk, "read_clk", lambda s, path, pattern: made.extend(path) or real(s, path, pattern))
    assert equals_sql(spark, events_of(spark, tmp_path, rows), "read_many_clk", "events")
    products = spark.read.option("recursiveFileLookup", True).text(made, wholetext=True).collect()
    assert len(products) == 10 and all(p.value.count("END OF HEADER") == 1 for p in products)
    assert all((body := p.value.split("END OF HEADER\n")[1].splitlines()) and len(body) < 110 for p in products)
