from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ephemera.operators import filters, profile
from ephemera.sources import clk, nav, sp3, tables, text
from ephemera.streaming.clocks import clock_rates, stream_clocks

SP3 = """#cP2025  7  6  0  0  0.00000000      96 ORBIT IGS20 HLM  IGS
## 2374      0.00000000   900.00000000 60862 0.0000000000000
+    2   G01G02  0  0
*  2025  7  6  0  0  0.00000000
PG01  13000.123456 -20000.654321   9000.000000    123.456789
PG02  14000.000000  21000.000000  -8000.000000 999999.999999
PG03 1.0 2.0
*  2025  7  6  0 15  0.50000000
PG01  1.0 2.0 3.0 4.0
EOF
"""
CLK = """     3.00           C                                       RINEX VERSION / TYPE
prog                run                 20250706            PGM / RUN BY / DATE
    18                                                      LEAP SECONDS
     2    AS    AR                                          # / TYPES OF DATA
IGS                                                         ANALYSIS CENTER
     1    IGS20                                             # OF SOLN STA / TRF
ALGO 40104M002      918129531  -4346071253   4561977829     SOLN STA NAME / NUM
                                                            END OF HEADER
AS G01  2025 07 06 00 00  0.000000  2    1.234567890123e-04  1.0e-11
AR ALGO 2025 07 06 00 00 30.500000  1   -2.500000000000e-08
XX G01  2025 07 06 00 00  0.000000  2    1.0
"""


def fields(values):
    return "    " + "".join(f"{v:19.12E}".replace("E", "D") for v in values) + "\n"


def record(sat="G01", lines=7):
    head = f"{sat} 2025 07 06 00 00 00" + "".join(f"{v:19.12E}".replace("E", "D") for v in (1.234567890123e-4, -1.023181539495e-11, 0.0)) + "\n"
    numbers = [[float(4 * k + j + 1) for j in range(4)] for k in range(7)]
    numbers[6] = numbers[6][:2]
    numbers[1][3] = 5153.5
    return head + "".join(fields(x) for x in numbers[:lines])


NAV = "     3.04           N: GNSS NAV DATA    M: MIXED            RINEX VERSION / TYPE\n                                                            END OF HEADER\n"


def files(spark, value):
    return spark.createDataFrame([("f", value)], "file string, value string")


def test_sp3(spark, tmp_path):
    (tmp_path / "day1").mkdir()
    (tmp_path / "day1" / "a.SP3").write_text(SP3)
    orbit, clock = sp3.read_sp3(spark, str(tmp_path))
    rows = orbit.orderBy("timestamp", "satellite").collect()
    assert [(r.satellite, r.timestamp) for r in rows] == [("G01", datetime(2025, 7, 6)), ("G02", datetime(2025, 7, 6)), ("G01", datetime(2025, 7, 6, 0, 15, 0, 500000))]
    assert rows[0].x == pytest.approx(13000123.456) and rows[0].y == pytest.approx(-20000654.321)
    assert [(r.satellite, pytest.approx(r.clock_bias)) for r in clock.orderBy("timestamp").collect()] == [("G01", 1.23456789e-4), ("G01", 4e-6)]
    h = sp3.read_sp3_header(spark, str(tmp_path)).first()
    assert (h.version, h.pos_vel_flag, h.num_epochs, h.gps_week, h.epoch_interval, h.satellites) == ("#c", "P", 96, 2374, 900.0, ["G01", "G02"])
    assert h.start == datetime(2025, 7, 6)
    assert text.find_files(spark, str(tmp_path), "*.SP3").first().file.endswith("a.SP3")


def test_clk(spark, tmp_path):
    (tmp_path / "a.CLK").write_text(CLK)
    rows = clk.read_clk(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.type, r.id, r.clock_bias, r.std_dev, r.num_values) for r in rows] == [("AS", "G01", 1.234567890123e-4, 1e-11, 2), ("AR", "ALGO", -2.5e-8, 0.0, 1)]
    assert rows[1].timestamp == datetime(2025, 7, 6, 0, 0, 30, 500000)
    h = clk.read_clk_header(spark, str(tmp_path)).first()
    assert (h.version, h.program, h.leap_seconds, h.data_types, h.analysis_center, h.num_stations, h.reference_frame) == ("3.00", "prog", 18, ["AS", "AR"], "IGS", 1, "IGS20")
    assert h.stations[0].name == "ALGO" and h.stations[0].x == 918129531.0
    records = clk.read_clk(spark, str(tmp_path))
    assert filters.satellite_clocks(records).columns[1] == "satellite" and filters.station_clocks(records).first().station == "ALGO"
    lines = text.read_lines(spark, str(tmp_path), "*.CLK")
    got = profile.file_line_counts(lines, {"satellites": "^AS", "stations": "^AR"}).first()
    assert (got.n_lines, got.satellites, got.stations) == (11, 1, 1)


def test_clk_stream_equals_batch(spark, tmp_path):
    (tmp_path / "a.CLK").write_text(CLK)
    q = clock_rates(stream_clocks(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.n) for r in spark.table("rates").collect()} == {("G01", 1), ("ALGO", 1)}


def test_nav(spark, tmp_path):
    (tmp_path / "a.rnx").write_text(NAV + record() + record("R02") + record("G03", 5) + record("G04"))
    rows = nav.read_nav(spark, str(tmp_path)).orderBy("satellite").collect()
    assert [r.satellite for r in rows] == ["G01", "G04"]
    r = rows[0]
    assert (r.af0, r.iode, r.m0, r.toe, r.idot, r.gps_week, r.tgd, r.iodc) == (1.234567890123e-4, 1.0, 4.0, 9.0, 17.0, 19.0, 23.0, 24.0)
    assert r.a == pytest.approx(5153.5**2) and r.timestamp == datetime(2025, 7, 6)
    wide = nav.read_nav(spark, str(tmp_path), wide=True).first()
    assert (wide.toc, wide.week, wide.health, wide.fit_interval) == (0.0, 19.0, 22.0, 26.0)
    assert nav.read_nav_clock(spark, str(tmp_path)).count() == 4
    assert nav.parse_nav(files(spark, NAV)).count() == 0


def test_orbit_line_fallback(spark):
    d = spark.createDataFrame([("     -.12D-04 1.5 x2",), ("    " + "-1.023181539495D-11" * 2,)], "s string")
    got = [r[0] for r in d.select(nav.parse_orbit_line(F.col("s"))).collect()]
    assert got[0] == [-1.2e-5, 1.5, 2.0] and got[1] == [-1.023181539495e-11] * 2


def test_error_tables(spark, tmp_path):
    (tmp_path / "e.csv").write_text("satellite_id,timestamp,orbit_error_m,clock_error_ns,radial_error_m,ephemeris_age_hours\nG01,2025-07-06 00:15:00,1.0,NaN,2.0,0.5\n")
    d = tables.read_errors_csv(spark, str(tmp_path / "e.csv"))
    r = d.first()
    assert r.clock_error_ns is None and r.timestamp == datetime(2025, 7, 6, 0, 15)
    tables.write_errors(d, str(tmp_path / "out"), "csv", sort=["timestamp"])
    assert tables.read_errors_csv(spark, str(tmp_path / "out")).collect() == [r]
    tables.write_errors(d, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).first().orbit_error_m == 1.0
    body = '{"data": [{"timestamp": "2025-07-06T00:15:00", "satellite_id": "G01", "orbit_error_m": 1.0}]}'
    (tmp_path / "o.json").write_text(body)
    assert tables.read_observations_json(spark, str(tmp_path / "o.json")).first().satellite_id == "G01"
    assert tables.parse_observations(spark.createDataFrame([(body,)], "body string")).first().orbit_error_m == 1.0
    stats = profile.dataset_statistics(d, "satellite_id", "timestamp")
    doc = tables.statistics_json(stats, profile.key_statistics(d, "satellite_id"), "satellite_id")
    tables.write_statistics_json(doc, str(tmp_path / "stats"))
    import json

    got = json.loads(doc.first().value)
    assert got["total_records"] == 1 and got["per_key"]["G01"]["records"] == 1 and got["orbit_error_m"]["percentile_95"] == 1.0
