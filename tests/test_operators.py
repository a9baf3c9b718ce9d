import datetime
import math

import duckdb
import numpy as np
import pytest

from wakeline.operators import boxes, heavy_keys, proximity, scoring, spikes, timestamps, trips
from wakeline.plans import operators, problems, reference
from wakeline.session import load

POINT = "id bigint, mmsi bigint, ts_us bigint, lat double, lon double, sog double, cog double"


@pytest.mark.parametrize(
    "text,want",
    [
        ("2010-11-31T12:00:00Z", None),
        ("25:61:07", None),
        ("31/12/2010 12:00:00 AM", ("year_last", 1293753600000000)),
        ("Sun, 03 Oct 2010 00:32:00 +0200", ("month_name", 1286065920000000)),
        ("Mon, 03 Oct 2010 00:32:00 +0200", None),
        ("2010-09-24T02:07:03,0001239Z", ("year_first", 1285294023000123)),
        ("2010-09-24T02:07:03," + "1234567890" * 6 + "Z", ("year_first", 1285294023123456)),
        ("1285294482000", ("epoch", 1285294482000000)),
        ("x" * 10_000, None),
        (None, None),
    ],
)
def test_parse_text(text, want):
    family, a, _, _ = timestamps.parse_text(text)
    assert (family, a) == (want or ("unreadable", None))


def test_orders_clocks_and_repeated_hours(spark):
    pts = spark.createDataFrame(
        [
            (1, "03/04/2010 10:00:00", 1, None),
            (2, "03/04/2010 10:00:00", 2, None),
            (3, "2010-10-31 02:30:00", 1, "2010-10-31 01:30:05"),
            (4, "2010-10-31 02:30:00", 1, "2010-10-31 00:30:05"),
            (5, "2010-03-28 02:30:00", 1, None),
            (6, None, None, None),
            (7, "03/04/2010 10:00:00", 3, None),
            (8, " 2010-10-01T00:00:00Z\t", 1, None),
        ],
        "id bigint, ts string, station_id int, received_at string",
    ).selectExpr("id", "ts", "station_id", "cast(received_at as timestamp) received_at", "'x' as clock_zone")
    st = spark.createDataFrame([(1, "Europe/Copenhagen", "DMY"), (2, "UTC", "MDY"), (3, "UTC", None)], "station_id int, clock_zone string, date_order string")
    got = {r["id"]: (r["ts_us"], r["ts_status"]) for r in timestamps.normalize_timestamps(pts, st).collect()}
    utc = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp()) * 1_000_000
    assert got[1] == (utc(2010, 4, 3, 8), "resolved") and got[2] == (utc(2010, 3, 4, 10), "resolved")
    assert got[3][0] - got[4][0] == 3_600_000_000
    assert got[5] == (None, "unreadable") and got[6] == (None, "unreadable")
    assert got[7] == (None, "ambiguous")
    assert got[8][1] == "canonical"
    assert timestamps.found_timestamps(pts.limit(0), st).count() == 0


def track(n=60, mmsi=1, lat=55.0, step=0.003, t0=0, first=0):
    rng = np.random.default_rng(mmsi)
    return [(first + i, mmsi, (t0 + 120 * i) * 1_000_000, lat + step * i + rng.normal(0, 1e-5), 10.0 + rng.normal(0, 1e-5), 10.0 + rng.normal(0, 0.3), float((5 + rng.normal(0, 2)) % 360)) for i in range(n)]


def test_spikes_stuck_runs_and_lasting_changes(spark):
    rows = [list(r) for r in track()]
    rows[10][3] = -rows[10][3]
    rows[20][5] = 60.0
    rows[30][6] = 170.0
    rows[40][4] = 181.0
    for k in range(45, 57):
        rows[k][5] = 10.3
    shift = [list(r) for r in track(mmsi=2, first=1000)]
    for r in shift[30:]:
        r[3] += 3.0
    rest = [(2000 + i, 3, 120_000_000 * i, 54.0, 11.0, 0.0, 90.0) for i in range(40)]
    odd = [(3000, None, 0, 95.0, None, -1.0, 360.0), (3001, 5, None, None, None, None, None)]
    df = spark.createDataFrame([tuple(r) for r in rows + shift] + rest + odd, POINT)
    got = {tuple(r) for r in spikes.flag_readings(df).collect()}
    want = {(10, "lat"), (20, "sog"), (30, "cog"), (40, "lon"), (3000, "lat"), (3000, "sog"), (3000, "cog")} | {(k, "sog") for k in range(45, 57)}
    assert got == want
    assert spikes.flag_readings(df.limit(0)).count() == 0


def test_stops_trips_and_silence(spark):
    rest = [(i, 1, 120_000_000 * i, 55.0, 10.0, 0.0, 0.0) for i in range(30)]
    sail = [(100 + i, 1, 120_000_000 * (30 + i), 55.0 + 0.005 * (i + 1), 10.0, 9.0, 0.0) for i in range(20)]
    again = [(200 + i, 1, 120_000_000 * (50 + i), 55.1, 10.0, 0.0, 0.0) for i in range(30)]
    later = [(300 + i, 1, (120 * i + 40_000) * 1_000_000, 56.0 + 0.005 * i, 10.0, 9.0, 0.0) for i in range(20)]
    lone = [(900, 2, 0, 1.0, 1.0, 0.0, 0.0), (901, None, 0, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rest + rest[:3] + sail + again + later + lone, POINT)
    got = sorted((r["kind"], r["start_us"] // 1_000_000, r["end_us"] // 1_000_000) for r in trips.stops_and_trips(df).collect())
    assert got == [("stop", 0, 29 * 120), ("stop", 49 * 120, 79 * 120), ("trip", 29 * 120, 49 * 120), ("trip", 40_000, 40_000 + 19 * 120)]
    assert trips.stops_and_trips(df.limit(0)).count() == 0


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        lat, lon = [(55.0, 10.0), (89.9995, 50.0), (0.0, 180.0), (-33.0, -179.9999)][i % 4]
        rows.append((i, int(rng.integers(1, 6)), int(rng.integers(0, 200)) * 1_000_000, float(min(90, lat + rng.normal(0, 6e-4))), float((lon + rng.normal(0, 1e-3) + 180) % 360 - 180)))
    df = spark.createDataFrame(rows, "id bigint, mmsi bigint, ts_us bigint, y double, x double")

    def dist(a, b):
        p, q = map(math.radians, (a[3], b[3]))
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 30_000_000 and dist(a, b) <= 150}
    assert {tuple(r) for r in proximity.near_pairs(df).collect()} == want and want
    assert proximity.near_pairs(df.limit(0)).count() == 0


def test_areas_holes_edges_and_geom_forms(spark):
    areas = spark.createDataFrame([(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 0)), ((30 0, 31 0, 31 1, 30 0)))"), (3, None)], "area_id bigint, wkt string")
    geoms = ["POINT(1 1)", "SRID=4326;POINT(5 5)", "srid=4326;Point( 4  5 )", "POINT (30.9 0.1)", "0101000020E6100000000000000000F03F000000000000F03F", "POINT EMPTY", "POINT(NaN NaN)", "", None, "POINT(1 91)", "POINT(10 5)"]
    pts = spark.createDataFrame(list(enumerate(geoms)), "id bigint, geom string")
    got = sorted(tuple(r) for r in proximity.inside(proximity.with_position(pts), areas).collect())
    assert got == [(1, 0), (1, 2), (1, 4), (1, 10), (2, 3)]


def test_heavy_keys(spark):
    df = spark.createDataFrame([(i, 1 if i % 2 else (None if i % 10 == 0 else 100 + i)) for i in range(1000)], "id bigint, mmsi bigint")
    assert [r["mmsi"] for r in heavy_keys.found_heavy(df).collect()] == [1]
    assert heavy_keys.found_heavy(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(reference.ORACLE | operators.ORACLE | problems.ORACLE))
def test_plans_against_oracle(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "ais_points_cleaned"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = (reference.QUERIES | operators.QUERIES | problems.QUERIES)[name](spark, sf).toPandas()
    want = con.execute((reference.ORACLE | operators.ORACLE | problems.ORACLE)[name]).df()
    cols = sorted(want.columns)
    norm = lambda df: sorted(tuple("null" if v is None or v != v else (f"{float(v):.5f}" if not isinstance(v, str) else v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values)
    assert sorted(got.columns) == cols and norm(got) == norm(want)


def test_nothing_in_nothing_out(spark):
    track = spark.createDataFrame([], "mmsi bigint, seg bigint, idx bigint, t bigint, lat double, lon double, retained int, event_id bigint")
    box = operators.box_frame(spark)
    assert boxes.hits(track, box).count() == 0 and boxes.hits(track, box.limit(0)).count() == 0
    assert boxes.crossings(track, box).count() == 0 and boxes.crossings(track, box.limit(0)).count() == 0
    assert tuple(scoring.distortion(track).first()) == (0.0, 0.0, 0.0, 0.0, 0) and scoring.length_kept(track).first()[0] == 1.0
    assert scoring.gap_scores(boxes.hits(track, box)).count() == 0


def test_orders_are_learned_where_none_is_declared(spark):
    """The mixture finds each source's order from arrivals; what only the other order can read is a stray."""
    day = lambda i: datetime.datetime(2010, 1 + i % 12, 1 + (7 * i) % 28, 9, 0, 5)
    rows = [(1000 * s + i, day(i).strftime("%d/%m/%Y %H:%M:%S" if s == 1 else "%m/%d/%Y %H:%M:%S"), s, day(i).isoformat(sep=" ")) for s in (1, 2) for i in range(200)]
    rows += [(1, "02/25/2010 10:00:00", 1, "2010-07-01 00:00:00"), (2, "03/04/2010 09:00:05", 1, None)]
    pts = spark.createDataFrame(rows, "id bigint, ts string, station_id int, received_at string").selectExpr("id", "ts", "station_id", "cast(received_at as timestamp) received_at")
    for orders in ((None, None), ("DMY", "MDY")):
        st = spark.createDataFrame([(1, "UTC", orders[0]), (2, "UTC", orders[1])], "station_id int, clock_zone string, date_order string")
        got = {r["id"]: (r["ts_us"], r["ts_status"], r["received_at"]) for r in timestamps.normalize_timestamps(pts, st).collect()}
        assert all(got[r[0]][0] == int(got[r[0]][2].replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000 for r in rows if r[0] >= 1000)
        assert got[1][:2] == (None, "unreadable") and got[2][1] == "resolved"
