import datetime

import pytest

from wakeline.operators import cleaning, tracks
from wakeline.sources import csv, importing, segment_cache

HEADER = "MMSI,# Timestamp,Type of mobile,Latitude,Longitude,SOG,COG,Ship type"


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_the_cleaning_job_from_file_to_file(spark, tmp_path):
    moving = [f"1,01/02/2024 10:{m:02d}:00,Class A,{55 + m * 0.002},10,10,0,Cargo" for m in range(0, 20, 2)]
    rows = [*moving, moving[0], "1,01/02/2024 10:09:00,Class A,58,10,10,0,Undefined", "2,2024-02-01 10:00:00,Class B,55,10,1,0,Cargo", "3,01/02/2024 10:00:00,Class A,55,10,0,0,Tug", "3,01/02/2024 10:30:00,Class A,55,10,0,0,Tug", "4,nonsense,Class A,55,10,0,0,Tug", "5,01/02/2024 10:00:00,Class A,55,10,1,0,Undefined", "6,01/02/2024 10:00:00,Class A,55,10,1,0,SAR"]
    path = write(tmp_path / "day.csv", *rows)
    raw = csv.read_raw(spark, csv.the_only_csv(str(tmp_path)))
    assert raw.count() == len(rows)
    before = cleaning.before_positions(raw)
    assert sorted((r["mmsi"], r["lat"]) for r in before.collect()) == sorted([("1", 55 + m * 0.002) for m in range(0, 20, 2)] + [("1", 58.0), ("3", 55.0)])
    assert {r["ship_type"] for r in before.filter("mmsi = '1'").collect()} == {"Cargo"}
    clean = cleaning.clean_raw(raw)
    assert clean.filter("lat = 58").count() == 0 and clean.count() == 11
    csv.write_csv(clean, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 11
    write(tmp_path / "other.csv")
    with pytest.raises(FileNotFoundError):
        csv.the_only_csv(str(tmp_path))
    both = csv.read_sources(spark, [path, str(tmp_path / "other.csv")])
    assert {r["source_id"] for r in both.collect()} == {0}


@pytest.mark.parametrize("fast,gone", [(24, False), (25, True)])
def test_vessels_of_undefined_type_that_are_often_too_fast(spark, fast, gone):
    rows = [(1, i, 55.0, 10.0, 60.0 if i < fast else 5.0, "Undefined") for i in range(40)] + [(2, i, 55.0, 10.0, 60.0, "Cargo") for i in range(40)]
    left = cleaning.drop_fast_vessels(spark.createDataFrame(rows, "mmsi int, t int, lat double, lon double, sog double, ship_type string"))
    assert {r["mmsi"] for r in left.collect()} == ({2} if gone else {1, 2})


def test_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 1\n\n3 \n1\n")
    ids = csv.read_ids(spark, str(tmp_path / "ids.txt"))
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("3",), (None,)], "MMSI string")
    kept, counts = csv.keep_ids(df, ids, "MMSI")
    assert sorted(r[0] for r in kept.collect()) == ["1", "3", "3"] and tuple(counts.first()) == (3, 5)
    with pytest.raises(ValueError):
        csv.keep_ids(df, ids, "IMO")


LINES = ["1,01/02/2024 10:00:00,Class A,55,10,1,2,Cargo", "2,,Class A,55,10,1,2,Cargo", "x,01/02/2024 10:00:00,A,55,10,,,", "4,01/02/2024 10:00:00,A,95,10,,,", '5,01/02/2024 10:00:00,A,"55,10,,,', "6,01/02/2024 10:00:00,A,55,10,bad,,"]


def test_an_import_goes_on_where_it_stopped(spark, tmp_path):
    lines = spark.createDataFrame([(k + 1, x) for k, x in enumerate(LINES)], "line_no int, line string")
    job = importing.Importer(spark, str(tmp_path))
    file = {"source": "a.csv", "size": 9, "mtime_ns": 1, "delimiter": ","}
    job.load(lines.filter("line_no <= 3"), **file, batch_lines=2)
    before = job.points().count()
    counts = job.load(lines, **file, batch_lines=2)
    assert counts == {"rows_read": 6, "inserted": 2, "skipped": 4, "skip_missing_ts": 1, "skip_missing_core": 1, "skip_bad_coords": 1}
    assert before == 1 and sorted(r["mmsi"] for r in job.points().collect()) == [1, 6]
    assert job.load(lines, **file) == counts and job.points().count() == 2
    assert job.points().filter("mmsi = 1").first()["geom"] == "SRID=4326;POINT(10.0 55.0)"
    with pytest.raises(ValueError):
        job.load(lines, **(file | {"size": 10}))
    job.forget("a.csv")
    assert job.progress().count() == 0


def test_upsert_takes_the_change_and_the_latest(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    old = spark.createDataFrame([("a", 1, at(1)), ("b", 2, at(2)), ("b", 3, at(3))], "k string, v int, at timestamp")
    new = spark.createDataFrame([("a", 9, at(1)), ("c", 4, None)], "k string, v int, at timestamp")
    assert sorted((r["k"], r["v"]) for r in importing.upsert(old, new, "k", "at").collect()) == [("a", 9), ("b", 3), ("c", 4)]
    assert importing.without(old, new, "k").count() == 2


def test_segment_cache_misses_then_hits(spark, tmp_path):
    pts = spark.createDataFrame([(100, t, 55.0, 10.0, 1.0, 2.0) for t in (0, 60, 120, 5000, 5060, 5120)] + [(200, 0, 55.0, 10.0, 1.0, 2.0), (200, 60, 55.0, 10.0, 1.0, 2.0)], "mmsi bigint, t bigint, lat double, lon double, speed double, heading double")
    build = lambda: tracks.segments(pts, max_gap=3600, min_points=3)
    first, hit1 = segment_cache.load_or_build(spark, str(tmp_path), {"path": "x"}, {"gap": 3600}, build)
    again, hit2 = segment_cache.load_or_build(spark, str(tmp_path), {"path": "x"}, {"gap": 3600}, lambda: 1 / 0)
    assert (hit1, hit2) == (False, True) and first.collect() == again.collect()
    assert sorted((r["mmsi"], r["count"]) for r in first.groupBy("mmsi", "seg").count().collect()) == [(100, 3), (100, 3)]
    assert tracks.segments(pts, max_gap=None, min_points=3).select("seg").distinct().count() == 1
    assert segment_cache.cache_key({"path": "x"}, {"gap": 1}) != segment_cache.cache_key({"path": "x"}, {"gap": 2})


def test_columns_are_found_by_their_other_names(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4.0, 5.0, 6.0)], "`Vessel_ID` int, `# Timestamp` int, Latitude double, LONGITUDE double, SOG double, COG double")
    assert tracks.resolve_columns(df).columns == ["mmsi", "lat", "lon", "speed", "heading", "t"]
    with pytest.raises(ValueError):
        tracks.resolve_columns(df.drop("SOG"))
