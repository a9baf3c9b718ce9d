"""Small cases whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import boxes, scoring, selectors, tracks

TRACK = "mmsi bigint, seg bigint, idx bigint, t double, lat double, lon double, retained int"
BOX = "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start double, t_end double"
UNIT = (1, -1.0, 1.0, -1.0, 1.0, 0.0, 10.0)


def track(spark, points, cuts=(), kept=()):
    rows, seg, idx = [], 1, 0
    for k, p in enumerate(points):
        if k in cuts:
            seg, idx = seg + 1, 0
        rows.append((1, seg, idx, *map(float, p), int(k in kept)))
        idx += 1
    return spark.createDataFrame(rows, TRACK)


def bracket(spark, points, cuts=()):
    got = {(r["seg"], r["idx"]) for r in boxes.brackets(track(spark, points, cuts), spark.createDataFrame([UNIT], BOX)).collect()}
    return [(r["seg"], r["idx"]) in got for r in track(spark, points, cuts).collect()]


def test_box_trajectories(spark):
    t = track(spark, [(0, 0, 0), (1, 0.1, 0.1), (2, 5, 5), (3, 5.1, 5.1)], cuts=(2,))
    b = spark.createDataFrame([(1, -0.5, 0.5, -0.5, 0.5, 0.0, 1.5)], BOX)
    assert {r["seg"] for r in boxes.hits(t, b).collect()} == {1}


def test_box_checks(spark):
    b = spark.createDataFrame([UNIT], BOX)
    boxes.check_boxes(b)
    with pytest.raises(ValueError, match="Only range queries"):
        boxes.check_boxes(b.withColumn("type", F.lit("unsupported")))
    for bad in (b.withColumn("lat_min", F.lit(2.0)), b.withColumn("t_end", F.lit(float("nan"))), b.withColumn("lon_max", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            boxes.check_boxes(bad)


def test_crossings_and_brackets(spark):
    assert bracket(spark, [(1, 0, -2), (2, 0, 2)]) == [True, True]
    assert bracket(spark, [(1, 0, 0), (2, 0.5, 0), (3, 0, 2)]) == [False, True, True]
    assert bracket(spark, [(20, 0, -2), (21, 0, 2)]) == [False, False]
    four = [(1, 0, -2), (2, 0, -2), (3, 0, 2), (4, 0, 2)]
    assert bracket(spark, four, cuts=(2,)) == [False] * 4 and bracket(spark, four) == [False, True, True, False]


def test_bounds_are_inside(spark):
    t = track(spark, [(5, 0, 0), (11, 0, 0), (5, 2, 0), (10, 1, -1)])
    assert {r["idx"] for r in boxes.hits(t, spark.createDataFrame([UNIT], BOX)).collect()} == {0, 3}


def test_wide_and_small_boxes_together(spark):
    pts = [(i, (i * 37 % 160) - 80, (i * 53 % 340) - 170) for i in range(200)]
    t = track(spark, pts)
    rows = [(1, -90.0, 90.0, -180.0, 180.0, 0.0, 1e9), (2, -10.0, 10.0, -20.0, 25.0, 20.0, 150.0), (3, -80.0, -80.0, -170.0, -170.0, 0.0, 0.0), (4, 3.0, -3.0, 0.0, 1.0, 0.0, 9.0)]
    got = {(r["query_id"], r["idx"]) for r in boxes.hits(t, spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(q, i) for q, a, b, c, d, e, f in rows for i, (s, y, x) in enumerate(pts) if a <= y <= b and c <= x <= d and e <= s <= f}


def test_distances(spark):
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.local_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.allowed_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))).first()
    assert d[0] == pytest.approx(111.19, abs=0.05) and d[1] == pytest.approx(111.32) and d[2] is None and d[3] == 0.05


def test_point_scores(spark):
    box = spark.createDataFrame([UNIT], BOX)
    five = [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (50, 0, 0)]
    score = lambda points, kept: scoring.point_scores(boxes.hits(track(spark, points, kept=kept), box)).first()["f1"]
    assert score(five, (1, 4)) == pytest.approx(0.4)
    assert score([(1, 0, 0), (1, 0, 0)], (0,)) == pytest.approx(2 / 3)
    assert score(five, range(5)) == 1.0 and score(five, ()) == 0.0


def test_distortion_of_a_straight_and_a_bent_track(spark):
    straight = track(spark, [(0, 0, 0), (1, 0, 1), (2, 0, 2)], kept=(0, 2))
    assert scoring.distortion(straight).first()["max_sed_km"] == pytest.approx(0, abs=1e-9)
    late = scoring.distortion(track(spark, [(0, 0, 0), (1, 0, 1.5), (2, 0, 2)], kept=(0, 2))).first()
    assert late["max_sed_km"] == pytest.approx(55.66) and late["max_ped_km"] == pytest.approx(0, abs=1e-9)
    assert scoring.distortion(track(spark, [(0, 0, 0), (1, 5, 1)], kept=(0,))).first()["removed_points"] == 0


def test_farthest_first_keeps_the_corner(spark):
    t = track(spark, [(i, 0 if i < 5 else i - 5, min(i, 5)) for i in range(11)])
    assert [r["idx"] for r in selectors.farthest_first(t, 0.25).filter("retained = 1").orderBy("idx").collect()] == [0, 5, 10]


def test_even_spacing_rounds_halves_to_even(spark):
    t = track(spark, [(i, 0, 0) for i in range(10)])
    kept = [r["idx"] for r in selectors.even(t, 0.3).filter("retained = 1").orderBy("idx").collect()]
    assert kept == [0, 4, 9]


def test_load_audit(spark):
    rows = [(1, 0, 55.0, 10.0, 1.0, 0.0), (1, 0, 55.0, 10.0, 1.0, 0.0), (1, 60, 55.0, 10.0, 1.0, 0.0), (1, 120, 55.0, 10.0, 1.0, 0.0), (1, 180, 55.0, 10.0, 1.0, 0.0), (1, 240, 55.0, 10.0, 1.0, 511.0), (1, 300, 91.0, 10.0, 1.0, 0.0)]
    pts = spark.createDataFrame(rows, "mmsi bigint, t bigint, lat double, lon double, speed double, heading double")
    got = tracks.fault_counts(pts).first().asDict()
    assert got == {"loaded": 7, "kept": 5, "bad_time": 0, "bad_lat": 1, "bad_lon": 0, "bad_speed": 0, "bad_heading": 1, "repeated_times": 1}
    seg = tracks.segments(tracks.valid(pts), max_gap=3600, min_points=2, max_points=3)
    assert [(r["seg"], r["idx"], r["t"]) for r in seg.orderBy("idx").collect()] == [(1, 0, 0), (1, 1, 60), (1, 2, 180)]


def test_smoothing_keeps_a_flat_grid_flat(spark):
    flat = spark.createDataFrame([(y, x, 2.0) for y in range(4) for x in range(4)], "gy int, gx int, v double")
    assert all(r["v"] == pytest.approx(2.0) for r in tracks.smooth(flat, "v", 4, passes=3).collect())
