import numpy as np
import pytest

from wakeline.operators import spikes
from wakeline.operators.blocks import in_blocks

POINT = "id bigint, mmsi bigint, ts_us bigint, lat double, lon double, sog double, cog double"
HOUR = 3_600_000_000


def sailing(n, every_us, mmsi=1, sog=None, first=0):
    rng = np.random.default_rng(5)
    return [(first + i, mmsi, 5 * HOUR + i * every_us, 50 + i * every_us / HOUR * 0.05, 5.0 + i * every_us / HOUR * 0.05, sog(i) if sog else float(4 + rng.normal(0, 0.2)), float(40 + rng.normal(0, 2))) for i in range(n)]


def flagged(spark, rows, field):
    return sorted(r["id"] for r in spikes.flag_readings(spark.createDataFrame(rows, POINT)).collect() if r["field"] == field)


@pytest.mark.parametrize("every_us", [HOUR, HOUR // 2])
def test_a_stuck_run_is_whole_however_seldom_the_vessel_reports(spark, every_us):
    rng = np.random.default_rng(2)
    rows = sailing(60, every_us, sog=lambda i: 4.1 if 20 <= i < 32 else float(4 + rng.normal(0, 0.3)))
    assert flagged(spark, rows, "sog") == list(range(20, 32))


def test_a_leap_between_pings_hours_apart_is_one_row(spark):
    rows = sailing(30, 7 * HOUR)
    i, m, t, lat, lon, sog, cog = rows[12]
    rows[12] = (i, m, t, lat + 25.0, lon, sog, cog)
    assert flagged(spark, rows, "lat") == [12]


def test_pieces_give_what_one_pass_gives():
    rng = np.random.default_rng(9)
    n = 3000
    z = np.cumsum(rng.normal(0, 0.2, n)) + rng.choice([0, 0, 0, 0, 0, 0, 30.0], n)
    z[rng.integers(0, n, 200)] = np.nan
    t = np.cumsum(rng.integers(1, 200, n)).astype(float)
    start, length = np.array([0, 1700]), np.array([1700, 1300])
    r, q = np.full(n, 0.05), np.full(n, 1e-5)
    state = np.tile(np.array([[np.nan], [0], [0], [np.nan], [np.nan], [0]]), 2)
    whole = np.full(n, -1, dtype=np.int8)
    spikes._filter(z, t, start, length, np.zeros(2, dtype=int), r, q, 4.0, 1.0, None, state, whole)
    assert (spikes.kalman_flags(z, t, start, length, r, q, 4.0, 1.0) == whole).mean() > 0.9995


def test_blocks_cover_every_row_once_with_its_neighbours(spark):
    rows = [(i, m, int(t)) for m, n in ((1, 5000), (2, 40)) for i, t in enumerate(np.random.default_rng(m).integers(0, 400 * HOUR, n))]
    pts = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "id bigint, mmsi bigint, ts_us bigint")
    got = in_blocks(pts, rows=500, halo=60).toPandas()
    home = got[got["__home"]]
    assert sorted(home["id"]) == list(range(len(rows)))
    assert set(home[home.mmsi == 2]["__block"]) == {0} and home[home.mmsi == 1]["__block"].nunique() >= 8
    one = home[home.mmsi == 1].sort_values(["ts_us", "id"])
    for b, part in one.groupby("__block"):
        near = got[(got.mmsi == 1) & (got["__block"] == b)]
        before, after = one[one.ts_us < part.ts_us.min()].tail(60), one[one.ts_us > part.ts_us.max()].head(60)
        assert set(before["id"]) | set(after["id"]) <= set(near["id"])
    assert in_blocks(pts.limit(0)).count() == 0
