from wakeline.operators import spikes

POINT = "id bigint, mmsi bigint, ts_us bigint, lat double, lon double, sog double, cog double"


def test_leaps_of_fast_and_rarely_seen_vessels(spark):
    def sail(mmsi, first, s):
        return [[first + i, mmsi, s * i * 1_000_000, 55.0 + 12.3 * s * i / 111_195, 10.0 + 1e-5 * (i % 7), 24.0, 0.0] for i in range(60)]

    fast, slow = sail(1, 0, 127), sail(2, 100, 240)
    fast[20][3] -= 0.07  # about 8 km south and 6 km east, and back
    fast[20][4] += 0.09
    for k in (40, 41):
        fast[k][4] -= 0.08
    slow[30][3] += 0.12
    rest = [[200 + i, 3, 150_000_000 * i, 54.0 + 1e-5 * (i % 5), 11.0 + 1e-5 * (i % 3), 0.1, 90.0] for i in range(13)]
    rest[6][3] += 0.12  # one leap spoils a sixth of the steps here
    turn = sail(4, 300, 127)
    for k in range(31, 60):  # goes back the way it came
        turn[k][3] = turn[60 - k][3]
    df = spark.createDataFrame([tuple(r) for r in fast + slow + rest + turn], POINT)
    got = {tuple(r) for r in spikes.flag_readings(df).filter("field in ('lat', 'lon')").collect()}
    assert got == {(20, "lat"), (20, "lon"), (40, "lon"), (41, "lon"), (130, "lat"), (206, "lat")}


def test_every_copy_of_a_false_ping(spark):
    rows = [(i, 1, 120_000_000 * i, 55.0 + 0.003 * i, 10.0 + 1e-5 * (i % 7), 10.0 + 0.1 * (i % 4), float(i % 5)) for i in range(60)]
    i, mmsi, ts, lat, lon, _, cog = rows[30]
    rows[30:31] = [(i + 1000 * k, mmsi, ts, lat, lon, 60.0, cog) for k in range(3)]
    lasts = [(2000 + 100 * k + r[0], 2, r[2], r[3], r[4], 10.0 + 0.1 * (r[0] % 4) + (30.0 if r[0] >= 40 else 0.0), r[6]) for r in rows[:30] + rows[33:] for k in range(2)]
    df = spark.createDataFrame(rows + lasts, POINT)
    assert {tuple(r) for r in spikes.flag_readings(df).collect()} == {(30, "sog"), (1030, "sog"), (2030, "sog")}
