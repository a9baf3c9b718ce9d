import math

import numpy as np
import pytest

from wakeline.operators.blocks import in_blocks
from wakeline.operators.trips import stops_and_trips

POINT = "id bigint, mmsi bigint, ts_us bigint, lat double, lon double"
S = 1_000_000


def metres(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    return 2 * 6_371_000 * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))


def voyage(every=120, mmsi=1, seed=1, loops=2):
    """Stays of two hours, each followed by two hours of sailing north."""
    rng, rows, lat, t = np.random.default_rng(seed), [], 55.0, 0
    for _ in range(loops):
        for k in range(7200 // every):
            rows.append((len(rows), mmsi, t * S, lat + rng.normal(0, 5e-5), 10 + rng.normal(0, 5e-5)))
            t += every
        for k in range(7200 // every):
            lat += every * 5 / 111_195
            rows.append((len(rows), mmsi, t * S, lat, 10.0))
            t += every
    return rows


def run(spark, pings, **kw):
    df = spark.createDataFrame(pings, POINT)
    if kw:
        df = in_blocks(df, **kw)
    return sorted(tuple(r) for r in stops_and_trips(df).collect())


def test_metres_are_those_between_first_and_last_ping(spark):
    rows = voyage()
    got = run(spark, rows + [(9_999, *rows[5][1:])])  # a repeated ping counts once
    assert [g[1] for g in got if g[1] == "stop"] == ["stop"] * 2 and len(got) == 4
    at = {r[2]: r[3:] for r in rows}
    for _, kind, start, end, duration, m in got:
        track = [at[t] for t in sorted(at) if start <= t <= end]
        assert duration == end - start and m == pytest.approx(sum(metres(a, b) for a, b in zip(track, track[1:])), rel=1e-9)


def test_a_motionless_stop_has_no_metres(spark):
    rows = [(i, 1, i * 120 * S, 55.0 + max(0, 10 - i) * 0.005, 10.0) for i in range(60)]
    assert [(k, round(m)) for _, k, *_, m in run(spark, rows) if k == "stop"] == [("stop", 0)]


@pytest.mark.parametrize("every,step", [(120, 25), (2, 10), (30, 6)])
def test_slow_or_often_reported_sailing_is_no_stop(spark, every, step):
    rows = [(i, 1, i * every * S, 55.0 + i * step / 111_195, 10.0) for i in range(max(40, 4800 // every))]
    assert [k for _, k, *_ in run(spark, rows)] == ["trip"]


def test_blocks_do_not_show(spark):
    rows = [r for m in (1, 2) for r in voyage(every=60, mmsi=m, seed=m, loops=4)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    whole = run(spark, rows)
    cut = run(spark, rows, rows=100, halo=20, chunk_us=1800 * S)
    assert [c[:5] for c in cut] == [w[:5] for w in whole] and len(whole) == 16
    assert [c[5] for c in cut] == pytest.approx([w[5] for w in whole])
