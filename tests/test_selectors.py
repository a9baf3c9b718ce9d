import math
from collections import defaultdict

import duckdb
import pytest

from wakeline.plans import operators, reference

SF01 = "/root/testdata/sf0.01"


def budget(n, ratio):
    return min(n, max(2, math.ceil(ratio * n)))


def even(n, k):
    return set(range(n)) if k >= n else {round(i * (n - 1) / (k - 1)) for i in range(k)}


def strata(scores, k):
    n = len(scores)
    if k >= n:
        return set(range(n))
    kept, inner, slots = {0, n - 1}, n - 2, k - 2
    for s in range(slots):
        left, right = 1 + math.floor(s * inner / slots), 1 + math.floor((s + 1) * inner / slots)
        kept.add(max(range(left, right), key=lambda i: (scores[i], -i)))
    return kept


def overall(segments, ratio):
    kept = {(key, i) for key, rows in segments.items() for i in even(len(rows), min(2, len(rows)))}
    rest = sorted(((-speed, event, key, i) for key, rows in segments.items() for i, (event, speed) in enumerate(rows) if (key, i) not in kept))
    total = sum(budget(len(rows), ratio) for rows in segments.values())
    return kept | {x[2:] for x in rest[: total - len(kept)]}


@pytest.mark.parametrize("data", ["sf", SF01])
def test_selectors_keep_the_budget_as_the_reference_does(spark, sf, data):
    at = sf if data == "sf" else data
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    segments = defaultdict(list)
    for mmsi, seg, event, speed in con.execute(reference._prelude(reference.ORACLE_EPOCH) + "SELECT mmsi, seg, event_id, speed FROM trk ORDER BY mmsi, seg, idx").fetchall():
        segments[mmsi, seg].append((event, speed))
    run = lambda name: [tuple(r) for r in (reference.QUERIES | operators.QUERIES)[name](spark, at).collect()]
    ids = lambda kept: sorted((segments[key][i][0],) for key, i in kept)
    assert {len(x) for x in segments.values()} > {1, 2, 3, 9}
    assert sorted(run("uniform_simplify")) == sorted((*key, i) for key, rows in segments.items() for i in even(len(rows), budget(len(rows), 0.25)))
    assert sorted(run("stratified_topk")) == ids((key, i) for key, rows in segments.items() for i in strata([s for _, s in rows], budget(len(rows), 0.25)))
    assert sorted(run("global_budget")) == ids(overall(segments, 0.1))
