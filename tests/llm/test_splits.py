import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm.splits import assign_splits, choose_counts, choose_split, connected_components, found_leaks, identity_edges
from wakeline.session import load


class Sets:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def union(self, a, b):
        self.p[self.find(a)] = self.find(b)


def brute_sets(rows):
    s = Sets()
    for r in rows:
        if r["mmsi"] is None:
            continue
        imo = re.sub(r"\D", "", r["imo"] or "")
        call = re.sub(r"[^0-9A-Z]", "", (r["callsign"] or "").upper())
        if len(imo) == 7 and len(set(imo)) > 1:
            s.union(r["mmsi"], "i" + imo)
        if len(set(call)) > 1 and call not in ("NONE", "UNKNOWN", "NA"):
            s.union(r["mmsi"], "c" + call)
    return s


def test_leaks_against_union_find(spark):
    d = "/root/testdata/sf0.01"
    runs, ident = load(spark, d, "run_data_split"), load(spark, d, "vessel_identity")
    s = brute_sets(ident.collect())
    want = set()
    for r in runs.collect():
        for a in r["train_mmsis"] or []:
            for b in r["test_mmsis"] or []:
                if a == b or s.find(a) == s.find(b):
                    want.add((r["run_id"], min(a, b), max(a, b)))
    assert {tuple(r) for r in found_leaks(runs, ident).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + d, f"k{i}") for i in range(60) for d in (0, 1)], "mmsi bigint, key string")
    assert {r["root"] for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_nulls_and_fillers_say_nothing(spark):
    ident = spark.createDataFrame([(1, "IMO 0000000", "n/a"), (2, "0000000", "N/A"), (None, "1234567", None), (3, None, "XXXX"), (4, "unknown", "xxxx")], "mmsi bigint, imo string, callsign string")
    assert identity_edges(ident).count() == 0
    runs = spark.createDataFrame([(1, [1, 1, None], [1, 2]), (2, None, [1]), (3, [], [])], "run_id bigint, train_mmsis array<bigint>, test_mmsis array<bigint>")
    assert [tuple(r) for r in found_leaks(runs, ident).collect()] == [(1, 1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4), st.integers(0, 60))
def test_subset_sum_is_closest(sizes, target):
    totals = {0}
    for s, n in sizes.items():
        totals = {t + k * s for t in totals for k in range(n + 1)}
    got = choose_counts(sizes, target)
    assert all(got[s] <= sizes[s] for s in got)
    assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(t - target) for t in totals)


def test_whole_vessels_on_one_side_and_shares_met(spark):
    d = "/root/testdata/sf0.01"
    rows = load(spark, d, "run_trajectories").select("traj_id", "mmsi")
    roots = connected_components(identity_edges(load(spark, d, "vessel_identity")))
    got = assign_splits(rows, roots, shares={"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    sides = defaultdict(set)
    for r in got:
        sides[r["vessel"]].add(r["split"])
    assert len(got) == rows.count() and all(len(x) == 1 for x in sides.values())
    count = Counter(r["split"] for r in got)
    assert abs(count["test"] - 0.1 * len(got)) <= 1 and abs(count["validation"] - 0.1 * len(got)) <= 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 400), st.integers(1, 900), min_size=1, max_size=12), st.integers(1, 64), st.floats(0.01, 0.5))
def test_coarse_units_settle_to_the_row(sizes, max_units, share):
    total = sum(s * n for s, n in sizes.items())
    target = round(share * total)
    got = choose_split(sizes, target, max_units)
    exact = choose_counts(sizes, target)
    miss = lambda c: abs(sum(s * n for s, n in c.items()) - target)
    assert all(0 <= got[s] <= sizes[s] for s in got)
    assert miss(got) <= miss(exact) + min(sizes)


def test_a_hundred_million_rows_in_fives():
    got = choose_split({5: 20_000_000}, 10_000_000, 1 << 21)
    assert got == {5: 2_000_000}


def test_shares_hold_when_units_are_coarse(spark):
    d = "/root/testdata/sf0.01"
    rows = load(spark, d, "run_trajectories").select("traj_id", "mmsi")
    roots = connected_components(identity_edges(load(spark, d, "vessel_identity")))
    got = assign_splits(rows, roots, shares={"train": 0.8, "validation": 0.1, "test": 0.1}, max_units=16).collect()
    count = Counter(r["split"] for r in got)
    assert abs(count["test"] - 0.1 * len(got)) <= 1 and abs(count["validation"] - 0.1 * len(got)) <= 1


def test_long_chain_settles(spark):
    n = 300
    edges = spark.createDataFrame([(i, f"c{j}") for i in range(n) for j in (i, i + 1)], "mmsi bigint, key string")
    assert {r["root"] for r in connected_components(edges).collect()} == {0}
