"""Small cases whose results are known by hand, and properties."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.operators import labels, ranking, row_parser, workloads
from wakeline.session import load

TRACK = "mmsi bigint, seg bigint, idx bigint, v double, retained int"


def track(spark, values, kept=()):
    return spark.createDataFrame([(1, 1, i, float(v) if v is not None else None, int(i in kept)) for i, v in enumerate(values)], TRACK)


def test_score_modes(spark):
    t = track(spark, [3, 1, 1, 2])
    got = lambda mode: [r["score"] for r in labels.score_mode(t, "v", mode).orderBy("idx").collect()]
    assert got("rank") == pytest.approx([1, 0, 1 / 3, 2 / 3]) and got("rank_tie") == pytest.approx([1, 1 / 6, 1 / 6, 2 / 3])
    assert [r["score"] for r in labels.score_mode(track(spark, [5, 5]), "v", "zscore_sigmoid").collect()] == [0.5, 0.5]
    assert labels.score_mode(track(spark, [7]), "v", "rank").first()["score"] == 0
    with pytest.raises(ValueError):
        labels.score_mode(t, "v", "other")


def test_runs_and_windows(spark):
    t = track(spark, [0, 5, 7, 6, 0, 1, None, 2])
    assert [r["idx"] for r in labels.run_heads(t, "v").filter("support = 1").orderBy("idx").collect()] == [2, 3, 5, 7]
    assert [r["near_sum"] for r in labels.window_sum(t, "v", 1).orderBy("idx").collect()] == [5, 12, 18, 13, 7, 1, 3, 2]


def test_masses_masks_and_ends(spark):
    t = track(spark, [1, 1, 1, 1, 1, 0, -3], kept=(0, 3, 6))
    assert sum(r["mass"] for r in labels.unit_mass(t, "v").collect()) == pytest.approx(1)
    assert tuple(labels.position_mass(t, "v").first()) == pytest.approx((0.4, 0.6, 0.0))
    assert tuple(labels.retained_gaps(t).first()) == pytest.approx((3.0, 0.5, 3.0))
    assert labels.endpoint_share(t).first()[0] == 1.0 and labels.endpoint_share(track(spark, [1, 1], kept=(0,))).first()[0] == 0.0
    assert tuple(labels.mask_overlap(t.withColumn("b", F.lit(0)), "b", "b").first()) == (0, 0, 1.0, 0)


def test_point_labels(spark):
    pts = track(spark, [1, 1, 1, 1]).withColumn("id", F.col("idx"))
    hits = pts.filter("idx < 2").withColumn("query_id", F.lit(1))
    got = {r["id"]: r["label"] for r in labels.point_labels(pts, hits, "id", hits.select("query_id").distinct()).collect()}
    assert got == pytest.approx({0: 2 / 3, 1: 2 / 3, 2: 0, 3: 0})


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 512), st.text("ab", max_size=3), st.lists(st.floats(0, 5), min_size=1, max_size=5))
def test_quotas_and_sequences_meet_the_request(n, seed, weights):
    w = {f"f{i}": x for i, x in enumerate(weights)}
    quota, seq = workloads.quotas(w, n), workloads.balanced_sequence(w, n, seed)
    assert sum(quota.values()) == n == len(seq) and Counter(seq) == {k: v for k, v in quota.items() if v}


def test_every_family_shows_early():
    assert set(workloads.balanced_sequence({"a": 0.8, "b": 0.15, "c": 0.05}, 100, "s")[:32]) == {"a", "b", "c"}


def test_draws_follow_the_weights(spark):
    pts = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 0, 8, 1])], "id int, w double")
    got = workloads.draw(pts, "w", "id", 400, "x").collect()
    n = Counter(r["id"] for r in got)
    assert len(got) == 400 and len({r["query_id"] for r in got}) == 400 and set(n) == {1, 3, 4} and 280 < n[3] < 350
    assert workloads.draw(pts.limit(0), "w", "id", 5, "x").count() == 0


def test_final_grid(spark):
    cells = [(p, r, 0.5, 0.4, 0.3) for p in "abcd" for r in workloads.RATIOS]
    grid = lambda rows: workloads.final_grid(spark.createDataFrame(rows, "profile string, ratio double, learned double, uniform double, farthest double"), list("abcd")).first().asDict()
    assert grid(cells) == {"cells": 28, "missing": 0, "uniform_wins": 28, "farthest_wins": 28, "low_wins": 12, "at_5_percent_wins": 4, "passed": True}
    assert not grid(cells[1:])["passed"] and grid(cells[1:])["missing"] == 1
    assert not grid([(*c[:2], 0.1, 0.4, 0.3) for c in cells])["passed"]


def test_metrics_of_nothing_and_of_one_side(spark):
    d = spark.createDataFrame([(i, float(i), i >= 3) for i in range(6)], "id int, s double, p boolean")
    assert ranking.roc_auc(d, "s", F.col("p")).first()[0] == 1.0 and ranking.average_precision(d, "s", F.col("p"), "id").first()[0] == 1.0
    assert ranking.roc_auc(d.filter("p"), "s", F.col("p")).first()[0] is None
    assert ranking.ks_distance(d, "s", F.col("p")).first()[0] == 1.0
    assert ranking.spearman(d.withColumn("t", -F.col("s")), "s", "t").first()[0] == pytest.approx(-1)
    assert ranking.spearman(d.limit(0).withColumn("t", F.col("s")), "s", "t").first()[0] == 0.0


def test_reject_counts_are_those_of_the_lines(spark, sf):
    lines, progress = load(spark, sf, "ais_raw_lines"), load(spark, sf, "ais_import_progress")
    found = {r["line_id"]: r["reason"] for r in row_parser.found_bad_lines(lines, progress).collect()}
    want = Counter((r["source_path"], found.get(r["line_id"], "loaded")) for r in lines.collect())
    assert {(r["source_path"], r["reason"]): r["n_lines"] for r in row_parser.reject_counts(lines, progress).collect()} == want
