"""Trajectory operators as declarative plans over the events-derived track view.

Each plan is one relational expression over a shared track view with its gap sessionisation; Catalyst prunes columns.
Predicates on computed columns (positions, times) are not pushed into the scan. ``QUERIES`` runs a plan on Spark,
``ORACLE`` gives the same text for another SQL engine, so it checks the engines against each other, not the plan;
the operators with oracles of their own are in ``plans/operators.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wakeline.session import load

GAP_S = 43_200
BOXES = [(k, 54.5 + 0.1 * (k % 8), 54.75 + 0.1 * (k % 8), 10.0 + 0.12 * (k % 7), 10.4 + 0.12 * (k % 7), 1704067200 + 86400 * (2 * k), 1704067200 + 86400 * (2 * k + 6), "abcd"[k % 4], "xy"[k % 2]) for k in range(12)]


def _prelude(epoch: str) -> str:
    boxes = ", ".join(f"({i}, {a:.4f}e0, {b:.4f}e0, {c:.4f}e0, {d:.4f}e0, {e}, {f}, '{g}', '{h}')" for i, a, b, c, d, e, f, g, h in BOXES)
    return f"""WITH raw AS (SELECT event_id, user_id AS mmsi, {epoch} AS t, value / 10 AS speed, (event_id * 37) % 360 AS heading, event_type AS ship_type FROM events),
pts AS (SELECT event_id, mmsi, t, speed, heading, ship_type,
  (54500000 + (mmsi % 50) * 20000 + abs((CAST(floor(t / 60) AS BIGINT) + 37 * mmsi) % 5760 - 2880) * 150) / 1e6 AS lat,
  (10000000 + (mmsi % 30) * 30000 + abs((CAST(floor(t / 60) AS BIGINT) + 91 * mmsi) % 8640 - 4320) * 150) / 1e6 AS lon FROM raw),
lagged AS (SELECT *, lag(t) OVER (PARTITION BY mmsi ORDER BY t, event_id) AS pt FROM pts),
marked AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {GAP_S} THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM lagged),
trk AS (SELECT event_id, mmsi, CAST(seg AS BIGINT) AS seg, t, lat, lon, speed, heading, ship_type,
  row_number() OVER (PARTITION BY mmsi, seg ORDER BY t, event_id) - 1 AS idx, count(*) OVER (PARTITION BY mmsi, seg) AS n FROM marked),
steps AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(t) OVER w AS ptime, lag(heading) OVER w AS phead FROM trk WINDOW w AS (PARTITION BY mmsi, seg ORDER BY idx)),
dist AS (SELECT *, CASE WHEN plat IS NULL THEN 0e0 ELSE 2 * 6371.0e0 * asin(least(1e0, sqrt(power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2)))) END AS km FROM steps),
q(query_id, lat_min, lat_max, lon_min, lon_max, t_start, t_end, anchor, footprint) AS (VALUES {boxes}),
hits AS (SELECT q.query_id, q.anchor, q.footprint, k.mmsi, k.seg, k.idx, k.event_id, k.speed FROM q JOIN trk k ON k.lat BETWEEN q.lat_min AND q.lat_max AND k.lon BETWEEN q.lon_min AND q.lon_max AND k.t BETWEEN q.t_start AND q.t_end),
kept AS (SELECT *, CASE WHEN idx = 0 OR idx = n - 1 OR row_number() OVER (PARTITION BY mmsi, seg ORDER BY speed DESC, idx) <= least(n, greatest(2, CAST(ceil(0.3e0 * n) AS BIGINT))) THEN 1 ELSE 0 END AS retained FROM trk)
"""


PLANS: dict[str, str] = {
    "adapter_points": "SELECT event_id, mmsi, t, lat, lon, heading FROM pts",
    "gap_sessions": "SELECT mmsi, seg, count(*) AS n_points, min(t) AS t_start, max(t) AS t_end FROM trk GROUP BY mmsi, seg",
    "load_audit": "SELECT count(*) AS n_segments, CAST(sum(n_points) AS BIGINT) AS n_points, max(n_points) AS longest FROM (SELECT mmsi, seg, count(*) AS n_points FROM trk GROUP BY mmsi, seg) s",
    "box_scan": "SELECT event_id, mmsi, t FROM pts WHERE lat BETWEEN 54.6e0 AND 55.1e0 AND lon BETWEEN 10.1e0 AND 10.7e0 AND t BETWEEN 1704200000 AND 1705500000",
    "box_trajectories": "SELECT DISTINCT mmsi, seg FROM trk WHERE lat BETWEEN 54.6e0 AND 55.1e0 AND lon BETWEEN 10.1e0 AND 10.7e0 AND t BETWEEN 1704200000 AND 1705500000",
    "multi_box_hits": "SELECT q.query_id, count(h.event_id) AS n_hits, count(DISTINCT h.mmsi) AS n_vessels FROM q LEFT JOIN hits h ON q.query_id = h.query_id GROUP BY q.query_id",
    "coverage_union": "SELECT DISTINCT event_id FROM hits",
    "coverage_fraction": "SELECT round((SELECT count(DISTINCT event_id) FROM hits) / ((SELECT count(*) FROM trk) * 1e0), 9) AS coverage",
    "box_iou_pairs": """SELECT a.query_id AS q1, b.query_id AS q2, round(x / (va + vb - x), 6) AS iou FROM (SELECT a.query_id AS qa, b.query_id AS qb,
        greatest(0, least(a.lat_max, b.lat_max) - greatest(a.lat_min, b.lat_min)) * greatest(0, least(a.lon_max, b.lon_max) - greatest(a.lon_min, b.lon_min)) * greatest(0, least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start)) AS x,
        (a.lat_max - a.lat_min) * (a.lon_max - a.lon_min) * (a.t_end - a.t_start) AS va, (b.lat_max - b.lat_min) * (b.lon_max - b.lon_min) * (b.t_end - b.t_start) AS vb
        FROM q a JOIN q b ON a.query_id < b.query_id) p JOIN q a ON a.query_id = p.qa JOIN q b ON b.query_id = p.qb""",
    "family_grouping_sets": "SELECT anchor, footprint, count(*) AS n_hits, count(DISTINCT query_id) AS n_queries FROM hits GROUP BY GROUPING SETS ((anchor), (footprint), (anchor, footprint))",
    "dedup_exact": "SELECT DISTINCT mmsi, t, lat, lon, speed, heading, ship_type FROM pts",
    "ship_type_fill": "SELECT event_id, coalesce(own, min(own) OVER (PARTITION BY mmsi)) AS filled FROM (SELECT event_id, mmsi, CASE WHEN ship_type = 'error' THEN NULL ELSE ship_type END AS own FROM pts) s",
    "max_gap_per_vessel": "SELECT mmsi, max(t - pt) AS max_gap_s FROM lagged GROUP BY mmsi",
    "turn_scores": "SELECT event_id, round(CASE WHEN phead IS NULL OR n <= 2 THEN 0e0 ELSE least(abs(heading - phead), 360 - abs(heading - phead)) / 180e0 END, 6) AS turn_score FROM steps",
    "path_length": "SELECT mmsi, seg, round(sum(km), 5) AS path_km FROM dist GROUP BY mmsi, seg",
    "cumulative_path": "SELECT event_id, round(sum(km) OVER (PARTITION BY mmsi, seg ORDER BY idx ROWS UNBOUNDED PRECEDING), 5) AS cum_km FROM dist",
    "score_topk": "SELECT event_id FROM kept WHERE retained = 1",
    "global_budget": """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY CASE WHEN idx = 0 OR idx = n - 1 THEN 0 ELSE 1 END, speed DESC, event_id) AS rn,
        sum(CASE WHEN idx = 0 THEN k ELSE 0 END) OVER () AS budget FROM (SELECT *, least(n, greatest(2, CAST(ceil(0.1e0 * n) AS BIGINT))) AS k FROM trk) b) g WHERE rn <= budget""",
    "stratified_topk": """SELECT event_id FROM (SELECT event_id, idx, n, k, row_number() OVER (PARTITION BY mmsi, seg, CASE WHEN idx = 0 OR idx = n - 1 THEN -1 ELSE stratum END ORDER BY speed DESC, idx) AS rn
        FROM (SELECT *, CAST(floor((idx * (k - 2) - 1) / (greatest(n - 2, 1) * 1e0)) AS BIGINT) AS stratum FROM (SELECT *, least(n, greatest(2, CAST(ceil(0.25e0 * n) AS BIGINT))) AS k FROM trk) b) c) s WHERE k >= n OR idx = 0 OR idx = n - 1 OR (k > 2 AND rn = 1)""",
    "query_recall_f1": "SELECT query_id, round(r, 6) AS recall, round(2 * r / (1 + r), 6) AS f1 FROM (SELECT q.query_id, coalesce(sum(k.retained) * 1e0 / count(k.retained), 1e0) AS r FROM q LEFT JOIN hits h ON q.query_id = h.query_id LEFT JOIN kept k ON k.event_id = h.event_id GROUP BY q.query_id) x",
    "space_time_grid": "SELECT CAST(floor(lat * 4) AS BIGINT) AS gy, CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour_bin, round(avg(speed), 6) AS mean_speed FROM pts GROUP BY CAST(floor(lat * 4) AS BIGINT), CAST(floor((t % 86400) / 3600) AS BIGINT)",
    "rank_modes": "SELECT event_id, round((row_number() OVER (PARTITION BY mmsi, seg ORDER BY speed, idx) - 1) * 1e0 / greatest(n - 1, 1), 6) AS rank01 FROM trk",
    "zscore": "SELECT event_id, round(CASE WHEN stddev_pop(speed) OVER (PARTITION BY mmsi, seg) <= 1e-6 THEN 0e0 ELSE (speed - avg(speed) OVER (PARTITION BY mmsi, seg)) / stddev_pop(speed) OVER (PARTITION BY mmsi, seg) END, 5) AS z FROM trk WHERE n > 2",
    "pearson_speed_heading": "SELECT round(corr(speed, heading * 1e0), 6) AS pearson FROM pts",
    "latest_wins_upsert": "SELECT mmsi, t, event_id FROM (SELECT mmsi, t, event_id, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, event_id DESC) AS rn FROM pts) u WHERE rn = 1",
    "top_gaps": "SELECT event_id, round(km, 6) AS km FROM dist ORDER BY km DESC, event_id LIMIT 20",
    "speed_summary": "SELECT count(*) AS n, round(min(speed), 6) AS min_speed, round(avg(speed), 6) AS mean_speed, round(max(speed), 6) AS max_speed, round(stddev_pop(speed), 6) AS sd FROM pts",
}

SPARK_EPOCH = "unix_seconds(CAST(ts AS TIMESTAMP))"
ORACLE_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


def _plan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = _prelude(SPARK_EPOCH).replace("FROM events)", "FROM {events})", 1) + PLANS[name]
        return spark.sql(text, events=load(spark, sf_dir, "events"))

    run.__name__ = name
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _plan(n) for n in PLANS}
ORACLE: dict[str, str] = {n: _prelude(ORACLE_EPOCH) + PLANS[n] for n in PLANS}
