"""Queries that call the track operators, and SQL written for another engine from what the operators shall compute.

The oracle texts share only the view of the test data (points, segments, boxes, a retained mask) with the queries;
the operators' own work is written anew in SQL, mostly by plain joins and correlated counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import boxes, cleaning, labels, ranking, scoring, selectors, tracks, workloads
from wakeline.plans import reference
from wakeline.session import load

BOX_SCHEMA = "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start bigint, t_end bigint, anchor string, footprint string"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame of the test data's track view: pts, trk, steps or kept."""
    text = reference._prelude(reference.SPARK_EPOCH).replace("FROM events)", "FROM {events})", 1) + f"SELECT * FROM {name}"
    return spark.sql(text, events=load(spark, sf_dir, "events"))


def box_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, *[float(f"{x:.4f}") for x in b[:4]], *b[4:]) for k, *b in reference.BOXES]
    return spark.createDataFrame(rows, BOX_SCHEMA)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = reference._prelude(reference.ORACLE_EPOCH) + sql
        return f

    return add


def _pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pts").withColumnRenamed("speed", "sog")


def _km(a: str, b: str) -> str:
    """Kilometres between row aliases a and b."""
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    return f"(12742e0 * CASE WHEN {h} > 1 THEN asin(1e0) ELSE asin(sqrt({h})) END)"


def _reaches(a: str, b: str, margin: str = "1.2e0", growth: str = "0.3e0") -> str:
    h = f"(abs({b}.t - {a}.t) / 3600e0)"
    return f"({_km(a, b)} <= greatest(greatest({a}.speed, {b}.speed) * 1.852e0 * {h} * {margin} * (1 + {growth} * {h}), 0.05e0))"


#: Pings numbered by vessel, joined with the pings one and two places away.
_NEAR = """, num AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, event_id) AS k FROM pts),
near AS (SELECT p.event_id, p.k, b1.k IS NOT NULL AS hb1, b2.k IS NOT NULL AS hb2, a1.k IS NOT NULL AS ha1, a2.k IS NOT NULL AS ha2,
  {b1} AS rb1, {b2} AS rb2, {a1} AS ra1, {a2} AS ra2 FROM num p
  LEFT JOIN num b1 ON b1.mmsi = p.mmsi AND b1.k = p.k - 1 LEFT JOIN num b2 ON b2.mmsi = p.mmsi AND b2.k = p.k - 2
  LEFT JOIN num a1 ON a1.mmsi = p.mmsi AND a1.k = p.k + 1 LEFT JOIN num a2 ON a2.mmsi = p.mmsi AND a2.k = p.k + 2)
""".format(**{n: _reaches("p", n, margin="0.05e0") for n in ("b1", "b2", "a1", "a2")})
#: The test data's steps are hours apart; a margin of 0.05 makes some of them too long.
_REACH = cleaning.Reach(tie="event_id", margin=0.05)


@query(_NEAR + """SELECT event_id FROM near WHERE NOT ((k = 1 AND ha2 AND NOT coalesce(ra1, false) AND NOT coalesce(ra2, false))
    OR (k IN (2, 3) AND ha1 AND NOT coalesce(rb1, false) AND NOT coalesce(ra1, false)))""")
def outlier_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_wrong_start(_pings(spark, sf_dir), _REACH).select("event_id")


@query(_NEAR + "SELECT event_id FROM near WHERE NOT hb1 OR NOT ha1 OR rb1 OR ra1")
def outlier_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_between(_pings(spark, sf_dir), _REACH).select("event_id")


@query(_NEAR + """SELECT event_id FROM near WHERE CASE WHEN hb2 AND ha2 THEN rb2 OR ra2 WHEN NOT hb2 AND ha1 AND ha2 THEN ra1 OR ra2
    WHEN hb1 AND hb2 AND NOT ha2 THEN rb1 OR rb2 ELSE true END""")
def outlier_skip_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_pairs(_pings(spark, sf_dir), _REACH).select("event_id")


@query()
def outlier_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_unreachable(_pings(spark, sf_dir), _REACH).select("event_id")


@query(f""", num AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, event_id) AS k FROM pts),
j AS (SELECT c.event_id, c.t - p.t AS seconds, {_km("p", "c")} AS km, greatest(p.speed, c.speed) AS top, n.t - p.t AS over_s, {_km("p", "n")} AS over_km
  FROM num c JOIN num p ON p.mmsi = c.mmsi AND p.k = c.k - 1 LEFT JOIN num n ON n.mmsi = c.mmsi AND n.k = c.k + 1),
r AS (SELECT *, CASE WHEN top > 0 AND seconds > 0 THEN km / (seconds / 3600e0 * 1.852e0) / top END AS ratio, CASE WHEN over_s > 0 THEN over_km / (over_s / 3600e0 * 1.852e0) END AS over_kn FROM j)
SELECT event_id, CASE WHEN seconds = 0 THEN 'DUPLICATE_TS' WHEN ratio <= 1.5 THEN 'OK_SPEED_MATCHES' WHEN over_kn < top * 1.5e0 AND ratio > 2 THEN 'SUSPICIOUS_SKIP_FIXES'
  WHEN ratio > 3 THEN 'SUSPICIOUS_VERY_FAST' WHEN ratio > 1.5 THEN 'BORDERLINE' ELSE 'OK' END AS verdict FROM r""")
def gap_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.gap_verdicts(_pings(spark, sf_dir), "event_id").select("event_id", "verdict")


@query(""", typ AS (SELECT *, CASE WHEN ship_type = 'error' THEN 'Undefined' ELSE ship_type END AS st FROM pts)
SELECT event_id FROM typ WHERE st <> 'SAR' AND mmsi NOT IN (SELECT mmsi FROM typ WHERE st = 'Undefined' AND speed > 15 GROUP BY mmsi HAVING count(*) >= 3)""")
def vessel_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pings(spark, sf_dir).withColumn("ship_type", F.when(F.col("ship_type") == "error", "Undefined").otherwise(F.col("ship_type")))
    return cleaning.drop_fast_vessels(p, above=15.0, rows=3).select("event_id")


#: floor(speed) stands for a speed over ground that is often 0.
_THIN = """, rest AS (SELECT *, floor(speed) AS sog FROM pts), thin AS (SELECT * FROM rest p WHERE sog <> 0 OR NOT EXISTS (SELECT 1 FROM rest o
  WHERE o.mmsi = p.mmsi AND o.sog = 0 AND floor(o.t / 3600) = floor(p.t / 3600) AND (o.t < p.t OR (o.t = p.t AND o.event_id < p.event_id))))
"""


def _thinned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _pings(spark, sf_dir).withColumn("sog", F.floor("sog"))
    return p, cleaning.thin_stationary(p, "event_id")


@query(_THIN + "SELECT event_id FROM thin")
def stationary_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thinned(spark, sf_dir)[1].select("event_id")


@query(_THIN + """, b AS (SELECT mmsi, count(*) AS n_before, max(g) AS gap_before FROM (SELECT mmsi, t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) AS g FROM rest) GROUP BY mmsi),
a AS (SELECT mmsi, count(*) AS n_after, max(g) AS gap_after FROM (SELECT mmsi, t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) AS g FROM thin) GROUP BY mmsi)
SELECT mmsi, n_before, gap_before, n_after, gap_after, n_before - n_after AS deleted, round(100e0 * (n_before - n_after) / n_before, 1) AS pct_deleted FROM b JOIN a USING (mmsi)""")
def before_after_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.change_report(*_thinned(spark, sf_dir), tie="event_id")


@query("""SELECT count(*) AS loaded, count(*) FILTER (WHERE speed BETWEEN 0 AND 40 AND heading % 7 <> 0) AS kept, CAST(0 AS BIGINT) AS bad_time, CAST(0 AS BIGINT) AS bad_lat, CAST(0 AS BIGINT) AS bad_lon,
  count(*) FILTER (WHERE NOT speed BETWEEN 0 AND 40) AS bad_speed, count(*) FILTER (WHERE heading % 7 = 0) AS bad_heading,
  (SELECT count(*) - count(DISTINCT mmsi * 10000000000 + t) FROM pts WHERE speed BETWEEN 0 AND 40 AND heading % 7 <> 0) AS repeated_times FROM pts""")
def load_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh heading is made invalid, and speeds above 40."""
    p = view(spark, sf_dir, "pts").withColumns({"heading": F.when(F.col("heading") % 7 == 0, F.lit(511)).otherwise(F.col("heading")), "speed": F.when(F.col("speed") > 40, F.lit(999.0)).otherwise(F.col("speed"))})
    return tracks.fault_counts(p)


@query(""", long AS (SELECT mmsi, seg, n, idx, event_id FROM trk WHERE n >= 3),
pick AS (SELECT DISTINCT mmsi, seg, CASE WHEN n <= 5 THEN idx ELSE CAST(floor(i * (n - 1) / 4e0) AS BIGINT) END AS idx FROM long, (VALUES (0), (1), (2), (3), (4)) v(i))
SELECT l.event_id, l.mmsi, l.seg, least(l.n, 5) AS n FROM long l JOIN pick USING (mmsi, seg, idx)""")
def segments_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks.segments(view(spark, sf_dir, "pts"), max_gap=reference.GAP_S, min_points=3, max_points=5, tie="event_id")
    return d.select("event_id", "mmsi", "seg", "n")


_LEN = ", len AS (SELECT count(*) AS v FROM trk GROUP BY mmsi, seg)\n"


@query(_LEN + """SELECT count(*) AS n, min(v) * 1e0 AS lo, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99,
  max(v) * 1e0 AS hi, round(avg(v), 6) AS mean FROM len""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks.summary(view(spark, sf_dir, "trk").groupBy("mmsi", "seg").agg(F.count("*").alias("v")), "v")
    return _rounded(d)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


@query("SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, min(t) AS t_min, max(t) AS t_max FROM pts")
def dataset_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.extent(view(spark, sf_dir, "pts"))


@query("SELECT query_id, event_id FROM hits")
def box_hits_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.hits(view(spark, sf_dir, "trk"), box_frame(spark)).select("query_id", "event_id")


@query("SELECT event_id FROM trk WHERE event_id IN (SELECT event_id FROM hits)")
def coverage_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.covered(view(spark, sf_dir, "trk"), box_frame(spark), "event_id").select("event_id")


def _slab(c: str, lo: str, hi: str, side: str) -> str:
    """Where on the step (0 to 1) a slab is entered or left; the whole line if the step runs along it inside."""
    a, b = f"(({lo} - {c}) / nullif({c}2 - {c}, 0e0))", f"(({hi} - {c}) / nullif({c}2 - {c}, 0e0))"
    return f"coalesce({'least' if side == 'in' else 'greatest'}({a}, {b}), {'0e0' if side == 'in' else '1e0'})"


_SLABS = (("t", "t_start", "t_end"), ("lat", "lat_min", "lat_max"), ("lon", "lon_min", "lon_max"))
_CROSS = f""", st AS (SELECT a.mmsi, a.seg, a.idx, a.t * 1e0 AS t, a.lat, a.lon, b.t * 1e0 AS t2, b.lat AS lat2, b.lon AS lon2 FROM trk a JOIN trk b ON b.mmsi = a.mmsi AND b.seg = a.seg AND b.idx = a.idx + 1),
cr AS (SELECT query_id, mmsi, seg, idx FROM st, q WHERE {" AND ".join(f"({c} <> {c}2 OR {c} BETWEEN {lo} AND {hi})" for c, lo, hi in _SLABS)}
  AND least(1e0, {", ".join(_slab(*s, "out") for s in _SLABS)}) >= greatest(0e0, {", ".join(_slab(*s, "in") for s in _SLABS)})
  AND NOT ({" AND ".join(f"{c} BETWEEN {lo} AND {hi} AND {c}2 BETWEEN {lo} AND {hi}" for c, lo, hi in _SLABS)}))
"""


@query(_CROSS + "SELECT query_id, mmsi, seg, idx FROM cr")
def box_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.crossings(view(spark, sf_dir, "trk"), box_frame(spark))


@query(_CROSS + "SELECT query_id, mmsi, seg, idx FROM cr UNION SELECT query_id, mmsi, seg, idx + 1 FROM cr")
def crossing_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.brackets(view(spark, sf_dir, "trk"), box_frame(spark))


_DIAG = """, d AS (SELECT q.query_id, count(h.event_id) AS n_hits, count(DISTINCT h.mmsi * 100000 + h.seg) AS n_segments FROM q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id),
e AS (SELECT count(*) AS np, count(DISTINCT mmsi * 100000 + seg) AS ns, max(lat) - min(lat) AS sy, max(lon) - min(lon) AS sx, max(t) - min(t) AS st FROM trk),
dia AS (SELECT query_id, n_hits, n_segments, round(n_hits / (np * 1e0), 6) AS point_share, round(n_segments / (ns * 1e0), 6) AS segment_share, round(least(1e0, (lat_max - lat_min) / sy), 6) AS lat_share,
  round(least(1e0, (lon_max - lon_min) / sx), 6) AS lon_share, round(least(1e0, (t_end - t_start) / (st * 1e0)), 6) AS t_share FROM d JOIN q USING (query_id), e)
"""


def _diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.diagnostics(view(spark, sf_dir, "trk"), box_frame(spark))


@query(_DIAG + "SELECT * FROM dia")
def query_span_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_diag(spark, sf_dir))


@query(_DIAG + """SELECT query_id, CASE WHEN n_hits < 5 THEN 'too_few_point_hits' WHEN point_share < 0.002 THEN 'too_low_point_hit_fraction' WHEN n_segments < 12 THEN 'too_few_trajectory_hits'
  WHEN point_share > 0.02 THEN 'too_broad' END AS reason FROM dia""")
def query_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.acceptance(_diag(spark, sf_dir), min_hits=5, min_share=0.002, min_segments=12, max_share=0.02).select("query_id", "reason")


@query(_DIAG + "SELECT count(*) AS n_queries, round(avg(CASE WHEN n_hits = 0 THEN 1e0 ELSE 0e0 END), 6) AS empty_rate, round(quantile_cont(n_hits, 0.1), 6) AS p10, round(quantile_cont(n_hits, 0.5), 6) AS p50, round(quantile_cont(n_hits, 0.9), 6) AS p90 FROM dia")
def workload_summary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(boxes.workload_summary(_diag(spark, sf_dir)))


_OVER = "greatest(0e0, least(a.{1}, b.{1}) - greatest(a.{0}, b.{0}))"
_PART = " * ".join(_OVER.format(lo, hi) for _, lo, hi in _SLABS)
_VOL = lambda x: " * ".join(f"({x}.{hi} - {x}.{lo})" for _, lo, hi in _SLABS)


@query(f"""SELECT * FROM (SELECT a.query_id, b.query_id AS earlier_id, round(({_PART}) / ({_VOL("a")} + {_VOL("b")} - {_PART}), 6) AS iou FROM q a JOIN q b ON a.query_id > b.query_id) WHERE iou >= 0.05""")
def near_duplicate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(boxes.near_duplicates(box_frame(spark), 0.05))


@query("""SELECT query_id, mmsi, seg, idx, CASE WHEN NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.mmsi = h.mmsi AND o.seg = h.seg AND o.idx = h.idx - 1) THEN 1 ELSE 0 END AS entry,
  CASE WHEN NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.mmsi = h.mmsi AND o.seg = h.seg AND o.idx = h.idx + 1) THEN 1 ELSE 0 END AS "exit" FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.mmsi = h.mmsi AND o.seg = h.seg AND o.idx = h.idx - 1)
  OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.mmsi = h.mmsi AND o.seg = h.seg AND o.idx = h.idx + 1)""")
def boundary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.entry_exit(view(spark, sf_dir, "trk"), box_frame(spark))


#: Removed points with the nearest retained ones on both sides, by correlated extrema, and their two errors.
_DEV = """, an AS (SELECT p.*, (SELECT max(o.idx) FROM kept o WHERE o.mmsi = p.mmsi AND o.seg = p.seg AND o.retained = 1 AND o.idx < p.idx) AS li,
  (SELECT min(o.idx) FROM kept o WHERE o.mmsi = p.mmsi AND o.seg = p.seg AND o.retained = 1 AND o.idx > p.idx) AS ri FROM kept p WHERE p.retained = 0),
de AS (SELECT p.mmsi, p.seg, p.idx, p.t, p.lat, p.lon, l.lat AS la, l.lon AS lo, r.lat AS ra, r.lon AS ro, greatest(0e0, least(1e0, (p.t - l.t) / greatest((r.t - l.t) * 1e0, 1e-9))) AS f
  FROM an p JOIN kept l ON l.mmsi = p.mmsi AND l.seg = p.seg AND l.idx = p.li JOIN kept r ON r.mmsi = p.mmsi AND r.seg = p.seg AND r.idx = p.ri),
er AS (SELECT *, 111.32e0 * sqrt(pow((lon - lo - f * (ro - lo)) * cos(radians(lat)), 2) + pow(lat - la - f * (ra - la), 2)) AS sed,
  111.32e0 * abs((ro - lo) * cos(radians(la)) * (lat - la) - (ra - la) * (lon - lo) * cos(radians(la))) / greatest(sqrt(pow((ro - lo) * cos(radians(la)), 2) + pow(ra - la, 2)), 1e-11) AS ped FROM de)
"""


@query(_DEV + "SELECT round(avg(sed), 6) AS avg_sed_km, round(max(sed), 6) AS max_sed_km, round(avg(ped), 6) AS avg_ped_km, round(max(ped), 6) AS max_ped_km, count(*) AS removed_points FROM er")
def sed_ped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.distortion(view(spark, sf_dir, "kept")))


@query(f""", num AS (SELECT mmsi, seg, lat, lon, retained, idx, sum(retained) OVER (PARTITION BY mmsi, seg ORDER BY idx) AS k FROM kept)
SELECT round(least(1e0, (SELECT sum({_km("a", "b")}) FROM num a JOIN num b ON a.mmsi = b.mmsi AND a.seg = b.seg AND b.k = a.k + 1 AND a.retained = 1 AND b.retained = 1)
  / (SELECT sum({_km("a", "b")}) FROM num a JOIN num b ON a.mmsi = b.mmsi AND a.seg = b.seg AND b.idx = a.idx + 1)), 6) AS length_preservation""")
def length_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.length_kept(view(spark, sf_dir, "kept")))


#: Hits numbered within query and segment.
_HIT = ", hk AS (SELECT h.query_id, k.*, row_number() OVER (PARTITION BY h.query_id, k.mmsi, k.seg ORDER BY k.idx) AS pos, count(*) OVER (PARTITION BY h.query_id, k.mmsi, k.seg) AS m FROM hits h JOIN kept k ON k.event_id = h.event_id)\n"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.hits(view(spark, sf_dir, "kept"), box_frame(spark))


@query(_HIT + "SELECT query_id, round(r, 6) AS recall, round(2 * r / (1 + r), 6) AS f1 FROM (SELECT query_id, sum(retained) * 1e0 / count(*) AS r FROM hk GROUP BY query_id)")
def point_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.point_scores(_hits(spark, sf_dir)))


@query(_HIT + """, bend AS (SELECT b.query_id, b.mmsi, b.seg, b.retained, coalesce(greatest(0e0, sqrt(pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2)) + sqrt(pow(c.lat - b.lat, 2) + pow(c.lon - b.lon, 2)) - sqrt(pow(c.lat - a.lat, 2) + pow(c.lon - a.lon, 2))), 0e0) AS w
  FROM hk b LEFT JOIN hk a ON a.query_id = b.query_id AND a.mmsi = b.mmsi AND a.seg = b.seg AND a.pos = b.pos - 1 LEFT JOIN hk c ON c.query_id = b.query_id AND c.mmsi = b.mmsi AND c.seg = b.seg AND c.pos = b.pos + 1),
s AS (SELECT query_id, sum(w) AS ww, sum(w * retained) / nullif(sum(w), 0e0) AS r, sum(retained) AS k FROM bend GROUP BY query_id, mmsi, seg)
SELECT query_id, round(avg(CASE WHEN k = 0 THEN 0e0 WHEN ww <= 1e-12 THEN 1e0 ELSE 2 * r / (1 + r) END), 6) AS turn FROM s GROUP BY query_id""")
def turn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.turn_scores(_hits(spark, sf_dir)))


@query(_HIT + f""", way AS (SELECT b.query_id, b.mmsi, b.seg, b.pos, b.m, b.retained, b.t * 1e0 AS v1, sum(coalesce({_km("a", "b")}, 0e0)) OVER (PARTITION BY b.query_id, b.mmsi, b.seg ORDER BY b.pos) AS v2
  FROM hk b LEFT JOIN hk a ON a.query_id = b.query_id AND a.mmsi = b.mmsi AND a.seg = b.seg AND a.pos = b.pos - 1),
mark AS (SELECT query_id, mmsi, seg, pos, v1, v2 FROM way WHERE retained = 1),
runs AS (SELECT w.query_id, w.mmsi, w.seg, w.pos, (SELECT max(k.pos) FROM mark k WHERE k.query_id = w.query_id AND k.mmsi = w.mmsi AND k.seg = w.seg AND k.pos < w.pos) AS lp,
  (SELECT min(k.pos) FROM mark k WHERE k.query_id = w.query_id AND k.mmsi = w.mmsi AND k.seg = w.seg AND k.pos > w.pos) AS rp, w.m FROM way w WHERE retained = 0),
gaps AS (SELECT r.query_id, r.mmsi, r.seg, max(b.v1 - a.v1) AS g1, max(b.v2 - a.v2) AS g2 FROM runs r JOIN way a ON a.query_id = r.query_id AND a.mmsi = r.mmsi AND a.seg = r.seg AND a.pos = coalesce(r.lp, 1)
  JOIN way b ON b.query_id = r.query_id AND b.mmsi = r.mmsi AND b.seg = r.seg AND b.pos = coalesce(r.rp, r.m) GROUP BY r.query_id, r.mmsi, r.seg),
tot AS (SELECT query_id, mmsi, seg, count(*) AS n, sum(retained) AS k, max(v1) - min(v1) AS s1, max(v2) - min(v2) AS s2 FROM way GROUP BY query_id, mmsi, seg),
sc AS (SELECT t.query_id, CASE WHEN k = 0 THEN 0e0 WHEN n = 1 OR s1 <= 1e-9 THEN 1e0 ELSE 1 - coalesce(g1, 0e0) / s1 END AS c1, CASE WHEN k = 0 THEN 0e0 WHEN n = 1 OR s2 <= 1e-9 THEN 1e0 ELSE 1 - coalesce(g2, 0e0) / s2 END AS c2
  FROM tot t LEFT JOIN gaps g USING (query_id, mmsi, seg))
SELECT query_id, round(least(avg(c1), avg(c2)), 6) AS gap FROM sc GROUP BY query_id""")
def gap_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.gap_scores(_hits(spark, sf_dir)))


@query(_DEV + _HIT + f""", j AS (SELECT b.query_id, b.mmsi, b.seg, b.retained, {_km("a", "b")} AS km, (er.sed + er.ped) / 2 AS err FROM hk b LEFT JOIN hk a ON a.query_id = b.query_id AND a.mmsi = b.mmsi AND a.seg = b.seg AND a.pos = b.pos - 1
  LEFT JOIN er ON er.mmsi = b.mmsi AND er.seg = b.seg AND er.idx = b.idx),
g AS (SELECT query_id, mmsi, seg, count(*) AS n, sum(retained) AS k, coalesce(sum(km), 0e0) / greatest(1, count(*) - 1) AS step, avg(err) AS err FROM j GROUP BY query_id, mmsi, seg),
s AS (SELECT query_id, CASE WHEN (SELECT sum(retained) FROM kept o WHERE o.mmsi = g.mmsi AND o.seg = g.seg) < 2 THEN 0e0 WHEN k = n THEN 1e0 WHEN err IS NULL THEN 0e0 ELSE least(1e0, k / 2e0) / (1 + err / greatest(step, 1e-6)) END AS v FROM g)
SELECT query_id, round(avg(v), 6) AS interpolation FROM s GROUP BY query_id""")
def interp_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.interpolation_scores(_hits(spark, sf_dir), view(spark, sf_dir, "kept")))


_SPLIT = "mmsi % 2 = 0"


def _left():  # noqa: ANN202
    return F.col("mmsi") % 2 == 0


@query(""", r AS (SELECT (SELECT avg(1e0) FROM pts) AS one, (rank() OVER (ORDER BY speed)) + (count(*) OVER (PARTITION BY speed) - 1) / 2e0 AS a, (rank() OVER (ORDER BY heading)) + (count(*) OVER (PARTITION BY heading) - 1) / 2e0 AS b FROM pts)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman_speed_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.spearman(view(spark, sf_dir, "pts"), "speed", "heading"))


@query("""SELECT value, n, CAST(rank AS DOUBLE) AS rank FROM (SELECT heading AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY heading) - (count(*) - 1) / 2e0 AS rank FROM pts GROUP BY heading)""")
def value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.average_ranks(view(spark, sf_dir, "pts"), "heading")


@query(""", r AS (SELECT heading > 300 AS pos, (rank() OVER (ORDER BY speed)) + (count(*) OVER (PARTITION BY speed) - 1) / 2e0 AS a FROM pts)
SELECT round((sum(a) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2e0) / (count(*) FILTER (WHERE pos) * 1e0 * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.roc_auc(view(spark, sf_dir, "pts"), "speed", F.col("heading") > 300))


_BY_SPEED = ", o AS (SELECT *, row_number() OVER (ORDER BY speed DESC, event_id) AS k, row_number() OVER (ORDER BY heading DESC, event_id) AS ideal, count(*) OVER () AS n FROM pts)\n"


@query(_BY_SPEED + "SELECT round(sum(CASE WHEN heading > 300 THEN c * 1e0 / k END) / count(*) FILTER (WHERE heading > 300), 6) AS average_precision FROM (SELECT *, sum(CASE WHEN heading > 300 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS c FROM o)")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.average_precision(view(spark, sf_dir, "pts"), "speed", F.col("heading") > 300, "event_id"))


@query(_BY_SPEED + """SELECT round(sum(heading / log2(k + 1)) FILTER (WHERE k <= ceil(0.05 * n)) / sum(heading / log2(ideal + 1)) FILTER (WHERE ideal <= ceil(0.05 * n)), 6) AS ndcg,
  round(avg(heading) FILTER (WHERE k <= ceil(0.05 * n)) / avg(heading), 6) AS lift FROM o""")
def ndcg_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.ndcg_and_lift(view(spark, sf_dir, "pts"), "speed", "heading", "event_id", 0.05))


@query(""", o AS (SELECT *, row_number() OVER (ORDER BY speed, event_id) AS k, count(*) OVER () AS c FROM pts), b AS (SELECT CAST(floor((k - 1) / ceil(c / 10e0)) AS BIGINT) AS bucket, count(*) AS n, avg(speed) AS mean_score, avg(heading) AS mean_target,
  avg(CASE WHEN heading > 0 THEN 1e0 ELSE 0e0 END) AS positive_rate FROM o GROUP BY 1)
SELECT bucket, n, round(mean_score, 6) AS mean_score, round(mean_target, 6) AS mean_target, round(positive_rate, 6) AS positive_rate, CASE WHEN mean_target + 1e-12 < lag(mean_target) OVER (ORDER BY bucket) THEN 1 ELSE 0 END AS falls FROM b""")
def decile_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.calibration(view(spark, sf_dir, "pts"), "speed", "heading", "event_id"))


@query(f""", v AS (SELECT DISTINCT speed FROM pts) SELECT round(max(abs(a - b)), 6) AS ks FROM (SELECT
  sum(count(*) FILTER (WHERE {_SPLIT})) OVER (ORDER BY speed) * 1e0 / (SELECT count(*) FROM pts WHERE {_SPLIT}) AS a, sum(count(*) FILTER (WHERE NOT {_SPLIT})) OVER (ORDER BY speed) * 1e0 / (SELECT count(*) FROM pts WHERE NOT {_SPLIT}) AS b FROM pts GROUP BY speed)""")
def ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.ks_distance(view(spark, sf_dir, "pts"), "speed", _left()))


_QUANTILES = ", ".join(f"quantile_cont(speed, {p}) FILTER (WHERE {c}) AS {n}{i}" for i, p in enumerate((0.1, 0.5, 0.9)) for n, c in (("a", _SPLIT), ("b", f"NOT {_SPLIT}")))


@query(f""", y AS (SELECT {_QUANTILES} FROM pts) SELECT round(greatest({", ".join(f"abs(a{i} - b{i}) / greatest(abs(a{i}), abs(b{i}), 1e0)" for i in range(3))}), 6) AS linf FROM y""")
def quantile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.quantile_linf(view(spark, sf_dir, "pts"), "speed", _left()))


@query(f"""SELECT round(sum(abs(a - b)), 6) AS l1 FROM (SELECT count(*) FILTER (WHERE {_SPLIT}) * 1e0 / (SELECT count(*) FROM pts WHERE {_SPLIT}) AS a, count(*) FILTER (WHERE NOT {_SPLIT}) * 1e0 / (SELECT count(*) FROM pts WHERE NOT {_SPLIT}) AS b FROM pts GROUP BY ship_type)""")
def l1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.count_distance(view(spark, sf_dir, "pts"), "ship_type", _left()))


@query("SELECT round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS normalized FROM (SELECT count(*) * 1e0 / (SELECT count(*) FROM pts) AS p FROM pts GROUP BY ship_type)")
def type_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.entropy(view(spark, sf_dir, "pts"), "ship_type"))


@query(_BY_SPEED + "SELECT round(sum(speed) FILTER (WHERE k <= ceil(0.05 * n)) / sum(speed), 6) AS top_mass FROM o")
def top_mass_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.top_mass(view(spark, sf_dir, "pts"), "speed", "event_id", 0.05))


#: Budget and the evenly spaced places, each rounded to the nearest index, halves to the even one.
_EVEN = """, bud AS (SELECT DISTINCT mmsi, seg, n, CAST(least(n, greatest(2, ceil({r} * n))) AS BIGINT) AS k FROM trk),
ev AS (SELECT DISTINCT mmsi, seg, CASE WHEN k = 1 THEN 0 ELSE CAST(round_even(i * (n - 1) / ((k - 1) * 1e0), 0) AS BIGINT) END AS idx FROM bud, generate_series(0, k - 1) g(i))
"""


@query(_EVEN.format(r="0.25e0") + "SELECT mmsi, seg, idx FROM ev")
def uniform_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.even(view(spark, sf_dir, "trk"), 0.25).filter("retained = 1").select("mmsi", "seg", "idx")


@query(""", kb AS (SELECT DISTINCT mmsi, seg, n, CAST(least(n, greatest(2, ceil(0.3e0 * n))) AS BIGINT) AS kk FROM trk), hb AS (SELECT *, CAST(least(kk, greatest(2, ceil(0.5e0 * kk))) AS BIGINT) AS k FROM kb),
ev AS (SELECT DISTINCT mmsi, seg, CASE WHEN k = 1 THEN 0 ELSE CAST(round_even(i * (n - 1) / ((k - 1) * 1e0), 0) AS BIGINT) END AS idx FROM hb, generate_series(0, k - 1) g(i)),
o AS (SELECT t.mmsi, t.seg, t.idx, kb.kk, row_number() OVER (PARTITION BY t.mmsi, t.seg ORDER BY CASE WHEN e.idx IS NULL THEN 1 ELSE 0 END, t.speed DESC, t.idx) AS p
  FROM trk t JOIN kb USING (mmsi, seg) LEFT JOIN ev e ON e.mmsi = t.mmsi AND e.seg = t.seg AND e.idx = t.idx)
SELECT mmsi, seg, idx FROM o WHERE p <= kk""")
def hybrid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.even_then_best(view(spark, sf_dir, "trk"), F.col("speed"), 0.3, 0.5).filter("retained = 1").select("mmsi", "seg", "idx")


@query()
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.farthest_first(view(spark, sf_dir, "trk"), 0.3).filter("retained = 1").select("mmsi", "seg", "idx")


_CELL = """, ext AS (SELECT min(lat) AS y0, max(lat) - min(lat) AS sy, min(lon) AS x0, max(lon) - min(lon) AS sx FROM pts),
cell AS (SELECT p.*, CAST(greatest(0, least(15, floor((lat - y0) / sy * 16))) AS INT) AS gy, CAST(greatest(0, least(15, floor((lon - x0) / sx * 16))) AS INT) AS gx FROM pts p, ext),
ras AS (SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, count(*) AS n FROM q, ext, generate_series(0, 15) a(gy), generate_series(0, 15) b(gx)
  WHERE gy BETWEEN greatest(0, least(15, floor((lat_min - y0) / sy * 16))) AND greatest(0, least(15, floor((lat_max - y0) / sy * 16)))
  AND gx BETWEEN greatest(0, least(15, floor((lon_min - x0) / sx * 16))) AND greatest(0, least(15, floor((lon_max - x0) / sx * 16))) GROUP BY 1, 2)
"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict, DataFrame]:
    p = view(spark, sf_dir, "pts")
    row = tracks.extent(p).first().asDict()
    return p, row, tracks.raster(box_frame(spark), row, 16)


@query(_CELL + "SELECT gy, gx, count(*) AS n, round(sum(speed), 3) AS total FROM cell GROUP BY gy, gx")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, row, _ = _grid(spark, sf_dir)
    return tracks.cell_means(tracks.cells(p, row, 16), "speed").select("gy", "gx", "n", F.round(F.col("mean") * F.col("n"), 3).alias("total"))


@query(_CELL + "SELECT gy, gx, n FROM ras")
def query_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)[2]


@query(_CELL + """, k AS (SELECT * FROM (VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0)) v(o, w)),
sm AS (SELECT CAST(a.y AS INT) AS gy, CAST(b.x AS INT) AS gx, sum(u.w * v.w * coalesce(r.n, 0)) AS s FROM generate_series(0, 15) a(y), generate_series(0, 15) b(x), k u, k v
  LEFT JOIN ras r ON r.gy = greatest(0, least(15, a.y + u.o)) AND r.gx = greatest(0, least(15, b.x + v.o)) GROUP BY 1, 2)
SELECT gy, gx, round(s, 6) AS s FROM sm WHERE s > 0""")
def grid_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tracks.smooth(_grid(spark, sf_dir)[2].withColumnRenamed("n", "s"), "s", 16))


@query(_CELL + "SELECT event_id, coalesce(r.n, 0) * 1e0 AS n FROM cell c LEFT JOIN ras r USING (gy, gx)")
def prior_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, row, ras = _grid(spark, sf_dir)
    return tracks.lookup(p, ras, "n", row, 16).select("event_id", "n")


@query("SELECT event_id, round(('0x' || substr(sha256(ship_type || event_id), 1, 16))::UBIGINT / 18446744073709551616e0, 9) AS u FROM pts")
def sha_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pts").select("event_id", F.round(geo.unit_interval(F.concat("ship_type", F.col("event_id").cast("string"))), 9).alias("u"))


@query("""SELECT event_id, strftime(make_timestamp(t * 1000000), '%H:%M') AS clock, round(sin(2 * pi() * (t % 86400) / 86400e0), 9) + 0e0 AS s, round(cos(2 * pi() * (t % 86400) / 86400e0), 9) + 0e0 AS c,
  CASE WHEN speed < 10 THEN CAST(round(speed * 100) AS BIGINT) || ' m' ELSE 'far' END AS d FROM pts""")
def clock_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = geo.clock_features(F.col("t"))
    d = F.when(F.col("speed") < 10, geo.distance_text(F.round(F.col("speed") * 100) / 1000)).otherwise("far")
    return view(spark, sf_dir, "pts").select("event_id", geo.hh_mm(F.col("t")).alias("clock"), (F.round(s, 9) + 0.0).alias("s"), (F.round(c, 9) + 0.0).alias("c"), d.alias("d"))


_SEGSTAT = """, st AS (SELECT *, avg(speed) OVER g AS m, stddev_pop(speed) OVER g AS sd, row_number() OVER (PARTITION BY mmsi, seg ORDER BY speed, idx) AS rn,
  (SELECT count(*) FROM trk o WHERE o.mmsi = t.mmsi AND o.seg = t.seg AND o.speed < t.speed) AS below, (SELECT count(*) FROM trk o WHERE o.mmsi = t.mmsi AND o.seg = t.seg AND o.speed = t.speed) AS ties
  FROM trk t WINDOW g AS (PARTITION BY mmsi, seg))
"""


@query(_SEGSTAT + """, z AS (SELECT *, 1 / (1 + exp(-CASE WHEN sd > 1e-6 THEN (speed - m) / sd ELSE 0e0 END / 2e0)) AS c FROM st)
SELECT event_id, round(1 / (1 + exp(-speed / 10e0 / 2e0)), 6) AS temperature_sigmoid, round((rn - 1) * 1e0 / greatest(n - 1, 1), 6) AS rank, round((below + (ties - 1) / 2e0) / greatest(n - 1, 1), 6) AS rank_tie, round(c, 6) AS zscore_sigmoid,
  round(0.85e0 * (rn - 1) / greatest(n - 1, 1) + 0.15e0 * c, 6) AS rank_confidence FROM z""")
def score_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "trk").withColumn("tenth", F.col("speed") / 10)
    for mode in ("temperature_sigmoid", "rank", "rank_tie", "zscore_sigmoid", "rank_confidence"):
        d = labels.score_mode(d, "tenth" if mode == "temperature_sigmoid" else "speed", mode, temperature=2.0).withColumnRenamed("score", mode)
    return _rounded(d.select("event_id", "temperature_sigmoid", "rank", "rank_tie", "zscore_sigmoid", "rank_confidence"))


@query(""", b AS (SELECT mmsi, seg, idx // 4 AS b, max(speed) AS mx, avg(speed) AS mn, sum(speed) AS su, list_avg(list_slice(list_reverse_sort(list(speed)), 1, CAST(greatest(1, ceil(0.2e0 * count(*))) AS BIGINT))) AS tp FROM trk GROUP BY 1, 2, 3),
top AS (SELECT max(mx) AS mx, max(mn) AS mn, max(su) AS su, max(tp) AS tp FROM b)
SELECT t.event_id, round(b.mx / top.mx, 6) AS max, round(b.mn / top.mn, 6) AS mean, round(b.su / top.su, 6) AS mass, round(b.tp / top.tp, 6) AS top20_mean FROM trk t JOIN b ON b.mmsi = t.mmsi AND b.seg = t.seg AND b.b = t.idx // 4, top""")
def segment_pool_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "trk")
    for pool in ("max", "mean", "mass", "top20_mean"):
        d = labels.pooled(d, "speed", pool, size=4).withColumnRenamed("pooled", pool)
    return _rounded(d.select("event_id", "max", "mean", "mass", "top20_mean"))


_RUNS = """, v AS (SELECT *, greatest(0, speed - 10) AS v FROM trk), r AS (SELECT *, (SELECT count(*) FROM v o WHERE o.mmsi = v.mmsi AND o.seg = v.seg AND o.v = 0 AND o.idx < v.idx) AS run FROM v WHERE v > 0)
"""


@query(_RUNS + "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY mmsi, seg, run ORDER BY v DESC, idx) AS k, count(*) OVER (PARTITION BY mmsi, seg, run) AS c FROM r) WHERE k <= greatest(1, ceil(0.35e0 * c))")
def replacement_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "trk").withColumn("v", F.greatest(F.lit(0.0), F.col("speed") - 10))
    return labels.run_heads(d, "v").filter("support = 1").select("event_id")


@query("SELECT a.event_id, round(sum(b.speed), 6) AS near_sum FROM trk a JOIN trk b ON b.mmsi = a.mmsi AND b.seg = a.seg AND b.idx BETWEEN a.idx - 2 AND a.idx + 2 GROUP BY a.event_id")
def local_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.window_sum(view(spark, sf_dir, "trk"), "speed", 2).select("event_id", "near_sum"))


@query("SELECT event_id, round(CASE WHEN s > 1e-12 THEN speed / s ELSE 0e0 END, 6) AS mass FROM trk JOIN (SELECT mmsi, seg, sum(speed) AS s FROM trk GROUP BY mmsi, seg) USING (mmsi, seg)")
def unit_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.unit_mass(view(spark, sf_dir, "trk"), "speed").select("event_id", "mass"))


_LABEL = ", cnt AS (SELECT query_id, count(*) AS c FROM hits GROUP BY query_id), lab AS (SELECT t.event_id, coalesce((SELECT sum(2e0 / (c + 1)) / 12 FROM hits h JOIN cnt USING (query_id) WHERE h.event_id = t.event_id), 0e0) AS label, idx, n FROM trk t)\n"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "trk")
    return labels.point_labels(t, boxes.hits(t, box_frame(spark)), "event_id", box_frame(spark))


@query(_LABEL + "SELECT event_id, round(label, 6) AS label FROM lab")
def point_f1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_labels(spark, sf_dir))


@query(_LABEL + """SELECT count(*) AS n, count(*) FILTER (WHERE label > 0) AS n_positive, round(count(*) FILTER (WHERE label > 0) * 1e0 / count(*), 6) AS positive_share, round(sum(label), 6) AS mass, round(max(label), 6) AS largest,
  round(quantile_cont(label, 0.5) FILTER (WHERE label > 0), 6) AS p50, round(quantile_cont(label, 0.9) FILTER (WHERE label > 0), 6) AS p90, round(quantile_cont(label, 0.95) FILTER (WHERE label > 0), 6) AS p95 FROM lab""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.label_summary(_labels(spark, sf_dir), "label"))


@query(""", edge AS (SELECT h.query_id, h.mmsi, h.seg, h.idx, CASE WHEN EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.mmsi = h.mmsi AND o.seg = h.seg AND o.idx = h.idx - 1)
  AND EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.mmsi = h.mmsi AND o.seg = h.seg AND o.idx = h.idx + 1) THEN 1e0 ELSE 1.5e0 END AS w FROM hits h)
SELECT query_id, mmsi, seg, idx, round(w / avg(w) OVER (PARTITION BY query_id), 6) AS weight FROM edge""")
def boundary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = view(spark, sf_dir, "trk"), box_frame(spark)
    return _rounded(labels.boundary_weights(boxes.entry_exit(t, b), boxes.hits(t, b), 0.5))


@query("""SELECT round(sum(speed) FILTER (WHERE n > 1 AND idx <= 0.2e0 * (n - 1)) / sum(speed), 5) AS "start", round(sum(speed) FILTER (WHERE n = 1 OR (idx > 0.2e0 * (n - 1) AND idx < 0.8e0 * (n - 1))) / sum(speed), 5) AS middle,
  round(sum(speed) FILTER (WHERE n > 1 AND idx >= 0.8e0 * (n - 1)) / sum(speed), 5) AS "end" FROM trk""")
def position_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.position_mass(view(spark, sf_dir, "trk"), "speed"), 5)


@query("""SELECT round(avg(-(p * log2(p) + (1 - p) * log2(1 - p))), 6) AS entropy, round(avg(CASE WHEN h > 0 THEN 1e0 ELSE 0e0 END), 6) AS gt_0_00, round(avg(CASE WHEN h > 0.01 THEN 1e0 ELSE 0e0 END), 6) AS gt_0_01,
  round(avg(CASE WHEN h > 0.05 THEN 1e0 ELSE 0e0 END), 6) AS gt_0_05, round(avg(CASE WHEN h > 0.1 THEN 1e0 ELSE 0e0 END), 6) AS gt_0_10 FROM (SELECT heading / 360e0 AS h, greatest(1e-6, least(1 - 1e-6, heading / 360e0)) AS p FROM pts)""")
def target_entropy_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "pts").withColumn("h", F.col("heading") / 360)
    return _rounded(labels.binary_entropy(d, "h").join(labels.support_shares(d, "h"), F.lit(True)))  # one row each


@query("""SELECT count(*) FILTER (WHERE retained = 1 AND idx % 4 = 0) AS common, count(*) FILTER (WHERE retained = 1 OR idx % 4 = 0) AS joint,
  round(count(*) FILTER (WHERE retained = 1 AND idx % 4 = 0) * 1e0 / count(*) FILTER (WHERE retained = 1 OR idx % 4 = 0), 6) AS jaccard, count(*) FILTER (WHERE (retained = 1) <> (idx % 4 = 0)) AS hamming FROM kept""")
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.mask_overlap(view(spark, sf_dir, "kept").withColumn("b", (F.col("idx") % 4 == 0).cast("int")), "retained", "b"))


@query(""", g AS (SELECT k.n, k.idx - (SELECT max(o.idx) FROM kept o WHERE o.mmsi = k.mmsi AND o.seg = k.seg AND o.retained = 1 AND o.idx < k.idx) AS g FROM kept k WHERE k.retained = 1)
SELECT round(avg(g), 6) AS avg_gap, round(avg(g / greatest(1, n - 1)), 6) AS avg_gap_share, max(g) * 1e0 AS max_gap FROM g WHERE g IS NOT NULL""")
def retained_gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.retained_gaps(view(spark, sf_dir, "kept")))


@query("SELECT round(avg(CASE WHEN f % 3 <> 0 AND l % 3 <> 0 THEN 1e0 ELSE 0e0 END), 6) AS endpoints FROM (SELECT min(event_id) FILTER (WHERE idx = 0) AS f, min(event_id) FILTER (WHERE idx = n - 1) AS l FROM trk GROUP BY mmsi, seg)")
def endpoint_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask that loses every third event, so that some ends are missing."""
    return _rounded(labels.endpoint_share(view(spark, sf_dir, "trk").withColumn("retained", (F.col("event_id") % 3 != 0).cast("int"))))


@query(_CELL + "SELECT event_id, round(1e0 / count(*) OVER (PARTITION BY gy, gx), 6) AS weight FROM cell")
def sparse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, row, _ = _grid(spark, sf_dir)
    return _rounded(workloads.sparse_weights(tracks.cells(p, row, 16)).select("event_id", "weight"))


@query("SELECT event_id AS query_id, round(lat - 2.2e0 / 111.32e0, 6) AS lat_min, round(lat + 2.2e0 / 111.32e0, 6) AS lat_max, round(lon - 2.2e0 / (greatest(0.1e0, cos(radians(lat))) * 111.32e0), 6) AS lon_min, round(lon + 2.2e0 / (greatest(0.1e0, cos(radians(lat))) * 111.32e0), 6) AS lon_max, t - 18000 AS t_start, t + 18000 AS t_end FROM pts")
def anchor_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "pts").withColumnRenamed("event_id", "query_id")
    return _rounded(workloads.boxes_around(a, F.lit(2.2), F.lit(5)))


_SCORES = ", sc AS (SELECT q.anchor, q.footprint, p.recall FROM (SELECT query_id, avg(retained) AS recall FROM hk GROUP BY query_id) p JOIN q USING (query_id))\n"


@query(_HIT + _SCORES + """SELECT anchor, footprint, count(*) AS n, round(avg(recall), 6) AS recall, CASE WHEN grouping(anchor) = 1 THEN 'footprint' WHEN grouping(footprint) = 1 THEN 'anchor' ELSE 'anchor_footprint' END AS level
  FROM sc GROUP BY GROUPING SETS ((anchor), (footprint), (anchor, footprint))""")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.point_scores(_hits(spark, sf_dir)).join(box_frame(spark).select("query_id", "anchor", "footprint"), "query_id")
    return _rounded(workloads.by_family(s, "anchor", "footprint", ["recall"]))


@query("""SELECT * FROM (VALUES ('anchor', 'a', 20), ('anchor', 'b', 5), ('thirds', 'x', 34), ('thirds', 'y', 33), ('thirds', 'z', 33), ('none', 'p', 2), ('none', 'q', 1)) v(plan, family, n)""")
def quota_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = {"anchor": ({"a": 0.8, "b": 0.2}, 25), "thirds": ({"x": 1, "y": 1, "z": 1}, 100), "none": ({"p": 0, "q": 0}, 3)}
    rows = [(p, k, n) for p, (w, total) in plans.items() for k, n in workloads.quotas(w, total).items()]
    return spark.createDataFrame(rows, "plan string, family string, n int")


_PROFILE = "chr(CAST(97 + floor(mmsi % 5) AS INT))"


@query(f""", c AS (SELECT {_PROFILE} AS profile, r AS ratio, avg(speed) * r AS learned, avg(heading) * r / 15 AS uniform, avg(heading) / 18 * r AS farthest FROM pts, (VALUES (0.01e0), (0.02e0), (0.05e0), (0.10e0), (0.15e0), (0.20e0)) v(r) GROUP BY 1, 2)
SELECT count(*) AS cells, 28 - count(*) AS missing, count(*) FILTER (WHERE learned > uniform) AS uniform_wins, count(*) FILTER (WHERE learned > farthest) AS farthest_wins, count(*) FILTER (WHERE learned > uniform AND ratio <= 0.05) AS low_wins,
  count(*) FILTER (WHERE learned > uniform AND ratio = 0.05) AS at_5_percent_wins, false AS passed FROM c WHERE profile <> 'e'""")
def final_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile is a fifth of the vessels; the ratio 0.30 has no cells."""
    p = view(spark, sf_dir, "pts").withColumn("profile", F.chr(F.lit(97) + F.col("mmsi") % 5)).withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in workloads.RATIOS[:-1]])))
    r = F.first("ratio")
    cells = p.groupBy("profile", "ratio").agg((F.avg("speed") * r).alias("learned"), (F.avg("heading") * r / 15).alias("uniform"), (F.avg("heading") / 18 * r).alias("farthest"))
    return workloads.final_grid(cells, ["a", "b", "c", "d"])


@query()
def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its parts are those of point_recall, interp_fidelity, turn_coverage and gap_continuity, which have oracles."""
    k = view(spark, sf_dir, "kept")
    h = boxes.hits(k, box_frame(spark))
    s = scoring.point_scores(h).join(scoring.interpolation_scores(h, k), "query_id").join(scoring.turn_scores(h), "query_id").join(scoring.gap_scores(h), "query_id")
    whole = scoring.distortion(k).join(scoring.length_kept(k), F.lit(True)).join(labels.endpoint_share(k), F.lit(True)).first()
    return _rounded(workloads.utility(s, length=whole["length_preservation"], avg_sed_km=whole["avg_sed_km"], endpoints=whole["endpoints"]))
