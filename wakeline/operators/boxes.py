"""Points and steps of tracks against many space-time boxes: hits, crossings, brackets, overlap, acceptance.

Boxes have query_id, lat_min, lat_max, lon_min, lon_max, t_start, t_end. Points have t, lat, lon and, for steps, the
track columns mmsi, seg and idx. Boxes are cut into cells of ``cell_deg`` degrees, points carry the cell they lie in,
and an equi-join on the cell finds candidates: no nested loop, whatever the number of boxes. A box of more than
``max_cells`` cells goes to coarser cells, each level ten times as wide, and points carry one cell per level in use.

Defined results: null coordinates lie in no box; boxes with a null bound or a lower bound above the upper one hold
nothing; bounds count as inside; repeated points and boxes all count; empty frames give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import in_box

BOUNDS = ["lat_min", "lat_max", "lon_min", "lon_max", "t_start", "t_end"]
LEVELS = 4


def check_boxes(boxes: DataFrame) -> None:
    """Raise unless every box is a range query with six finite, ordered bounds."""
    if "type" in boxes.columns and boxes.filter(F.lower("type") != "range").limit(1).count():
        raise ValueError("Only range queries are known")
    finite = F.forall(F.array(*[F.col(b).cast("double") for b in BOUNDS]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ordered = (F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max")) & (F.col("t_start") <= F.col("t_end"))
    if boxes.filter(~F.coalesce(finite & ordered, F.lit(False))).limit(1).count():
        raise ValueError("a box needs six finite bounds in order")


def _cell(x: Column, level: Column | int, cell_deg: float) -> Column:
    return F.floor(x / (F.lit(cell_deg) * F.pow(F.lit(10.0), F.lit(level) if isinstance(level, int) else level)))


def _box_cells(boxes: DataFrame, cell_deg: float, max_cells: int) -> DataFrame:
    span = lambda a, b, k: _cell(F.col(b), k, cell_deg) - _cell(F.col(a), k, cell_deg) + 1
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(span("lat_min", "lat_max", k) * span("lon_min", "lon_max", k) <= max_cells, F.lit(k)).otherwise(level)
    b = boxes.filter((F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max"))).withColumn("__level", level)
    cells = lambda lo, hi: F.sequence(_cell(F.col(lo), F.col("__level"), cell_deg), _cell(F.col(hi), F.col("__level"), cell_deg))
    return b.withColumn("__cy", F.explode(cells("lat_min", "lat_max"))).withColumn("__cx", F.explode(cells("lon_min", "lon_max")))


def hits(points: DataFrame, boxes: DataFrame, *, cell_deg: float = 0.05, max_cells: int = 400) -> DataFrame:
    """Every point with every box it lies in (columns of both)."""
    cut = _box_cells(boxes, cell_deg, max_cells)
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most LEVELS values
    if not levels:
        return points.limit(0).crossJoin(boxes.limit(0))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("__level"), _cell(F.col("lat"), k, cell_deg).alias("__cy"), _cell(F.col("lon"), k, cell_deg).alias("__cx")) for k in levels]))
    placed = points.withColumn("__at", at).select(*points.columns, "__at.*")
    joined = placed.join(cut, ["__level", "__cy", "__cx"])
    return joined.filter(in_box(F.col("lat"), F.col("lon"), F.col("t"), {b: F.col(b) for b in BOUNDS})).drop("__level", "__cy", "__cx")


def covered(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Points in at least one box, once each by key."""
    return points.join(hits(points.select(key, "t", "lat", "lon"), boxes).select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")


def steps(track: DataFrame) -> DataFrame:
    """Each point with the next one of its segment as t2, lat2, lon2."""
    w = Window.partitionBy("mmsi", "seg").orderBy("idx")
    return track.withColumns({f"{c}2": F.lead(c).over(w) for c in ("t", "lat", "lon")}).filter("t2 IS NOT NULL")


def crossings(track: DataFrame, boxes: DataFrame, *, cell_deg: float = 0.05, max_cells: int = 400, wide_cells: int = 64) -> DataFrame:
    """(query_id, mmsi, seg, idx) of each step from idx to the next point that crosses or passes through a box.

    A step wholly inside is none. Steps are clipped against the three slabs of the box. Candidates come from the cells
    of the step's bounding rectangle; steps over more than wide_cells cells use the coarsest level.
    """
    s = steps(track.select("mmsi", "seg", "idx", "t", "lat", "lon"))
    cut = _box_cells(boxes, cell_deg, max_cells)
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())
    lows, highs = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    west, east = F.least("lon", "lon2"), F.greatest("lon", "lon2")
    found = None
    for k in levels:
        cells = lambda lo, hi, k=k: F.sequence(_cell(lo, k, cell_deg), _cell(hi, k, cell_deg))
        part = s.withColumn("__cy", F.explode(cells(lows, highs))).withColumn("__cx", F.explode(cells(west, east)))
        j = part.join(cut.filter(F.col("__level") == k), ["__cy", "__cx"])
        enter, leave, valid = F.lit(0.0), F.lit(1.0), F.lit(True)
        for c, lo, hi in (("t", "t_start", "t_end"), ("lat", "lat_min", "lat_max"), ("lon", "lon_min", "lon_max")):
            d = (F.col(f"{c}2") - F.col(c)).cast("double")
            flat = F.abs(d) <= 1e-12
            u1, u2 = (F.col(lo) - F.col(c)) / F.nullif(d, F.lit(0.0)), (F.col(hi) - F.col(c)) / F.nullif(d, F.lit(0.0))
            valid = valid & (~flat | F.col(c).between(F.col(lo), F.col(hi)))
            enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(u1, u2)))
            leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(u1, u2)))
        box = {b: F.col(b) for b in BOUNDS}
        inside = in_box(F.col("lat"), F.col("lon"), F.col("t"), box) & in_box(F.col("lat2"), F.col("lon2"), F.col("t2"), box)
        got = j.filter(valid & (leave >= enter) & ~inside).select("query_id", "mmsi", "seg", "idx").distinct()
        found = got if found is None else found.unionByName(got)
    return found if found is not None else s.limit(0).select(F.lit(None).cast("bigint").alias("query_id"), "mmsi", "seg", "idx")


def brackets(track: DataFrame, boxes: DataFrame) -> DataFrame:
    """Both ends of every crossing step, once each; they never belong to different segments."""
    return crossings(track, boxes).withColumn("idx", F.explode(F.array(F.col("idx"), F.col("idx") + 1))).distinct()


def overlap(a: str, b: str) -> Column:
    """Share of their joint volume that boxes aliased a and b have in common; 1 where both have no volume."""
    def side(x: str, lo: str, hi: str) -> Column:
        return F.greatest(F.lit(0.0), (F.col(f"{x}.{hi}") - F.col(f"{x}.{lo}")).cast("double"))

    def common(lo: str, hi: str) -> Column:
        return F.greatest(F.lit(0.0), (F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}"))).cast("double"))

    sides = list(zip(BOUNDS[::2], BOUNDS[1::2]))
    both, va, vb = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for lo, hi in sides:
        both, va, vb = both * common(lo, hi), va * side(a, lo, hi), vb * side(b, lo, hi)
    return F.when(va + vb - both > 0, both / (va + vb - both)).otherwise(1.0)


def near_duplicates(boxes: DataFrame, at_least: float) -> DataFrame:
    """(query_id, earlier_id, iou) of boxes that overlap an earlier one so much; joined over shared one-degree cells, so at_least is above 0."""
    cut = _box_cells(boxes, 1.0, 10_000)
    a, b = cut.alias("a"), cut.alias("b")
    j = a.join(b, (F.col("a.__cy") == F.col("b.__cy")) & (F.col("a.__cx") == F.col("b.__cx")) & (F.col("a.__level") == F.col("b.__level")) & (F.col("a.query_id") > F.col("b.query_id")))
    return j.select(F.col("a.query_id").alias("query_id"), F.col("b.query_id").alias("earlier_id"), overlap("a", "b").alias("iou")).filter(F.col("iou") >= at_least).distinct()


def diagnostics(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per box: hits, segments hit, shares of all points and segments, spans as shares of the data's extent; boxes without hits keep their row."""
    ext = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon", "t") for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("all_points"), F.count_distinct("mmsi", "seg").alias("all_segments"))
    per = hits(points, boxes).groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count_distinct("mmsi", "seg").alias("n_segments"))
    d = boxes.join(per, "query_id", "left").fillna(0, ["n_hits", "n_segments"]).join(F.broadcast(ext), F.lit(True))  # ext is one row
    span = lambda lo, hi, c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(hi) - F.col(lo)) / F.greatest((F.col(f"hi_{c}") - F.col(f"lo_{c}")).cast("double"), F.lit(1e-9))))
    return d.select("query_id", "n_hits", "n_segments", (F.col("n_hits") / F.col("all_points")).alias("point_share"), (F.col("n_segments") / F.col("all_segments")).alias("segment_share"), span("lat_min", "lat_max", "lat").alias("lat_share"), span("lon_min", "lon_max", "lon").alias("lon_share"), span("t_start", "t_end", "t").alias("t_share"))


def acceptance(diag: DataFrame, *, min_hits: int, min_share: float, min_segments: int, max_share: float) -> DataFrame:
    """diag with the first reason that holds against a box, null where it is accepted."""
    reason = (
        F.when(F.col("n_hits") < min_hits, "too_few_point_hits")
        .when(F.col("point_share") < min_share, "too_low_point_hit_fraction")
        .when(F.col("n_segments") < min_segments, "too_few_trajectory_hits")
        .when(F.col("point_share") > max_share, "too_broad")
    )
    return diag.withColumn("reason", reason)


def workload_summary(diag: DataFrame) -> DataFrame:
    """One row: boxes, share of boxes without hits, and 10, 50 and 90 % quantiles of hits."""
    q = F.percentile("n_hits", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    d = diag.agg(F.count("*").alias("n_queries"), F.avg((F.col("n_hits") == 0).cast("double")).alias("empty_rate"), q.alias("q"))
    return d.select("n_queries", "empty_rate", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def entry_exit(track: DataFrame, boxes: DataFrame) -> DataFrame:
    """(query_id, mmsi, seg, idx, entry, exit) of the hits before which or after which the track is outside the box, or ends."""
    h = hits(track, boxes)
    w = Window.partitionBy("query_id", "mmsi", "seg").orderBy("idx")
    entry = F.coalesce(F.lag("idx").over(w) != F.col("idx") - 1, F.lit(True))
    leave = F.coalesce(F.lead("idx").over(w) != F.col("idx") + 1, F.lit(True))
    return h.select("query_id", "mmsi", "seg", "idx", entry.cast("int").alias("entry"), leave.cast("int").alias("exit")).filter("entry = 1 OR exit = 1")
