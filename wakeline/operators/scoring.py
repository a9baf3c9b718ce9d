"""How well retained points stand for the whole tracks: distortion, length, recall, turns, gaps, interpolation.

Tracks have mmsi, seg, idx, t, lat, lon and retained (0 or 1); in-box scores work on the hits of boxes, which carry
query_id, too. Scores by query are means over the segments a query hits.

Defined results: a segment with fewer than two retained points has no distortion; removed points before the first or
after the last retained one have none either; without any removed point distortions are 0; without any length the
length kept is 1; a query that hits nothing has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import DEGREE_KM, haversine_km

SEGMENT = ["mmsi", "seg"]


def with_anchors(track: DataFrame) -> DataFrame:
    """Each point with the retained points before (l_) and after it (r_), itself not counted."""
    anchor = F.when(F.col("retained") == 1, F.struct("idx", "t", "lat", "lon"))
    w = Window.partitionBy(*SEGMENT).orderBy("idx")
    back = Window.partitionBy(*SEGMENT).orderBy(F.col("idx").desc())
    d = track.withColumn("__a", anchor)
    d = d.withColumn("__l", F.last("__a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__r", F.last("__a", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    return d.select(*track.columns, *[F.col(f"__{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("idx", "t", "lat", "lon")])


def deviations(track: DataFrame) -> DataFrame:
    """Removed points between retained ones with sed (to the place at the same time) and ped (to the chord) in km."""
    d = with_anchors(track).filter((F.col("retained") == 0) & F.col("l_t").isNotNull() & F.col("r_t").isNotNull())
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t") - F.col("l_t")) / F.greatest((F.col("r_t") - F.col("l_t")).cast("double"), F.lit(1e-9))))
    on = lambda c: F.col(f"l_{c}") + part * (F.col(f"r_{c}") - F.col(f"l_{c}"))
    sed = F.hypot((F.col("lon") - on("lon")) * F.cos(F.radians("lat")) * DEGREE_KM, (F.col("lat") - on("lat")) * DEGREE_KM)
    shrink = F.cos(F.radians("l_lat"))
    east = lambda c: (F.col(c) - F.col("l_lon")) * shrink * DEGREE_KM
    north = lambda c: (F.col(c) - F.col("l_lat")) * DEGREE_KM
    chord = F.greatest(F.hypot(east("r_lon"), north("r_lat")), F.lit(1e-9))
    ped = F.abs(east("r_lon") * north("lat") - north("r_lat") * east("lon")) / chord
    return d.withColumns({"sed": sed, "ped": ped})


def distortion(track: DataFrame) -> DataFrame:
    """One row: mean and largest sed and ped over all removed points, and their number."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return deviations(track).agg(*[zero(f(c)).alias(f"{n}_{c}_km") for c in ("sed", "ped") for n, f in (("avg", F.avg), ("max", F.max))], F.count("*").alias("removed_points"))


def length_kept(track: DataFrame) -> DataFrame:
    """One row: length of the retained tracks over that of the whole ones, held to [0, 1]."""
    w = Window.partitionBy(*SEGMENT).orderBy("idx")
    step = lambda: haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    total = lambda d, n: d.select(step().alias("km")).agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias(n))
    both = total(track, "whole").join(total(track.filter("retained = 1"), "kept"), F.lit(True))  # one row each
    return both.select(F.when(F.col("whole") <= 1e-9, 1.0).otherwise(F.least(F.lit(1.0), F.col("kept") / F.col("whole"))).alias("length_preservation"))


def _f1(kept: Column, whole: Column, least: float) -> Column:
    recall = kept / whole
    return F.when(whole <= least, 1.0).when(kept <= 0, 0.0).otherwise(2 * recall / (1 + recall))


def point_scores(hits: DataFrame) -> DataFrame:
    """(query_id, recall, f1) of the points hit that are retained."""
    g = hits.groupBy("query_id").agg(F.sum("retained").alias("k"), F.count("*").alias("n"))
    return g.select("query_id", (F.col("k") / F.col("n")).alias("recall"), _f1(F.col("k").cast("double"), F.col("n").cast("double"), 0.0).alias("f1"))


def turn_scores(hits: DataFrame) -> DataFrame:
    """(query_id, turn): weighted F1 of retained route changes; a change is how much shorter the way past a hit is, in degrees, or its turn_score."""
    w = Window.partitionBy("query_id", *SEGMENT).orderBy("idx")
    at = lambda c, k: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w)
    here, before, after = (F.col("lat"), F.col("lon")), (at("lat", -1), at("lon", -1)), (at("lat", 1), at("lon", 1))
    apart = lambda p, q: F.hypot(q[0] - p[0], q[1] - p[1])
    bend = F.coalesce(F.greatest(F.lit(0.0), apart(before, here) + apart(here, after) - apart(before, after)), F.lit(0.0))
    weight = F.greatest(bend, F.greatest(F.coalesce("turn_score", F.lit(0.0)), F.lit(0.0))) if "turn_score" in hits.columns else bend
    g = hits.withColumn("__w", weight).groupBy("query_id", *SEGMENT).agg(F.sum("__w").alias("whole"), F.sum(F.col("__w") * F.col("retained")).alias("kept"), F.sum("retained").alias("k"))
    score = F.when(F.col("k") == 0, 0.0).otherwise(_f1(F.col("kept"), F.col("whole"), 1e-12))
    return g.groupBy("query_id").agg(F.avg(score).alias("turn"))


def gap_scores(hits: DataFrame) -> DataFrame:
    """(query_id, gap): one less the longest missing run by time or by way, over the whole, the lesser of the two means."""
    w = Window.partitionBy("query_id", *SEGMENT).orderBy("idx")
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    p = hits.withColumn("__km", F.coalesce(step, F.lit(0.0))).withColumns({"__way": F.sum("__km").over(w), "__pos": F.row_number().over(w), "__time": F.col("t").cast("double")})
    whole = Window.partitionBy("query_id", *SEGMENT)
    ends = {f"{n}{c}": f(c).over(whole) for c in ("__way", "__time", "__pos") for n, f in (("lo", F.min), ("hi", F.max))}
    p = p.withColumns(ends)
    r = p.filter("retained = 1")
    cols = []
    for c in ("__way", "__time"):
        before = F.when(F.lag("__pos").over(w).isNull(), F.col(c) - F.col(f"lo{c}")).when(F.col("__pos") - F.lag("__pos").over(w) > 1, F.col(c) - F.lag(c).over(w)).otherwise(0.0)
        after = F.when(F.lead("__pos").over(w).isNull(), F.col(f"hi{c}") - F.col(c)).otherwise(0.0)
        cols.append(F.greatest(before, after).alias(f"gap{c}"))
    longest = r.select("query_id", *SEGMENT, *cols).groupBy("query_id", *SEGMENT).agg(F.max("gap__way").alias("gw"), F.max("gap__time").alias("gt"))
    spans = p.groupBy("query_id", *SEGMENT).agg(F.count("*").alias("n"), F.first(F.col("hi__way") - F.col("lo__way")).alias("sw"), F.first(F.col("hi__time") - F.col("lo__time")).alias("st"))
    j = spans.join(longest, ["query_id", *SEGMENT], "left")
    score = lambda g, s: F.when(F.col(g).isNull(), 0.0).when((F.col("n") == 1) | (F.col(s) <= 1e-9), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(g) / F.col(s)))
    return j.groupBy("query_id").agg(F.least(F.avg(score("gw", "sw")), F.avg(score("gt", "st"))).alias("gap"))


def interpolation_scores(hits: DataFrame, track: DataFrame) -> DataFrame:
    """(query_id, interpolation): how near removed hits lie to what the retained points of the whole segment tell of them.

    By segment 1 / (1 + mean error over mean step), the error halfway between sed and ped, times half the retained
    hits where there are fewer than two; 0 without two retained points or a removed hit between any, 1 if none is removed.
    """
    dev = deviations(track).select(*SEGMENT, "idx", ((F.col("sed") + F.col("ped")) / 2).alias("__err"))
    kept = track.groupBy(*SEGMENT).agg(F.sum("retained").alias("__all"))
    w = Window.partitionBy("query_id", *SEGMENT).orderBy("idx")
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    h = hits.select("query_id", *SEGMENT, "idx", "retained", step.alias("__km")).join(dev, [*SEGMENT, "idx"], "left")
    g = h.groupBy("query_id", *SEGMENT).agg(F.count("*").alias("n"), F.sum("retained").alias("k"), F.coalesce(F.sum("__km"), F.lit(0.0)).alias("km"), F.avg("__err").alias("err")).join(kept, SEGMENT)
    step_km = F.greatest(F.col("km") / F.greatest(F.lit(1), F.col("n") - 1), F.lit(1e-6))
    score = F.when(F.col("__all") < 2, 0.0).when(F.col("k") == F.col("n"), 1.0).when(F.col("err").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("k") / 2) / (1 + F.col("err") / step_km))
    return g.groupBy("query_id").agg(F.avg(score).alias("interpolation"))
