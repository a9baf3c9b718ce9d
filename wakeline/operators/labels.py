"""Scores and targets of track points: score modes, pooled and windowed values, runs, masses, label diagnostics.

Frames have mmsi, seg, idx and the value named. Values below 0 count as 0 where masses are formed; ties go to the
lower index; a null value counts as 0 in masses and stays null elsewhere. Windows go by segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = ["mmsi", "seg"]
MODES = ["raw", "sigmoid", "temperature_sigmoid", "rank", "rank_tie", "zscore_sigmoid", "rank_confidence"]


def _mass(value: str) -> Column:
    return F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def score_mode(track: DataFrame, value: str, mode: str, *, temperature: float = 1.0, confidence: float = 0.15) -> DataFrame:
    """track with score: value turned into a selection score of the mode; ranks and z-scores by segment.

    A segment of one point has rank 0; of no spread, z 0.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}; not {mode}")
    v, heat = F.col(value).cast("double"), max(temperature, 1e-6)
    whole = Window.partitionBy(*SEGMENT)
    n = F.greatest(F.count("*").over(whole) - 1, F.lit(1))
    ordinal = (F.row_number().over(whole.orderBy(value, "idx")) - 1) / n
    if mode == "raw":
        score = v
    elif mode == "sigmoid":
        score = _sigmoid(v)
    elif mode == "temperature_sigmoid":
        score = _sigmoid(v / heat)
    elif mode == "rank":
        score = ordinal
    elif mode == "rank_tie":
        score = (F.rank().over(whole.orderBy(value)) - 1 + (F.count("*").over(Window.partitionBy(*SEGMENT, value)) - 1) / 2) / n
    else:
        sd = F.stddev_pop(v).over(whole)
        sure = _sigmoid(F.when(sd > 1e-6, (v - F.avg(v).over(whole)) / sd).otherwise(0.0) / heat)
        share = min(max(confidence, 0.0), 1.0)
        score = sure if mode == "zscore_sigmoid" else (1 - share) * ordinal + share * sure
    return track.withColumn("score", score)


def pooled(track: DataFrame, value: str, pool: str, size: int = 32) -> DataFrame:
    """track with pooled: the max, mean, top20_mean or mass of its stretch of size points, over the largest of all stretches."""
    d = track.withColumns({"__b": F.floor(F.col("idx") / size), "__v": _mass(value)})
    block = Window.partitionBy(*SEGMENT, "__b")
    if pool == "top20_mean":
        keep = F.greatest(F.lit(1), F.ceil(F.count("*").over(block) * 0.2))
        d = d.withColumn("__k", F.row_number().over(block.orderBy(F.col("__v").desc(), "idx")) <= keep)
    how = {"max": F.max("__v"), "mean": F.avg("__v"), "mass": F.sum("__v"), "top20_mean": F.avg(F.when(F.col("__k"), F.col("__v"))) if pool == "top20_mean" else None}
    if pool not in how:
        raise ValueError(f"pool is one of {', '.join(how)}; not {pool}")
    d = d.withColumn("__p", how[pool].over(block))
    top = d.agg(F.max("__p").alias("__top"))
    return d.join(F.broadcast(top), F.lit(True)).withColumn("pooled", F.least(F.lit(1.0), F.col("__p") / F.greatest("__top", F.lit(1e-6)))).drop("__b", "__v", "__k", "__p", "__top")  # top is one row


def run_heads(track: DataFrame, value: str, share: float = 0.35) -> DataFrame:
    """track with support: 1 for the largest share, one at least, of every run of neighbouring points with a value above 0."""
    on = (_mass(value) > 0).cast("int")
    w = Window.partitionBy(*SEGMENT).orderBy("idx")
    d = track.withColumn("__on", on).withColumn("__run", F.sum((F.col("__on") == 0).cast("int")).over(w))
    run = Window.partitionBy(*SEGMENT, "__run", "__on")
    keep = F.greatest(F.lit(1), F.ceil(F.count("*").over(run) * F.lit(float(share))))
    place = F.row_number().over(run.orderBy(F.col(value).desc(), "idx"))
    return d.withColumn("support", ((F.col("__on") == 1) & (place <= keep)).cast("int")).drop("__on", "__run")


def window_sum(track: DataFrame, value: str, radius: int) -> DataFrame:
    """track with near_sum: the sum of value over the points up to radius places away."""
    w = Window.partitionBy(*SEGMENT).orderBy("idx").rowsBetween(-radius, radius)
    return track.withColumn("near_sum", F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w))


def unit_mass(track: DataFrame, value: str) -> DataFrame:
    """track with mass: value over its segment's sum; 0 in segments without any."""
    total = F.sum(_mass(value)).over(Window.partitionBy(*SEGMENT))
    return track.withColumn("mass", F.when(total > 1e-12, _mass(value) / total).otherwise(0.0))


def point_utility(hit: Column, behaviour: Column, boundary: Column, replacement: Column) -> Column:
    """How much a point is worth to the queries; inputs are held to [0, 1]."""
    h, b, e, r = (F.least(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for x in (hit, behaviour, boundary, replacement))
    return F.least(F.lit(1.0), (0.50 * h + 0.45 * b) * (0.75 + 0.25 * r) + 0.05 * e)  # fixed values


def point_labels(points: DataFrame, hits: DataFrame, key: str, boxes: DataFrame) -> DataFrame:
    """(key, label) of every point: the sum over the boxes it lies in of 2 / (hits of the box + 1), over the number of boxes; 0 where it lies in none."""
    n = hits.groupBy(F.col("query_id").alias("__q")).agg(F.count("*").alias("__c"))
    worth = hits.join(n, F.col("query_id") == F.col("__q")).groupBy(F.col(key).alias("__k")).agg(F.sum(2.0 / (F.col("__c") + 1)).alias("__s"))
    total = boxes.agg(F.greatest(F.lit(1), F.count("*")).alias("__n"))
    d = points.join(worth, F.col(key) == F.col("__k"), "left").join(F.broadcast(total), F.lit(True))  # total is one row
    return d.select(key, F.least(F.lit(1.0), F.coalesce(F.col("__s") / F.col("__n"), F.lit(0.0))).alias("label"))


def boundary_weights(edges: DataFrame, hits: DataFrame, boost: float) -> DataFrame:
    """(query_id, mmsi, seg, idx, weight) of hits: 1, more at entries and exits by boost, scaled to mean 1 within a query."""
    at = edges.select("query_id", *SEGMENT, "idx", F.lit(1).alias("__e"))
    d = hits.select("query_id", *SEGMENT, "idx").join(at, ["query_id", *SEGMENT, "idx"], "left").withColumn("__w", 1 + F.lit(float(max(boost, 0.0))) * F.coalesce("__e", F.lit(0)))
    mean = d.groupBy("query_id").agg(F.avg("__w").alias("__m"))
    return d.join(mean, "query_id").select("query_id", *SEGMENT, "idx", (F.col("__w") / F.col("__m")).alias("weight"))


def position_mass(track: DataFrame, value: str) -> DataFrame:
    """One row: shares of the sum of value in the first fifth, the middle and the last fifth of segments; single points are middle."""
    n = F.count("*").over(Window.partitionBy(*SEGMENT))
    d = track.withColumns({"__n": n, "__v": _mass(value)}).withColumn("__p", F.when(F.col("__n") > 1, F.col("idx") / (F.col("__n") - 1)).otherwise(0.5))
    total = F.sum("__v")
    part = lambda c, name: F.when(total > 1e-12, F.coalesce(F.sum(F.when(c, F.col("__v"))), F.lit(0.0)) / total).otherwise(0.0).alias(name)
    p = F.col("__p")
    return d.agg(part(p <= 0.20, "start"), part((p > 0.20) & (p < 0.80), "middle"), part(p >= 0.80, "end"))


def binary_entropy(df: DataFrame, value: str) -> DataFrame:
    """One row: mean entropy in bits of values in [0, 1] taken as probabilities, held 1e-6 off the ends; 0 without rows."""
    p = F.least(F.greatest(F.col(value).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.agg(F.coalesce(F.avg(-(p * F.log2(p) + (1 - p) * F.log2(1 - p))), F.lit(0.0)).alias("entropy"))


def support_shares(df: DataFrame, value: str, thresholds: Sequence[float] = (0.0, 0.01, 0.05, 0.10)) -> DataFrame:
    """One row: share of rows with a value above each threshold, named gt_0_01 and so on."""
    return df.agg(*[F.coalesce(F.avg((F.col(value) > x).cast("double")), F.lit(0.0)).alias(f"gt_{x:.2f}".replace(".", "_")) for x in thresholds])


def label_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: rows, positive rows and their share, sum, largest value, and 50, 90 and 95 % quantiles of positive values."""
    pos = F.when(F.col(value) > 0, F.col(value).cast("double"))
    q = F.percentile(pos, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    g = df.agg(F.count("*").alias("n"), F.count(pos).alias("n_positive"), F.coalesce(F.sum(pos), F.lit(0.0)).alias("mass"), F.coalesce(F.max(pos), F.lit(0.0)).alias("largest"), q.alias("q"))
    share = F.when(F.col("n") > 0, F.col("n_positive") / F.col("n")).otherwise(0.0)
    return g.select("n", "n_positive", share.alias("positive_share"), "mass", "largest", *[F.coalesce(F.col("q")[i], F.lit(0.0)).alias(n) for i, n in enumerate(("p50", "p90", "p95"))])


def mask_overlap(track: DataFrame, a: str, b: str) -> DataFrame:
    """One row: common, joint, their ratio (1 if both are empty) and rows that differ, of two 0/1 columns."""
    x, y = F.col(a) == 1, F.col(b) == 1
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    g = track.agg(n(x & y).alias("common"), n(x | y).alias("joint"), n(x != y).alias("hamming"))
    return g.select("common", "joint", F.when(F.col("joint") > 0, F.col("common") / F.col("joint")).otherwise(1.0).alias("jaccard"), "hamming")


def retained_gaps(track: DataFrame) -> DataFrame:
    """One row: mean index gap between neighbouring retained points of a segment, that over the segment's length, and the largest."""
    w = Window.partitionBy(*SEGMENT).orderBy("idx")
    d = track.withColumn("__n", F.count("*").over(Window.partitionBy(*SEGMENT))).filter("retained = 1").withColumn("__g", F.col("idx") - F.lag("idx").over(w)).filter("__g IS NOT NULL")
    zero = lambda c, name: F.coalesce(c.cast("double"), F.lit(0.0)).alias(name)
    return d.agg(zero(F.avg("__g"), "avg_gap"), zero(F.avg(F.col("__g") / F.greatest(F.lit(1), F.col("__n") - 1)), "avg_gap_share"), zero(F.max("__g"), "max_gap"))


def endpoint_share(track: DataFrame) -> DataFrame:
    """One row: share of segments whose first and last points are both retained; 1 without segments."""
    n = F.count("*").over(Window.partitionBy(*SEGMENT))
    end = (F.col("idx") == 0) | (F.col("idx") == F.col("__n") - 1)
    g = track.withColumn("__n", n).groupBy(*SEGMENT).agg(F.min(F.when(end, F.col("retained")).otherwise(1)).alias("ok"))
    return g.agg(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(1.0)).alias("endpoints"))
