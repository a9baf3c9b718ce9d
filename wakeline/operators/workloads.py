"""Workloads of boxes: quotas by family, balanced sequences, boxes around anchor points, weights of anchors, reports.

Plans of a few hundred boxes are made on the driver from parameters alone; whatever looks at points is a plan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import DEGREE_KM, unit_interval
from wakeline.operators.ranking import running

#: Weights of the parts of the utility of a retained set, and bars of the final grid.
WEIGHTS = {"recall": 0.50, "interpolation": 0.20, "turn": 0.15, "gap": 0.10, "endpoints": 0.02, "shape": 0.02, "length": 0.01}
RATIOS = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30)
BARS = {"uniform_wins": 19, "farthest_wins": 24, "low_wins": 7, "at_5_percent_wins": 3}


def quotas(weights: Mapping[str, float], n: int) -> dict[str, int]:
    """n shared out by weight: whole parts first, what is left to the largest remainders, then weights, then earlier names."""
    names = list(weights)
    w = [max(0.0, float(weights[k])) for k in names]
    if n <= 0 or not names:
        return {k: 0 for k in names}
    if sum(w) <= 0:
        w = [1.0] * len(names)
    exact = [n * x / sum(w) for x in w]
    out = [math.floor(x) for x in exact]
    by_rest = sorted(range(len(names)), key=lambda i: (out[i] - exact[i], -w[i], i))
    for i in by_rest[: n - sum(out)]:
        out[i] += 1
    return dict(zip(names, out))


def balanced_sequence(weights: Mapping[str, float], n: int, seed: str) -> list[str]:
    """Names by quota, each place to the name furthest behind its share so far; then larger quota, then a hash."""
    quota = quotas(weights, n)
    used = dict.fromkeys(quota, 0)
    total, out = sum(quota.values()), []
    for place in range(total):
        def behind(k: str) -> tuple[float, int, bytes]:
            return ((place + 1) * quota[k] / total - used[k], quota[k], hashlib.sha256(f"{seed}:{place}:{k}".encode()).digest()[:8])

        k = max((k for k in quota if used[k] < quota[k]), key=behind)
        used[k] += 1
        out.append(k)
    return out


def boxes_around(anchors: DataFrame, half_km: Column, half_hours: Column) -> DataFrame:
    """A box around each anchor (query_id, lat, lon, t): so many kilometres and hours to each side."""
    dy = half_km / DEGREE_KM
    dx = half_km / (F.greatest(F.lit(0.10), F.cos(F.radians("lat"))) * DEGREE_KM)
    return anchors.select("query_id", (F.col("lat") - dy).alias("lat_min"), (F.col("lat") + dy).alias("lat_max"), (F.col("lon") - dx).alias("lon_min"), (F.col("lon") + dx).alias("lon_max"), (F.col("t") - half_hours * 3600).alias("t_start"), (F.col("t") + half_hours * 3600).alias("t_end"))


def sparse_weights(points: DataFrame, by: Sequence[str] = ("gy", "gx")) -> DataFrame:
    """points with weight: one over the points of their cell."""
    n = points.groupBy(*by).agg(F.count("*").alias("__n"))
    return points.join(n, list(by)).withColumn("weight", 1.0 / F.col("__n")).drop("__n")


def draw(points: DataFrame, weight: str, key: str, n: int, seed: str) -> DataFrame:
    """n draws with replacement by weight, at fixed places of the summed weights: query_id and the drawn point's columns.

    Places come from the seed and n; sums run in two stages. A point and a place meet in one of n slots of the sum, so
    the join is on the slot and has at most rows + n candidates.
    """
    d = running(points.filter(F.col(weight) > 0), [F.col(key).asc()], [weight])
    total = float(points.filter(F.col(weight) > 0).agg(F.coalesce(F.sum(weight), F.lit(0.0))).first()[0])
    at = points.sparkSession.range(n).select(F.col("id").alias("query_id"), (unit_interval(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))) * total).alias("__at"))
    slot = lambda x: F.least(F.lit(n - 1), F.floor(x / F.lit(max(total, 1e-300) / n)))
    lo, hi = F.col(f"before_{weight}"), F.col(f"before_{weight}") + F.col(weight)
    spread = d.withColumn("__slot", F.explode(F.sequence(slot(lo), slot(hi))))
    picked = spread.join(at.withColumn("__slot", slot(F.col("__at"))), "__slot").filter((F.col("__at") >= lo) & (F.col("__at") < hi))
    return picked.drop("__at", "__slot", f"before_{weight}")


def utility(scores: DataFrame, *, length: float = 1.0, avg_sed_km: float = 0.0, endpoints: float = 1.0) -> DataFrame:
    """One row: means over queries of recall, interpolation, turn and gap, and their weighted sum with the guards of the whole."""
    parts = {k: F.coalesce(F.avg(k), F.lit(1.0)) for k in ("recall", "interpolation", "turn", "gap")}
    whole = {"endpoints": F.lit(endpoints), "shape": F.lit(1.0 / (1.0 + max(0.0, avg_sed_km))), "length": F.lit(min(1.0, max(0.0, length)))}
    total = F.lit(0.0)
    for k, v in (parts | whole).items():
        total = total + v * WEIGHTS[k]
    return scores.agg(*[v.alias(k) for k, v in parts.items()], total.alias("utility"))


def by_family(scores: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Means of values and number of rows by a, by b and by both: grouping sets, with the level's name."""
    g = scores.groupingSets([[a], [b], [a, b]], a, b).agg(F.grouping_id().alias("__g"), F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    level = F.when(F.col("__g") == 1, a).when(F.col("__g") == 2, b).otherwise(f"{a}_{b}")
    return g.withColumn("level", level).drop("__g")


def final_grid(cells: DataFrame, profiles: Sequence[str], ratios: Sequence[float] = RATIOS, low: float = 0.05) -> DataFrame:
    """One row over the wanted cells (profile, ratio): present and missing ones, wins of learned over uniform and over
    farthest, over uniform at low ratios and at 5 %, and whether all bars are met. cells: profile, ratio, learned, uniform, farthest."""
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(p, float(r)) for p in profiles for r in ratios], "__p string, __r double")
    j = wanted.join(cells, (F.col("profile") == F.col("__p")) & (F.abs(F.col("ratio") - F.col("__r")) <= 1e-9), "left")
    known = F.col("learned").isNotNull() & F.col("uniform").isNotNull() & F.col("farthest").isNotNull()
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
    better = F.col("learned") > F.col("uniform")
    g = j.agg(n(known).alias("cells"), n(~known).alias("missing"), n(known & better).alias("uniform_wins"), n(known & (F.col("learned") > F.col("farthest"))).alias("farthest_wins"), n(known & better & (F.col("__r") <= low)).alias("low_wins"), n(known & better & (F.abs(F.col("__r") - 0.05) <= 1e-9)).alias("at_5_percent_wins"))
    ok = F.col("missing") == 0
    for c, bar in BARS.items():
        ok = ok & (F.col(c) >= bar)
    return g.withColumn("passed", ok)


def sequence_frame(spark: SparkSession, weights: Mapping[str, float], n: int, seed: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(balanced_sequence(weights, n, seed))), "place int, family string")
