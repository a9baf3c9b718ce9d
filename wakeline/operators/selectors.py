"""Choosing the points of tracks to retain under a budget of min(n, max(2, ceil(ratio * n))) points a segment.

Tracks have mmsi, seg, idx, t, lat, lon; results are the same rows with retained (0 or 1). Segments are bounded by the
gap rule, so a window by segment is a bounded group unless a vessel never falls silent; those are cut by the caller.
Ties go to the lower index.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import budget

SEGMENT = ["mmsi", "seg"]


def _sized(track: DataFrame, ratio: float) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*SEGMENT))
    return track.withColumn("__n", n).withColumn("__k", budget(F.col("__n"), ratio))


def even(track: DataFrame, ratio: float) -> DataFrame:
    """Evenly spaced indices with both ends: those nearest to i * (n - 1) / (k - 1), halves to the even one."""
    d = _sized(track, ratio)
    # index j is chosen if some i rounds to it: look at the i on both sides of j * (k - 1) / (n - 1)
    at = F.col("idx") * (F.col("__k") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))
    place = lambda i: F.rint(i * (F.col("__n") - 1) / F.greatest(F.col("__k") - 1, F.lit(1)))
    chosen = (place(F.floor(at)) == F.col("idx")) | (place(F.ceil(at)) == F.col("idx"))
    return d.withColumn("retained", (chosen | (F.col("__k") >= F.col("__n"))).cast("int")).drop("__n", "__k")


def jitter(idx: Column, group: Column) -> Column:
    """A fixed fraction of an index and a group in [-0.5, 0.5) that parts equal scores."""
    x = F.sin(idx * 12.9898 + group * 78.233) * 43758.5453  # fixed values
    return x - F.floor(x) - 0.5


def best_scores(track: DataFrame, score: Column, ratio: float, *, group: Column | None = None) -> DataFrame:
    """The ends and the best-scored points up to the budget; with group equal scores are parted by a jitter of 1e-6."""
    s = score if group is None else score + F.lit(1e-6) * jitter(F.col("idx"), group)
    d = _sized(track, ratio).withColumn("__s", s)
    place = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy(F.col("__s").desc(), "idx"))
    ends = (F.col("idx") == 0) | (F.col("idx") == F.col("__n") - 1)
    return d.withColumn("retained", (ends | (place <= F.col("__k"))).cast("int")).drop("__n", "__k", "__s")


def even_then_best(track: DataFrame, score: Column, ratio: float, base: float) -> DataFrame:
    """An even base of the share base of the budget, filled up with the best-scored of the other points."""
    d = _sized(track, ratio)
    b = F.least(F.col("__k"), F.greatest(F.lit(2), F.ceil(F.col("__k") * F.lit(float(base))))).cast("bigint")
    d = d.withColumns({"__b": b, "__s": score})
    at = F.col("idx") * (F.col("__b") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))
    place = lambda i: F.rint(i * (F.col("__n") - 1) / F.greatest(F.col("__b") - 1, F.lit(1)))
    base_row = (place(F.floor(at)) == F.col("idx")) | (place(F.ceil(at)) == F.col("idx")) | (F.col("__b") >= F.col("__n"))
    d = d.withColumn("__base", base_row)
    order = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy(F.col("__base").desc(), F.col("__s").desc(), "idx"))
    return d.withColumn("retained", (order <= F.col("__k")).cast("int")).drop("__n", "__k", "__b", "__s", "__base")


def _split(lat: np.ndarray, lon: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """Largest distance of an inner point from the chord from a to b in degrees, and the first such point; from a if the chord is a point."""
    if b - a < 2:
        return -1.0, -1
    y, x = lat[a + 1 : b] - lat[a], lon[a + 1 : b] - lon[a]
    dy, dx = lat[b] - lat[a], lon[b] - lon[a]
    size = float(np.hypot(dx, dy))
    d = np.abs(dx * y - dy * x) / size if size > 1e-12 else np.hypot(x, y)
    k = int(np.argmax(d))
    return float(d[k]), a + 1 + k


def farthest_first(track: DataFrame, ratio: float) -> DataFrame:
    """Douglas-Peucker by budget: from the ends on, the point farthest from its chord is retained next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        n = len(pdf)
        keep = np.zeros(n, dtype="int32")
        left = min(n, max(2, int(np.ceil(ratio * n - 1e-9))))
        keep[[0, n - 1]] = 1
        left -= int(keep.sum())
        lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
        d, at = _split(lat, lon, 0, n - 1)
        heap = [(-d, at, 0, n - 1)] if at >= 0 else []
        while left > 0 and heap:
            _, at, a, b = heapq.heappop(heap)
            keep[at] = 1
            left -= 1
            for lo, hi in ((a, at), (at, b)):
                d, m = _split(lat, lon, lo, hi)
                if m >= 0:
                    heapq.heappush(heap, (-d, m, lo, hi))
        return pdf.assign(retained=keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in track.schema.fields if f.name != "retained") + ", retained int"
    return track.drop("retained").groupBy(*SEGMENT).applyInPandas(run, schema)
