"""From pings to segments: valid rows, segments parted by gaps, thinning to a length, audit, grids and their lookup.

Frames have mmsi, t, lat, lon and, where named, speed and heading. Nulls make a row invalid; a gap is longer than
``max_gap`` seconds, strictly; null max_gap parts nothing. Empty frames give no rows and a zero audit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names a column may have, the first that is there counts, and the valid ranges.
ALIASES = {"mmsi": ["mmsi", "ship_id", "vessel_id"], "lat": ["lat", "latitude"], "lon": ["lon", "longitude"], "speed": ["speed", "sog"], "heading": ["heading", "cog"], "t": ["timestamp", "time", "datetime"]}
#: Conditions of a sound row.
SOUND = {
    "bad_time": "t IS NOT NULL",
    "bad_lat": "lat BETWEEN -90 AND 90",
    "bad_lon": "lon BETWEEN -180 AND 180",
    "bad_speed": "speed BETWEEN 0 AND 102.2",
    "bad_heading": "heading >= 0 AND heading < 360",
}


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """The known columns under their own names; case and a leading # don't matter; a missing one is an error."""
    have = {c.lstrip("# ").lower(): c for c in reversed(df.columns)}
    picked = {}
    for name, known in aliases.items():
        found = next((have[a] for a in known if a in have), None)
        if found is None:
            raise ValueError(f"no column for {name}: one of {', '.join(known)}")
        picked[name] = found
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in picked.items()])


def _sound() -> Column:
    return F.coalesce(F.expr(" AND ".join(f"({c})" for c in SOUND.values())) & F.col("mmsi").isNotNull(), F.lit(False))


def valid(points: DataFrame) -> DataFrame:
    return points.filter(_sound())


def fault_counts(points: DataFrame) -> DataFrame:
    """One row: rows, valid rows, rows by fault (a row may have several), and rows beyond the first of a vessel and time."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    bad = [count(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in SOUND.items()]
    whole = points.agg(F.count("*").alias("loaded"), count(_sound()).alias("kept"), *bad)
    twice = valid(points).groupBy("mmsi", "t").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_times"))
    return whole.join(twice, F.lit(True))  # one row each


def segments(points: DataFrame, *, max_gap: float | None, min_points: int = 1, max_points: int | None = None, tie: str = "t") -> DataFrame:
    """points with seg, idx and n: cut at gaps, short segments dropped, long ones thinned evenly to max_points with both ends."""
    w = Window.partitionBy("mmsi").orderBy("t", tie)
    gap = F.col("t") - F.lag("t").over(w)
    cut = (gap > max_gap).cast("bigint") if max_gap is not None else F.lit(0)
    d = points.withColumn("__cut", F.coalesce(cut, F.lit(0))).withColumn("seg", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    ws = Window.partitionBy("mmsi", "seg")
    d = d.withColumns({"n": F.count("*").over(ws), "idx": F.row_number().over(ws.orderBy("t", tie)) - 1}).filter(F.col("n") >= min_points)
    if max_points is not None:
        k = F.lit(max_points)
        at = F.col("idx") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1))
        place = lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(k - 1, F.lit(1)))
        d = d.filter((F.col("n") <= k) | (place(F.ceil(at)) == F.col("idx")))
        d = d.withColumns({"n": F.count("*").over(ws), "idx": F.row_number().over(ws.orderBy("t", tie)) - 1})
    return d.drop("__cut")


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: count, min, p50, p75, p95, p99, max and mean; zeros where there are no values."""
    q = F.percentile(F.col(value), F.array(*[F.lit(x) for x in (0.5, 0.75, 0.95, 0.99)]))
    g = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return g.select("n", zero(F.col("lo")).alias("lo"), *[zero(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((50, 75, 95, 99))], zero(F.col("hi")).alias("hi"), zero(F.col("mean")).alias("mean"))


def extent(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon", "t") for n, f in (("min", F.min), ("max", F.max))])


def cells(points: DataFrame, extent_row: Mapping[str, float], bins: int = 64) -> DataFrame:
    """points with gy and gx: their cell of a bins x bins grid over the extent, the last cells with their upper edges."""
    def at(c: str) -> Column:
        lo, hi = float(extent_row[f"{c}_min"]), float(extent_row[f"{c}_max"])
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / max(hi - lo, 1e-9) * bins))).cast("int")

    return points.withColumns({"gy": at("lat"), "gx": at("lon")})


def cell_means(points: DataFrame, value: str, by: Sequence[str] = ("gy", "gx")) -> DataFrame:
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def smooth(grid: DataFrame, value: str, bins: int, passes: int = 1) -> DataFrame:
    """A full or sparse grid (gy, gx, value) after passes of the 3 x 3 binomial mean; edges repeat, missing cells count 0.

    A cell gives its value to the cells around it, so a pass is one aggregation of nine rows a cell.
    """
    # replicate padding: an edge cell also stands for its neighbours outside, so it gives their weight to itself and along the edge
    offsets = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(w).alias("w")) for k, w in ((-1, 0.25), (0, 0.5), (1, 0.25))])

    def spread(c: str) -> Column:
        inner = F.transform(offsets, lambda x: F.struct((F.col(c) + x["o"]).alias("to"), x["w"].alias("w")))
        held = F.filter(inner, lambda x: (x["to"] >= 0) & (x["to"] < bins))
        edge = F.when((F.col(c) == 0) | (F.col(c) == bins - 1), F.array(F.struct(F.col(c).alias("to"), F.lit(0.25 if bins > 1 else 0.5).alias("w")))).otherwise(F.filter(inner, lambda x: F.lit(False)))
        return F.concat(held, edge)

    for _ in range(passes):
        g = grid.select("gy", "gx", F.col(value).alias("__v"))
        g = g.withColumn("y", F.explode(spread("gy"))).withColumn("x", F.explode(spread("gx")))
        grid = g.groupBy(F.col("y.to").alias("gy"), F.col("x.to").alias("gx")).agg(F.sum(F.col("__v") * F.col("y.w") * F.col("x.w")).alias(value))
    return grid


def raster(boxes: DataFrame, extent_row: Mapping[str, float], bins: int = 64) -> DataFrame:
    """(gy, gx, n): in how many boxes each cell of the extent's grid has a part."""
    def at(c: str, bound: str) -> Column:
        lo, hi = float(extent_row[f"{c}_min"]), float(extent_row[f"{c}_max"])
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(bound) - lo) / max(hi - lo, 1e-9) * bins))).cast("int")

    b = boxes.withColumn("gy", F.explode(F.sequence(at("lat", "lat_min"), at("lat", "lat_max")))).withColumn("gx", F.explode(F.sequence(at("lon", "lon_min"), at("lon", "lon_max"))))
    return b.groupBy("gy", "gx").agg(F.count("*").alias("n"))


def lookup(points: DataFrame, grid: DataFrame, value: str, extent_row: Mapping[str, float], bins: int = 64) -> DataFrame:
    """points with the grid's value of their cell; 0 in missing cells and outside the extent."""
    outside = ~(F.col("lat").between(float(extent_row["lat_min"]), float(extent_row["lat_max"])) & F.col("lon").between(float(extent_row["lon_min"]), float(extent_row["lon_max"])))
    d = cells(points, extent_row, bins).withColumn("__out", outside).join(grid.select("gy", "gx", value), ["gy", "gx"], "left")
    return d.withColumn(value, F.when(F.col("__out"), 0.0).otherwise(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))).drop("__out")
