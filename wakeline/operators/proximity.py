"""Points near other points and in regions (problem 4).

Pairs: every point has one home cell of time and place; its 150 m and 30 s box touches a few cells. It is sent to its
home cell and to those of them that follow it in order, so that of two points of different cells only one is sent to
the other's; an equi-join on the cell finds each candidate pair once, which the exact distance confirms. Rows of cells get their own number
of columns by latitude, so the join is right at the poles and across the antimeridian.

Regions: crossing parity. Polygon edges are binned into latitude strips, points join the edges of their strip,
and the crossings of a ray to the east are counted by point and region; an odd count lies inside, so holes are
outside. A point on an edge counts as inside.

Defined results: rows whose geom is null, empty, not a point, not finite or out of range take no part; rows of
null mmsi or unreadable time take no part in pairs; repeated rows all count; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.trips import metres
from wakeline.session import bounded_local, partitions_for

RX_POINT = r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$"
ROW_DEG = 0.01
STRIP_DEG = 0.05
DEG_M = 111_194.9


def parse_ewkb(texts: pd.Series) -> pd.DataFrame:
    """x and y of points in hex EWKB, null where a text is none; one numpy read per form and batch."""
    x, y = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    raw = texts.str.strip().str.lower()
    srid = raw.str.len() == 50
    for order, end in (("01", "<"), ("00", ">")):
        kind = np.dtype(end + "u4")
        for mask, flag, at in ((srid, 0x20000000, 9), (raw.str.len() == 42, 0, 5)):
            rows = np.flatnonzero((mask & raw.str.startswith(order)).fillna(False).to_numpy(dtype=bool))
            if not len(rows):
                continue
            data = np.frombuffer(bytes.fromhex("".join(raw.iloc[rows])), dtype=np.uint8).reshape(len(rows), -1)
            typed = np.ascontiguousarray(data[:, 1:5]).view(kind)[:, 0]
            point = ((typed & 0xFF) == 1) & ((typed & 0x20000000) == flag) & ((typed & 0xC0000000) == 0)
            xy = np.ascontiguousarray(data[:, at : at + 16]).view(np.dtype(end + "f8"))
            x[rows[point]], y[rows[point]] = xy[point, 0], xy[point, 1]
    return pd.DataFrame({"x": x, "y": y})


def with_position(points: DataFrame) -> DataFrame:
    """Add x (lon) and y (lat) of geom; keep only rows with a readable position in range."""
    g = F.col("geom")
    hexed = g.rlike(r"^\s*0[01]([0-9A-Fa-f]{40}|[0-9A-Fa-f]{48})\s*$")
    df = points.withColumn("__b", F.pandas_udf(parse_ewkb, "struct<x double, y double>")(F.when(hexed, g)))
    text = lambda i: F.regexp_extract(g, RX_POINT, i).try_cast("double")
    df = df.select("*", F.inline(F.array(F.struct(F.coalesce(F.nanvl("__b.x", F.lit(None).cast("double")), text(1)).alias("x"), F.coalesce(F.nanvl("__b.y", F.lit(None).cast("double")), text(2)).alias("y"))))).drop("__b")
    return df.filter(F.col("x").between(-180, 180) & F.col("y").between(-90, 90) & ~F.isnan("x") & ~F.isnan("y"))


def _columns(row: Column) -> Column:
    """Cells in a row: about 0.02 degrees of latitude wide at the row's edge nearer to the pole."""
    edge = F.greatest(F.abs(row.cast("double")), F.abs(row + 1.0)) * ROW_DEG
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * 360 / (2 * ROW_DEG))).cast("bigint")


def near_pairs(points: DataFrame, *, seconds: int = 30, radius: float = 150.0) -> DataFrame:
    """(a, b) of rows of different vessels at most seconds and radius apart; points needs id, mmsi, ts_us, x, y."""
    p = points.filter(F.col("mmsi").isNotNull() & F.col("ts_us").isNotNull()).select("id", "mmsi", "ts_us", "x", "y")
    step = seconds * 1_000_000
    reach = radius / DEG_M * 1.001
    row, tbin = F.floor(F.col("y") / ROW_DEG), F.floor(F.col("ts_us") / step)

    def col_of(x: Column, r: Column) -> Column:
        n = _columns(r)
        return F.pmod(F.floor((x + 180.0) / 360.0 * n), n)

    home = p.select(F.col("id").alias("b"), F.col("mmsi").alias("mb"), F.col("ts_us").alias("tb"), F.col("x").alias("xb"), F.col("y").alias("yb"), tbin.alias("ct"), row.alias("cr"), col_of(F.col("x"), row).alias("cc"))
    parts = partitions_for(points, 8 << 20)
    wide = p.withColumns({"ht": tbin, "hr": row, "hc": col_of(F.col("x"), row)})
    wide = wide.withColumn("ct", F.explode(F.sequence(F.col("ht"), F.floor((F.col("ts_us") + step) / step))))
    wide = wide.withColumn("cr", F.explode(F.sequence(F.floor((F.col("y") - reach) / ROW_DEG), F.floor((F.col("y") + reach) / ROW_DEG))))
    wide = wide.filter((F.col("ct") > F.col("ht")) | (F.col("cr") >= F.col("hr")))
    # degrees of longitude within reach at the latitude nearest the pole that the box touches; all of the row near a pole
    top = F.least(F.abs(F.col("y")) + reach, F.lit(90.0))
    half = F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians(top)), F.lit(1e-9)))
    n = _columns(F.col("cr"))
    lo, hi = F.floor((F.col("x") - half + 180.0) / 360.0 * n), F.floor((F.col("x") + half + 180.0) / 360.0 * n)
    wide = wide.withColumn("cc", F.explode(F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + n)), lambda c: F.pmod(c, n)))))
    same = (F.col("ct") == F.col("ht")) & (F.col("cr") == F.col("hr"))
    wide = wide.filter(~same | (F.col("cc") >= F.col("hc"))).withColumn("__own", same & (F.col("cc") == F.col("hc"))).drop("ht", "hr", "hc")
    joined = wide.repartition(parts, "ct", "cr", "cc").join(home.repartition(parts, "ct", "cr", "cc"), ["ct", "cr", "cc"])
    joined = joined.filter((~F.col("__own") | (F.col("id") < F.col("b"))) & (F.col("mmsi") != F.col("mb")) & (F.abs(F.col("ts_us") - F.col("tb")) <= step))
    return joined.filter(metres(F.col("y"), F.col("x"), F.col("yb"), F.col("xb")) <= radius).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def rings(wkt: str | None) -> list[list[tuple[float, float]]]:
    """Closed rings of a POLYGON or MULTIPOLYGON text; outer rings and holes alike."""
    out = []
    for body in re.findall(r"\(([^()]+)\)", wkt or ""):
        pts = [tuple(map(float, q.split()[:2])) for q in body.split(",") if len(q.split()) >= 2]
        if len(pts) >= 3:
            out.append(pts if pts[0] == pts[-1] else [*pts, pts[0]])
    return out


def area_edges(areas: DataFrame) -> DataFrame:
    """(area_id, x1, y1, x2, y2, strip): every edge once in each latitude strip it touches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *a, *b) for i, wkt in zip(pdf["area_id"], pdf["wkt"]) for r in rings(wkt) for a, b in zip(r, r[1:])]
            yield pd.DataFrame(rows, columns=["area_id", "x1", "y1", "x2", "y2"])

    e = areas.select("area_id", "wkt").mapInPandas(run, "area_id bigint, x1 double, y1 double, x2 double, y2 double")
    return e.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / STRIP_DEG), F.floor(F.greatest("y1", "y2") / STRIP_DEG))))


def inside(points: DataFrame, areas: DataFrame, *, max_edges: int = 200_000) -> DataFrame:
    """(area_id, id) of each point in an area; points needs id, x, y."""
    edges, small = bounded_local(area_edges(areas), max_edges)
    edges = F.broadcast(edges) if small else edges
    p = points.select("id", "x", "y", F.floor(F.col("y") / STRIP_DEG).alias("strip"))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    j = p.join(edges, "strip").filter(x <= F.greatest(x1, x2))
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on_edge = (cross == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    j = j.select("area_id", "id", F.coalesce(hit, F.lit(False)).cast("int").alias("hit"), on_edge.cast("int").alias("edge")).filter("hit = 1 or edge = 1")
    counted = j.groupBy("area_id", "id").agg(F.sum("hit").alias("hits"), F.max("edge").alias("edge"))
    return counted.filter((F.col("edge") == 1) | (F.pmod("hits", F.lit(2)) == 1)).select("area_id", "id")
