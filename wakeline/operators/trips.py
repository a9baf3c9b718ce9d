"""Trips and stops (problem 3): gaps and islands over a vessel's pings with SQL windows.

Silences of more than ``silence`` part a vessel's pings into stretches. Within a stretch lagged distance and speed
tell steps of travel from steps of rest with hysteresis: above ``slow`` a vessel travels, at half of it or less it
rests, between the two it goes on as before. Consecutive rest steps are islands; what of an island doesn't stay
within ``radius`` for ``stay`` (drifting, slow sailing however often reported) is cut off; islands interrupted by a
short excursion close by are merged, and islands of at least ``stay`` are stops. Trips lie between stops.

Rows are worked on in blocks (``blocks``), so a hot vessel is many tasks. What leaves a block is one row per five
minutes of rest and the first and last pings of stretches and blocks; only these meet by vessel, at most about
105,000 a year.

A stop's metres are those sailed between its first and last ping, a trip's those from its first to its last.

Defined results: rows with null mmsi, ts_us, lat or lon are ignored; repeated pings count once; a vessel with
one ping has neither stop nor trip; an empty table gives no rows. More than 256 steps on end between the two speeds
count as rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.blocks import in_blocks
from wakeline.session import partitions_for

MIN_US = 60_000_000
BUCKET_US = 5 * MIN_US


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h))) * (2 * 6_371_000)


def _rest_pieces(blocked: DataFrame, silence_us: int, radius: float, slow: float) -> DataFrame:
    """Five-minute pieces of rest islands of five minutes or more, and those at edges of stretches and blocks."""
    w = Window.partitionBy("mmsi", "__block").orderBy("ts_us", "id")
    p = blocked.withColumn("__before", F.lag("ts_us").over(w)).filter(F.col("__before").isNull() | (F.col("__before") != F.col("ts_us")))
    p = p.withColumns({"__t": F.lag("ts_us").over(w), "__la": F.lag("lat").over(w), "__lo": F.lag("lon").over(w)})
    p = p.withColumn("__d", metres(F.col("__la"), F.col("__lo"), F.col("lat"), F.col("lon"))).withColumn("__v", F.col("__d") / ((F.col("ts_us") - F.col("__t")) / 1e6))
    cut = F.col("__t").isNull() | (F.col("ts_us") - F.col("__t") > silence_us)
    # Slow sailing: each step is short, but the positions four pings before and after lie well apart from this one.
    back = metres(F.lag("lat", 4).over(w), F.lag("lon", 4).over(w), F.col("lat"), F.col("lon"))
    ahead = metres(F.lead("lat", 4).over(w), F.lead("lon", 4).over(w), F.col("lat"), F.col("lon"))
    calm_us = F.lead("ts_us", 4).over(w) - F.lag("ts_us", 4).over(w)
    drift = F.coalesce((back > 120) & (ahead > 120) & ((back + ahead) / (calm_us / 1e6) > 0.15) & (calm_us <= silence_us), F.lit(False))
    p = p.withColumns({"__cut": cut, "__drift": drift})
    sure = F.when(F.col("__cut") | F.col("__drift") | (F.col("__d") > radius) | ((F.col("__d") > 60) & (F.col("__v") > slow)), 1).when((F.col("__d") <= 60) | (F.col("__v") <= slow / 2), 0)
    p = p.withColumn("__travel", F.coalesce(F.last(sure, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    p = p.filter("__home")
    p = p.withColumns({"__isl": F.sum("__travel").over(w), "__cum": F.sum(F.when(F.col("__cut"), 0.0).otherwise(F.col("__d"))).over(w), "__bucket": F.floor(F.col("ts_us") / BUCKET_US)})
    pieces = p.groupBy("mmsi", "__block", "__isl", "__bucket").agg(
        F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.count("*").alias("n"), F.sum("lat").alias("slat"), F.sum("lon").alias("slon"),
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
        F.min("__cum").alias("ca"), F.max("__cum").alias("cb"), F.max("__cut").alias("cuts"), F.max("__travel").alias("moves"),
    )
    wi, wb = Window.partitionBy("mmsi", "__block", "__isl"), Window.partitionBy("mmsi", "__block").orderBy("a")
    lead_cuts, nxt = F.lead("cuts").over(wb), F.lead("a").over(wb)
    pieces = pieces.withColumns({"__last": nxt.isNull(), "__first": F.lag("a").over(wb).isNull(), "__ends": F.coalesce(lead_cuts, F.lit(False)), "__span": F.max("b").over(wi) - F.min("a").over(wi)})
    return pieces.filter((F.col("__span") >= BUCKET_US) | F.col("cuts") | F.col("__ends") | F.col("__first") | F.col("__last"))


def stops_and_trips(points: DataFrame, *, silence_us: int = 180 * MIN_US, stay_us: int = 30 * MIN_US, trip_us: int = 10 * MIN_US, radius: float = 200.0, slow: float = 0.5) -> DataFrame:
    """(mmsi, kind, start_us, end_us, duration_us, metres) of every stop and trip; points needs id, mmsi, ts_us, lat, lon.

    Points that come from blocks already (with __block and __home) are not cut again.
    """
    p = points.filter(F.col("mmsi").isNotNull() & F.col("ts_us").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if "__block" not in p.columns:
        p = in_blocks(p.select("id", "mmsi", "ts_us", "lat", "lon")).repartition(partitions_for(points), "mmsi", "__block")
    pieces = _rest_pieces(p.select("id", "mmsi", "ts_us", "lat", "lon", "__block", "__home"), silence_us, radius, slow)
    # Number stretches and islands of the whole vessel: an island goes on over a block's edge unless it begins with travel.
    wv = Window.partitionBy("mmsi").orderBy("__block", "a")
    begins = F.col("cuts") | (F.col("moves") == 1) | F.coalesce((F.col("__isl") != F.lag("__isl").over(wv)) & (F.col("__block") == F.lag("__block").over(wv)), F.lit(True) & F.lag("__isl").over(wv).isNull())
    k = pieces.withColumns({"__seg": F.sum(F.col("cuts").cast("int")).over(wv), "__run": F.sum(begins.cast("int")).over(wv)})
    sailed = F.coalesce(F.sum(F.when(F.col("__last"), F.col("cb"))).over(wv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    k = k.withColumn("__sailed", sailed).withColumns({"ca": F.col("ca") + F.col("__sailed"), "cb": F.col("cb") + F.col("__sailed")})
    ends = k.groupBy("mmsi", "__seg").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.min("ca").alias("clo"), F.max("cb").alias("chi"))

    # Of islands wider than the radius allows only what stays within it for long enough is kept.
    def wide(w) -> Column:  # noqa: ANN001
        north = (F.max("lat1").over(w) - F.min("lat0").over(w)) * 111_195
        east = (F.max("lon1").over(w) - F.min("lon0").over(w)) * 111_195 * F.cos(F.radians(F.col("lat0")))
        return F.greatest(north, east) > 2 * radius

    wr = Window.partitionBy("mmsi", "__run")
    ahead = wr.orderBy("a").rangeBetween(0, stay_us)
    k = k.withColumns({"__wide": wide(wr), "__calm": (~wide(ahead) & (F.max("b").over(ahead) - F.col("a") >= stay_us)).cast("int")})
    k = k.withColumn("__in", ~F.col("__wide") | (F.max("__calm").over(wr.orderBy("a").rangeBetween(-stay_us, 0)) == 1))
    k = k.withColumn("__part", F.sum((~F.col("__in")).cast("int")).over(wr.orderBy("a"))).filter("__in")
    isl = k.groupBy("mmsi", "__seg", "__run", "__part").agg(F.min("a").alias("a"), F.max("b").alias("b"), (F.sum("slat") / F.sum("n")).alias("lat"), (F.sum("slon") / F.sum("n")).alias("lon"), F.min("ca").alias("ca"), F.max("cb").alias("cb"))
    # Merge islands that lie within the radius of the island before them, a short excursion apart.
    ws = Window.partitionBy("mmsi", "__seg").orderBy("a")
    long = isl.filter(F.col("b") - F.col("a") >= 5 * MIN_US)
    far = metres(F.lag("lat").over(ws), F.lag("lon").over(ws), F.col("lat"), F.col("lon"))
    joins = F.coalesce((far <= radius / 2) & (F.col("a") - F.lag("b").over(ws) <= 20 * MIN_US), F.lit(False))
    grouped = long.withColumn("__new", (~joins).cast("int")).withColumn("__grp", F.sum("__new").over(ws))
    stops = grouped.groupBy("mmsi", "__seg", "__grp").agg(F.min("a").alias("s"), F.max("b").alias("e"), F.min("ca").alias("cs"), F.max("cb").alias("ce")).filter(F.col("e") - F.col("s") >= stay_us)
    # Trips: from the end of one stop (or the stretch's first ping) to the start of the next (or its last ping).
    none = F.lit(None).cast("bigint")
    bounds = stops.select("mmsi", "__seg", "s", "e", "cs", "ce").unionByName(ends.select("mmsi", "__seg", none.alias("s"), F.col("lo").alias("e"), F.lit(None).cast("double").alias("cs"), F.col("clo").alias("ce")))
    wb = Window.partitionBy("mmsi", "__seg").orderBy(F.col("e"), F.col("s").asc_nulls_first())
    after = bounds.withColumns({"nxt": F.lead("s").over(wb), "cnxt": F.lead("cs").over(wb)}).join(ends, ["mmsi", "__seg"])
    both = after.select("mmsi", F.inline(F.array(
        F.struct(F.lit("stop").alias("kind"), F.col("s").alias("start_us"), F.col("e").alias("end_us"), (F.col("ce") - F.col("cs")).alias("metres")),
        F.struct(F.lit("trip").alias("kind"), F.col("e").alias("start_us"), F.coalesce("nxt", "hi").alias("end_us"), (F.coalesce("cnxt", "chi") - F.col("ce")).alias("metres")),
    )))
    both = both.filter(F.col("start_us").isNotNull() & ((F.col("kind") == "stop") | (F.col("end_us") - F.col("start_us") >= trip_us)))
    return both.select("mmsi", "kind", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.greatest("metres", F.lit(0.0)).alias("metres"))
