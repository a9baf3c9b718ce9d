"""Cleaning of pings: exact copies, moored rows, ship types, unlikely vessels, unreachable positions, gap verdicts.

Frames have mmsi, t (seconds), lat, lon, sog and whatever else is carried; ties of time go by ``tie``. Every step is a
plan; only the fixpoint loop counts rows between its passes. Nulls: a row without t, lat, lon or sog is dropped by
``typed`` and not expected later; null mmsi form one group. Empty frames stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import KNOT_KMH, allowed_km, first_timestamp, haversine_km
from wakeline.session import write_table

#: The columns of a raw file, in order.
RAW = ["MMSI", "# Timestamp", "Type of mobile", "Latitude", "Longitude", "SOG", "COG", "Ship type"]


def class_a_copies_removed(raw: DataFrame) -> DataFrame:
    """The eight raw columns of Class A rows, each different row once; compared as texts, before parsing."""
    return raw.select(*[F.col(f"`{c}`") for c in RAW]).filter(F.col("`Type of mobile`") == "Class A").distinct()


def typed(raw: DataFrame) -> DataFrame:
    """Typed pings of raw text rows; rows without time, position or speed are dropped."""
    number = lambda c: F.col(c).try_cast("double")
    cols = [F.col("MMSI").alias("mmsi"), F.unix_seconds(first_timestamp(F.col("`# Timestamp`"))).alias("t"), number("Latitude").alias("lat"), number("Longitude").alias("lon"), number("SOG").alias("sog"), number("COG").alias("cog"), F.col("`Type of mobile`").alias("mobile_type"), F.col("`Ship type`").alias("ship_type")]
    return raw.select(*cols).dropna(subset=["t", "lat", "lon", "sog"])


def thin_stationary(points: DataFrame, tie: str = "t") -> DataFrame:
    """Of rows at rest (sog 0) the earliest of each vessel and hour; all others."""
    w = Window.partitionBy("mmsi", F.floor(F.col("t") / 3600), F.col("sog") == 0).orderBy("t", tie)
    return points.withColumn("__n", F.row_number().over(w)).filter((F.col("sog") != 0) | (F.col("__n") == 1)).drop("__n")


def fill_ship_type(points: DataFrame, undefined: str = "Undefined") -> DataFrame:
    """Rows of undefined type take the vessel's least known one; rows of vessels without any are dropped."""
    own = F.nullif(F.col("ship_type"), F.lit(undefined))
    known = F.min(own).over(Window.partitionBy("mmsi"))
    return points.withColumn("ship_type", F.coalesce(own, known)).filter(F.col("ship_type").isNotNull())


def drop_fast_vessels(points: DataFrame, *, undefined: str = "Undefined", above: float = 50.0, rows: int = 25) -> DataFrame:
    """All but search-and-rescue rows, without vessels that, among rows of undefined type, sail faster than above in rows rows or more."""
    kept = points.filter(F.coalesce(F.col("ship_type") != "SAR", F.lit(True)))
    fast = kept.filter((F.col("ship_type") == undefined) & (F.col("sog") > above)).groupBy(F.col("mmsi").alias("__m")).agg(F.count("*").alias("n")).filter(F.col("n") >= rows)
    return kept.join(fast.select("__m"), F.col("mmsi") == F.col("__m"), "left_anti")


@dataclass(frozen=True)
class Reach:
    """Whether the ping k steps away in a vessel's order exists and could have been sailed to or from."""

    tie: str = "t"
    margin: float = 1.2
    growth: float = 0.3

    def window(self):  # noqa: ANN201
        return Window.partitionBy("mmsi").orderBy("t", self.tie)

    def other(self, k: int) -> tuple[Column, Column]:
        """(exists, reachable); reachable is null where there is no such ping."""
        at = lambda c: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(self.window())
        hours = F.abs(at("t") - F.col("t")) / 3600.0
        km = haversine_km(F.col("lat"), F.col("lon"), at("lat"), at("lon"))
        return at("t").isNotNull(), km <= allowed_km(F.col("sog"), at("sog"), hours, self.margin, self.growth)


def _dropping(points: DataFrame, wrong: Column) -> DataFrame:
    return points.withColumn("__wrong", wrong).filter(~F.coalesce(F.col("__wrong"), F.lit(False))).drop("__wrong")


def drop_wrong_start(points: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """Of a vessel's first three pings: the first if it fits neither of the next two, the others if they fit neither neighbour."""
    place = F.row_number().over(reach.window())
    unfit = lambda k: ~F.coalesce(reach.other(k)[1], F.lit(False))
    first = (place == 1) & unfit(1) & unfit(2) & reach.other(2)[0]
    others = place.isin(2, 3) & unfit(-1) & unfit(1) & reach.other(1)[0]
    return _dropping(points, first | others)


def drop_between(points: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """Pings with neighbours on both sides that reach neither."""
    (has1, ok1), (has2, ok2) = reach.other(-1), reach.other(1)
    return _dropping(points, has1 & has2 & ~ok1 & ~ok2)


def drop_pairs(points: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """Pings that reach neither second neighbour; near an end, neither of the two beside them."""
    (b1, ok_b1), (a1, ok_a1), (b2, ok_b2), (a2, ok_a2) = (reach.other(k) for k in (-1, 1, -2, 2))
    inner = b2 & a2 & ~ok_b2 & ~ok_a2
    start = ~b2 & a1 & a2 & ~ok_a1 & ~ok_a2
    end = b1 & b2 & ~a2 & ~ok_b1 & ~ok_b2
    return _dropping(points, inner | start | end)


def until_settled(points: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """Repeat step until it drops no row, at most so many times; each pass is written to the shared folder."""
    n = points.count()
    for _ in range(most):
        points = write_table(step(points), "clean")
        left = points.count()
        if left == n:
            break
        n = left
    return points


def drop_unreachable(points: DataFrame, reach: Reach = Reach(), most: int = 3) -> DataFrame:
    """The whole detector: start, between, then pairs until settled."""
    return until_settled(write_table(drop_between(drop_wrong_start(points, reach), reach), "clean"), lambda df: drop_pairs(df, reach), most)


def gap_verdicts(points: DataFrame, tie: str = "t") -> DataFrame:
    """Every step from a ping to the next with km, seconds, needed speed over the greater reported one, and a verdict.

    The step's ping before it is looked up once, so a vessel's second ping has its step too.
    """
    w = Window.partitionBy("mmsi").orderBy("t", tie)
    p = points.withColumns({f"{c}{n}": fn(c).over(w) for n, fn in (("0", F.lag), ("2", F.lead)) for c in ("t", "lat", "lon", "sog")}).filter("t0 IS NOT NULL")
    knots = lambda km, hours: F.when(hours > 0, km / (hours * KNOT_KMH))
    p = p.withColumns({"seconds": F.col("t") - F.col("t0"), "km": haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), "top_sog": F.greatest("sog0", "sog")})
    p = p.withColumn("ratio", F.when(F.col("top_sog") > 0, knots(F.col("km"), F.col("seconds") / 3600.0) / F.col("top_sog")))
    past = knots(haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat2"), F.col("lon2")), (F.col("t2") - F.col("t0")) / 3600.0)
    verdict = (
        F.when(F.col("seconds") == 0, "DUPLICATE_TS")
        .when(F.col("ratio") <= 1.5, "OK_SPEED_MATCHES")
        .when((past < F.col("top_sog") * 1.5) & (F.col("ratio") > 2.0), "SUSPICIOUS_SKIP_FIXES")
        .when(F.col("ratio") > 3.0, "SUSPICIOUS_VERY_FAST")
        .when(F.col("ratio") > 1.5, "BORDERLINE")
        .otherwise("OK")
    )
    return p.withColumn("verdict", verdict).drop("t0", "lat0", "lon0", "sog0", "t2", "lat2", "lon2", "sog2", "top_sog")


def change_report(before: DataFrame, after: DataFrame, tie: str = "t") -> DataFrame:
    """Per vessel: rows before and after, rows deleted and their percentage, longest gap before and after in seconds."""

    def side(df: DataFrame, name: str) -> DataFrame:
        gap = F.col("t") - F.lag("t").over(Window.partitionBy("mmsi").orderBy("t", tie))
        return df.select("mmsi", gap.alias("g")).groupBy("mmsi").agg(F.count("*").alias(f"n_{name}"), F.max("g").alias(f"gap_{name}"))

    both = side(before, "before").join(side(after, "after"), "mmsi", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    gone = F.col("n_before") - F.col("n_after")
    return both.withColumns({"deleted": gone, "pct_deleted": F.round(100.0 * gone / F.col("n_before"), 1)})


def clean_raw(raw: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """The whole job from raw text rows to clean typed pings."""
    return drop_unreachable(before_positions(raw), reach)


def before_positions(raw: DataFrame) -> DataFrame:
    """The job up to the checks of positions."""
    return drop_fast_vessels(fill_ship_type(thin_stationary(typed(class_a_copies_removed(raw)))))


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several days' frames, matched by column name; vessel columns must be spelled alike."""
    names = {tuple(c for c in f.columns if c.lower() == "mmsi") for f in frames}
    if len(names) != 1:
        raise ValueError(f"the days spell their vessel column differently: {sorted(names)}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
