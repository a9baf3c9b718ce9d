"""Per-key results where a few keys hold most rows (problem 6): two-stage salted aggregation.

Keys that hold at least ``heavy_share`` of all rows get a salt; partial results are computed per
(key, salt) and then merged per key, so no task works on more than about 1/salts of a heavy key.
There are at most 1/heavy_share heavy keys, which bounds the broadcast list of them.

Defined results: rows with a null key form the group of key null unless ``keep_null`` is false; an
empty table gives no rows; repeated rows all count; columns that clash with internal names are safe
because only the columns named by the caller are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import write_table

#: (output name, partial aggregate over rows, merging aggregate over the partial column)
Measure = tuple[str, Column, "callable"]


def heavy_keys(df: DataFrame, key: str, share: float) -> tuple[DataFrame, int]:
    """Keys with at least ``share`` of the rows and the total row count; counted over all rows."""
    counts = write_table(df.groupBy(key).agg(F.count("*").alias("n")), "keycounts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    return counts.filter(F.col(key).isNotNull() & (F.col("n") >= F.lit(total) * share)).select(key), total


def salted_aggregate(
    df: DataFrame, key: str, row_id: str, measures: Sequence[Measure], *, heavy_share: float = 0.005, salts: int = 64, keep_null: bool = False
) -> tuple[DataFrame, int]:
    """Aggregate per key in two stages; returns (one row per key, total rows of df).

    The salt of a row comes from a hash of ``row_id``, so a re-run of a lost task gives the same rows.
    """
    heavy, total = heavy_keys(df, key, heavy_share)
    src = df if keep_null else df.filter(F.col(key).isNotNull())
    flagged = src.join(F.broadcast(heavy.select(F.col(key).alias("__heavy"))), F.col(key) == F.col("__heavy"), "left")
    salt = F.when(F.col("__heavy").isNotNull(), F.pmod(F.xxhash64(row_id), F.lit(salts))).otherwise(F.lit(0))
    partial = flagged.withColumn("__salt", salt).groupBy(key, "__salt").agg(*[p.alias(n) for n, p, _ in measures])
    return partial.groupBy(key).agg(*[merge(F.col(n)).alias(n) for n, _, merge in measures]), total


def found_heavy(points: DataFrame, share: float = 0.02) -> DataFrame:
    """Each non-null mmsi with at least ``share`` of all rows, through the salted aggregation."""
    per_key, total = salted_aggregate(points.select("id", "mmsi"), "mmsi", "id", [("n", F.count("*"), F.sum)])
    return per_key.filter(F.col("n") >= F.lit(total) * share).select("mmsi")


def vessel_profile(points: DataFrame) -> DataFrame:
    """Per-vessel statistics of all rows by the same two stages."""
    measures = [
        ("n_rows", F.count("*"), F.sum),
        ("n_sog", F.count("sog"), F.sum),
        ("min_lat", F.min("lat"), F.min),
        ("max_lat", F.max("lat"), F.max),
        ("max_sog", F.max("sog"), F.max),
        ("first_id", F.min("id"), F.min),
        ("last_id", F.max("id"), F.max),
    ]
    cols = points.select("id", "mmsi", "lat", "sog")
    return salted_aggregate(cols, "mmsi", "id", measures)[0]
