"""Queries pN_ of the general problems, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import heavy_keys, proximity, row_parser, spikes, timestamps, trips
from wakeline.session import load, write_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found_timestamps(load(spark, sf_dir, "ais_points_cleaned"), load(spark, sf_dir, "ais_stations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_parser.found_bad_lines(load(spark, sf_dir, "ais_raw_lines"), load(spark, sf_dir, "ais_import_progress"))


def p5_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_parser.reject_counts(load(spark, sf_dir, "ais_raw_lines"), load(spark, sf_dir, "ais_import_progress"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.found_heavy(load(spark, sf_dir, "ais_points_cleaned"))


def p6_vessel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.vessel_profile(load(spark, sf_dir, "ais_points_cleaned"))


def _timed_points(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    src = load(spark, sf_dir, "ais_points_cleaned").select("ts", "station_id", "received_at", *cols)
    return timestamps.normalize_timestamps(src, load(spark, sf_dir, "ais_stations")).select(*cols, "ts_us")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = write_table(_timed_points(spark, sf_dir, "id", "mmsi", "lat", "lon", "sog", "cog"), "timed")
    return spikes.flag_readings(timed)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = write_table(_timed_points(spark, sf_dir, "id", "mmsi", "lat", "lon", "sog", "cog"), "timed")
    return trips.stops_and_trips(spikes.clean_positions(timed)).select("mmsi", "kind", "start_us", "end_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = write_table(proximity.with_position(_timed_points(spark, sf_dir, "id", "mmsi", "geom")).drop("geom"), "placed")
    pairs = proximity.near_pairs(timed).select(F.lit("pair").alias("kind"), "a", "b")
    areas = proximity.inside(timed, load(spark, sf_dir, "sea_areas")).select(F.lit("area").alias("kind"), F.col("area_id").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(areas)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p5_reject_counts, p6_found, p6_vessel_profile)}
ORACLE: dict[str, str] = {
    "p6_found": """SELECT mmsi FROM ais_points_cleaned WHERE mmsi IS NOT NULL GROUP BY mmsi
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM ais_points_cleaned)""",
    "p6_vessel_profile": """SELECT mmsi, count(*) AS n_rows, count(sog) AS n_sog, min(lat) AS min_lat, max(lat) AS max_lat,
        max(sog) AS max_sog, min(id) AS first_id, max(id) AS last_id FROM ais_points_cleaned WHERE mmsi IS NOT NULL GROUP BY mmsi""",
}
