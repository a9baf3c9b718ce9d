"""CSV files in and out, id lists, several days at once. All cells are read as text; nothing is inferred.

Empty and quoted-empty cells are null. Files are named by the caller; the driver only lists names.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wakeline.operators.cleaning import RAW


def clean_header(name: str) -> str:
    """A header's name without blanks, byte order mark and leading #."""
    return name.strip().lstrip("﻿").lstrip("#").strip()


def the_only_csv(folder: str) -> str:
    """The one *.csv of a folder; none or several are an error."""
    found = sorted(str(p) for p in Path(folder).glob("*.csv"))
    if len(found) != 1:
        raise FileNotFoundError(f"{folder} holds {len(found)} csv files, not one")
    return found[0]


def read_raw(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = RAW, delimiter: str = ",") -> DataFrame:
    """Headered files whose header has these columns, as texts."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).csv(paths if isinstance(paths, str) else list(paths))


def read_sources(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = RAW) -> DataFrame:
    """Several files with source_id, the place of the row's file in paths; the same file twice is an error."""
    if len(set(paths)) != len(paths):
        raise ValueError("a file is named twice")
    out = None
    for k, path in enumerate(paths):
        part = read_raw(spark, path, columns).withColumn("source_id", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def three_days(folder: str) -> dict[str, str]:
    """The first three csv files of a folder by name as train, validation and evaluation."""
    found = sorted(str(p) for p in Path(folder).glob("*.csv"))
    if len(found) < 3:
        raise FileNotFoundError(f"{folder} holds {len(found)} csv files, not three")
    return dict(zip(("train", "validation", "eval"), found))


def write_csv(df: DataFrame, path: str, files: int = 1) -> None:
    """Headered files; one of them unless the caller asks for more. Replaces what is there."""
    df.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file that aren't blank, trimmed, each once, as id."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def keep_ids(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose column is one of ids, and one row with kept and total; a missing column is an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column}; there are {', '.join(df.columns)}")
    known = ids.select(F.col("id").alias("__id"))
    counts = df.join(known.withColumn("__in", F.lit(1)), F.col(f"`{column}`") == F.col("__id"), "left").agg(F.count("__in").alias("kept"), F.count("*").alias("total"))
    return df.join(known, F.col(f"`{column}`") == F.col("__id"), "left_semi"), counts


def write_points_csv(df: DataFrame, path: str) -> None:
    """Retained points with fixed decimals: t 3, lat and lon 6, speed and heading 4."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double")).alias(c)
    write_csv(df.select("mmsi", "seg", "idx", fixed("t", 3), fixed("lat", 6), fixed("lon", 6), fixed("speed", 4), fixed("heading", 4)), path)


def boxes_geojson(boxes: DataFrame) -> DataFrame:
    """One GeoJSON feature per box as text, with its ring and clock times."""
    from wakeline.functions.geo import hh_mm, rectangle_ring

    ring = rectangle_ring({c: F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")})
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct("query_id", hh_mm(F.col("t_start")).alias("from"), hh_mm(F.col("t_end")).alias("to"))
    return boxes.select("query_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))
