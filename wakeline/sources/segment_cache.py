"""Segments as Parquet with a manifest, found again by a key of the source's identity and the loader's settings."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
#: The columns of the canonical segment table.
COLUMNS = ["mmsi", "seg", "idx", "t", "lat", "lon", "speed", "heading"]


def cache_key(identity: Mapping[str, object], settings: Mapping[str, object]) -> str:
    text = json.dumps([VERSION, identity, settings], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def file_identity(path: str) -> dict[str, object]:
    s = os.stat(path)
    return {"path": os.path.abspath(path), "size": s.st_size, "mtime_ns": s.st_mtime_ns}


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segment table in order; a missing column is an error."""
    df = spark.read.parquet(path)
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.orderBy("mmsi", "seg", "idx")


def load_or_build(spark: SparkSession, root: str, identity: Mapping[str, object], settings: Mapping[str, object], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(segments, whether they were there already); the manifest is written last, so half a table is never a hit."""
    folder = f"{root}/{cache_key(identity, settings)}"
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    fs = manifest.getFileSystem(spark._jsc.hadoopConfiguration())
    hit = fs.exists(manifest)
    if not hit:
        build().select(*COLUMNS).write.mode("overwrite").parquet(f"{folder}/segments")
        out = fs.create(manifest, True)
        out.write(bytearray(json.dumps({"version": VERSION, "identity": dict(identity), "settings": dict(settings)}, default=str).encode()))
        out.close()
    return read_segments(spark, f"{folder}/segments"), hit
