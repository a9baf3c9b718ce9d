"""Resumable import of raw lines into a point table, with progress per source file.

A batch of lines of one source is parsed, its sound rows go to the point table and its progress row is replaced. The
points of a batch are written to a folder of their own, named by source and first line, before progress moves on, and
a batch that is run again replaces that folder: a run that dies between the two repeats the batch and leaves each line
once. Progress of a source whose size, time or delimiter changed is an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.operators.row_parser import parse_lines
from wakeline.session import input_bytes

PROGRESS = "source_path string, source_size bigint, source_mtime_ns bigint, delimiter string, rows_read bigint, inserted bigint, skipped bigint, skip_missing_ts bigint, skip_missing_core bigint, skip_bad_coords bigint, updated_at timestamp"
COUNTS = ["rows_read", "inserted", "skipped", "skip_missing_ts", "skip_missing_core", "skip_bad_coords"]


def upsert(table: DataFrame, changes: DataFrame, key: str, newest: str) -> DataFrame:
    """table with changes laid over it: of each key the row with the latest newest, changes before table on ties."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("__new").desc(), F.col(newest).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in sorted(table.columns)])
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


@dataclass
class Importer:
    """Point and progress tables under root, a folder that all executors share."""

    spark: SparkSession
    root: str

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/progress")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(p) else []

    def progress(self) -> DataFrame:
        """The last progress table that was written whole; empty before the first."""
        known = self._versions()
        return self.spark.read.schema(PROGRESS).parquet(f"{self.root}/progress/{known[-1]}") if known else self.spark.createDataFrame([], PROGRESS)

    def points(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/points") if self._exists(f"{self.root}/points") else None

    def load(self, lines: DataFrame, *, source: str, size: int, mtime_ns: int, delimiter: str, batch_lines: int = 1_000_000) -> dict[str, int]:
        """Import the lines (line_no, line) of source that progress doesn't cover yet; returns the source's counts."""
        old = self.progress().filter(F.col("source_path") == source).first()
        if old and (old["source_size"], old["source_mtime_ns"], old["delimiter"]) != (size, mtime_ns, delimiter):
            raise ValueError(f"{source} is not the file that was begun; delete its progress first")
        counts = {c: old[c] if old else 0 for c in COUNTS}
        last = lines.agg(F.max("line_no")).first()[0] or 0
        name = hashlib.sha256(source.encode()).hexdigest()[:16]
        while counts["rows_read"] < last:
            first, upto = counts["rows_read"] + 1, min(last, counts["rows_read"] + batch_lines)
            batch = lines.filter(F.col("line_no").between(first, upto)).withColumn("source_path", F.lit(source))
            params = self.spark.createDataFrame([(source, delimiter, None, 0)], "source_path string, delimiter string, updated_at timestamp, rows_read bigint")
            done = parse_lines(batch, params).select("line_no", "reason", *[F.col(f"p_{c}").alias(c) for c in ("mmsi", "ts", "mobile_type", "lat", "lon", "sog", "cog", "ship_type")])
            sound = done.filter("reason IS NULL").drop("reason").withColumn("geom", F.format_string("SRID=4326;POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string")))
            sound.write.mode("overwrite").parquet(f"{self.root}/points/batch={name}-{first:012d}")
            reasons = {r["reason"]: r["count"] for r in done.groupBy("reason").count().collect()}  # six values at most
            counts["rows_read"] = upto
            counts["inserted"] += reasons.pop(None, 0)
            counts["skipped"] += sum(reasons.values())
            for why in ("missing_ts", "missing_core", "bad_coords"):
                counts[f"skip_{why}"] += reasons.get(why, 0)
            row = self.spark.createDataFrame([(source, size, mtime_ns, delimiter, *[counts[c] for c in COUNTS])], PROGRESS.rsplit(",", 1)[0]).withColumn("updated_at", F.current_timestamp())
            self._replace(upsert(self.progress(), row, "source_path", "updated_at"))
        return counts

    def forget(self, source: str) -> None:
        self._replace(self.progress().filter(F.col("source_path") != source))

    def _replace(self, table: DataFrame) -> None:
        """Write the next version; readers take the last one that is whole, so a lost run leaves the one before."""
        known = self._versions()
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/progress/{(known[-1] if known else 0) + 1}")


def layout(points: DataFrame, path: str, part_bytes: int = 256 << 20) -> None:
    """A point table by day, sorted by vessel and time within its files, so that day, vessel and time prune a scan."""
    parts = max(1, -(-min(input_bytes(points), 1 << 50) // part_bytes))
    day = points.withColumn("day", F.to_date("ts"))
    day.repartitionByRange(min(parts, 100_000), "day", "mmsi", "ts").sortWithinPartitions("day", "mmsi", "ts").write.mode("overwrite").partitionBy("day").parquet(path)
