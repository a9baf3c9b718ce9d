"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "wakeline") -> SparkSession:
    """A local session with the settings the tests and the bench use (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WAKELINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one only where it is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    target = spark.conf.get("spark.checkpoint.dir", None)
    if target is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        target = tempfile.mkdtemp(prefix="wakeline-ckpt-")
        atexit.register(shutil.rmtree, target, ignore_errors=True)
    sc.setCheckpointDir(target)
    return sc._jsc.sc().getCheckpointDir().get()


_tables: list[str] = []


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wakeline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables written so far; for use when no frame that reads them is needed any more."""
    n = len(_tables)
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, part_bytes: int = 16 << 20) -> int:
    """How many partitions keep each near part_bytes of the size estimated for df; at least the session's number.

    A size the optimizer doesn't know (it then says the largest number) asks for the session's number.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return least if size >= 1 << 60 else max(least, min(100_000, -(-size // part_bytes)))


def spread(df: DataFrame, *keys: str, part_bytes: int = 16 << 20) -> DataFrame:
    """Partition df by keys into as many parts as its size asks for."""
    return df.repartition(partitions_for(df, part_bytes), *keys)


def spread_scan(df: DataFrame) -> DataFrame:
    """df as scanned, unless its scan has fewer tasks than the cluster cores; then spread evenly."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_local(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Fetch a small parameter table to the driver if it has at most max_rows rows.

    Returns (frame, True) with a local relation fit for broadcast, or (df written as a
    table, False) when the bound does not hold; the caller then joins without a hint.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return write_table(df, "params"), False
