"""Long histories of one key as blocks of rows with a halo of neighbours, so that a hot key is many tasks.

The rows of a key are counted by time chunk; keys with more than ``rows`` rows are cut between chunks into blocks of
about that many. A block also gets the chunks beside it that hold the ``halo`` rows before and after it, whatever
their age: the halo is counted in rows, so sparse keys are never cut and a cut never hides what lies just beyond.
One key's chunk counts, not its rows, meet in one task: at most 2,922 a year.

Defined results: rows whose key or time is null take no part; an empty table gives no rows; a chunk is never cut, so
a block has at most ``rows`` and one chunk's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_US = 3 * 3600 * 1_000_000


def in_blocks(points: DataFrame, *, key: str = "mmsi", rows: int = 8192, halo: int = 256, chunk_us: int = CHUNK_US) -> DataFrame:
    """points with __block and __home (the row belongs to the block); a row is repeated for each block it is beside."""
    usable = points.filter(F.col(key).isNotNull() & F.col("ts_us").isNotNull()).withColumn("__chunk", F.floor(F.col("ts_us") / chunk_us))
    of_key, on = Window.partitionBy("__k"), Window.partitionBy("__k").orderBy("__c")
    counts = usable.groupBy(F.col(key).alias("__k"), F.col("__chunk").alias("__c")).agg(F.count("*").alias("n"))
    big = counts.withColumn("__all", F.sum("n").over(of_key)).filter(F.col("__all") > rows)
    big = big.withColumn("__hi", F.sum("n").over(on)).withColumn("__lo", F.col("__hi") - F.col("n")).withColumn("__raw", F.floor(F.col("__lo") / rows))
    big = big.withColumn("__b", F.sum((F.col("__raw") != F.coalesce(F.lag("__raw").over(on), F.lit(0))).cast("int")).over(on))
    of_block = Window.partitionBy("__k", "__b")
    big = big.withColumns({"__first": F.min("__lo").over(of_block), "__last": F.max("__hi").over(of_block), "__most": F.max("__b").over(of_key)})
    after = F.when((F.col("__hi") > F.col("__last") - halo) & (F.col("__b") < F.col("__most")), F.col("__b") + 1)
    before = F.when((F.col("__lo") < F.col("__first") + halo) & (F.col("__b") > 0), F.col("__b") - 1)
    known = big.select("__k", "__c", "__b", F.array_compact(F.array("__b", after, before)).alias("__blocks"))
    joined = usable.join(known, (F.col(key) == F.col("__k")) & (F.col("__chunk") == F.col("__c")), "left")
    shown = joined.withColumn("__block", F.explode(F.coalesce("__blocks", F.array(F.lit(0).cast("bigint")))))
    return shown.withColumn("__home", F.coalesce(F.col("__block") == F.col("__b"), F.lit(True))).drop("__k", "__c", "__b", "__blocks", "__chunk")
