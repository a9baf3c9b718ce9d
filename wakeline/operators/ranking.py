"""Ranks, ranking metrics and distribution distances over whole frames without a single-task window.

``running`` gives sums over all rows before a row in a global order in two stages: rows are range-partitioned and
written, sums per partition are added up in a table of one row per partition, and running sums within a partition are
added to those. Metrics first group by score value, so ties share one row.

Defined results: rows whose score or target is null or NaN are left out; undefined metrics (no positives, no
variance, no rows) are null for AUC and average precision and 0 for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.session import partitions_for, write_table


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with before_<c> for each c of sums: the sum of c over all rows that come earlier in the order."""
    kept = write_table(df.repartitionByRange(partitions_for(df), *order).withColumn("__pid", F.spark_partition_id()), "ranked")
    upto = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("__pid").agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("__pid").alias("__q"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__p_{c}") for c in sums])
    inner = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = kept.join(F.broadcast(totals), F.col("__pid") == F.col("__q"))  # one row per partition
    out = joined.withColumns({f"before_{c}": F.col(f"__p_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums})
    return out.drop("__pid", "__q", *[f"__p_{c}" for c in sums])


def _usable(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, n, rank): each different value with its rows and the mean of their places, from 1."""
    counts = _usable(df, col).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, [F.col("value").asc()], ["n"]).select("value", "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def pearson(df: DataFrame, x: str, y: str) -> Column:
    """Aggregate: correlation, 0 where it is undefined."""
    return F.coalesce(F.nanvl(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = _usable(df, x, y).groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__w"))
    rank = lambda c, src, out: average_ranks(_usable(df, x, y), src).select(F.col("value").alias(c), F.col("rank").alias(out))
    j = d.join(rank("__x", x, "rx"), "__x").join(rank("__y", y, "ry"), "__y")
    w = F.col("__w")
    n, sx, sy = F.sum(w), F.sum(w * F.col("rx")), F.sum(w * F.col("ry"))
    cov = F.sum(w * F.col("rx") * F.col("ry")) - sx * sy / n
    vx, vy = F.sum(w * F.col("rx") ** 2) - sx * sx / n, F.sum(w * F.col("ry") ** 2) - sy * sy / n
    return j.agg(F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(0.0).alias("spearman"))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the curve by rank sums, ties at their mean rank."""
    g = _usable(df, score).groupBy(F.col(score).alias("s")).agg(F.sum(positive.cast("bigint")).alias("pos"), F.count("*").alias("n"))
    r = running(g, [F.col("s").asc()], ["n"])
    p, n = F.sum("pos"), F.sum("n")
    rank_sum = F.sum(F.col("pos") * (F.col("before_n") + (F.col("n") + 1) / 2))
    return r.agg(F.when((p > 0) & (n > p), (rank_sum - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: Column, tie: str) -> DataFrame:
    """Mean over positives of the precision at their place, best score first, ties by tie."""
    d = _usable(df, score).select(score, tie, positive.cast("bigint").alias("pos"), F.lit(1).alias("one"))
    r = running(d, [F.col(score).desc(), F.col(tie).asc()], ["pos", "one"])
    return r.agg(F.when(F.sum("pos") > 0, F.sum(F.when(F.col("pos") == 1, (F.col("before_pos") + 1) / (F.col("before_one") + 1))) / F.sum("pos")).alias("average_precision"))


def _top(df: DataFrame, score: str, tie: str, ratio: float, n: int) -> DataFrame:
    """The best ceil(ratio * n) rows, one at least, with their place from 1."""
    keep = min(n, max(1, -(-round(ratio * n * 1_000_000) // 1_000_000)))
    r = running(df.withColumn("one", F.lit(1)), [F.col(score).desc(), F.col(tie).asc()], ["one"])
    return r.withColumn("place", F.col("before_one") + 1).filter(F.col("place") <= keep)


def ndcg_and_lift(df: DataFrame, score: str, target: str, tie: str, ratio: float) -> DataFrame:
    """NDCG and lift of the best share of rows by score; targets below 0 count as 0."""
    d = _usable(df, score, target).select(score, tie, F.greatest(F.col(target).cast("double"), F.lit(0.0)).alias("__y"))
    n, base = d.agg(F.count("*"), F.coalesce(F.avg("__y"), F.lit(0.0))).first()
    gain = F.sum(F.col("__y") / F.log2(F.col("place") + 1))
    got = _top(d, score, tie, ratio, n).agg(gain.alias("dcg"), F.avg("__y").alias("top"))
    ideal = _top(d, "__y", tie, ratio, n).agg(gain.alias("idcg"))
    both = got.join(ideal, F.lit(True))  # one row each
    ndcg = F.when(F.col("idcg") > 1e-12, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return both.select(ndcg.alias("ndcg"), (F.col("top") / base if base > 1e-12 else F.lit(0.0)).alias("lift"))


def calibration(df: DataFrame, score: str, target: str, tie: str, buckets: int = 10) -> DataFrame:
    """Buckets of ceil(n / buckets) rows from the lowest score up: n, mean score, mean target, share of positive targets, and whether the mean target falls."""
    d = _usable(df, score, target).select(score, tie, F.greatest(F.col(target).cast("double"), F.lit(0.0)).alias("__y"), F.lit(1).alias("one"))
    size = max(1, -(-d.count() // buckets))
    r = running(d, [F.col(score).asc(), F.col(tie).asc()], ["one"]).withColumn("bucket", F.floor(F.col("before_one") / size))
    g = r.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg("__y").alias("mean_target"), F.avg((F.col("__y") > 0).cast("double")).alias("positive_rate"))
    falls = F.coalesce(F.col("mean_target") + 1e-12 < F.lag("mean_target").over(Window.orderBy("bucket")), F.lit(False))
    return g.withColumn("falls", falls.cast("int"))  # at most so many rows


def ks_distance(df: DataFrame, value: str, left: Column) -> DataFrame:
    """Largest difference of the two empirical distributions of value: rows where left holds, and the others."""
    g = _usable(df, value).groupBy(F.col(value).alias("v")).agg(F.sum(left.cast("bigint")).alias("a"), F.sum((~left).cast("bigint")).alias("b"))
    r = running(g, [F.col("v").asc()], ["a", "b"])
    n = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("na") - (F.col("before_b") + F.col("b")) / F.col("nb"))
    return r.join(F.broadcast(n), F.lit(True)).agg(F.max(gap).alias("ks"))  # n is one row


def quantile_linf(df: DataFrame, value: str, left: Column) -> DataFrame:
    """Largest difference of the 10, 50 and 90 % quantiles of both sides over the greater of them and 1."""
    q = lambda c: F.percentile(F.when(c, F.col(value)), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    pair = F.arrays_zip(F.col("a"), F.col("b"))
    part = F.transform(pair, lambda x: F.abs(x["a"] - x["b"]) / F.greatest(F.abs(x["a"]), F.abs(x["b"]), F.lit(1.0)))
    return df.agg(q(left).alias("a"), q(~left).alias("b")).select(F.array_max(part).alias("linf"))


def count_distance(df: DataFrame, key: str, left: Column) -> DataFrame:
    """Sum over keys of the differences of both sides' shares."""
    g = df.groupBy(key).agg(F.sum(left.cast("bigint")).alias("a"), F.sum((~left).cast("bigint")).alias("b"))
    n = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    part = lambda x, t: F.when(F.col(t) > 0, F.col(x) / F.col(t)).otherwise(0.0)
    return g.join(F.broadcast(n), F.lit(True)).agg(F.sum(F.abs(part("a", "na") - part("b", "nb"))).alias("l1"))


def entropy(df: DataFrame, key: str) -> DataFrame:
    """Entropy of a key's counts in nats, and over that of as many equal counts (0 for one key)."""
    g = df.groupBy(key).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    raw = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return g.agg(raw.alias("entropy"), F.when(F.count("*") > 1, raw / F.log(F.count("*"))).otherwise(0.0).alias("normalized"))


def top_mass(df: DataFrame, value: str, tie: str, ratio: float) -> DataFrame:
    """Share of the sum of value that its largest ceil(ratio * n) rows hold."""
    d = _usable(df, value).select(value, tie)
    n, total = d.agg(F.count("*"), F.sum(value)).first()
    return _top(d, value, tie, ratio, n).agg((F.coalesce(F.sum(value), F.lit(0)) / F.lit(float(total)) if total else F.lit(0.0)).alias("top_mass"))
