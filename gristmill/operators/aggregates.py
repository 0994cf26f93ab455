"""Grouped statistics with fixed tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, ties to the smallest. Counts first, so a key is one row a value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.v").alias(value), (-F.col("_b.less")).alias("n"))


def covered_class(df: DataFrame, key: str, level: str, share: float) -> DataFrame:
    """(key, level): the strongest level such that at least ``share`` of the key's rows have it or a stronger one."""
    counts = df.groupBy(key, level).agg(F.count("*").alias("n"))
    down = Window.partitionBy(key).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("held", F.sum("n").over(down)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return reached.where(F.col("held") >= F.lit(share) * F.col("total")).groupBy(key).agg(F.max(level).alias(level))


def best_rank_only(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """Rows of the smallest rank of their key."""
    ranked = df.withColumn("_rank", rank)
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy(key))).where("_rank = _best").drop("_rank", "_best")


def reached_by(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, value): the largest value that at least ``share`` of the key's rows reach; null if any value is missing."""
    down = Window.partitionBy(key).orderBy(F.desc_nulls_last(value))
    total = Window.partitionBy(key)
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count("*").over(total) - 1e-9))
    placed = df.withColumn("_at", F.row_number().over(down)).withColumn("_need", need).withColumn("_missing", F.max(F.col(value).isNull()).over(total))
    return placed.where("_at = _need").select(key, F.when(~F.col("_missing"), F.col(value)).alias(value))


def clustered_error(df: DataFrame, cluster: str, residual: Column, *group: str) -> DataFrame:
    """(group, n, clusters, se): sqrt of the sum over clusters of squared residual sums, by n."""
    inner = df.groupBy(*group, cluster).agg(F.sum(residual).alias("s"), F.count("*").alias("n"))
    return inner.groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), (F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.sum("n")).alias("se"))


def reliability(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, observed) of equal-width bins; probability 1 is in the last."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row (ece): the mean gap of bins by their rows."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))


def concordance(df: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    """(group, concordance): the share of positive-negative pairs whose positive scores higher, ties half.

    From rank sums, so a group's pairs are never made.
    """
    by_score = df.groupBy(group, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = by_score.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    sums = summed.groupBy(group).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.where("pos > 0 and neg > 0").select(group, (F.col("won") / (F.col("pos") * F.col("neg"))).alias("concordance"))


def largest_remainder(df: DataFrame, weight: str, total: int, key: str) -> DataFrame:
    """(key, seats): whole seats by weight that sum to ``total``; remainders in falling order, then keys, get one more. One row a key."""
    every = Window.partitionBy()
    exact = df.withColumn("_exact", F.col(weight) * total / F.sum(weight).over(every)).withColumn("_floor", F.floor("_exact"))
    ranked = exact.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key)))
    left = F.lit(total) - F.sum("_floor").over(every)
    return ranked.select(key, (F.col("_floor") + F.when(F.col("_rank") <= left, 1).otherwise(0)).cast("long").alias("seats"))
