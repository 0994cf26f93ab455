"""Ordered work on keys of any size: rows stand in blocks of bounded length, and only what crosses a block's edge is carried.

A window over a key with a third of the table would sort it in one task.
Here windows run over (key, block); a block gives one row, or its two edges,
to the windows over keys.  Names that begin with an underscore are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A quantile's sketch misses a rank by at most 1 / ACCURACY of the rows.
ACCURACY = 100_000


def block_of(index: Column, size: int) -> Column:
    """Where the block of a whole number starts."""
    return index - F.pmod(index, F.lit(size))


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the further columns of ``right``, whose keys are its own; null keys match."""
    names = {k: f"_{n}_" for n, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(other, on).drop(*names.values()) if keys else left.crossJoin(F.broadcast(right))


def lagged(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the value of the row before in its key's order; null for a first row.

    ``block`` must not fall as ``order`` rises.  The last value of each block
    is carried to the first row of the key's next one, however far that is.
    Ties of ``order`` are put in some order.
    """
    by = [*keys, "_block"]
    inside = Window.partitionBy(*by).orderBy(*order)
    held = df.withColumn("_block", block).withColumns({"_inside": F.lag(value).over(inside), "_place": F.row_number().over(inside)})
    ends = held.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_end")
    joined = _matched(held, carried, by)
    return joined.withColumn(name, F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_inside"))).drop("_block", "_inside", "_place", "_carried")


def runs(df: DataFrame, keys: list[str], index: str, size: int) -> DataFrame:
    """(keys, first, last): inclusive runs of consecutive whole numbers, blocks of ``size`` numbers; null ones are left out.

    Runs that touch no edge of their block are whole; of the others each block
    has two at most, and those are joined over keys.
    """
    numbers = df.where(F.col(index).isNotNull()).select(*keys, index).distinct().withColumn("_block", block_of(F.col(index), size))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(index))
    parts = numbers.withColumn("_run", F.col(index) - place).groupBy(*keys, "_block", "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"))
    edge = (F.col("first") == F.col("_block")) | (F.col("last") == F.col("_block") + size - 1)
    by_key = Window.partitionBy(*keys).orderBy("first")
    begins = F.coalesce(F.col("first") != F.lag("last").over(by_key) + 1, F.lit(True))
    edges = parts.where(edge).withColumn("_begins", begins.cast("int")).withColumn("_chain", F.sum("_begins").over(by_key))
    whole = edges.groupBy(*keys, "_chain").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return parts.where(~edge).select(*keys, "first", "last").unionByName(whole.select(*keys, "first", "last"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, n, name): the smallest value that at least ``share`` of the key's rows do not exceed, exactly; nulls do not count.

    A sketch bounds the value from both sides; rows below the bounds are
    counted, and only the few between them are put in order, equal ones as
    one.  A bound that failed stops the job.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 2 / ACCURACY
    sketch = F.percentile_approx("_v", [max(0.0, share - slack), min(1.0, share + slack)], ACCURACY)
    low = F.when(F.lit(share <= slack), F.min("_v")).otherwise(F.get(sketch, F.lit(0)))
    high = F.when(F.lit(share >= 1 - slack), F.max("_v")).otherwise(F.get(sketch, F.lit(1)))
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("_n"), low.alias("_low"), high.alias("_high"))
    asked = _matched(rows, bounds, keys)
    between = F.when(F.col("_v") < F.col("_low"), F.lit(None)).otherwise(F.col("_v"))
    counted = asked.where(F.col("_v") <= F.col("_high")).groupBy(*keys, "_n", between.alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.lit(share) * F.col("_n"), 9)))
    found = counted.withColumn("_upto", upto).where(F.col("_upto") >= rank)
    best = found.groupBy(*keys, "_n").agg(F.min_by("_v", "_upto").alias(name))
    checked = F.coalesce(F.col(name), F.raise_error(F.lit("the sketch missed a quantile")).cast(df.schema[value].dataType))
    return best.select(*keys, F.col("_n").alias("n"), checked.alias(name))


def least(df: DataFrame, keys: list[str], order: list[str], limit: str, group: Column, name: str = "place") -> DataFrame:
    """The rows of each key that come first by ``order``, as many as the row's ``limit`` says, with their place.

    Two steps: the first rows of each ``group`` of a key, then the first of
    those, so no task sorts a whole key.
    """
    grouped = df.withColumn("_group", group)
    first = grouped.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(*order))).where(F.col(name) <= F.col(limit))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= F.col(limit)).drop("_group")
