"""Ordered rows: runs, islands, gaps, and the latest of conflicting intervals."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_unchanged(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first of a key stays unless its value is null."""
    window = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(window)
    return df.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def islands(df: DataFrame, key: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """``df`` with the number of its island: one more at each row where ``starts`` holds."""
    window = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(window))


def weekday_number(day: Column) -> Column:
    """Weekdays since the Monday before the epoch; a weekend counts as the Friday before it."""
    days = F.unix_date(day) + 3
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))


def index_runs(df: DataFrame, key: str, index: str) -> DataFrame:
    """Inclusive runs of consecutive integers for each key."""
    window = Window.partitionBy(key).orderBy(index)
    numbered = df.select(key, index).distinct().withColumn("_run", F.col(index) - F.row_number().over(window))
    return numbered.groupBy(key, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_run")


def index_gaps(df: DataFrame, key: str, index: str) -> DataFrame:
    """``df`` with ``gap``: the index less that of the row before (less -1 for the first)."""
    window = Window.partitionBy(key).orderBy(index)
    return df.withColumn("gap", F.col(index) - F.coalesce(F.lag(index).over(window), F.lit(-1)))


def from_gaps(encoded: DataFrame, key: str, position: str = "pos", gap: str = "gap") -> DataFrame:
    """The inverse of ``index_gaps``: a running sum."""
    window = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return encoded.withColumn("index", F.sum(gap).over(window) - 1)


def simultaneous_latest(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Rows that may be the newest of their key: the latest end, or an end after the earliest start among those."""
    window = Window.partitionBy(key)
    latest = F.max(hi).over(window)
    marked = df.withColumn("_latest", latest).withColumn("_since", F.min(F.when(F.col(hi) == F.col("_latest"), F.col(lo))).over(window))
    return marked.where((F.col(hi) == F.col("_latest")) | (F.col(hi) > F.col("_since"))).drop("_latest", "_since")


def supersede(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Fold a key's rows in order: a repeated value keeps its first row's place, another one replaces it; ``changes`` counts these."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    changed = F.count_if(F.col("_before") != F.col(value)).cast("int")
    return df.withColumn("_before", before).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), changed.alias("changes"))


def running_medians(df: DataFrame, key: str, order: str, value: str, prior: str, copies: int, row_id: str, name: str) -> DataFrame:
    """``row_id`` and ``name``: the median of a key's values at earlier ``order`` and of ``copies`` copies of ``prior``.

    Rows stream in order within partitions; a task holds the sorted values of
    one key.
    """

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting, moment = None, [], [], None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in (key, order, value, prior))
            for k, when, v, p in zip(*columns):
                if k != at:
                    at, held, waiting = k, [], []
                elif when != moment:
                    for x in waiting:
                        insort(held, x)
                    waiting = []
                moment = when
                if v is not None:
                    waiting.append(v)
                low, size = bisect_left(held, p), len(held) + copies

                def ranked(r: int) -> float:
                    return held[r] if r < low else p if r < low + copies else held[r - copies]

                out.append((ranked((size - 1) // 2) + ranked(size // 2)) / 2)
            yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.array(out, pa.float64())], names=[row_id, name])

    slim = df.select(row_id, key, order, value, prior).repartition(key).sortWithinPartitions(key, order)
    return slim.mapInArrow(medians, f"{row_id} {df.schema[row_id].dataType.simpleString()}, {name} double")
