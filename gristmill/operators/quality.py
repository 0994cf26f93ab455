"""Row validation: ordered reject reasons, key audits and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds; null where none does. A null check does not hold."""
    return F.coalesce(*[F.when(check, F.lit(reason)) for check, reason in checks])


def all_reasons(checks: list[tuple[Column, str]]) -> Column:
    """Every reason that holds, in order."""
    return F.array_compact(F.array(*[F.when(check, F.lit(reason)) for check, reason in checks]))


def out_of_bounds(value: Column, low: float, high: float) -> Column:
    return value.isNull() | ~value.between(low, high)


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that repeat or hold a null, with their row count; empty for a sound key."""
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | any_null)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, after an action that raises where a key repeats or is null."""
    bad = key_violations(df, *keys).limit(3).collect()
    if bad:
        raise ValueError(f"keys {keys} are not unique: {bad}")
    return df


def reconcile(df: DataFrame, reason: str, *group: str) -> DataFrame:
    """kept, dropped and total rows for each group, with a total row of null groups."""
    kept = F.col(reason).isNull()
    return df.rollup(*group).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count("*").alias("total"))
