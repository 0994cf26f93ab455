"""Counts at nested levels, left-out counts and shrinkage toward broader levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_counts(leaves: DataFrame, levels: list[str], y: str, n: str) -> DataFrame:
    """``leaves`` (one row each, small counts) with y_<level> and n_<level> of each level of the path, and y_all, n_all.

    Broader levels are summed from narrower ones, so the rows are read once.
    """
    totals, table = {}, leaves
    for depth in range(len(levels), 0, -1):
        path, name = levels[:depth], levels[depth - 1]
        table = table.groupBy(*path).agg(F.sum(y).alias(y), F.sum(n).alias(n))
        totals[name] = table
    out = leaves
    for depth, name in enumerate(levels, 1):
        out = out.join(totals[name].withColumnsRenamed({y: f"y_{name}", n: f"n_{name}"}), levels[:depth])
    whole = totals[levels[0]].agg(F.sum(y).alias("y_all"), F.sum(n).alias("n_all"))
    return out.crossJoin(F.broadcast(whole))  # one row


def shrunk(y: Column, n: Column, above: Column, strength: float) -> Column:
    """(y + m above) / (n + m)."""
    return (y + F.lit(float(strength)) * above) / (n + F.lit(float(strength)))


def shrinkage_chain(counts: DataFrame, levels: list[str], strengths: dict[str, float]) -> DataFrame:
    """``counts`` of ``level_counts`` with rate_all and rate_<level>, each shrunk toward the level above."""
    out = counts.withColumn("rate_all", F.col("y_all") / F.col("n_all"))
    above = "rate_all"
    for name in levels:
        out = out.withColumn(f"rate_{name}", shrunk(F.col(f"y_{name}"), F.col(f"n_{name}"), F.col(above), strengths[name]))
        above = f"rate_{name}"
    return out


def published(p: Column) -> Column:
    """Two digits, halves to even, from 0.01 to 0.99."""
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.bround(p, 2)))


def left_out(counts: DataFrame, group: str, season: str, y: str, n: str) -> DataFrame:
    """``counts`` (one row a group and season) with the sums of the group's other seasons."""
    sums = counts.groupBy(group).agg(F.sum(y).alias("_y"), F.sum(n).alias("_n"))
    return counts.join(sums, group).withColumn(f"{y}_others", F.col("_y") - F.col(y)).withColumn(f"{n}_others", F.col("_n") - F.col(n)).drop("_y", "_n")
