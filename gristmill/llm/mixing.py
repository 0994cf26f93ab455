"""Mixing sources to target weights by subset sums over length counts.

Documents are counted by exact length in words.  A source whose target is
``t`` times its size takes every document ``floor(t)`` times, and the rest of
its budget is fitted as a bounded knapsack over its length counts: in
proportion first, then by dynamic programming over what is left.  Which
documents of a length are taken follows a seeded hash.

Only counts are fitted: a source's distinct lengths number at most the root of
twice its words, which bounds the group that one task fits.  Documents of one
source and length may be a third of the table, so they are dealt over
``BUCKETS`` by their hash; whole buckets are taken in order and only inside
one bucket are documents ranked.  The query drops the texts once they are
counted; ``mixed_documents`` carries them through one shuffle.

Edge cases: a null or wordless text has size 0 and is never in the mix; a null
source is a source of its own, the last; rows that repeat are documents of
their own, and their takings sum as if they had differed; an empty table gives
an empty result; other columns are kept by ``mix`` and ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD_SQL, cut, documents

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 29
BUCKETS = 256
RESERVE = 1 << 16
MOST_UNITS = 1 << 18


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the words of each row as ``size``."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_SQL)), F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source"), F.col("text"))
    taken = mix(sizes(named).drop("text")).where("copies > 0 AND size > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, source_col: str = "source") -> DataFrame:
    """``target`` for each row of (source, source_size): shares by weight, none above ``most`` times its size.

    Filling by weight until no source is above its cap has a closed form.  In
    order of cap by weight, a source is capped if the level that the remaining
    budget and weights give lies above its own; the first that is not fixes
    the level of all the others.  There is one row for each source.
    """
    named = Window.orderBy(F.col(source_col).asc_nulls_last())
    place = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    every = Window.partitionBy()
    by_level = Window.orderBy("level", F.col(source_col).asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0.0))

    return (
        by_source.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("common", (F.sum("source_size").over(every) - so_far("cap")) / (F.sum("weight").over(every) - so_far("weight")))
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("common", F.min(F.when(F.col("common") <= F.col("level"), F.struct("place", "common"))).over(every)["common"])
        .withColumn("target", F.least("cap", F.col("weight") * F.col("common")))
        .drop("weight", "cap", "level", "common", "place")
    )


def fit(lengths: list[int], counts: list[int], budget: int, reserve: int = RESERVE) -> list[int]:
    """How many of each length to take (at most its count) so that their sum is near ``budget`` and not above it.

    In proportion, rounded down; one more of each length by largest remainder,
    and then whatever fits from the longest down, while over ``reserve`` words
    would remain; the remainder by bounded-knapsack dynamic programming.  If
    that misses the budget and there are lengths above ``reserve``, these are
    also fitted first, by a coarser programme, and the nearer fit is taken.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    near = _in_proportion(lengths, counts, budget, total, reserve)
    rest = budget - sum(n * k for n, k in zip(lengths, near))
    if rest and max(lengths) > reserve:
        other = _long_first(lengths, counts, budget, reserve)
        if budget - sum(n * k for n, k in zip(lengths, other)) < rest:
            return other
    return near


def _long_first(lengths: list[int], counts: list[int], budget: int, reserve: int) -> list[int]:
    """Lengths above ``reserve`` by dynamic programming in units that ``MOST_UNITS`` of cover the budget, rounded up; then the others."""
    unit = -(-budget // MOST_UNITS)
    long = [i for i, n in enumerate(lengths) if n > reserve]
    chosen = knapsack([-(-lengths[i] // unit) for i in long], [counts[i] for i in long], budget // unit)
    taken = [0] * len(lengths)
    for k, copies in chosen.items():
        taken[long[k]] = copies
    rest = budget - sum(n * k for n, k in zip(lengths, taken))
    short = [0 if n > reserve else c for n, c in zip(lengths, counts)]
    whole = sum(n * c for n, c in zip(lengths, short))
    more = short if rest >= whole else _in_proportion(lengths, short, rest, whole, reserve)
    return [a + b for a, b in zip(taken, more)]


def _in_proportion(lengths: list[int], counts: list[int], budget: int, total: int, reserve: int) -> list[int]:
    taken = [c * budget // total for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, taken))
    by_remainder = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % total), lengths[i]))
    for i in by_remainder:
        if counts[i] * budget % total and lengths[i] <= rest - reserve:
            taken[i] += 1
            rest -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] and lengths[i] <= rest - reserve:
            more = min(counts[i] - taken[i], (rest - reserve) // lengths[i])
            taken[i] += more
            rest -= more * lengths[i]
    for i, more in knapsack(lengths, [c - k for c, k in zip(counts, taken)], rest).items():
        taken[i] += more
    return taken


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """The bounded subset sum nearest to ``budget`` from below.

    Counts are split into powers of two, each used once; ``first`` holds the
    item with which a sum was first reached, so the way back uses every item
    at most once.
    """
    items = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i] * 2654435761 % (1 << 32)):  # short ones are not preferred
        n, c, part = lengths[i], counts[i], 1
        while n and c > 0 and n * min(part, c) <= budget:
            items.append((i, min(part, c)))
            c -= min(part, c)
            part *= 2
    first = np.full(budget + 1, -1, np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for k, (i, copies) in enumerate(items):
        size = lengths[i] * copies
        new = np.zeros_like(reached)
        new[size:] = reached[: budget + 1 - size]
        new &= ~reached
        first[new] = k
        reached |= new
        if reached[budget]:
            break
    out: dict[int, int] = {}
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, copies = items[first[at]]
        out[i] = out.get(i, 0) + copies
        at -= lengths[i] * copies
    return out


def _fit_source(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    target, whole = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    copies = min(int(target // whole), most) if whole else 0
    budget = 0 if copies >= most else int(target - copies * whole)
    chosen = fit([int(n) for n in rows["size"]], [int(c) for c in rows["documents"]], budget)
    return rows[["source", "size", "source_size", "target"]].assign(copies=copies, chosen=chosen)


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``sized`` with source_size, target and copies: how often the mix takes the row.

    ``sized`` (of ``sizes``) is read twice and should be cheap to read.
    """
    drawn = sized.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(id_col))).withColumn("_bucket", F.pmod(F.col("_draw"), F.lit(buckets)).cast("int"))
    cells = drawn.groupBy(F.col(source_col).alias("source"), "size", "_bucket").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("documents"))
    by_source = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size")), weights, most)
    fitted = (
        lengths.alias("l")
        .join(by_source.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
        .select("l.source", "l.size", "l.documents", "s.source_size", "s.target")
        .groupBy("source")
        .applyInPandas(lambda rows: _fit_source(rows, most), "source string, size long, source_size long, target double, copies long, chosen long")
    )
    order = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        .alias("c")
        .join(fitted.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")) & (F.col("c.size") == F.col("f.size")))
        .select("c.source", "c.size", "c._bucket", "f.source_size", "f.target", F.col("f.copies").alias("_copies"), F.greatest(F.lit(0), F.col("f.chosen") - F.col("c.before")).alias("_quota"))
    )
    rank = F.row_number().over(Window.partitionBy(source_col, "size", "_bucket").orderBy("_draw", id_col))
    ranked = drawn.withColumn("_rank", rank)
    same = ranked[source_col].eqNullSafe(quota["source"]) & (ranked["size"] == quota["size"]) & (ranked["_bucket"] == quota["_bucket"])
    copies = quota["_copies"] + (ranked["_rank"] <= quota["_quota"]).cast("long")
    return ranked.join(quota, same).select(*[ranked[c] for c in sized.columns], quota["source_size"], quota["target"], copies.alias("copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sizes(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text"), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
