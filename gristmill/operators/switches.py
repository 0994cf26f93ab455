"""A switch with streaks as a finite automaton whose steps compose, and states of a sweep over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOOD, EVEN, BAD, AWFUL = range(4)


def steps(on_after: int, off_after: int) -> list[list[int]]:
    """For each symbol, the state that follows each state: off with 0.. good ones in a row, then on with 0.. bad ones in a row.

    Off, a good symbol counts and the last one needed switches on; any other
    starts the count anew.  On, an awful one switches off at once, a bad one
    counts and the last one needed switches off; others start the count anew.
    """
    off, on = range(on_after), range(on_after, on_after + off_after)
    good = [s + 1 for s in off] + [on_after for _ in on]
    even = [0 for _ in off] + [on_after for _ in on]
    bad = [0 for _ in off] + [s + 1 if s + 1 < on_after + off_after else 0 for s in on]
    return [good, even, bad, [0 for _ in [*off, *on]]]


def replayed(rows: DataFrame, key: str, order: list[str], symbol: str, block: Column, on_after: int, off_after: int) -> DataFrame:
    """``rows`` with state: that of the switch of each key after the row, from off and no streak.

    A block's rows are composed into one map from states to states; the
    states at which blocks begin follow from the maps before them, and then
    each block is replayed by itself.  Composing is associative, so a key's
    history may be cut anywhere, and no task holds more than a block's rows
    and a key's maps.
    """
    table = F.array(*[F.array(*[F.lit(s) for s in row]) for row in steps(on_after, off_after)])
    start = F.array(*[F.lit(s) for s in range(on_after + off_after)])
    placed = rows.withColumn("_block", block)
    listed = placed.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct(*order, symbol))).alias("_rows"))
    mapped = listed.withColumn("_map", F.aggregate("_rows", start, lambda held, r: F.transform(held, lambda s: F.get(F.get(table, r[symbol]), s))))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = mapped.withColumn("_begin", F.aggregate(F.collect_list("_map").over(before), F.lit(0), lambda s, m: F.get(m, s)))

    def run(held: Column, r: Column) -> Column:
        state = F.get(F.get(table, r[symbol]), held["state"])
        return F.struct(state.alias("state"), F.concat(held["out"], F.array(state)).alias("out"))

    states = F.aggregate("_rows", F.struct(F.col("_begin").alias("state"), F.array().cast("array<int>").alias("out")), run)["out"]
    told = begun.select(key, F.explode(F.arrays_zip("_rows", states.alias("_states"))).alias("r"))
    return told.select(key, *[F.col(f"r._rows.{c}").alias(c) for c in [*order, symbol]], F.col("r._states").alias("state"))


def swept(spans: DataFrame, moments: DataFrame, key: str, levels: int) -> DataFrame:
    """(key, moment, level): the largest level of the spans (key, start, end, level) that hold at each moment; 0 where none does.

    Starts and ends are one ordered stream of each key with the moments, and
    the number of open spans of each level is a running sum, so no span meets
    a moment.  A null end is open; empty spans never hold.
    """
    real = spans.where("end IS NULL OR start < end")
    opens = real.select(key, F.col("start").alias("at"), "level", F.lit(1).alias("d"))
    closes = real.where("end IS NOT NULL").select(key, F.col("end").alias("at"), "level", F.lit(-1).alias("d"))
    asked = spans.select(key).distinct().join(F.broadcast(moments.select("moment").distinct())).select(key, F.col("moment").alias("at"), F.lit(0).alias("level"), F.lit(0).alias("d"))
    changes = opens.union(closes).union(asked).groupBy(key, "at").agg(*[F.sum(F.when(F.col("level") == n, F.col("d")).otherwise(0)).alias(f"_{n}") for n in range(1, levels + 1)], F.max(F.col("d") == 0).alias("_asked"))
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.lit(0)
    for n in range(1, levels + 1):
        held = F.when(F.col(f"_o{n}") > 0, n).otherwise(held)
    running = changes.select(key, "at", "_asked", *[F.sum(f"_{n}").over(order).alias(f"_o{n}") for n in range(1, levels + 1)])
    return running.where("_asked").select(key, F.col("at").alias("moment"), held.alias("level"))
