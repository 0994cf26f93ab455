"""Exact likelihoods, sign tests and permutations whose work is spread over rows.

Nothing here needs a whole group in one place but its sums: a group's
polynomial is made block by block and multiplied together, and a permutation
is a join of ranks.
"""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chances closer to 0 and 1 count as these.
LEAST_CHANCE = 1e-6
BLOCK_ROWS = 256


def log_odds(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - LEAST_CHANCE)), F.lit(LEAST_CHANCE))
    return F.log(held) - F.log1p(-held)


def _sum_distribution(chances: np.ndarray) -> np.ndarray:
    """How likely each number of successes is, for independent rows."""
    out = np.ones(1)
    for p in chances:
        out = np.append(out * (1 - p), 0.0) + np.append(0.0, out * p)
    return out


def conditional_likelihood(rows: DataFrame, group: str, chance: str, outcome: str, row_id: str) -> DataFrame:
    """(group, n, closed, value): the log likelihood of which rows of a group came out true, given how many did.

    The odds are tilted so that the expected number is about the true one;
    then the number is a sum of independent rows whose distribution has its
    peak near the coefficient that is asked for, and nothing under- or
    overflows.  Blocks of ``BLOCK_ROWS`` rows give distributions, which are
    convolved in order of size.  Groups of one outcome have value 0; rows
    without a chance or an outcome are left out.
    """
    lo = rows.where(F.col(chance).isNotNull() & F.col(outcome).isNotNull()).select(F.col(group).alias("g"), log_odds(F.col(chance)).alias("lo"), F.col(outcome).cast("boolean").alias("y"), F.xxhash64(row_id).alias("h"))
    sums = lo.groupBy("g").agg(F.count("*").alias("n"), F.count_if("y").alias("k"), F.sum(F.when(F.col("y"), F.col("lo")).otherwise(0.0)).alias("chosen"), F.avg("lo").alias("mean"))
    tilted = sums.withColumn("tilt", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.log(F.col("k") / (F.col("n") - F.col("k"))) - F.col("mean")))
    mixed = lo.join(tilted.where("tilt IS NOT NULL").select("g", "n", "tilt"), "g")
    x = F.col("lo") + F.col("tilt")
    softplus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    blocked = mixed.select("g", F.pmod("h", F.ceil(F.col("n") / BLOCK_ROWS)).alias("block"), (1 / (1 + F.exp(-x))).alias("p"), softplus.alias("s"))
    kind = rows.schema[group].dataType.simpleString()

    def of_block(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "pmf": [_sum_distribution(np.sort(frame["p"].to_numpy())).tolist()], "s": [float(frame["s"].sum())]})

    def of_group(frame: pd.DataFrame) -> pd.DataFrame:
        parts = sorted((np.array(p) for p in frame["pmf"]), key=len)
        while len(parts) > 1:
            parts = sorted([*(np.convolve(a, b) for a, b in zip(parts[::2], parts[1::2])), *(parts[-1:] if len(parts) % 2 else [])], key=len)
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "pmf": [parts[0].tolist()], "s": [float(frame["s"].sum())]})

    blocks = blocked.groupBy("g", "block").applyInPandas(of_block, f"g {kind}, pmf array<double>, s double")
    whole = blocks.groupBy("g").applyInPandas(of_group, f"g {kind}, pmf array<double>, s double")
    joined = tilted.join(whole, "g", "left")
    log_e = F.col("s") + F.log(F.get("pmf", F.col("k").cast("int"))) - F.col("k") * F.col("tilt")
    return joined.select(F.col("g").alias(group), "n", F.col("k").alias("closed"), F.when(F.col("tilt").isNull(), 0.0).otherwise(F.col("chosen") - log_e).alias("value"))


def binomial_tail(successes: Column, trials: Column) -> Column:
    """The chance of so many successes or more in fair trials; terms are added up in logarithms of binomials, one after the other."""
    ln2 = F.log(F.lit(2.0))

    def term(held: Column, k: Column) -> Column:
        at = held["at"] + F.log((trials - k + 1).cast("double") / k)
        return F.struct(at.alias("at"), (held["sum"] + F.when(k >= successes, F.exp(at)).otherwise(0.0)).alias("sum"))

    first = -trials * ln2
    start = F.struct(first.alias("at"), F.when(successes <= 0, F.exp(first)).otherwise(0.0).alias("sum"))
    ks = F.when(trials > 0, F.sequence(F.lit(1).cast("long"), trials.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(ks, start, term)["sum"]


def sign_test(deltas: DataFrame, delta: str) -> DataFrame:
    """One row: units, worse, better, and the chance of so many worse ones or more if either sign were as likely; ties are left out."""
    counts = deltas.agg(F.count("*").alias("units"), F.count_if(F.col(delta) < 0).alias("worse"), F.count_if(F.col(delta) > 0).alias("better"))
    return counts.withColumn("p", binomial_tail(F.col("worse"), F.col("worse") + F.col("better")))


def shuffled(rows: DataFrame, group: str, unit: str, row_id: str, draws: int, seed: int) -> DataFrame:
    """(draw, row_id, unit): in each draw, the units of a group's rows dealt over its rows anew.

    Rows are numbered by id and again by a digest of seed, draw and id, and
    the units of one numbering go to the rows of the other, so every draw is
    a permutation, and reruns agree.
    """
    drawn = rows.select(group, unit, row_id).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), "draw", row_id))
    numbered = drawn.withColumn("_at", F.row_number().over(Window.partitionBy("draw", group).orderBy(row_id))).withColumn("_to", F.row_number().over(Window.partitionBy("draw", group).orderBy(mixed, row_id)))
    places, given = numbered.select("draw", group, row_id, F.col("_at").alias("_k")), numbered.select("draw", group, unit, F.col("_to").alias("_k"))
    return places.join(given, ["draw", group, "_k"]).select("draw", row_id, unit)


def spread(rows: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """``by`` and spread: the variance of the units' means."""
    means = rows.groupBy(*by, unit).agg(F.avg(value).alias("_m"))
    return means.groupBy(*by).agg(F.var_pop("_m").alias("spread"))


def bisected(low: Column, high: Column, above: Callable[[Column], Column], steps: int = 40) -> Column:
    """Where a rising function passes zero: ``above`` says whether a point lies beyond; ``steps`` halvings, as a fold over columns."""

    def halve(held: Column, _: Column) -> Column:
        middle = (held["low"] + held["high"]) / 2
        beyond = above(middle)
        return F.struct(F.when(beyond, held["low"]).otherwise(middle).alias("low"), F.when(beyond, middle).otherwise(held["high"]).alias("high"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.cast("double").alias("low"), high.cast("double").alias("high")), halve)
    return (out["low"] + out["high"]) / 2


def pull(logit: Column, low: Column, high: Column, share: float = 0.5, steps: int = 30) -> Column:
    """Log odds pulled step by step by ``share`` of what they lie outside of [low, high], until they lie inside to a thousandth."""

    def nearer(x: Column, _: Column) -> Column:
        outside = F.when(x < low - 0.001, low - x).when(x > high + 0.001, high - x).otherwise(0.0)
        return x + share * outside

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), logit.cast("double"), nearer)
