"""Fits whose sums over rows are Spark aggregates; the driver holds a few coefficients."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import stored


def bounded_logistic(df: DataFrame, terms: list[str], y: str, penalty: float, low: list[float], high: list[float], rounds: int = 25) -> np.ndarray:
    """Coefficients of a penalised logistic regression within bounds, by projected Newton steps.

    Rows that agree in all terms are one row with two counts before the first
    step, so a round reads distinct settings and not rows.
    """
    cells = df.groupBy(*terms).agg(F.sum(F.col(y).cast("double")).alias("_y"), F.count("*").alias("_n")).persist()
    try:
        beta, bounds = np.clip(np.zeros(len(terms)), low, high), (np.array(low), np.array(high))
        for _ in range(rounds):
            score = sum((F.col(t) * float(b) for t, b in zip(terms, beta)), F.lit(0.0))
            p = 1 / (1 + F.exp(-score))
            sums = [F.sum(F.col(t) * (F.col("_y") - F.col("_n") * p)) for t in terms]
            curves = [F.sum(F.col(s) * F.col(t) * F.col("_n") * p * (1 - p)) for k, s in enumerate(terms) for t in terms[: k + 1]]
            row = cells.agg(*sums, *curves).first()
            if row[0] is None:
                return beta
            gradient = np.array(row[: len(terms)], float) - penalty * beta
            curve = np.zeros((len(terms), len(terms)))
            curve[np.tril_indices(len(terms))] = row[len(terms) :]
            curve = curve + np.tril(curve, -1).T + penalty * np.eye(len(terms))
            held = ((beta <= bounds[0]) & (gradient < 0)) | ((beta >= bounds[1]) & (gradient > 0))
            move = np.zeros(len(terms))
            free = ~held
            move[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free]) if free.any() else []
            new = np.clip(beta + move, *bounds)
            if np.abs(new - beta).max(initial=0) < 1e-10:
                return new
            beta = new
        return beta
    finally:
        cells.unpersist()


def bootstrap_upper(df: DataFrame, cluster: str, value: str, draws: int, share: float, seed: int) -> DataFrame:
    """One row, upper: the ``share`` quantile over ``draws`` of the mean when whole clusters are drawn again.

    Clusters are summed first.  A cluster's times in a draw follow a Poisson
    of mean 1, read off a digest of seed, draw and cluster, so draws need no
    common state and reruns agree.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", cluster)), 1, 8), 16, 10).cast("long") / float(1 << 32)
    chances = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)])
    times = sum(((u >= float(c)).cast("int") for c in chances), F.lit(0))
    means = drawn.withColumn("_t", times).groupBy("draw").agg((F.sum(F.col("_t") * F.col("_s")) / F.sum(F.col("_t") * F.col("_n"))).alias("mean"))
    return means.withColumn("mean", F.round("mean", 6)).agg(F.expr(f"percentile_disc({share}) within group (order by mean)").alias("upper"))


def _nodes(most: float = 6.0, number: int = 121) -> np.ndarray:
    return np.linspace(-most, most, number)


@dataclass(frozen=True)
class OwnParts:
    """A fitted spread, and (unit, n, mean, sd) of what is each unit's own."""

    spread: float
    units: DataFrame


def own_parts(rows: DataFrame, unit: str, offset: str, outcome: str, least: float = 0.01, most: float = 2.0, rounds: int = 4, tried: int = 17) -> OwnParts:
    """Units' own parts of log odds: normal around 0 with one spread, which has the highest likelihood of (unit, offset, outcome).

    A unit's likelihood at each of a fixed row of own parts is a sum over its
    rows, added up in tasks before it is shuffled, and stored.  Its integral under a spread is then a
    weighted sum of that row, so the fit reads one short row a unit: each
    round tries ``tried`` spreads at once and narrows to the best one's
    neighbours.  The driver holds the sums of one round.
    """
    u = _nodes()
    spark = rows.sparkSession
    sign = F.when(F.col(outcome).cast("boolean"), 1.0).otherwise(-1.0)
    seen = rows.where(F.col(unit).isNotNull() & F.col(offset).isNotNull() & F.col(outcome).isNotNull())
    unit_kind = rows.schema[unit].dataType.simpleString()

    def likelihoods(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes, names = pd.factorize(frame["unit"])
            at = -np.logaddexp(0.0, -frame["sign"].to_numpy()[:, None] * (frame["offset"].to_numpy()[:, None] + u))
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(names))
            sums = np.add.reduceat(at[order], np.cumsum(counts) - counts, axis=0) if len(frame) else at
            yield pd.DataFrame({"unit": names, "n": counts, "at": list(sums)})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A unit's parts, which lie side by side, as one row."""
        held: tuple | None = None
        for frame in frames:
            out = []
            for name, n, at in zip(frame["unit"], frame["n"], frame["at"]):
                if held is not None and held[0] == name:
                    held = (name, held[1] + n, held[2] + at)
                else:
                    out += [held] if held is not None else []
                    held = (name, n, np.array(at))
            yield pd.DataFrame(out, columns=["unit", "n", "at"])
        if held is not None:
            yield pd.DataFrame([held], columns=["unit", "n", "at"])

    schema = f"unit {unit_kind}, n long, at array<double>"
    parts = seen.select(F.col(unit).alias("unit"), F.col(offset).alias("offset"), sign.alias("sign")).mapInPandas(likelihoods, schema)
    sums = parts.repartition("unit").sortWithinPartitions("unit").mapInPandas(added, schema)
    table = spark.read.schema(schema).parquet(stored(spark, f"own parts {uuid.uuid4().hex}", lambda folder: sums.write.parquet(folder)))

    def values(spreads: np.ndarray) -> list[float]:
        density = -(u**2) / (2 * spreads[:, None] ** 2)

        def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(spreads))
            for frame in frames:
                for at in frame["at"]:
                    both = density + at
                    top = both.max(axis=1)
                    total += top + np.log(np.exp(both - top[:, None]).sum(axis=1)) - np.log(np.exp(density).sum(axis=1))
            yield pd.DataFrame({"k": range(len(spreads)), "value": total})

        found = {r.k: r.value for r in table.mapInPandas(summed, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()}
        return [found.get(k, 0.0) for k in range(len(spreads))]

    low, high = np.log(least), np.log(most)
    for _ in range(rounds):
        grid = np.linspace(low, high, tried)
        value = values(np.exp(grid))
        best = max(range(tried), key=lambda k: (value[k], -k))
        low, high = grid[max(0, best - 1)], grid[min(tried - 1, best + 1)]
    spread = float(np.exp(grid[best]))

    @F.pandas_udf("mean double, sd double")
    def moments(rows_at: pd.Series) -> pd.DataFrame:
        out = []
        for at in rows_at:
            both = np.array(at) - u**2 / (2 * spread**2)
            w = np.exp(both - both.max())
            mean = float((w * u).sum() / w.sum())
            out.append((mean, float(np.sqrt((w * (u - mean) ** 2).sum() / w.sum()))))
        return pd.DataFrame(out, columns=["mean", "sd"])

    return OwnParts(spread, table.select(F.col("unit").alias(unit), "n", moments("at").alias("m")).select(unit, "n", "m.*"))
