"""Connected components and greedy cover as joins and aggregates."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import shared_folder


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of an edge table (a, b): the smallest node that is reachable.

    Labels jump: each round a node takes the least label among its own, its
    neighbours' and its label's label, so rounds follow the logarithm of the
    longest path.  Each round is a checkpoint, so a lost executor repeats one.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("least"))
        of_label = least.select(F.col("node").alias("_n"), F.col("least").alias("_l"))
        jumped = least.join(of_label, least["least"] == of_label["_n"]).select("node", "component", F.least("least", "_l").alias("next")).checkpoint()
        labels = jumped.select("node", F.col("next").alias("component"))
        if jumped.where("next <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def greedy_cover(pairs: DataFrame, weights: DataFrame, steps: int) -> list[tuple]:
    """(family, gain, elements) of each step: the family of ``pairs`` (family, element) that adds most weight (element, weight).

    Ties go to more elements and then to the smallest family.  The weighed
    pairs are written once; each step is one aggregate over those that are
    left, and what is covered meets them by shuffle, so the driver gets the
    chosen names only.
    """
    spark = pairs.sparkSession
    path = f"{shared_folder(spark)}/gristmill-cover-{uuid4().hex}"
    pairs.distinct().join(weights, "element").write.parquet(path)
    weighed = spark.read.parquet(path)
    chosen: list[tuple] = []
    for _ in range(steps):
        covered = weighed.where(F.col("family").isin([c[0] for c in chosen])).select("element").distinct().hint("merge")
        left = weighed.join(covered, "element", "left_anti") if chosen else weighed
        gains = left.groupBy("family").agg(F.sum("weight").alias("gain"), F.count("*").alias("elements"))
        best = gains.orderBy(F.desc(F.round("gain", 6)), F.desc("elements"), "family").first()
        if best is None or best.gain <= 0:
            break
        chosen.append((best.family, round(best.gain, 6), best.elements))
    return chosen
