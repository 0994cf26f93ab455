"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and joins on vertices; nothing of a
component's size meets in one task but by a minimum, which Spark combines
before the shuffle, and joins on a vertex of many edges are left to adaptive
skew splitting.  Rounds end at tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex links the neighbours on one side of it to the smallest of itself and all its neighbours.

    Large stars take the larger neighbours of a vertex; small stars take the
    smaller ones and the vertex itself.
    """
    if large:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("v", "u")
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        linked = both.where("u > v").join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
    else:
        least = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        down = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
        linked = down.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).union(least.select(F.col("m"), F.col("v")))
    return linked.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b): the smallest vertex that is reachable.

    Ends when a round changes no edge; edges are then a star around the
    smallest vertex of every component.
    """
    held = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = _mark(held)
    while mark[0]:
        held = cut(_star(_star(held, True), False), "edges")
        was, mark = mark, _mark(held)
        if was == mark:
            break
    return held.select(F.col("b").alias("vertex"), F.col("a").alias("component")).union(held.select("a", F.col("a").alias("c")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
