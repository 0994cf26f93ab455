"""Whether the places that a row states agree with the records it was matched with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGREES, CONFLICT, UNKNOWN = "agrees", "conflict", "unknown"


def place_verdicts(matches: DataFrame, stated: DataFrame, records: DataFrame, towns: DataFrame, reach: float, row_id: str) -> DataFrame:
    """(row_id, verdict) of every row of ``matches``: agrees if any stated place does, else conflict if any does, else unknown.

    ``matches`` is (row_id, record), ``stated`` (row_id, state, town), either
    null, ``records`` (record, state, x, y) and ``towns`` (state, town, x, y).
    A place whose state none of the located records has is in conflict.  Else
    its town, where ``towns`` knows it, decides: it agrees if a point of it
    lies within ``reach`` of such a record.  Without a known town, a state
    agrees and no state is unknown; a town without a state is looked for in the
    records' states.  Rows without places or located records are unknown.

    A record meets the points of its own places' towns in the nine cells around
    it, no others, and of those one is enough.
    """
    located = matches.select(row_id, "record").distinct().join(records.select("record", F.col("state").alias("_at"), F.col("x").alias("_x"), F.col("y").alias("_y")).where("_x is not null and _y is not null"), "record")
    places = stated.where("state is not null or town is not null").select(row_id, "state", "town").distinct()
    pairs = places.join(located, row_id).withColumn("_there", F.coalesce(F.col("state") == F.col("_at"), F.col("state").isNull()))
    known = towns.where("x is not null and y is not null").select(F.col("state").alias("_at"), F.col("town"), F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    names = known.select("_at", "town").distinct().withColumn("_known", F.lit(True))
    asked = pairs.where("_there").join(names, ["_at", "town"], "left")
    around = [F.explode(F.array(*[F.floor(F.col(c) / reach) + k for k in (-1, 0, 1)])).alias(n) for c, n in (("_x", "_i"), ("_y", "_j"))]
    cells = asked.where("_known").select(row_id, "state", "town", "_at", "record", "_x", "_y", around[0]).select("*", around[1])
    points = known.withColumns({"_i": F.floor(F.col("_tx") / reach), "_j": F.floor(F.col("_ty") / reach)}).select(F.col("_at").alias("_pa"), F.col("town").alias("_pt"), F.col("_i").alias("_pi"), F.col("_j").alias("_pj"), "_tx", "_ty")
    same = (F.col("_at") == F.col("_pa")) & (F.col("town") == F.col("_pt")) & (F.col("_i") == F.col("_pi")) & (F.col("_j") == F.col("_pj"))
    close = F.hypot(F.col("_x") - F.col("_tx"), F.col("_y") - F.col("_ty")) <= reach
    near = cells.join(points, same & close, "left_semi").select(row_id, F.col("state").alias("_s"), F.col("town").alias("_t")).distinct().withColumnRenamed(row_id, "_r").withColumn("_near", F.lit(True))
    there = asked.groupBy(row_id, "state", "town").agg(F.max(F.coalesce("_known", F.lit(False))).alias("_known"))
    judged = there.join(near, (F.col(row_id) == F.col("_r")) & F.col("state").eqNullSafe(F.col("_s")) & (F.col("town") == F.col("_t")), "left")
    verdict = F.when(F.col("_near"), AGREES).when(F.col("_known"), CONFLICT).when(F.col("state").isNotNull(), AGREES).otherwise(UNKNOWN)
    elsewhere = pairs.groupBy(row_id, "state", "town").agg(F.max("_there").alias("_any")).where(~F.col("_any"))
    said = judged.select(row_id, verdict.alias("_v")).unionByName(elsewhere.select(row_id, F.lit(CONFLICT).alias("_v"))).groupBy(row_id).agg(F.min("_v").alias("verdict"))
    return matches.select(row_id).distinct().join(said, row_id, "left").select(row_id, F.coalesce("verdict", F.lit(UNKNOWN)).alias("verdict"))
