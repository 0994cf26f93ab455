"""Labels of places and days from reads of lists, builds for folds, and what changed between two builds.

A read is one list's row of a place on a day: (unit, place, day, state).
Everything is grouped sums and equi joins on (unit, place), (unit, day) and
(place, day), combined before they are shuffled.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSED, OPEN, UNKNOWN, MISSING = "closed", "open", "unknown", "missing"
KNOWN = (CLOSED, OPEN)


def audiences(reads: DataFrame, days: int) -> DataFrame:
    """(unit, place, since): the places that a unit has named on ``days`` days or more, and the first of them."""
    daily = reads.where("unit is not null and place is not null and day is not null").groupBy("unit", "place", "day").agg(F.lit(1).alias("_one"))
    return daily.groupBy("unit", "place").agg(F.count("*").alias("_days"), F.min("day").alias("since")).where(F.col("_days") >= days).drop("_days")


def usual_rows(reads: DataFrame) -> DataFrame:
    """(unit, reads, usual): the days a unit was read, and the mean number of its rows on them."""
    daily = reads.where("unit is not null and day is not null").groupBy("unit", "day").agg(F.count("*").alias("_rows"))
    return daily.groupBy("unit").agg(F.count("*").alias("reads"), F.avg("_rows").alias("usual"))


def fold_labels(reads: DataFrame, closed: Column, before: date | None = None, audience_days: int = 3, least_reads: int = 2, least_share: float = 0.5) -> DataFrame:
    """(place, day, outcome) of the days before ``before``, from nothing that was read on it or later.

    A unit's read of a day counts if the unit was read on ``least_reads`` days
    and holds ``least_share`` of its usual rows that day; audiences and usual
    rows come from the fold alone.  A place that a counted unit names is
    ``closed`` where any such row is ``closed``; it is ``open`` where a counted
    unit that carries it shows others but not it, or only rows that are not
    ``closed``; it is ``unknown`` where units that carry it were read, none
    counted.  Days on which no unit that carries a place was read give no row.
    """
    mine = reads if before is None else reads.where(F.col("day") < F.lit(before))
    carried, usual = audiences(mine, audience_days), usual_rows(mine)
    shown = mine.where("unit is not null and day is not null").groupBy("unit", "day").agg(F.count("*").alias("_rows"))
    counted = shown.join(usual, "unit").select("unit", "day", ((F.col("reads") >= least_reads) & (F.col("_rows") >= least_share * F.col("usual"))).alias("_counted"))
    named = mine.where("unit is not null and place is not null and day is not null").groupBy("unit", "place", "day").agg(F.max(F.coalesce(closed, F.lit(False))).alias("_closed"))
    evidence = carried.join(counted, "unit").where(F.col("day") >= F.col("since")).join(named, ["unit", "place", "day"], "left")
    said = evidence.groupBy("place", "day").agg(F.max("_counted").alias("_any"), F.max(F.col("_counted") & F.coalesce("_closed", F.lit(False))).alias("_shut"))
    return said.select("place", "day", F.when(~F.col("_any"), UNKNOWN).when(F.col("_shut"), CLOSED).otherwise(OPEN).alias("outcome"))


def compared(whole: DataFrame, fold: DataFrame) -> DataFrame:
    """(was, now, kind, n): how many labels of one build stand as what in another; ``kind`` is same, changed, added or neither.

    A known label that became anything else is changed; one that was unknown
    or missing and became known is added; the rest trains nothing either way.
    """
    joined = whole.select("place", "day", F.col("outcome").alias("was")).join(fold.select("place", "day", F.col("outcome").alias("now")), ["place", "day"], "full")
    moved = joined.select(F.coalesce("was", F.lit(MISSING)).alias("was"), F.coalesce("now", F.lit(MISSING)).alias("now")).groupBy("was", "now").agg(F.count("*").alias("n"))
    had, has = F.col("was").isin(*KNOWN), F.col("now").isin(*KNOWN)
    kind = F.when(had & (F.col("was") == F.col("now")), "same").when(had, "changed").when(has, "added").otherwise("neither")
    return moved.select("was", "now", kind.alias("kind"), "n")


def named_shares(labels: DataFrame, members: DataFrame, reasons: DataFrame, positive: tuple[str, ...]) -> DataFrame:
    """(place, day, eligible, share): of a place's members, how many had a reason named on a day labelled ``positive``; no members: share 0.

    ``members`` is (place, member); ``reasons`` is (member, day), repeats allowed.
    """
    asked = labels.where(F.col("outcome").isin(*positive)).select("place", "day")
    sizes = members.distinct().groupBy("place").agg(F.count("*").alias("eligible"))
    named = reasons.select("member", "day").distinct().join(members.distinct(), "member").groupBy("place", "day").agg(F.count("*").alias("_named"))
    joined = asked.join(sizes, "place", "left").join(named, ["place", "day"], "left")
    eligible = F.coalesce("eligible", F.lit(0))
    return joined.select("place", "day", eligible.alias("eligible"), F.when(eligible > 0, F.coalesce("_named", F.lit(0)) / eligible).otherwise(F.lit(0.0)).alias("share"))


def snapshots(labelled: DataFrame, captures: DataFrame, carried: DataFrame, posted: DataFrame, begins: Column, ends: Column) -> DataFrame:
    """(place, day, snapshot_at): the last capture before a day's window ends of a unit that carries the place then.

    ``labelled`` is (place, day), ``captures`` (unit, at), ``carried`` (unit,
    place, since), ``posted`` (place, day, first).  ``begins`` and ``ends`` give
    the window of a ``day``; windows of two days must not meet.  A place that
    had posted by the window's end has none, nor has one without a capture in
    the window.  Captures are cut to one for each unit and day before the join.
    """
    days = labelled.select("day").distinct().select("day", begins.alias("_begins"), ends.alias("_ends"))
    night = F.explode(F.array(F.to_date("at"), F.date_add(F.to_date("at"), 1)))
    last = captures.select("unit", "at", night.alias("day")).join(days, "day").where((F.col("at") >= F.col("_begins")) & (F.col("at") < F.col("_ends"))).groupBy("unit", "day").agg(F.max("at").alias("_at"))
    seen = carried.join(last, "unit").where(F.col("day") >= F.col("since")).groupBy("place", "day").agg(F.max("_at").alias("_at"))
    rows = labelled.select("place", "day").distinct().join(seen, ["place", "day"], "left").join(posted.select("place", "day", "first"), ["place", "day"], "left").join(days, "day")
    early = F.coalesce(F.col("first") <= F.col("_ends"), F.lit(False))
    return rows.select("place", "day", F.when(~early, F.col("_at")).alias("snapshot_at"))


def neighbour_shares(snapshot: DataFrame, neighbours: DataFrame, shut: DataFrame) -> DataFrame:
    """(place, day, share): of a place's neighbours, how many had shown no school by its snapshot; null without a snapshot, 0 without neighbours.

    ``neighbours`` is (place, other) without repeats, ``shut`` (place, day, first).
    """
    asked = snapshot.where("snapshot_at is not null").select("place", "day", "snapshot_at")
    sizes = neighbours.groupBy("place").agg(F.count("*").alias("_n"))
    others = shut.select(F.col("place").alias("other"), "day", "first")
    met = asked.join(neighbours, "place").join(others, ["other", "day"]).where(F.col("first") <= F.col("snapshot_at")).groupBy("place", "day").agg(F.count("*").alias("_met"))
    joined = snapshot.join(sizes, "place", "left").join(met, ["place", "day"], "left")
    share = F.when(F.col("_n") > 0, F.coalesce("_met", F.lit(0)) / F.col("_n")).otherwise(F.lit(0.0))
    return joined.select("place", "day", F.when(F.col("snapshot_at").isNotNull(), share).alias("share"))


def level(value: Column, steps: list[float]) -> Column:
    """How many of the rising ``steps`` a value reaches; -1 where it is null."""
    reached = sum((F.when(value >= s, 1).otherwise(0) for s in steps), F.lit(0))
    return F.when(value.isNull(), -1).otherwise(reached)


def captures_planned(captures: DataFrame, storms: DataFrame, most: int) -> DataFrame:
    """(unit, season, at, size, why): which captures of a unit's season to read.

    Captures of storm days first, larger ones first, ``most`` of them; a season
    without a storm capture takes those larger than its mean size, else its
    largest, ``most`` of them too.  Ties go to the earlier one.
    """
    marked = captures.join(storms.select("day").distinct().withColumn("_storm", F.lit(True)), "day", "left").withColumn("_storm", F.coalesce("_storm", F.lit(False)))
    season = marked.groupBy("unit", "season").agg(F.max("_storm").alias("_stormy"), F.avg("size").alias("_usual"), F.max("size").alias("_largest"))
    ranked = marked.join(season, ["unit", "season"]).where(F.col("_storm") | (~F.col("_stormy") & ((F.col("size") > F.col("_usual")) | (F.col("size") == F.col("_largest")))))
    place = F.row_number().over(Window.partitionBy("unit", "season").orderBy(F.desc("size"), "at"))
    return ranked.withColumn("_place", place).where(F.col("_place") <= most).select("unit", "season", "at", "size", F.when(F.col("_storm"), "storm").otherwise("large").alias("why"))
