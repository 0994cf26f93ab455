"""Comparing two models: gains by day with resampled days, splits by direction, whether to swap, what each term adds.

Rows are combined to days, classes or bins before anything else; windows
without keys run over days only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import numeric
from gristmill.operators import inference

#: Scores that differ by no more are even.
TIE = 1e-12


def conditional_groups(rows: DataFrame, on: str, off: str, outcome: str, row_id: str) -> DataFrame:
    """(day, klass, n, diff, moved) of the groups of a day and class with both outcomes.

    ``diff`` is the conditional log likelihood with the chances ``on`` less the
    one with ``off``; a group is moved if any of its rows has other chances.
    Rows without a chance or an outcome are left out of both.
    """
    held = rows.where(F.col(on).isNotNull() & F.col(off).isNotNull() & F.col(outcome).isNotNull()).withColumn("_group", F.to_json(F.struct("day", "klass")))
    arms = [inference.conditional_likelihood(held, "_group", arm, outcome, row_id).withColumnRenamed("value", name) for arm, name in ((on, "_on"), (off, "_off"))]
    seen = held.groupBy("_group").agg(F.first("day").alias("day"), F.first("klass").alias("klass"), F.max(F.col(on) != F.col(off)).alias("moved"))
    keyed = [arm.withColumnRenamed(arm.columns[0], "_group") for arm in arms]
    joined = seen.join(keyed[0], "_group").join(keyed[1].select("_group", "_off"), "_group").where((F.col("closed") > 0) & (F.col("closed") < F.col("n")))
    return joined.select("day", "klass", "n", (F.col("_on") - F.col("_off")).alias("diff"), "moved")


def _draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to below 1 that the digest of the parts gives."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def resampled(days: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, mean): sum(d) / sum(n) of as many days as there are, drawn with replacement; ``days`` is (day, d, n), one row a day."""
    numbered = days.withColumns({"_slot": F.row_number().over(Window.orderBy("day")) - 1, "_size": F.count("*").over(Window.partitionBy())})
    asked = numbered.select("_slot", "_size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picked = asked.select("draw", F.floor(_draw(seed, F.col("draw"), F.col("_slot")) * F.col("_size")).alias("_slot"))
    return picked.join(numbered.select("_slot", "d", "n"), "_slot").groupBy("draw").agg((F.sum("d") / F.sum("n")).alias("mean"))


def evaluated(groups: DataFrame, draws: int, bound: float, seed: int, class_rows: int, class_days: int) -> DataFrame:
    """(scope, rows, moved, gain, lower, upper, largest_share, last_gain, binding): of all groups, and of each class.

    ``groups`` is (day, klass, n, diff, moved).  Gains are by row; the bounds
    hold ``bound`` of the draws of whole days.  For all, ``moved`` counts days
    with a moved group; for a class likewise, and it binds if it has
    ``class_rows`` rows and ``class_days`` moved days.
    """
    days = groups.groupBy("day").agg(F.sum("diff").alias("d"), F.sum("n").alias("n"), F.max("moved").alias("moved"))
    tail = (1 - bound) / 2
    bounds = resampled(days.select("day", "d", "n"), draws, seed).agg(F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"))
    overall = days.agg(
        F.sum("n").alias("rows"), F.count_if("moved").alias("moved"), (F.sum("d") / F.sum("n")).alias("gain"), (F.max("n") / F.sum("n")).alias("largest_share"), F.max_by(F.col("d") / F.col("n"), "day").alias("last_gain")
    )
    whole = overall.crossJoin(F.broadcast(bounds)).withColumns({"scope": F.lit("all"), "binding": F.lit(None).cast("boolean")})
    classes = groups.groupBy(F.col("klass").cast("string").alias("scope")).agg(F.sum("n").alias("rows"), F.count_distinct(F.when(F.col("moved"), F.col("day"))).alias("moved"), (F.sum("diff") / F.sum("n")).alias("gain"))
    binding = (F.col("rows") >= class_rows) & (F.col("moved") >= class_days)
    return whole.unionByName(classes.withColumn("binding", binding), allowMissingColumns=True).select("scope", "rows", "moved", "gain", "lower", "upper", "largest_share", "last_gain", "binding")


def raised_lowered(rows: DataFrame, new: str, base: str, y: str) -> DataFrame:
    """(split, n, rate, sse_base, sse_new): squared errors of the rows whose chance was raised, lowered and left."""
    split = F.when(F.col(new) > F.col(base), "raised").when(F.col(new) < F.col(base), "lowered").otherwise("unchanged")
    error = lambda p: F.sum(F.pow(F.col(p) - F.col(y), 2))
    return rows.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.avg(y).alias("rate"), error(base).alias("sse_base"), error(new).alias("sse_new"))


def swap(rows: DataFrame, new: str, base: str, y: str, situation: str, bins: int, out_of_bound: float, tolerance: float) -> DataFrame:
    """One row (kind, why, n and both models' scores): whether a refit may take the place of the model served.

    It is kept out by the first of: no rows, a worse Brier score, a worse one
    in some situation, more bins out of bound, a calibration error worse by
    more than ``tolerance``.
    """
    error = lambda p: F.sum(F.pow(F.col(p) - F.col(y), 2))
    by_situation = rows.groupBy(situation).agg(F.count("*").alias("n"), error(new).alias("e_new"), error(base).alias("e_base"))
    worse = F.when(F.col("e_new") / F.col("n") > F.col("e_base") / F.col("n") + TIE, F.col(situation).cast("string"))
    pooled = by_situation.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("e_new") / F.sum("n")).alias("brier_new"), (F.sum("e_base") / F.sum("n")).alias("brier_base"), F.min(worse).alias("worse"))
    both = rows.select(F.col(y).cast("double").alias("_y"), F.explode(F.create_map(F.lit("new"), F.col(new), F.lit("base"), F.col(base))).alias("_model", "_p"))
    bin_ = F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1))
    binned = both.groupBy("_model", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.abs(F.avg("_p") - F.avg("_y")).alias("_gap"))
    of = lambda model, value: F.sum(F.when(F.col("_model") == model, value))
    figures = [of(m, F.col("_gap") * F.col("_n")) / of(m, F.col("_n")) for m in ("new", "base")] + [F.coalesce(of(m, (F.col("_gap") > out_of_bound).cast("int")), F.lit(0)) for m in ("new", "base")]
    calibrated = binned.agg(*[f.alias(n) for f, n in zip(figures, ("ece_new", "ece_base", "out_new", "out_base"))])
    joined = pooled.crossJoin(F.broadcast(calibrated))
    why = (
        F.when(F.col("n") == 0, "rows").when(F.col("brier_new") > F.col("brier_base") + TIE, "brier").when(F.col("worse").isNotNull(), F.concat(F.lit("situation "), F.col("worse")))
        .when(F.col("out_new") > F.col("out_base"), "bins").when(F.col("ece_new") > F.col("ece_base") + tolerance + TIE, "calibration")
    )
    return joined.select(F.when(why.isNull(), "swap").otherwise("keep").alias("kind"), why.alias("why"), "n", "brier_new", "brier_base", "out_new", "out_base", "ece_new", "ece_base")


def step_fits(rows: DataFrame, terms: list[str], y: str) -> DataFrame:
    """(term, level, n, value): how far the log odds of a level's rate, smoothed by one of each, lie from the rate of all rows with the term; level -1 has none."""
    long = rows.select(F.col(y).cast("int").alias("_y"), F.explode(F.create_map(*[c for t in terms for c in (F.lit(t), F.col(t).cast("int"))])).alias("term", "level")).where("level >= 0")
    counts = long.groupBy("term", "level").agg(F.sum("_y").alias("_s"), F.count("*").alias("n"))
    odds = lambda s, n: numeric.logit((s + 1) / (n + 2))
    every = Window.partitionBy("term")
    return counts.select("term", "level", "n", (odds(F.col("_s"), F.col("n")) - odds(F.sum("_s").over(every), F.sum("n").over(every))).alias("value"))


def contributions(rows: DataFrame, row_id: str, terms: list[str], fits: DataFrame, raised_only: Mapping[str, Column]) -> DataFrame:
    """(row_id, term, level, value): what each term adds to a row's log odds, 0 where its level is unknown or was never fitted.

    A term of ``raised_only`` adds no less than 0 where its condition holds.
    """
    floors = [c for t in terms for c in (F.lit(t), F.coalesce(raised_only.get(t, F.lit(False)), F.lit(False)))]
    long = rows.withColumn("_floors", F.create_map(*floors)).select(row_id, "_floors", F.explode(F.create_map(*[c for t in terms for c in (F.lit(t), F.coalesce(F.col(t).cast("int"), F.lit(-1)))])).alias("term", "level"))
    found = long.join(fits.select("term", "level", "value"), ["term", "level"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    held = F.when(F.element_at("_floors", F.col("term")), F.greatest("value", F.lit(0.0))).otherwise(F.col("value"))
    return found.select(row_id, "term", "level", held.alias("value"))


def declined(slots: DataFrame, by: list[str], end: str, past: str, ended: str, step: float, least: float, scale: float) -> DataFrame:
    """``by``, ``end``, x, delta: how far a chance has fallen by each slot's end, and the log odds that takes.

    x grows towards ``past``, by ``step`` a slot at most, and never falls; a
    slot without ``past`` holds it, and one that has ``ended`` has 0.  The log
    odds fall from 0 to log(``least``).  A key's slots are one row each, so few
    that they are folded as one list.
    """
    listed = slots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(end).alias("end"), F.col(past).cast("double").alias("past"), F.coalesce(F.col(ended), F.lit(False)).alias("ended")))).alias("_slots"))

    def grown(held: Column, s: Column) -> Column:
        x = held["x"]
        now = F.when(s["past"].isNull() | s["ended"], x).otherwise(F.greatest(x, F.least(s["past"], x + step)))
        shown = F.when(s["ended"], F.lit(0.0)).otherwise(now)
        return F.struct(now.alias("x"), F.concat(held["out"], F.array(F.struct(s["end"].alias("end"), shown.alias("x")))).alias("out"))

    kind = slots.schema[end].dataType.simpleString()
    start = F.struct(F.lit(0.0).alias("x"), F.array().cast(f"array<struct<end:{kind},x:double>>").alias("out"))
    out = listed.select(*by, F.explode(F.aggregate("_slots", start, grown, lambda h: h["out"])).alias("_o"))
    return out.select(*by, F.col("_o.end").alias(end), F.col("_o.x").alias("x"), F.log(least + (1 - least) * F.exp(-F.col("_o.x") / scale)).alias("delta"))


def published_as(counts: DataFrame, situation: str, n: str, fallback: Mapping[str, str], least: int) -> DataFrame:
    """(situation, published): the situation whose rates stand for it: itself with ``least`` rows or more, else the first of its chain of fallbacks that has them, else null.

    ``fallback`` names one situation for some; a chain that turns in a circle
    ends there.  A situation of it that has no rows counts as none.
    """
    backed = counts.where(F.col(n) >= least).select(F.col(situation).alias("published"))
    chains = []
    for first in sorted({*fallback, *fallback.values()}):
        at, seen = first, []
        while at is not None and at not in seen:
            seen.append(at)
            at = fallback.get(at)
        chains += [(first, place, to) for place, to in enumerate(seen)]
    steps = counts.sparkSession.createDataFrame(chains, "_s string, _place int, published string")
    own = counts.select(F.col(situation).alias("_s"), F.lit(0).alias("_place"), F.col(situation).alias("published"))
    best = steps.unionByName(own).distinct().join(backed, "published").groupBy("_s").agg(F.min_by("published", "_place").alias("published"))
    every = steps.select("_s").union(own.select("_s")).distinct()
    return every.join(best, "_s", "left").select(F.col("_s").alias(situation), "published")


def states_by_moment(states: DataFrame, keys: list[str], moment: str, value: str, moments: list, unknown: int) -> DataFrame:
    """``keys`` and a column for each of ``moments``: the largest value there, ``unknown`` where a key has none."""
    wide = states.groupBy(*keys).pivot(moment, moments).agg(F.max(value))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{m}`"), F.lit(unknown)).alias(f"m{m}") for m in moments])
