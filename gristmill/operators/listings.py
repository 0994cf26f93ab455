"""Listed rows: aliases by market, details on which rows agree, and what each slot of a source adds and takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alias_key(text: Column) -> Column:
    """The form in which listed texts are compared: single blanks, none at the ends, lower case.  Texts come with composed letters."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))


def alias_join(rows: DataFrame, aliases: DataFrame, market: str, text: str, target: str) -> DataFrame:
    """``rows`` with ``target``, a row for each target of the text's alias in its market; null where it has none.

    An alias listed again with the same target counts once.  Null markets and
    texts have no alias.  ``rows`` may hold columns of any name but ``target``.
    """
    names = aliases.select(F.col(market).alias("_market"), alias_key(F.col(text)).alias("_key"), F.col(target)).distinct()
    said = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), rows[market].alias("_m"), alias_key(rows[text]).alias("_k"))
    found = said.join(names, (said["_m"] == names["_market"]) & (said["_k"] == names["_key"]), "left")
    return found.select("_row.*", names[target].alias(target))


def agreed(stated: DataFrame, groups: DataFrame, unit: list[str], row: list[str], detail: str, group: str) -> DataFrame:
    """(unit, group, detail): the details of a unit in groups on which all rows that state something of the group state the same.

    ``groups`` names the group of each detail and is sent to all tasks: a join
    by shuffle would put each detail's rows in one task.  Details of no group
    are left out.  Rows agree where each detail of the group comes in every
    row that states one, so two counts decide and no row's details are
    gathered; a unit's rows are shuffled once.  Repeated statements count
    once; rows of a null unit are left out.
    """
    known = stated.dropna(subset=unit).select(*unit, *row, detail).join(F.broadcast(groups), detail).select(*unit, *row, group, detail)
    said = known.repartition(*unit).distinct()
    speaker = F.dense_rank().over(Window.partitionBy(*unit, group).orderBy(*row))
    each = said.withColumn("_speaker", speaker).groupBy(*unit, group, detail).agg(F.count("*").alias("_said"), F.max("_speaker").alias("_speaker"))
    whole = Window.partitionBy(*unit, group)
    counted = each.withColumns({"_least": F.min("_said").over(whole), "_rows": F.max("_speaker").over(whole)})
    return counted.where("_least = _rows").select(*unit, group, detail)


def slot_runs(reads: DataFrame, source: str, slot: str, member: str) -> DataFrame:
    """(source, slot, member, change): members that a slot of a source holds and its slot before does not (added), and the other way round (removed).

    The first slot of a source adds all its members.  A source's slots are put
    in order once, by themselves; members meet the slot before by a join, so no
    set of members is gathered.  Repeated reads count once; null members are
    members like any other.
    """
    held = reads.select(source, slot, member).distinct()
    slots = held.select(source, slot).distinct()
    order = Window.partitionBy(source).orderBy(slot)
    steps = slots.select(source, slot, F.lead(slot).over(order).alias("_next"))
    later = held.join(steps.where("_next is not null"), [source, slot]).select(source, F.col("_next").alias(slot), member, F.lit(1).alias("_before"), F.lit(0).alias("_now"))
    both = later.union(held.select(source, slot, member, F.lit(0), F.lit(1))).groupBy(source, slot, member).agg(F.sum("_before").alias("_b"), F.sum("_now").alias("_n"))
    return both.where("_b <> _n").select(source, slot, member, F.when(F.col("_n") == 1, "added").otherwise("removed").alias("change"))


def slot_states(runs: DataFrame, slots: DataFrame, source: str, slot: str, member: str) -> DataFrame:
    """The inverse of ``slot_runs``: (source, slot, member) of all ``slots``; a member stays from the slot that adds it until one removes it."""
    changes = Window.partitionBy(source, member).orderBy(slot)
    spans = runs.select(source, member, F.col(slot).alias("_from"), F.lead(slot).over(changes).alias("_to"), "change").where("change = 'added'")
    numbered = slots.select(source, slot).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(source).orderBy(slot)))
    first = numbered.select(source, F.col(slot).alias("_from"), F.col("_k").alias("_k1"))
    stop = numbered.select(source, F.col(slot).alias("_to"), F.col("_k").alias("_k2"))
    last = numbered.groupBy(source).agg((F.max("_k") + 1).alias("_end"))
    placed = spans.join(first, [source, "_from"]).join(stop, [source, "_to"], "left").join(last, source)
    each = placed.select(source, member, F.explode(F.sequence("_k1", F.coalesce("_k2", "_end") - 1)).alias("_k"))
    return each.join(numbered, [source, "_k"]).select(source, slot, member)
