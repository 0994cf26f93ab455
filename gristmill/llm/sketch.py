"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

A sketch is the sorted set of a text's shingle hashes below the threshold.
Sketches of the same fraction merge by union (``merged``), and the share of one in another
estimates containment, however unequal the texts are.  A text none of whose
hashes lies below the threshold keeps its smallest, so only a text without
words has an empty sketch.

Everything is an expression of built-in functions; the next document's text
reaches a document through a window within ranges of ids, and only the part
that is needed of the first document of a range goes to the range before it.

Edge cases: a null text counts as empty; two empty sketches have likeness 1,
an empty one and another 0; documents of equal or null ids follow in order of
their text, null ids first; a table of one document follows itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, UPPER, documents

WORDS = 5
FRACTION = 1 / 8
ROWS_PER_RANGE = 500
MOST_RANGES = 1 << 15
#: Fixed value: 2 to the 63rd; hashes are signed.
HALF_RANGE = 1 << 63


def sketch(text: Column, size: int = WORDS, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes of runs of ``size`` words below ``fraction`` of the range; fewer words are one run."""
    lowered = F.translate(text, UPPER, LOWER)
    tokens = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(t: Column) -> Column:
        runs = F.greatest(F.size(t) - (size - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), runs), lambda i: F.xxhash64(F.slice(t, i, size)))

    def of(t: Column) -> Column:
        return F.when(F.size(t) > 0, _bind(hashed(t), lambda h: _retained(h, fraction))).otherwise(F.array().cast("array<bigint>"))

    return _bind(tokens, of)


def _retained(hashes: Column, fraction: float) -> Column:
    """What a sketch keeps of one or more hashes: those below the fraction, or else the smallest.  Unions keep what the whole would."""
    limit = int(fraction * 2 * HALF_RANGE) - HALF_RANGE
    below = F.filter(hashes, lambda x: x < limit)
    return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(F.array(F.array_min(hashes)))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def likeness(a: Column, b: Column) -> Column:
    """The sketches' Jaccard similarity; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """The share of ``a`` that ``b`` holds; an empty sketch is held by any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts together, but for the runs across their border: below the threshold if either has any there."""
    return _bind(F.array_union(a, b), lambda h: F.when(F.size(h) > 0, _retained(h, fraction)).otherwise(h))


def as_string(hashes: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def ranges(docs: DataFrame, id_col: str, rows: int = ROWS_PER_RANGE) -> list:
    """Ids that split ``docs`` into ranges of about ``rows`` rows, from one approximate percentile over all ids."""
    count = docs.count()
    parts = min(MOST_RANGES, -(-count // rows))
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    return sorted(set(docs.agg(F.percentile_approx(id_col, shares, 10 * parts)).first()[0] or []))


def with_next(docs: DataFrame, derive=lambda df: df, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``derive(docs)`` with the struct ``next``: text and derived columns of the document that follows by id; the first follows the last.

    Rows are dealt by range of ids and ordered within.  The last of a range
    gets the head of the next range that has any.  Heads are found by id
    alone, and only theirs are derived a second time; ranges number at most
    ``MOST_RANGES``, so a list of them fits one task.
    """
    bounds = ranges(docs, id_col, rows)
    ranged = docs.withColumn("_range", _range_of(F.col(id_col), bounds))
    full = derive(ranged)
    payload = F.struct(*[c for c in full.columns if c not in (id_col, "_range")])
    order = Window.partitionBy("_range").orderBy(F.col(id_col).asc_nulls_first(), text_col)
    follows = full.withColumn("next", F.lead(payload).over(order))

    least = ranged.groupBy("_range").agg(F.min(id_col).alias("_least"), F.max(F.col(id_col).isNull()).alias("_nulls"))
    all_ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.min("_range").over(all_ranges))
    successor = least.select("_range", after.alias("_after"))
    first_id = F.when(F.col("_nulls"), F.col(id_col).isNull()).otherwise(F.col(id_col) == F.col("_least"))
    at_head = ranged.join(F.broadcast(least.withColumnRenamed("_range", "_of")), (F.col("_range") == F.col("_of")) & first_id).select(ranged.columns)
    ranked = at_head.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(text_col)))
    heads = derive(ranked.where("_rank = 1").drop("_rank")).select(F.col("_range").alias("_after"), payload.alias("_head"))
    links = successor.join(heads, "_after").select(F.col("_range").alias("_of"), "_head")
    return follows.join(links.hint("merge"), F.col("_range") == F.col("_of"), "left").withColumn("next", F.coalesce("next", "_head")).drop("_range", "_of", "_head")


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the value, by halving: log2(bounds) comparisons a row."""
    if not bounds:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds))
    widths = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def halve(low: Column, width: Column) -> Column:
        return F.when(F.try_element_at(table, low + width) < value, low + width).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), halve)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"))
    paired = with_next(docs, lambda df: df.withColumn("sketch", sketch(F.col("text"))))
    length = F.length("text")
    edit = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - edit), F.substring(F.col("next.text"), F.lit(1), edit))
    both = paired.select("doc_id", length.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )
