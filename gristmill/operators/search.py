"""Ranked token search over a stored index.

``store`` counts each document's tokens where the document is read and writes
the postings (token, doc_id, times, first), packed by token and batch of
documents, dealt to folders by a hash of the token and sorted by it there, and
the dictionary.  A typo is found by pieces: each token of the dictionary is
cut into 2 k + 1 pieces for k = 1 and 2.  An edit, or a swap of two
neighbours, spoils two pieces at most, so of a token within k edits of a word
one piece is found in the word, at most k places away.  A search cuts the
tokens of its words' lengths as it reads the dictionary, checks those alone
that share a piece, and reads the postings of the tokens that it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import folded, tokens

FOLDERS = 64
MOST_EDITS = 2
#: Tokens that a word may stand for and that the postings are filtered by; with more, they are joined.
MOST_NAMED = 1000
#: Tokens that are counted at a time; a longer document is alone.
SLICE_TOKENS = 1 << 20


def near(word: str, token: str) -> tuple[int, int, int]:
    """(distance, prefix distance, prefix length): optimal string alignment of ``word`` with ``token`` and with its closest prefix, the longest of equally close ones."""
    before, last = [], list(range(len(word) + 1))
    best, length = len(word), 0
    for i, c in enumerate(token, 1):
        row = [i]
        for j, q in enumerate(word, 1):
            v = min(last[j - 1] + (q != c), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and q == token[i - 2] and word[j - 2] == c:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
        if row[-1] <= best:
            best, length = row[-1], i
    return last[-1], best, length


def alignments(pairs: DataFrame, word: str, token: str) -> DataFrame:
    """``pairs`` with distance, prefix_distance and prefix_length of ``word`` and ``token``."""
    names = "distance int, prefix_distance int, prefix_length int"

    @F.pandas_udf(names)
    def aligned(words: pd.Series, others: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([near(w, t) for w, t in zip(words, others)], columns=["distance", "prefix_distance", "prefix_length"])

    return pairs.withColumn("_a", aligned(word, token)).select(*pairs.columns, "_a.*")


def cut_at(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a token of ``n`` letters."""
    return [(k * n // parts, (k + 1) * n // parts - k * n // parts) for k in range(parts)]


def pieces(dictionary: DataFrame) -> DataFrame:
    """(edits, n, part, piece, token): the pieces of every token, for each number of edits."""
    n = F.length("token")

    def cut(edits: int) -> Column:
        parts = 2 * edits + 1

        def piece(k: Column) -> Column:
            start = F.floor(k * n / parts).cast("int")
            return F.struct(F.lit(edits).alias("edits"), n.alias("n"), k.alias("part"), F.substring(F.col("token"), start + 1, F.floor((k + 1) * n / parts).cast("int") - start).alias("piece"))

        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), piece)

    rows = F.explode(F.concat(*[cut(k) for k in range(1, MOST_EDITS + 1)]))
    return dictionary.select(rows.alias("r"), "token").select("r.*", "token")


def asked_pieces(words: list[str]) -> list[tuple[str, int, int, int, str]]:
    """(word, edits, n, part, piece): where a token of n letters within a word's edits may have a piece of its own."""
    out = set()
    for word in words:
        edits = budget(word)
        for n in range(max(1, len(word) - edits), len(word) + edits + 1) if edits else ():
            for part, (start, length) in enumerate(cut_at(n, 2 * edits + 1)):
                for at in range(max(0, start - edits), min(len(word) - length, start + edits) + 1):
                    out.add((word, edits, n, part, word[at : at + length]))
    return sorted(out)


def budget(word: str) -> int:
    """None for numbers; two edits from eight letters, one from four."""
    return 0 if any(c.isdigit() for c in word) else 2 if len(word) >= 8 else 1 if len(word) >= 4 else 0


@dataclass
class Index:
    """A stored index; reading it costs nothing until a search asks for rows."""

    postings: DataFrame
    dictionary: DataFrame


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the index of ``docs`` to ``folder``."""
    home = F.pmod(F.xxhash64("token"), F.lit(FOLDERS)).cast("int")
    packed = packed_postings(docs, doc_id, text)
    if not docs.groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        packed = _merged(packed)
    packed.withColumn("home", home).repartition("home").sortWithinPartitions("home", "token").write.partitionBy("home").parquet(f"{folder}/postings")
    dictionary(docs.sparkSession.read.parquet(f"{folder}/postings")).sort("token").write.parquet(f"{folder}/dictionary")


def opened(spark: SparkSession, folder: str) -> Index:
    return Index(unpacked(spark.read.parquet(f"{folder}/postings")), spark.read.parquet(f"{folder}/dictionary"))


def packed_postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(token, doc_ids, times, firsts, documents, whole): how often and where first each token stands in each row of ``docs``; a token comes once for each slice of rows that holds it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("tokens"), batch.column("doc_id")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            low = 0
            while low < len(lengths):
                before = ends[low] - lengths[low]
                high = max(low + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
                flat = lists.slice(low, high - low).flatten()
                if len(flat):
                    yield packed(flat, lengths[low:high], ids.slice(low, high - low))
                low = high

    def packed(flat: pa.Array, lengths: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        named = flat.dictionary_encode()
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lengths) + row
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(starts, len(key)))
        code = key[starts] // len(lengths)
        tokens_at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        offsets = pa.array(np.append(tokens_at, len(code)), pa.int32())
        columns = [ids.take(pa.array(key[starts] % len(lengths))), pa.array(times, pa.int64()), pa.array(place[order[starts]], pa.int32())]
        totals = [pa.array(np.diff(np.append(tokens_at, len(code))), pa.int64()), pa.array(np.add.reduceat(times, tokens_at), pa.int64())]
        return pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(code[tokens_at])), *(pa.ListArray.from_arrays(offsets, c) for c in columns), *totals], names=names)

    names = ["token", "doc_ids", "times", "firsts", "documents", "whole"]
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    return slim.mapInArrow(counted, f"token string, doc_ids array<{kind}>, times array<long>, firsts array<int>, documents long, whole long")


def unpacked(packed: DataFrame) -> DataFrame:
    """The other columns of ``packed`` and doc_id, times and first: a row for each token and document."""
    others = [c for c in packed.columns if c not in ("doc_ids", "times", "firsts", "documents", "whole")]
    each = packed.select(*others, F.explode(F.arrays_zip("doc_ids", "times", "firsts")).alias("p"))
    return each.select(*others, F.col("p.doc_ids").alias("doc_id"), F.col("p.times").alias("times"), F.col("p.firsts").alias("first"))


def _merged(packed: DataFrame) -> DataFrame:
    """``packed`` with one posting for each token and document, where rows repeat a document's id."""
    once = unpacked(packed).groupBy("token", "doc_id").agg(F.sum("times").alias("times"), F.min("first").alias("first"))
    return once.select("token", F.array("doc_id").alias("doc_ids"), F.array("times").alias("times"), F.array("first").alias("firsts"), F.lit(1).cast("long").alias("documents"), F.col("times").alias("whole"))


def dictionary(packed: DataFrame) -> DataFrame:
    """(token, documents, times) for every token."""
    return packed.groupBy("token").agg(F.sum("documents").alias("documents"), F.sum("whole").alias("times"))


def expand(words: list[str], index: Index) -> DataFrame:
    """(word, token, level): 0 equal, 1 prefix, 2 within the word's typo budget by optimal string alignment."""
    spark = index.dictionary.sparkSession
    begins = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith("token", w))
    any_of = F.lit(False)
    for w in words:
        any_of = any_of | F.startswith("token", F.lit(w))
    found = index.dictionary.where(any_of).select(F.explode(begins).alias("word"), "token").select("word", "token", F.when(F.col("token") == F.col("word"), 0).otherwise(1).alias("level"))
    rows = asked_pieces(words)
    if not rows:
        return found
    asked = spark.createDataFrame(rows, "word string, edits int, n int, part int, piece string")
    sizes = sorted({(r[1], r[2]) for r in rows})
    fits = F.lit(False)
    for edits, n in sizes:
        fits = fits | ((F.col("edits") == edits) & (F.col("n") == n))
    lengths = sorted({n for _, n in sizes})
    tried = pieces(index.dictionary.where(F.length("token").isin(lengths))).where(fits).join(F.broadcast(asked), ["edits", "n", "part", "piece"]).select("word", "token", "edits").distinct()
    typos = alignments(tried, "word", "token").where("distance <= edits").select("word", "token", F.lit(2).alias("level"))
    return found.union(typos).groupBy("word", "token").agg(F.min("level").alias("level"))


def rows_of(index: Index, expanded: DataFrame) -> DataFrame:
    """The postings of the tokens of ``expanded``, with word and level: read by folder and token where they are few."""
    first = [r.token for r in expanded.select("token").distinct().limit(MOST_NAMED + 1).collect()]
    if len(first) > MOST_NAMED:
        return index.postings.join(expanded, "token")
    spark = index.postings.sparkSession
    homes = [r.home for r in spark.createDataFrame([(t,) for t in first], "token string").select(F.pmod(F.xxhash64("token"), F.lit(FOLDERS)).cast("int").alias("home")).distinct().collect()] if first else []
    return index.postings.where(F.col("home").isin(homes) & F.col("token").isin(first)).join(F.broadcast(expanded), "token")


def search(index: Index, words: list[str], weights: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best documents that match every word: by the worst level of a word, then weight, then id."""
    return _best(rows_of(index, expand(words, index)), words, weights, limit)


def search_texts(docs: DataFrame, words: list[str], weights: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``search`` finds, from one reading of the texts: less work than an index that only one search would read."""
    return _best(standing(docs, words, doc_id, text), words, weights, limit)


def _best(matched: DataFrame, words: list[str], weights: DataFrame, limit: int) -> DataFrame:
    per_word = matched.groupBy("doc_id", "word").agg(F.min("level").alias("level"))
    scored = per_word.groupBy("doc_id").agg(F.count("*").alias("words"), F.max("level").alias("level")).where(F.col("words") == len(set(words)))
    return scored.join(weights, "doc_id").orderBy("level", F.desc("weight"), "doc_id").limit(limit).select("doc_id", "level", "weight")


def may_stand(words: list[str]) -> str:
    """A pattern of the tokens of a folded text that begin with a word or share a piece with one, as ``asked_pieces`` has it: all that may stand for the words, and some more."""
    sized: dict[int, set[str]] = {}
    for _, edits, n, part, piece in asked_pieces(words):
        start, length = cut_at(n, 2 * edits + 1)[part]
        sized.setdefault(n, set()).add(f"[a-z0-9]{{{start}}}{piece}[a-z0-9]{{{n - start - length}}}")
    typos = [f"(?=[a-z0-9]{{{n}}}(?![a-z0-9]))(?:{'|'.join(sorted(sized[n]))})" for n in sorted(sized)]
    return f"(?<![a-z0-9])(?:{'|'.join([f'(?:{'|'.join(words)})[a-z0-9]*', *typos])})"


def standing(docs: DataFrame, words: list[str], doc_id: str, text: str) -> DataFrame:
    """(doc_id, word, level): the levels of ``expand`` at which tokens of a row of ``docs`` stand for the words."""

    def level(word: str, token: str) -> int | None:
        if token.startswith(word):
            return int(token != word)
        edits = budget(word)
        return 2 if edits and abs(len(word) - len(token)) <= edits and near(word, token)[0] <= edits else None

    @F.pandas_udf("array<int>")
    def levels(tokens: pd.Series) -> pd.Series:
        return tokens.map({t: [level(w, t) for w in words] for t in tokens.unique()})

    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col(text)), F.lit(may_stand(words)), F.lit(0)))).alias("token"))
    each = found.select("doc_id", F.posexplode(levels("token")).alias("at", "level")).where("level IS NOT NULL")
    return each.select("doc_id", F.element_at(F.array(*map(F.lit, words)), F.col("at") + 1).alias("word"), "level")


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words stand side by side in order among a text's tokens, without cutting the text into them."""
    return F.rlike(folded(text), F.lit(f"(?<![a-z0-9]){'[^a-z0-9]+'.join(words)}(?![a-z0-9])"))


def within_edits(names: DataFrame, name: str, edits: int) -> DataFrame:
    """Pairs (name < other) of distinct names within ``edits`` edits, by the pigeonhole principle.

    A name is cut into edits + 1 pieces, of which the edits leave one as it
    is: the other name has it too, at most ``edits`` places away.  Only names
    that share a piece are compared.
    """
    parts = edits + 1
    size = F.length(name)

    def piece(text: str, k: Column, n: Column, shift: Column) -> Column:
        start = F.floor(k * n / parts).cast("int")
        length = F.floor((k + 1) * n / parts).cast("int") - start
        at = start + shift
        return F.when(at >= 0, F.substring(F.col(text), at + 1, length)), length

    cuts = names.select(name, size.cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("k"))
    cuts = cuts.withColumn("piece", piece(name, F.col("k"), F.col("n"), F.lit(0))[0])
    others = names.select(F.col(name).alias("other"), F.explode(F.sequence(F.greatest(F.lit(0), size - edits), size + edits)).alias("n"))
    others = others.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(edits)))).withColumn("shift", F.explode(F.sequence(F.lit(-edits), F.lit(edits))))
    found, length = piece("other", F.col("k"), F.col("n"), F.col("shift"))
    others = others.withColumn("piece", found).where(F.col("piece").isNotNull() & (F.length("piece") == length)).select("other", "n", "k", "piece").distinct()
    near = cuts.join(others, ["n", "k", "piece"]).where(F.col(name) < F.col("other"))
    return near.select(name, "other").distinct().where(F.levenshtein(name, "other", edits) >= 0)
