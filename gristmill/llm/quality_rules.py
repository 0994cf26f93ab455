"""Quality rules as a short-circuit cascade.

A document is kept when no rule rejects it, so the rules may run in any order.
``plan`` times every rule and counts its rejections on a bounded sample, on
the executors, and orders the rules by rejections per nanosecond; ``apply``
then stops at a document's first rejection.  The order changes the cost and
the reason reported, never the verdict; costs are times, so that a rerun may
report another of a document's reasons.  The base test is two rules among the
others.

Edge cases: a null text counts as empty, has no words and fails the base
check; a null id is kept; repeated rows are judged one by one; an empty table
gives an empty result; columns beside id and text are ignored by ``counts``
and kept as they are by ``filter_documents``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import documents, slices, words

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the text and its words."""

    name: str
    rejects: Callable[[str, list[str]], bool]


def repeated_words(tokens: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included.

    Windows are compared by a wrapping polynomial of word numbers first: if
    these all differ, so do the windows.  Only where two agree are the windows
    themselves compared.
    """
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.uint64, len(tokens))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    repeated = np.isin(mixed, ordered[1:][ordered[1:] == ordered[:-1]])
    starts = np.flatnonzero(repeated)
    rows = np.stack([ids[starts + k] for k in range(window)], axis=1)
    _, group, sizes = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    covered = np.zeros(len(tokens) + 1, np.int64)
    twice = starts[sizes[group.ravel()] > 1]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += bool(words(line))
        else:
            seen.add(line)
    return repeats


def symbol_count(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED_PERCENT * n_words


def _shouting(text: str, tokens: list[str]) -> bool:
    return text.count("!") * 10 > 3 * len(tokens)


def _mean_length(text: str, tokens: list[str]) -> bool:
    held = sum(map(len, tokens))
    return held < 2 * len(tokens) or held > 14 * len(tokens)


def _few_letters(text: str, tokens: list[str]) -> bool:
    return sum(any(c.isalpha() for c in w) for w in tokens) * 10 < 6 * len(tokens)


def _same_lines(text: str, tokens: list[str]) -> bool:
    return duplicate_lines(text) * 10 > 6 * (text.count("\n") + 1)


def _few_distinct(text: str, tokens: list[str]) -> bool:
    """The same word follows itself in over a fifth of the places."""
    return sum(a == b for a, b in zip(tokens, tokens[1:])) * 5 > len(tokens)


RULES = (
    Rule("few_words", lambda text, tokens: len(tokens) < LEAST_WORDS),
    Rule("repeated_words", lambda text, tokens: 100 * repeated_words(tokens) > MOST_REPEATED_PERCENT * len(tokens)),
    Rule("symbols", lambda text, tokens: symbol_count(text) * 10 > len(tokens)),
    Rule("shouting", _shouting),
    Rule("mean_word_length", _mean_length),
    Rule("few_letters", _few_letters),
    Rule("same_lines", _same_lines),
    Rule("few_distinct", _few_distinct),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> dict[str, tuple[float, float]]:
    """Mean nanoseconds and rejection rate of each rule, on about ``sample_rows`` rows drawn by a hash of id and seed.

    Rows come to the driver as one sum for each rule.
    """
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.col(text_col).alias("text"))

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, rows = [0] * len(rules), [0] * len(rules), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                text = text or ""
                tokens = words(text)
                rows += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter_ns()
                    hits[k] += rule.rejects(text, tokens)
                    spent[k] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "ns": spent, "hits": hits, "seen": [rows] * len(rules)})

    sums = drawn.mapInArrow(timed, "rule string, ns long, hits long, seen long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
    return {r.rule: (r.ns / max(r.seen, 1), r.hits / max(r.seen, 1)) for r in sums.collect()}


def plan(measured: dict[str, tuple[float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejections per nanosecond, best first; ties, and rules that reject nothing, by cost."""

    def worth(rule: Rule) -> tuple[float, float, str]:
        cost, rate = measured.get(rule.name, (1.0, 0.0))
        return (-rate / max(cost, 1e-9), cost, rule.name)

    return tuple(sorted(rules, key=worth))


def cascade(text: str, tokens: list[str], ordered: tuple[Rule, ...]) -> str | None:
    """The name of the first rule that rejects, or None."""
    return next((rule.name for rule in ordered if rule.rejects(text, tokens)), None)


def judge(docs: DataFrame, ordered: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the base counts, base_failed, kept and rejected_by."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")}
            for text in batch.column("text").to_pylist():
                text = text or ""
                tokens = words(text)
                repeat = repeated_words(tokens)
                failed = base_failed(len(tokens), repeat)
                reason = cascade(text, tokens, ordered)
                for key, value in zip(out, (len(tokens), sum(map(len, tokens)), symbol_count(text), duplicate_lines(text), repeat, failed, reason is None, reason)):
                    out[key].append(value)
            arrays = [pa.array(v, t) for v, t in zip(out.values(), (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *out])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = slim.mapInArrow(counted, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
    return made.withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, ordered: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in one pass without a join."""
    at = docs.columns.index(text_col)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_column):
            keep = []
            for text in batch.column(at).to_pylist():
                text = text or ""
                tokens = words(text)
                keep.append(cascade(text, tokens, ordered) is None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    batch_column = text_col
    return docs.mapInArrow(passed, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, plan(measure(docs)))
