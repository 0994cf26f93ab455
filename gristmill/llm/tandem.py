"""Runs of tandem repeats by the linear method of Gusfield and Stoye, over words.

Words become numbers, and texts meet in one sequence a slice of a batch.

1. A run of at least ``least`` words repeats at its period, so windows of half
   that length found twice in its text cover all of it.  Only stretches that
   such windows cover are searched further; a window without its like is in
   no run's way.
2. The stretches, each ended by a symbol of its own, get suffix ranks
   (``suffixes.rank_tables``), from which the longest earlier factor of every
   position and the Lempel-Ziv blocks follow.
3. The right half of a leftmost square touches two blocks at most.  So common
   extensions around the block borders, at distances of up to two blocks, give
   squares that cover the leftmost one of every kind.
4. Suffix links lead from a square to its rotation one word on; following them
   from the covering squares completes the vocabulary of squares, each a place
   in the suffix tree: an interval of the suffix array and a length.  Squares
   of a repeated root are left out, since their run has the shorter period.
5. The leaves below each place are the occurrences of that square.  Those of
   one period at consecutive positions are one run.

A text is searched whole in its task, and no text needs another: the plan has
no shuffle.  Memory is some twenty numbers a word of the stretches, times the
logarithm of the longest repeat.

Edge cases: a null or empty text has no words and no runs; rows that repeat
give the same result; a null id is handed to ``rewrite`` as it is; an empty
table gives an empty result; all columns are kept, and the result is one struct
column ``into``, which replaces a column of that name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import documents, slices
from gristmill.llm.suffixes import common_after, common_before, expanded, first_true, rank_tables, word_numbers

#: Fixed value of the contract.
LEAST_WORDS = 12

#: From an id and a number of words to the number of the word that stands at each place, or None where all stay.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def planted(number: int | None, n: int) -> np.ndarray | None:
    """The contract's repetition: by the id's checksum, a tenth of the texts end in a period."""
    h = zlib.crc32(str(number).encode()) if number is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _twice_covered(symbols: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of stretches of at least ``least`` words that windows found twice in their group cover, and the stretch of each.

    ``group`` never falls.  Windows are compared by 64-bit hashes; two that
    only share a hash let more words through, never fewer.
    """
    window = (least + 1) // 2
    room = len(symbols) - window + 1
    if room <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, odd = group[:room].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    for k in range(window):
        hashes = (hashes ^ symbols[k : room + k].astype(np.uint64)) * odd
        hashes ^= hashes >> np.uint64(29)
    at = np.flatnonzero(group[:room] == group[window - 1 :])
    order = at[np.argsort(hashes[at], kind="stable")]
    same = (hashes[order][1:] == hashes[order][:-1]) & (group[order][1:] == group[order][:-1])
    twice = order[np.append(same, False) | np.append(False, same)]
    rise = np.bincount(twice, minlength=len(symbols) + 1) - np.bincount(twice + window, minlength=len(symbols) + 1)
    covered = np.flatnonzero(np.cumsum(rise)[:-1] > 0)
    if not len(covered):
        return covered, covered
    new = np.append(True, (covered[1:] != covered[:-1] + 1) | (group[covered][1:] != group[covered][:-1]))
    stretch = np.cumsum(new) - 1
    long_enough = np.bincount(stretch)[stretch] >= least
    return covered[long_enough], stretch[long_enough]


def lz_blocks(tables: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest factor that also begins earlier, or one new symbol."""
    n = tables.shape[1] - 1
    rank = tables[-1][:n].tolist()
    # Suffixes leave a list in the order of ranks from the last position on, so the neighbours of each are the nearest ones that begin earlier.
    before, after, low, high = list(range(-1, n)), list(range(1, n + 2)), [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        b, a = before[r], after[r]
        low[i], high[i] = b, a
        after[b] = a  # the place -1 is the last of the list and never read
        before[a] = b
    suffix = np.append(np.argsort(tables[-1][:n]), 0)
    here, factor = np.arange(n), np.zeros(n, np.int64)
    for side in (np.array(low), np.array(high)):
        some = np.flatnonzero((side >= 0) & (side < n))
        factor[some] = np.maximum(factor[some], common_after(tables, here[some], suffix[side[some]]))
    step = np.maximum(factor, 1).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    return np.array(starts, np.int64)


def covering_squares(tables: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, half): squares begin at all positions from first to last; the leftmost of every kind is among them."""
    n = tables.shape[1] - 1
    ends = np.append(starts[1:], n)
    after = np.append(ends[1:], n)
    block, half = expanded(np.ones(len(starts), np.int64), ends - starts + 1)  # ends at the border: half as long as the block at most
    right = ends[block]
    pairs = [(right - half, right, half)]
    block, half = expanded(np.ones(len(starts), np.int64), after - starts + 1)
    pairs.append((starts[block], starts[block] + half, half))
    one, two, half = (np.concatenate(x) for x in zip(*pairs))
    inside = (one >= 0) & (two < n)
    one, two, half = one[inside], two[inside], half[inside]
    first, length = one - common_before(tables, one, two), common_after(tables, one, two)
    last = one + length - half
    real = last >= first
    found = np.unique(np.stack([first[real], last[real], half[real]], axis=1), axis=0)
    first, last, half = found.T
    return tuple(x[_primitive(tables, first, half)] for x in (first, last, half))


def _primitive(tables: np.ndarray, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the root of ``half`` symbols at each position is no power of a shorter one."""
    most = int(half.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            some = factor[p * p :: p]
            some[some == np.arange(p * p, most + 1, p)] = p
    whole, rest = np.ones(len(at), bool), half.copy()
    while (open_ := np.flatnonzero(rest > 1)).size:
        prime = factor[rest[open_]]
        short = half[open_] // prime
        whole[open_] &= common_after(tables, at[open_], at[open_] + short) < half[open_] - short
        rest[open_] //= prime
    return whole


def vocabulary(tables: np.ndarray, first: np.ndarray, last: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, half): the interval of the suffix array below each distinct square."""
    which, at = expanded(first, last + 1)  # along the suffix links
    half = half[which]
    level = np.frexp(2 * half)[1] - 1
    shift = 2 * half - (1 << level)
    head, tail = tables[level, at], tables[level, at + shift]
    kinds = np.unique(np.stack([half, head, tail], axis=1), axis=0, return_index=True)[1]
    at, half, level, shift, head, tail = (x[kinds] for x in (at, half, level, shift, head, tail))
    n = tables.shape[1] - 1
    suffix, rank = np.argsort(tables[-1][:n]), tables[-1][at].astype(np.int64)

    def inside(r: np.ndarray) -> np.ndarray:
        other = suffix[np.minimum(r, n - 1)]
        return (tables[level, other] == head) & (tables[level, np.minimum(other + shift, n)] == tail)

    low = first_true(head.astype(np.int64), rank, inside)  # a rank names where its group begins
    high = first_true(rank, np.full(len(at), n), lambda r: ~inside(r))
    return low, high, half


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least two periods, by period and start."""
    tables = rank_tables(symbols)
    low, high, half = vocabulary(tables, *covering_squares(tables, lz_blocks(tables)))
    which, r = expanded(low, high)
    at, period = np.argsort(tables[-1][: len(symbols)])[r], half[which]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at)) - 1
    start, period = at[begins], period[begins]
    return start, at[ends[: len(begins)]] - start + 2 * period, period


def runs_of_texts(symbols: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least ``least`` words, by text, start and period; ``counts``: words of each text."""
    offsets, home = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    kept, stretch = _twice_covered(symbols, home, least)
    again, inner = _twice_covered(symbols[kept], stretch, least)  # most windows found twice are found far apart
    kept, stretch = kept[again], inner
    if not len(kept):
        return (np.zeros(0, np.int64),) * 4
    new = np.append(True, stretch[1:] != stretch[:-1])
    gaps = np.cumsum(new) - 1
    place = np.arange(len(kept)) + gaps
    joined = np.zeros(len(kept) + gaps[-1], np.int64)
    joined[place] = symbols[kept]
    ends = np.setdiff1d(np.arange(len(joined)), place, assume_unique=True)
    joined[ends] = symbols.max(initial=0) + 1 + np.arange(len(ends))
    start, length, period = runs(joined)
    long_enough = length >= least
    start, length, period = start[long_enough], length[long_enough], period[long_enough]
    back = np.full(len(joined), -1)
    back[place] = kept
    at = back[start]
    text = home[at]
    order = np.lexsort((period, at))
    return text[order], (at - offsets[text])[order], length[order], period[order]


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def _results(texts: pa.Array, ids: list, least: int, rewrite: Rewrite | None) -> list[pa.Array]:
    names, symbols, counts = word_numbers(texts)
    symbols = symbols.astype(np.int64)
    offsets = np.cumsum(counts) - counts
    if rewrite is not None:
        for row, number in enumerate(ids):
            low, n = offsets[row], counts[row]
            if (places := rewrite(number, int(n))) is not None:
                symbols[low : low + n] = symbols[low + places]
    text, start, length, period = runs_of_texts(symbols, counts, least)
    where = offsets[text] + start
    rise = np.bincount(where + period, minlength=len(symbols) + 1) - np.bincount(where + length, minlength=len(symbols) + 1)
    stays = np.cumsum(rise)[:-1] <= 0
    left = np.bincount(np.repeat(np.arange(len(counts)), counts)[stays], minlength=len(counts))
    words = names.take(pa.array(symbols[stays]))
    listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
    borders = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    per_text = np.bincount(text, minlength=len(counts))
    return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(borders(per_text), listed), pc.binary_join(pa.ListArray.from_arrays(borders(left), words), " ")]


def tandem_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "tandem", least: int = LEAST_WORDS, rewrite: Rewrite | None = None) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``RESULT``: words, runs by start and period, and the words left when each run keeps its first period."""
    whole = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into]).alias("row"))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _results(batch.column("text"), batch.column("id").to_pylist(), least, rewrite)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *found], names=["row", *RESULT.names])

    found = whole.mapInArrow(applied, T.StructType([T.StructField("row", whole.schema["row"].dataType), *RESULT.fields]))
    return found.select("row.*", F.struct(*RESULT.names).alias(into))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tandem_runs(documents(spark, sf_dir).select("doc_id", "text"), rewrite=planted).select("doc_id", "tandem.*")
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    with_best = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return with_best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
