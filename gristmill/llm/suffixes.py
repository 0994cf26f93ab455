"""Words of whole batches as numbers, and suffix ranks over them.

``rank_tables`` is prefix doubling: table k orders all positions by the 2**k
symbols that follow, and names equal ones alike, so two lookups compare any two
stretches and a descent over the tables gives their common length, forwards and
backwards.  The last table is the inverse of the suffix array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in them, how many words each text has); words end at ASCII white space, a null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0))  # white space at an end gives an empty word
    home = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.bincount(home[real], minlength=len(texts))


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) for all numbers of the ranges [low, high)."""
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]


def first_true(low: np.ndarray, high: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The least number of each [low, high) that passes a test that holds from some number on; high where none does."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high) >> 1, 0)
        passed = test(middle)
        high = np.where(open_ & passed, middle, high)
        low = np.where(open_ & ~passed, middle + 1, low)
    return low


def _starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, where the group of each begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def rank_tables(symbols: np.ndarray) -> np.ndarray:
    """One row for each power of two, with a last column of -1 behind the end; the last row has no equal ranks."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _starts(symbols[order])
    tables, step = [], 1
    while True:
        tables.append(np.append(rank, -1).astype(np.int32 if n < 2**31 else np.int64))
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else order
        if not len(tied):
            return np.stack(tables)
        after = tied + step
        key = rank[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at = tied[by]
        rank = rank.copy()
        rank[at] += _starts(key[by]) - _starts(rank[at])
        step *= 2


def common_after(tables: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal."""
    n, length = tables.shape[1] - 1, np.zeros(len(i), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        length += np.where((i != j) & (tables[k][np.minimum(i + length, n)] == tables[k][np.minimum(j + length, n)]), 1 << k, 0)
    return length


def common_before(tables: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols that end before i and before j are equal."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        one, two = i - length - (1 << k), j - length - (1 << k)
        inside = (one >= 0) & (two >= 0)
        length += np.where(inside & (tables[k][np.maximum(one, 0)] == tables[k][np.maximum(two, 0)]), 1 << k, 0)
    return length
