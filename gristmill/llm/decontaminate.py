"""Benchmark decontamination by suffix arrays of the training text.

The documents are dealt into shards, the slices of each task.  A shard gets an
array of its suffixes, ordered by their first ``window`` words; suffixes that
hold a word unknown to the benchmark before the shortest window ends can match
nothing and are left out.  Every suffix of the benchmark, cut to a window (an
item of fewer words is one window by itself), is looked up by binary search;
equal ones once.  The interval found holds the places of all verbatim
occurrences, which cover the document's words.  Where a covered stretch begins,
and again behind each match, the suffix array of the benchmark is narrowed word
by word to the longest match.  Documents with a match are removed.

The benchmark travels in blocks of at most ``BLOCK_BYTES`` of text, one
broadcast each; with more than one, every block is a pass over the documents
that ends at a table in the shared folder, so neither a task nor the driver
holds more than a block.  Documents are never shuffled.

Edge cases: a null text has no words; an item without words is ignored; an
item without an id makes hits but is not listed; repeated items and items of
equal text are searched once and listed under each id, an id once; repeated
documents get equal results; a very long document is a shard of its own; empty
documents give an empty result, an empty benchmark one without hits; all
columns are kept, and the result is one struct column ``into``, which replaces
a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import cut, documents, slices
from gristmill.llm.suffixes import expanded, first_true, rank_tables, word_numbers

#: Fixed value of the contract: words of a window.
WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20

#: ASCII letters lower-cased, digits and all bytes beyond ASCII kept, everything else white space.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

MATCH = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType())])
SPAN = T.StructType(MATCH.fields[:2])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH)),
])


def plain(texts: list[str | None]) -> pa.Array:
    """Texts whose words are divided by spaces."""
    return pa.array([(t or "").encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts], pa.binary()).cast(pa.string())


@dataclass
class Benchmark:
    """A block of items: words as numbers from 1, each item ended by a 0; its suffix array; its windows in that array's order."""

    words: pa.Array
    symbols: np.ndarray
    suffix: np.ndarray
    item_at: np.ndarray  # of each symbol
    item_start: np.ndarray
    items: list[list[str]]
    low: np.ndarray  # of each distinct window, its interval in ``suffix``
    high: np.ndarray
    length: np.ndarray
    place: np.ndarray  # where it begins in an item that it is a window of
    columns: np.ndarray  # the packed words of each window
    bits: int
    window: int

    @property
    def shortest(self) -> int:
        return int(self.length.min(initial=self.window))


def _packed(symbols: np.ndarray, at: np.ndarray, window: int, bits: int) -> np.ndarray:
    """The ``window`` words from each place on, as rows of 62-bit numbers that order as the words do."""
    per = max(1, 62 // bits)
    rows = []
    for low in range(0, window, per):
        row = np.zeros(len(at), np.int64)
        for k in range(low, min(low + per, window)):
            row = (row << bits) | symbols[at + k]
        rows.append(row)
    return np.stack(rows)


def prepared(texts: list[str], ids: list[list[str]], window: int = WINDOW) -> Benchmark:
    """A block of distinct item texts, with the ids that each stands for."""
    words, numbers, counts = word_numbers(plain(texts))
    n_items = len(counts)
    item_start = np.cumsum(counts + 1) - counts - 1
    place = np.arange(len(numbers)) + np.repeat(np.arange(n_items), counts)
    symbols = np.zeros(len(numbers) + n_items + window, np.int64)
    symbols[place] = numbers + 1
    item_at = np.repeat(np.arange(n_items + 1), np.append(counts + 1, window))
    # Zeros that end items get numbers of their own while suffixes are ranked, so that no suffix runs into the next item.
    own = symbols.copy()
    zeros = np.flatnonzero(symbols == 0)
    own += len(zeros)
    own[zeros] = np.arange(len(zeros))
    suffix = np.argsort(rank_tables(own)[-1][: len(own)])
    left = np.repeat(counts, counts) - (np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts))
    whole = np.repeat(np.minimum(counts, window), counts)  # an item's windows have its own length where it is short
    opens = np.zeros(len(own), np.int64)
    opens[place[left >= whole]] = whole[left >= whole]
    in_order = opens[suffix]
    bits = max(1, int(len(words) + 1).bit_length())
    found = []
    for length in np.unique(in_order[in_order > 0]):
        rows = np.flatnonzero(in_order == length)
        key = _packed(symbols, suffix[rows], int(length), bits)
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        found.append((rows[first], np.full(len(first), length)))
    low = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
    length = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
    at, padded = suffix[low], np.append(symbols, np.zeros(window, np.int64))
    columns = _packed(np.append(padded, 0), at, window, bits)
    # Of all suffixes below a window, longer items' included.
    high = first_true(low, np.full(len(low), len(suffix)), lambda r: ~_same(padded, suffix[np.minimum(r, len(suffix) - 1)], at, length))
    low = first_true(np.zeros(len(low), np.int64), low, lambda r: _same(padded, suffix[np.minimum(r, len(suffix) - 1)], at, length))
    return Benchmark(words, padded, suffix, item_at, np.append(item_start, len(symbols)), ids, low, high, length, at, columns, bits, window)


def _same(symbols: np.ndarray, one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
    same = np.ones(len(one), bool)
    for k in range(int(length.max(initial=0))):
        same &= (k >= length) | (symbols[np.minimum(one + k, len(symbols) - 1)] == symbols[np.minimum(two + k, len(symbols) - 1)])
    return same


def shard(texts: list[str | None], words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, home, counts): the documents' words by the benchmark's numbers, 0 for others and behind each document; whose each is."""
    own, numbers, counts = word_numbers(plain(texts))
    known = np.asarray(pc.fill_null(pc.index_in(own, value_set=words), -1)) + 1
    home = np.repeat(np.arange(len(counts)), counts)
    symbols = np.zeros(len(numbers) + len(counts) + window, np.int64)
    symbols[np.arange(len(numbers)) + home] = known[numbers] if len(numbers) else numbers
    return symbols, np.repeat(np.arange(len(counts)), counts + 1), counts


def suffix_array(symbols: np.ndarray, shortest: int, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, packed words) of the suffixes with ``shortest`` known words at least, ordered by their first ``window`` words."""
    zeros = np.flatnonzero(symbols == 0)
    room = np.diff(np.append(-1, zeros)) - 1
    which, at = expanded(zeros - room, zeros - shortest + 1)
    at = at[at + window <= len(symbols)]
    columns = _packed(symbols, at, window, bits)
    order = np.lexsort(columns[::-1])
    return at[order], columns[:, order]


def looked_up(columns: np.ndarray, wanted: np.ndarray, length: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval of the suffix array of each window, by binary search over one packed number after another."""
    low, high = np.zeros(len(length), np.int64), np.full(len(length), columns.shape[1])
    per = max(1, 62 // bits)
    for k, (row, want) in enumerate(zip(columns, wanted)):
        here = min(per, window - k * per)
        free = bits * np.clip(here - (length - k * per), 0, here)  # bits of words beyond a short window
        least = (want >> free) << free
        most = least | ((np.int64(1) << free) - 1)
        begin = first_true(low, high, lambda r, row=row, least=least: row[r] >= least)
        high = first_true(begin, high, lambda r, row=row, most=most: row[r] > most)
        low = begin
    return low, high


def longest(symbols: np.ndarray, start: np.ndarray, window: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(length, place in the benchmark) of the longest verbatim match from each place, whose window is known."""
    low, high, length = bench.low[window], bench.high[window], bench.length[window].copy()
    going = np.arange(len(start))
    last = len(bench.suffix) - 1
    while len(going):
        word = symbols[start[going] + length[going]]
        depth = length[going]
        next_word = lambda r, depth=depth: bench.symbols[np.minimum(bench.suffix[np.minimum(r, last)] + depth, len(bench.symbols) - 1)]
        begin = first_true(low[going], high[going], lambda r, word=word, f=next_word: f(r) >= word)
        end = first_true(begin, high[going], lambda r, word=word, f=next_word: f(r) > word)
        more = (begin < end) & (word > 0)
        low[going[more]], high[going[more]] = begin[more], end[more]
        length[going[more]] += 1
        going = going[more]
    if not len(start):
        return length, start
    short = length < bench.window  # no longer item shares a whole window, so the short one stands
    return np.where(short, bench.length[window], length), np.where(short, bench.place[window], bench.suffix[low])


def searched(texts: list[str | None], bench: Benchmark) -> tuple[np.ndarray, list[list], list[list], list[list]]:
    """(words, spans, items, matches) of each text of a shard."""
    symbols, home, counts = shard(texts, bench.words, bench.window)
    spans, items, matches = ([[] for _ in texts] for _ in range(3))
    at, columns = suffix_array(symbols, bench.shortest, bench.window, bench.bits)
    if not len(at) or not len(bench.length):
        return counts, spans, items, matches
    low, high = looked_up(columns, bench.columns, bench.length, bench.window, bench.bits)
    which, r = expanded(low, high)
    if not len(which):
        return counts, spans, items, matches
    place, begins = at[r], np.cumsum(counts + 1) - counts - 1
    order = np.lexsort((-bench.length[which], place))
    place, which = place[order], which[order]
    rise = np.bincount(place, minlength=len(symbols) + 1) - np.bincount(place + bench.length[which], minlength=len(symbols) + 1)
    covered = np.append(np.append(False, np.cumsum(rise)[:-1] > 0), False)
    opens, closes = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    for row, start, end in zip(home[opens].tolist(), (opens - begins[home[opens]]).tolist(), (closes - begins[home[opens]]).tolist()):
        spans[row].append((start, end - start))
    _collect_items(items, home[place], which, bench)
    reach = np.maximum.accumulate(place + bench.length[which])
    now = np.searchsorted(place, opens)
    while len(now):
        size, where = longest(symbols, place[now], which[now], bench)
        for row, start, n, spot in zip(home[place[now]].tolist(), place[now].tolist(), size.tolist(), where.tolist()):
            item = int(bench.item_at[spot])
            matches[row].append((start - int(begins[row]), n, bench.items[item][0] if bench.items[item] else None, spot - int(bench.item_start[item])))
        end = place[now] + size
        after = np.searchsorted(reach, end, side="right")  # the first window that ends behind the match
        now = after[(after < len(place)) & (place[np.minimum(after, len(place) - 1)] < closes[np.searchsorted(closes, end, side="left").clip(max=len(closes) - 1)])]
        now = np.unique(now)
    return counts, spans, items, [sorted(set(m)) for m in matches]


def _collect_items(items: list[list], rows: np.ndarray, which: np.ndarray, bench: Benchmark) -> None:
    """The ids of all items that hold a window found in a document; documents with the same windows share the work."""
    pairs = np.unique(np.stack([rows, which], axis=1), axis=0)
    known: dict[bytes, list[str]] = {}
    edges = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
    for low, high in zip(edges.tolist(), np.append(edges[1:], len(pairs)).tolist()):
        windows = pairs[low:high, 1]
        key = windows.tobytes()
        if key not in known:
            held = np.zeros(len(bench.items) + 1, bool)
            for w in windows.tolist():
                spots = bench.suffix[bench.low[w] : bench.high[w]]
                if bench.length[w] < bench.window:  # a short window is looked for on behalf of the items that it is the whole of
                    spots = spots[(bench.item_start[bench.item_at[spots]] == spots) & (bench.symbols[spots + bench.length[w]] == 0)]
                held[bench.item_at[spots]] = True
            known[key] = sorted({i for k in np.flatnonzero(held).tolist() for i in bench.items[k]})
        items[int(pairs[low, 0])] = known[key]


def _merged(one: list, two: list) -> list:
    """Spans that are in either list."""
    out: list[tuple[int, int]] = []
    for start, length in sorted([*one, *two]):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length - out[-1][0]))
        else:
            out.append((start, length))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, budget: int = BLOCK_BYTES) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Distinct item texts with all their ids, by so many bytes of text; the driver holds one block."""
    grouped = benchmark.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.sort_array(F.collect_set(F.col(id_col).cast("string"))).alias("ids"))
    texts: list[str] = []
    ids: list[list[str]] = []
    size = 0
    for row in grouped.toLocalIterator():
        if texts and size + len(row.text) > budget:
            yield texts, ids
            texts, ids, size = [], [], 0
        texts.append(row.text)
        ids.append(list(row.ids))
        size += len(row.text)
    if texts:
        yield texts, ids


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``RESULT``: words, covered spans, items with a window in the document, longest verbatim matches and their places."""
    whole = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into]).alias("row"))
    out = None
    for texts, ids in blocks(benchmark, item_id, item_text, block_bytes):
        out = _pass(whole if out is None else cut(out, "contamination"), prepared(texts, ids, window))
    if out is None:
        out = _pass(whole, prepared([], [], window))
    return out.select("row.*", F.struct(*RESULT.names).alias(into))


def _pass(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """One block against all documents, added to what earlier blocks have found."""
    shared = rows.sparkSession.sparkContext.broadcast(bench)
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))]

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in slices(batches, budget=SHARD_BYTES):
            counts, *found = searched(batch.column("text").to_pylist(), bench)
            spans, items, matches = found
            if "spans" in batch.schema.names:
                earlier = [[[tuple(x.values()) if isinstance(x, dict) else x for x in row] for row in batch.column(c).to_pylist()] for c in ("spans", "items", "matches")]
                spans = [_merged(a, b) for a, b in zip(earlier[0], spans)]
                items, matches = ([sorted({*a, *b}, key=str) for a, b in zip(x, y)] for x, y in zip(earlier[1:], (items, matches)))
            lists = [[[dict(zip((f.name for f in kind.value_type), x)) for x in row] for row in rows] if pa.types.is_struct(kind.value_type) else rows for kind, rows in zip(kinds, (spans, items, matches))]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), pa.array(counts, pa.int64()), *map(pa.array, lists, kinds)], names=["text", "row", *RESULT.names])

    return rows.mapInArrow(applied, T.StructType([T.StructField("text", T.StringType()), T.StructField("row", rows.schema["row"].dataType), *RESULT.fields]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **named: object) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the columns they came with."""
    found = contamination(docs, benchmark, into="_contamination", **named)
    return found.where(F.size("_contamination.spans") == 0).select([F.col(f"`{c}`") for c in docs.columns])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, s: n + s.length)
    return found.select(
        "doc_id", "contamination.n_words", hit.alias("n_hit"), F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("contamination.items", ","), "UTF-8"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH found AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), tests AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL
), places AS (
    SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS place FROM tests WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[place:place + size - 1], ' ') AS win FROM places
), sizes AS (
    SELECT DISTINCT size FROM windows
), doc_places AS (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM found, sizes WHERE len(words) >= size
), doc_windows AS (
    SELECT doc_id, size, place, array_to_string(words[place:place + size - 1], ' ') AS win FROM doc_places
), hits AS (
    SELECT d.doc_id, d.place, d.size, w.item_id FROM doc_windows d JOIN windows w ON d.size = w.size AND d.win = w.win
), covered AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS spot FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT f.doc_id, len(f.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM found f LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
