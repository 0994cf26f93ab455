"""Line dedup with two Bloom filters.

One pass over the texts fills a filter of keys seen once and one of keys seen
twice.  Tasks keep both for the rows they read and hand on the segments that
hold anything; per segment, twice is what either side saw twice or both saw
once.  A second pass probes the filter of twice-seen keys, and only suspects
leave their task, as 128-bit hashes: they are counted exactly, and the document
that keeps a key is chosen.  A third pass drops the lines.

The filter has about ``BITS_PER_LINE`` bits a line and at most ``MOST_BITS``,
which bounds what is broadcast; beyond that more keys are suspected and
shuffled, and results stay exact.  Confirmed keys are broadcast up to
``MOST_KEYS`` of them, after counting; beyond that the lines to drop are
joined to the documents.

Edge cases: a null or empty text is one empty line; rows that repeat are
documents of their own, so all of them that hold the largest id keep its
lines; a document without an id keeps no key for others and loses its own when
another keeps it; an empty table gives an empty result; further columns are
kept as they are by ``dedup``, which refuses those named like its counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import cut, documents, lower_ascii, slices

#: Fixed values of the contract.
STRIPPED = " \t\n\v\f\r"
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3

HASHES = 3
BITS_PER_LINE = 16
SEGMENT_BITS = 1 << 19
MOST_BITS = 1 << 30
MOST_KEYS = 1 << 20
FLUSH_KEYS = 1 << 21


def line_key(line: str) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a short one."""
    if len(line) < LEAST_CHARS:
        return None
    key = lower_ascii(line.strip(STRIPPED))
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")) if len(key) >= LEAST_CHARS else None


def _positions(keys: np.ndarray, segments: int) -> np.ndarray:
    """Bit positions, one row for each hash function; all bits of a key lie in one segment."""
    one, two = keys[:, 0], keys[:, 1] | np.uint64(1)
    start = (one % np.uint64(segments)) * np.uint64(SEGMENT_BITS)
    mixed = one >> np.uint64(20)
    return np.stack([start + (mixed + np.uint64(i) * two) % np.uint64(SEGMENT_BITS) for i in range(HASHES)])


def _as_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _bitmap(offsets: np.ndarray) -> bytes:
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    bits[offsets] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def segments_for(lines: int) -> int:
    """How many segments the filter has for so many lines."""
    return max(1, min(MOST_BITS, lines * BITS_PER_LINE) // SEGMENT_BITS)


def twice_seen(texts: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the filter of keys seen twice or more, in rows of 64 KB."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held += {k for line in (text or "").split("\n") if (k := line_key(line))}
            if len(held) > FLUSH_KEYS:
                yield from filled(held)
                held = []
        yield from filled(held)

    def filled(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        at, times = np.unique(_positions(_as_keys(held), segments), return_counts=True)
        home = (at // np.uint64(SEGMENT_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        for low, high in zip(starts, np.r_[starts[1:], len(at)]):
            offsets = (at[low:high] % np.uint64(SEGMENT_BITS)).astype(np.int64)
            row = [[int(home[low])], [_bitmap(offsets)], [_bitmap(offsets[times[low:high] > 1])]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], names=["segment", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        for batch in batches:
            for segment, *packed in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
                if segment == at:
                    twice |= t | (once & o)
                    once |= o
                    continue
                if at is not None:
                    yield finished(at, twice)
                at, once, twice = segment, o.copy(), t.copy()
        if at is not None:
            yield finished(at, twice)

    def finished(segment: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "bits"])

    # Sorted and merged as a stream: however many tasks have filled a segment, two bitmaps are held.
    rows = texts.mapInArrow(seen, "segment int, once binary, twice binary")
    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, bits binary")


def broadcast_filter(filled: DataFrame, segments: int) -> Broadcast:
    """The whole filter, at most ``MOST_BITS`` bits, on every worker."""
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in filled.toLocalIterator():
        bits[row.segment] = np.frombuffer(row.bits, np.uint8)
    return filled.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def suspects(docs: DataFrame, twice: Broadcast, segments: int) -> DataFrame:
    """(id, one, two, high, low, at): each suspected key of a document and the numbers of its lines.

    ``docs`` has id, one, two and text; (one, two) names the row's content.
    """

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for batch in slices(batches):
            keys: dict[tuple[int, bytes], list[int]] = {}
            for row, text in enumerate(batch.column("text").to_pylist()):
                for number, line in enumerate((text or "").split("\n")):
                    if key := line_key(line):
                        keys.setdefault((row, key), []).append(number)
            if not keys:
                continue
            pairs = _as_keys([k for _, k in keys])
            at = _positions(pairs, segments)
            hit = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            rows = pa.array(np.fromiter((r for r, _ in keys), np.int32, len(keys))[hit])
            numbers = [n for n, yes in zip(keys.values(), hit) if yes]
            wanted = [batch.column(c).take(rows) for c in ("id", "one", "two")]
            halves = [pa.array(pairs[hit, k].view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*wanted, *halves, pa.array(numbers, pa.list_(pa.int32()))], names=["id", "one", "two", "high", "low", "at"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(probed, f"id {kind}, one long, two long, high long, low long, at array<int>")


def confirmed(found: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(high, low, keeper): keys that ``least`` documents hold, and the largest id among them."""
    counts = found.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    return counts.where((F.col("n") >= least) & F.col("keeper").isNotNull()).drop("n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCUMENTS, most_keys: int = MOST_KEYS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with its text reduced to the lines that stay, and two columns ``counts``: lines and dropped lines."""
    if clash := set(counts) & set(docs.columns):
        raise ValueError(f"columns that are there already: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = segments_for(lines)
    slim = _rows(docs, id_col, text_col).select("id", "one", "two", "text")
    twice = broadcast_filter(twice_seen(slim.select("text"), segments), segments)
    found = cut(suspects(slim, twice, segments), "line-suspects")
    keys = cut(confirmed(found, least), "line-keys")
    if keys.count() <= most_keys:
        return _apply_broadcast(docs, keys, id_col, text_col, counts)
    return _apply_join(docs, found, keys, id_col, text_col, counts)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, one, two): what else a row holds travels in a struct, so no name of ours meets one of its own."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(rest.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[h.alias(n) for h, n in zip(_content(id_col, text_col), ("one", "two"))])


def _content(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The name of a row's id and text, 128 bits."""
    return F.xxhash64(F.lit(1), id_col, text_col), F.xxhash64(F.lit(2), text_col, id_col)


def _reduced(rows: DataFrame, gone: Callable[[pa.RecordBatch, int, list[str]], set[int]], docs: DataFrame, text_col: str, counts: tuple[str, str]) -> DataFrame:
    """The columns of ``docs`` and ``counts``; ``gone`` gives the numbers of the lines that a row of a batch loses."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for row, text in enumerate(batch.column("text").to_pylist()):
                lines = (text or "").split("\n")
                lost = gone(batch, row, lines)
                stay = [line for k, line in enumerate(lines) if k not in lost] if lost else lines
                for column, value in zip(out, ("\n".join(stay), len(lines), len(lines) - len(stay))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.int64())))], names=["row", "text", "before", "dropped"])

    kinds = (T.StringType(), T.LongType(), T.LongType())
    made = rows.mapInArrow(applied, T.StructType([rows.schema["row"], *(T.StructField(n, k) for n, k in zip(("text", "before", "dropped"), kinds))]))
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return made.select(*columns, F.col("before").alias(counts[0]), F.col("dropped").alias(counts[1]))


def _apply_broadcast(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, counts: tuple[str, str]) -> DataFrame:
    """One pass over the documents with the confirmed keys at hand: no text is shuffled."""
    table = {np.array([r.high, r.low], np.int64).tobytes(): r.keeper for r in keys.toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def gone(batch: pa.RecordBatch, row: int, lines: list[str]) -> set[int]:
        keeper, number = shared.value.get, None
        lost = set()
        for k, line in enumerate(lines):
            if (key := line_key(line)) and (owner := keeper(key)) is not None:
                number = batch.column("id")[row].as_py() if number is None else number
                if owner != number:
                    lost.add(k)
        return lost

    return _reduced(_rows(docs, id_col, text_col), gone, docs, text_col, counts)


def _apply_join(docs: DataFrame, found: DataFrame, keys: DataFrame, id_col: str, text_col: str, counts: tuple[str, str]) -> DataFrame:
    """The lines to drop of each document, joined to it by its content."""
    lost = found.join(keys, ["high", "low"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = lost.groupBy("one", "two").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("drop"))
    joined = _rows(docs, id_col, text_col).join(drops, ["one", "two"], "left").select("row", "text", "drop")
    return _reduced(joined, lambda batch, row, lines: set(batch.column("drop")[row].as_py() or ()), docs, text_col, counts)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS number
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.number, k.line, o.keeper IS NOT NULL AND o.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
