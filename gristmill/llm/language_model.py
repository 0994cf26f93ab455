"""Language-model scores from a log-frequency Bloom filter.

Words and pairs of words are counted over all training texts.  A count c is
quantised to q = 1 + floor(log_b c), and the filter holds the n-gram with each
of 1..q; probing 1, 2, ... until a miss gives q back, never too small.

Keys are hashes, dealt over parts by their value.  A task hands on sorted
arrays of keys and counts, one for each part, so what is shuffled is a few
bytes a distinct n-gram of the task and no key is hot.  The task that gets a
part adds up its counts exactly and makes the part's filter, of a size that
follows its entries.  Parts follow the input, and their filters lie one after
the other in one file of the shared folder, which workers map, so no process
holds the filter.  Exact counts of words, sorted by hash, lie in the same file.

P(w | v) = (c(v, w) + K P(w)) / (s(v) + K), with P(w) = (c(w) + 0.5) / (M +
0.5 (V + 1)).  A count read back is the mean of the integers of its level; M
sums those over all words, and s(v), an entry of the filter as well and read
at the upper end of a finer level, sums those over the pairs of v.  So the
probabilities after a word sum to at most 1.  K = a + b s(v), with the a and b
of ``GRID`` that give an inner fold of the training texts the highest
probability when each of them is left out of the counts that score it.
Held-out texts decide nothing.

Edge cases: a null text counts as empty and has one token, its end; a null id
counts as an empty string and trains; repeated rows train and are scored one
by one; with no training row every word is unknown; with an empty inner fold the
first of ``GRID`` is taken; an empty table gives an empty result; other columns
are ignored; a very long text is scored alone.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, documents, lower_ascii, shared_folder, slices, words

#: Fixed values of the contract.
FOLDS, HELD_OUT = 5, 1
ADDED = 0.5

#: The training texts on which the smoothing is chosen.
INNER_FOLD = 2

END = "\n"  # no word holds white space
BASE = 1.5
CONTEXT_BASE = 1.2
#: (a, b) of the smoothing K = a + b s(v).
GRID = tuple((a, b) for a in (1.0, 10.0, 100.0, 1000.0) for b in (0.0, 0.5, 2.0))
HASHES = 3
BITS_PER_ENTRY = 10
PART_BYTES = 1 << 20
#: More parts than these are larger ones.
SMALL_PARTS, LARGE_PART_BYTES = 1 << 12, 1 << 26
HELD_WORDS = 300_000
HELD_PAIRS = 1 << 21
PROBED_WORDS = 1 << 17
START = np.uint64(0x243F6A8885A308D3)
WORD, PAIR, CONTEXT = range(3)

_32, _HIGH = np.uint64(32), np.uint64(0xFFFFFFFF00000000)
_MIX = 0x9E3779B97F4A7C15
_BACK = pow(_MIX, -1, 1 << 64)
_ROUNDS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_PROBES = tuple(np.uint64(k) for k in (0xE7037ED1A0B428DB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def word_hashes(found: list[str]) -> np.ndarray:
    """Two columns: the halves of each word's 128-bit hash; the first names it in the filter."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), ">u8").astype(np.uint64).reshape(-1, 2)


def mixed(keys: np.ndarray, by: int = _MIX) -> np.ndarray:
    """A permutation of 64-bit keys that spreads them over the whole range."""
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> _32)) * np.uint64(by)
        return x ^ (x >> _32)


def unmixed(keys: np.ndarray) -> np.ndarray:
    return mixed(keys, _BACK)


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """32 bits of either word's hash, spread."""
    return mixed((before & _HIGH) | (after >> _32))


def context_key(before: np.ndarray) -> np.ndarray:
    """The key of what follows a word, from the upper half of its hash."""
    return mixed((before & _HIGH) ^ np.uint64(0x5BF03635))


def home_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, which ascends with the key."""
    return (((keys >> _32) * np.uint64(parts)) >> _32).astype(np.int64)


def level_of(n: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(n) / np.log(base) + 1e-9)).astype(np.int64)


def _means() -> list[float]:
    """What a level of BASE is read back as: the mean of its integers; 0 for level 0."""
    out = [0.0]
    for q in range(1, 110):
        low, high = int(np.ceil(BASE ** (q - 1) - 1e-6)), int(np.ceil(BASE**q - 1e-6)) - 1
        out.append((low + max(low, high)) / 2)
    return out


MEANS = np.array(_means())
UPPER = np.concatenate([[0.0], CONTEXT_BASE ** np.arange(1, 500)])


class Vocabulary:
    """Words numbered in the order they come, and their hashes; a task keeps one over many batches."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.empty((0, 2), np.uint64)

    def take_in(self) -> None:
        """Words that have been numbered since the last call get their hashes."""
        new = list(islice(self.number, len(self.hashes), None))
        if new:
            self.hashes = np.concatenate([self.hashes, word_hashes(new)])


class Tokens:
    """The tokens of a batch of texts as numbers of ``vocabulary``, which grows, and where each text starts."""

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary) -> None:
        number = vocabulary.number
        codes: list[int] = []
        sizes = []
        for text in texts:
            found = words(lower_ascii(text or ""))
            codes += [number.setdefault(w, len(number)) for w in found]
            codes.append(number.setdefault(END, len(number)))
            sizes.append(len(found) + 1)
        vocabulary.take_in()
        self.hashes = vocabulary.hashes[:, 0]
        self.codes = np.array(codes, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pairs(self) -> np.ndarray:
        """The key of each token after the one before it."""
        before = np.empty(len(self.codes), np.uint64)
        before[1:] = self.hashes[self.codes[:-1]]
        before[self.starts] = START
        return pair_key(before, self.hashes[self.codes])


ROWS = "kind int, part int, high binary, low binary, n binary"


def _packed(values: np.ndarray | None, starts: np.ndarray) -> pa.Array:
    """A binary value for each stretch that begins at one of ``starts``."""
    if values is None:
        return pa.nulls(len(starts), pa.binary())
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def dealt(kind: int, parts: int, high: np.ndarray, low: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    """A row of ``ROWS`` for each part that holds keys; ``high`` ascends."""
    home = home_of(high, parts)
    starts = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
    columns = [pa.array(np.full(len(starts), kind, np.int32)), pa.array(home[starts].astype(np.int32)), *(_packed(v, starts) for v in (high, low, n))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "high", "low", "n"])


def summed(high: np.ndarray, low: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    order = np.argsort(high) if low is None else np.lexsort((low, high))
    high, low, n = high[order], None if low is None else low[order], n[order]
    new = high[1:] != high[:-1]
    if low is not None:
        new |= low[1:] != low[:-1]
    starts = np.flatnonzero(np.append(True, new))
    return high[starts], None if low is None else low[starts], np.add.reduceat(n, starts)


def count_ngrams(texts: DataFrame, parts: int) -> DataFrame:
    """``ROWS`` of the words and pairs of ``texts``, one pass over them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = Vocabulary(), np.zeros(0, np.int64)
        pairs: list[np.ndarray] = []
        n_pairs = 0
        for batch in slices(batches):
            tokens = Tokens(batch.column("text").to_pylist(), vocabulary)
            times = np.bincount(tokens.codes, minlength=len(vocabulary.hashes))
            times[: len(held)] += held
            held = times
            pairs.append(tokens.pairs())
            n_pairs += len(pairs[-1])
            if len(held) > HELD_WORDS:
                yield word_rows(vocabulary, held)
                vocabulary, held = Vocabulary(), np.zeros(0, np.int64)
            if n_pairs > HELD_PAIRS:
                yield pair_rows(pairs)
                pairs, n_pairs = [], 0
        if len(held):
            yield word_rows(vocabulary, held)
        if pairs:
            yield pair_rows(pairs)

    def word_rows(vocabulary: Vocabulary, held: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(vocabulary.hashes[:, 0])
        return dealt(WORD, parts, vocabulary.hashes[order, 0], vocabulary.hashes[order, 1], held[order])

    def pair_rows(pairs: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(pairs), return_counts=True)
        return dealt(PAIR, parts, values, None, counts.astype(np.int64))

    return texts.mapInArrow(counted, ROWS)


def _probes(keys: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The bit of (key, level) for each hash function, within its part of so many bits."""
    with np.errstate(over="ignore"):
        x = (keys + np.uint64(level * _MIX & 0xFFFFFFFFFFFFFFFF)) * _ROUNDS[0]
        x = (x ^ (x >> np.uint64(33))) * _ROUNDS[1]
        x ^= x >> np.uint64(29)
        for i in range(HASHES):
            yield ((x * _PROBES[i] >> _32) * sizes) >> _32


def filled(keys: np.ndarray, levels: np.ndarray, per_entry: int = BITS_PER_ENTRY) -> bytes:
    """The filter of one part: each key with each of its levels."""
    size = -(-max(64, int(levels.sum()) * per_entry) // 64) * 64
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for at in _probes(keys, level, np.uint64(size)):
            bits[at.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


MADE = "kind int, part int, bits binary, high binary, low binary, n binary, total double, distinct long, read double"


def made(rows: DataFrame, per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """``MADE`` of each part of ``ROWS``: its filter, its sums, the sorted table of a part of words, and of a part of pairs the sums by context."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for kind, part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "high", "low", "n"))):
                if (kind, part) != at and held:
                    yield finished(*at, held)
                    held = []
                at = kind, part
                held.append(blobs)
        if held:
            yield finished(*at, held)

    def finished(kind: int, part: int, held: list[list[bytes | None]]) -> pa.RecordBatch:
        high = np.frombuffer(b"".join(h for h, _, _ in held), np.uint64)
        low = np.frombuffer(b"".join(x for _, x, _ in held), np.uint64) if kind == WORD else None
        high, low, n = summed(high, low, np.frombuffer(b"".join(x for _, _, x in held), np.float64 if kind == CONTEXT else np.int64))
        levels = level_of(n, CONTEXT_BASE if kind == CONTEXT else BASE)
        read = MEANS[levels] if kind != CONTEXT else n
        blobs: list[bytes | None] = [None] * 3
        if kind == WORD:
            blobs = [high.tobytes(), low.tobytes(), n.tobytes()]
        elif kind == PAIR:
            halves, _, sums = summed(unmixed(high) >> _32, None, read)
            blobs = [halves.astype(np.uint32).tobytes(), None, sums.tobytes()]
        values = [kind, part, filled(high, levels, per_entry), *blobs, float(n.sum()), len(n), float(read.sum())]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in MADE.split(", ")])

    return rows.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(parts, MADE)


def context_rows(pairs: DataFrame, parts: int) -> DataFrame:
    """``ROWS`` of the contexts of ``pairs`` (high, n: sums by context)."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, sums, size = [], [], 0
        for batch in batches:
            for high, n in zip(batch.column("high").to_pylist(), batch.column("n").to_pylist()):
                halves.append(np.frombuffer(high, np.uint32))
                sums.append(np.frombuffer(n, np.float64))
                size += len(halves[-1])
                if size > HELD_PAIRS:
                    yield rows(halves, sums)
                    halves, sums, size = [], [], 0
        if size:
            yield rows(halves, sums)

    def rows(halves: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        high, _, n = summed(context_key(np.concatenate(halves).astype(np.uint64) << _32), None, np.concatenate(sums))
        return dealt(CONTEXT, parts, high, None, n)

    return pairs.mapInArrow(contexts, ROWS)


class LogFrequencyFilter:
    """A file of filters and of exact counts, or one that Spark sends to every worker's host by name.

    For each kind, parts start at ``starts`` (bytes) and have ``sizes`` bits;
    ``table`` is where the words' hashes and counts begin, and their number.
    """

    def __init__(self, path: str, sent: bool, starts: list[np.ndarray], sizes: list[np.ndarray], table: tuple[int, int, int, int]) -> None:
        self.path, self.sent, self.starts, self.sizes, self.table = path, sent, starts, sizes, table
        self._file: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_file": None}

    @property
    def file(self) -> np.ndarray:
        if self._file is None:
            path = SparkFiles.get(self.path) if self.sent else self.path
            self._file = np.asarray(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else np.zeros(0, np.uint8)
        return self._file

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: the first level that is missing, less one."""
        out = np.zeros(len(keys), np.int64)
        home = home_of(keys, len(self.starts[kind]))
        live = np.flatnonzero(self.sizes[kind][home])
        keys, start, size = keys[live], self.starts[kind][home[live]], self.sizes[kind][home[live]].astype(np.uint64)
        level = 1
        while len(live):
            hit = np.arange(len(live))
            for k in range(HASHES):  # most misses end at the first probe
                at = next(islice(_probes(keys[hit], level, size[hit]), k, None)).astype(np.int64)
                hit = hit[(self.file[start[hit] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            live, keys, start, size = live[hit], keys[hit], start[hit], size[hit]
            out[live] = level
            level += 1
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The exact count of each word."""
        at_high, at_low, at_n, rows = self.table
        high, low, n = (self.file[at : at + 8 * rows].view(kind) for at, kind in ((at_high, np.uint64), (at_low, np.uint64), (at_n, np.int64)))
        out = np.zeros(len(hashes), np.int64)
        at, live = np.searchsorted(high, hashes[:, 0]), np.arange(len(hashes))
        while len(live):  # once, but for words that agree in half of their hash
            inside = at < rows
            live, at = live[inside], at[inside]
            same = high[at] == hashes[live, 0]
            live, at = live[same], at[same]
            found = low[at] == hashes[live, 1]
            out[live[found]] = n[at[found]]
            live, at = live[~found], at[~found] + 1
        return out


@dataclass(frozen=True)
class Model:
    """What scoring needs on every worker; the filter is mapped."""

    filter: LogFrequencyFilter
    train_tokens: int
    distinct: int
    read_tokens: float
    smoothing: tuple[float, float] = GRID[0]


def parts_for(size: int) -> int:
    return max(1, min(-(-size // PART_BYTES), max(SMALL_PARTS, -(-size // LARGE_PART_BYTES))))


def placed(tables: list[DataFrame], parts: list[int]) -> LogFrequencyFilter:
    """The file of all parts of ``tables`` (``MADE``): tasks write each part to its place."""
    spark = tables[0].sparkSession
    sizes = F.col("kind"), F.col("part"), F.length("bits").alias("bytes"), F.when(F.col("kind") == WORD, F.length("high")).otherwise(0).alias("rows")
    found = [r for t in tables for r in t.select(*sizes).toLocalIterator()]
    start, bits, rows = [np.zeros(p, np.int64) for p in parts], [np.zeros(p, np.int64) for p in parts], np.zeros(parts[WORD] + 1, np.int64)
    for r in found:
        bits[r.kind][r.part] = r.bytes
        if r.kind == WORD:
            rows[r.part + 1] = r.rows
    end = 0
    for kind in range(3):
        start[kind][:] = end + np.cumsum(bits[kind]) - bits[kind]
        end += int(bits[kind].sum())
    whole = int(rows.sum())
    words_at = np.cumsum(rows)
    table = (end, end + whole, end + 2 * whole)

    folder = shared_folder(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    mapped = at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"  # a path without a scheme is the default file system's
    local = at.toUri().getPath() if mapped else tempfile.mkdtemp()
    os.makedirs(local, exist_ok=True)
    path = f"{local}/gristmill-filter-{uuid.uuid4().hex}"
    with open(path, "wb") as file:
        file.truncate(end + 3 * whole)

    def put(row: dict) -> None:
        """A task that is run again writes the same bytes to the same place."""
        with open(path, "r+b") as file:
            file.seek(start[row["kind"]][row["part"]])
            file.write(row["bits"])
            if row["kind"] == WORD:
                for at, column in zip(table, ("high", "low", "n")):
                    file.seek(at + words_at[row["part"]])
                    file.write(row[column])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                put(batch.slice(k, 1).to_pylist()[0])
        yield pa.RecordBatch.from_pydict({"done": [True]})

    for made_parts in tables:
        slim = made_parts.select("kind", "part", "bits", *[F.when(F.col("kind") == WORD, F.col(c)).alias(c) for c in ("high", "low", "n")])
        if mapped:
            slim.mapInArrow(written, "done boolean").write.format("noop").mode("overwrite").save()
        else:  # a shared folder that is no mounted path
            for row in slim.toLocalIterator():
                put(row.asDict())
    if not mapped:
        spark.sparkContext.addFile(path)
    return LogFrequencyFilter(path if mapped else os.path.basename(path), not mapped, start, [b * 8 for b in bits], (*table, whole // 8))


def fit(texts: DataFrame, per_entry: int = BITS_PER_ENTRY) -> Model:
    """The model of ``texts`` (column text), with the first smoothing of ``GRID``."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(size)
    counted = cut(made(count_ngrams(texts, parts), per_entry), "ngrams")
    contexts = cut(made(context_rows(counted.where(F.col("kind") == PAIR).select("high", "n"), parts), per_entry), "contexts")
    total = counted.where(F.col("kind") == WORD).agg(F.sum("total"), F.sum("distinct"), F.sum("read")).first()
    return Model(placed([counted, contexts], [parts] * 3), int(total[0] or 0), total[1] or 0, total[2] or 0.0)


class Reader:
    """Reads of one task: of words once for many batches, of pairs once a batch."""

    def __init__(self, model: Model) -> None:
        self.model, self.vocabulary, self.of_words = model, Vocabulary(), np.empty((3, 0))
        self.start = UPPER[model.filter.levels(CONTEXT, context_key(np.array([START])))][0]

    def read(self, texts: list[str | None]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, and for each of them its exact count, P(w), c(v, w) and s(v)."""
        probe = self.model.filter
        if len(self.vocabulary.hashes) > PROBED_WORDS:
            self.vocabulary, self.of_words = Vocabulary(), np.empty((3, 0))
        tokens = Tokens(texts, self.vocabulary)
        new = self.vocabulary.hashes[self.of_words.shape[1] :]
        alone = (MEANS[probe.levels(WORD, new[:, 0])] + ADDED) / (self.model.read_tokens + ADDED * (self.model.distinct + 1))
        self.of_words = np.concatenate([self.of_words, [probe.counts(new), alone, UPPER[probe.levels(CONTEXT, context_key(new[:, 0]))]]], axis=1)
        pairs, at = np.unique(tokens.pairs(), return_inverse=True)  # frequent ones take the most probes
        joint = MEANS[probe.levels(PAIR, pairs)][at]
        known, alone, after = self.of_words
        total = np.empty(len(tokens.codes))
        total[1:] = after[tokens.codes[:-1]]
        total[tokens.starts] = self.start
        return tokens, known[tokens.codes], alone[tokens.codes], joint, np.maximum(total, joint)


def log_likelihood(alone: np.ndarray, joint: np.ndarray, total: np.ndarray, smoothing: tuple[float, float]) -> np.ndarray:
    weight = smoothing[0] + smoothing[1] * total
    return np.log10((joint + weight * alone) / (total + weight))


def _times(*columns: np.ndarray) -> np.ndarray:
    """How often each row of the columns occurs among them."""
    order = np.lexsort(columns[::-1])
    new = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0))
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def without_own(tokens: Tokens, alone: np.ndarray, joint: np.ndarray, total: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(w), c(v, w) and s(v) less what each token's own text has added to them."""
    text = np.repeat(np.arange(len(tokens.sizes)), tokens.sizes)
    before = np.append(-1, tokens.codes[:-1])
    before[tokens.starts] = -1
    joint_left = np.maximum(joint - _times(text, tokens.pairs()), 0.0)
    left = np.maximum(alone - _times(text, tokens.codes) / whole, ADDED / whole)
    return left, joint_left, np.maximum(total - _times(text, before), joint_left)


def smoothed(model: Model, texts: DataFrame, grid: tuple[tuple[float, float], ...] = GRID, counted: bool = False) -> Model:
    """The model with the smoothing that gives ``texts`` (column text) the highest probability; ``counted``: the model has counted them, and each is left out of its own score."""
    whole = model.read_tokens + ADDED * (model.distinct + 1)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(model), np.zeros(len(grid))
        for batch in slices(batches):
            tokens, _, *read = reader.read(batch.column("text").to_pylist())
            if counted:
                read = without_own(tokens, *read, whole)
            sums += [log_likelihood(*read, s).sum() for s in grid]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(sums)], names=["at", "value"])

    sums = texts.mapInArrow(tried, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    best = max(sums, key=lambda r: (round(r.value, 3), -r.at), default=None)
    return model if best is None else replace(model, smoothing=grid[best.at])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text and others) with n_tokens, n_known, base_score and score instead of the text."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    whole = model.train_tokens + ADDED * (model.distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in slices(batches):
            tokens, known, *read = reader.read(batch.column("text").to_pylist())
            values = (known > 0).astype(np.int64), np.log10((known + ADDED) / whole), log_likelihood(*read, model.smoothing)
            sums = [pa.array(np.add.reduceat(v, tokens.starts)) for v in values]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(tokens.sizes), *sums], names=[*(f.name for f in keep), "n_tokens", "n_known", "base_score", "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(score, kept + "n_tokens long, n_known long, base_score double, score double")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold == HELD_OUT).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")).select("text"))
    model = smoothed(model, documents(spark, sf_dir).where(fold == INNER_FOLD).select("text"), counted=True)
    out = scored(docs, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
