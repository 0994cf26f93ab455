"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made where the documents are; only distinct ones travel.
Their 64 bits are reordered so that correlated bits stand together in bytes.
If parts of the bits have thresholds t with sum(t + 1) = threshold + 1, two
fingerprints within the threshold are within t in some part.  Dynamic
programming over (byte, thresholds left) chooses parts and their unequal
thresholds at once, at the least estimated cost: rows to shuffle, and
candidates from the distances that the bytes' own counts give.

A part of width w with threshold t is probed by its C(w, t) ways of leaving t
bits out: within t, some way agrees.  Rows are sorted by that key, candidates
are verified on all bits, and a key's links come out as a spanning star.  A
key with more than ``MOST_IN_KEY`` distinct fingerprints is refined: its other
bits are split into threshold + 1 groups, one of which must agree as well.
What is still too large after ``REFINEMENTS`` rounds is dealt in pairs of
blocks, so no task holds more than two blocks of a key.

The pipeline's stage takes near copies by Jaccard similarity instead.  A pair
of 0.8 differs in 15 % of the bits on average, so its fingerprints are longer
and cut into many parts (``near_parts``): those that differ in fewer bits than
there are parts agree in one by the pigeonhole principle, most of the others
by chance.  Each word's bits are reordered as above, a part is a group of
correlated bits of one word, and its threshold is 0, or -1 (not looked up)
for the groups in which most pairs agree; at such distances a threshold of 1
probes more rows than further parts do.  What agrees in a part and is close in
further bits is verified by the exact similarity.

Edge cases: a null text counts as empty; no words make fingerprint 0, which
links like any other; fewer words than a shingle make one shingle; rows that
repeat share a fingerprint; a null id is never a component's name unless all
its ids are null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, documents, lower_ascii, slices, words
from gristmill.llm.components import components

#: Fixed values of the contract.
SEED = 42
WORDS = 3
THRESHOLD = 2

BITS = 64
#: Hashes whose bits are unpacked at a time.
VOTE_ROWS = 1 << 17
MOST_IN_KEY = 2048
REFINEMENTS = 2
#: The cost of shuffling a row, in verified candidates.
ROW_COST = 60

Part = tuple[int, int, int]  # first byte, byte after the last, threshold


def shingles(tokens: list[str], size: int) -> list[str]:
    """All runs of ``size`` words, repeats included; the whole sequence where there are fewer."""
    if not tokens:
        return []
    if len(tokens) <= size:
        return [" ".join(tokens)]
    return list(map(" ".join, zip(*(tokens[k:] for k in range(size)))))


def vote(hashes: list[int] | np.ndarray, lengths: list[int]) -> np.ndarray:
    """One fingerprint for each run of ``lengths`` hashes: bits set in over half of the run; 0 for an empty run."""
    out = np.zeros(len(lengths), np.uint64)
    sizes = np.array(lengths, np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.ascontiguousarray(hashes, "<u8")
    starts = (np.cumsum(sizes) - sizes)[full]
    counts = np.zeros((len(full), BITS), np.int64)
    for low in range(0, len(flat), VOTE_ROWS):
        bits = np.unpackbits(flat[low : low + VOTE_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(starts, low, "right")) - 1
        inside = starts[first + 1 : int(np.searchsorted(starts, low + len(bits)))] - low
        runs = np.append(0, inside) if first >= 0 else inside
        counts[first : first + len(runs)] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, features: Callable[[list[str]], list[str]], seeds: tuple[int, ...] = (SEED,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp0, fp1, ...: one signed 64-bit fingerprint of the features of the lower-cased words for each seed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches):
            found = [features(words(lower_ascii(t or ""))) for t in batch.column("text").to_pylist()]
            lengths = [len(f) for f in found]
            columns = [vote([digest(s, seed) for f in found for s in f], lengths).view(np.int64) for seed in seeds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], names=names)

    names = ["id", *(f"fp{k}" for k in range(len(seeds)))]
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(made, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:])).withColumnRenamed("id", id_col)


#: Near duplicates: sets of five-word shingles of Jaccard similarity 0.8 (4 in 5) and more.  A bit of their SimHash
#: fingerprints agrees with chance 1 - acos(8/9) / pi = 0.85; a pair of 0.8 agrees in no part with chance MISSED.
NEAR_WORDS = 5
NEAR_OF, NEAR_IN = 4, 5
AGREE = 1 - acos(2 * NEAR_OF / (NEAR_IN + NEAR_OF)) / pi
MISSED = 0.0002
#: Sets of fewer hashes are near only if they are equal; those of 4 and 5 are near only if one holds the other.
NEAR_LEAST = 4
#: Words of a fingerprint beyond its parts that rows carry, and the bits that may differ there: 5 deviations above a
#: pair of 0.8 and 6 below unrelated ones.
CARRIED, CARRIED_APART = 3, 54
STAR_ROUNDS = 3
#: Words of a parity sketch: each shingle flips one of its bits.
PARITY = 8
#: Tables of 16 bytes a row are broadcast up to so many rows, after counting; larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 19


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in shingles(words(lower_ascii(text or "")), NEAR_WORDS)], np.uint64))


def near_parts(n: int) -> tuple[int, int]:
    """(parts, bits of a part) of the fingerprints of ``n`` sets, at the least estimated cost in rows and candidates.

    Fingerprints that differ in fewer bits than there are parts agree in one;
    those further apart do by chance, for which there are enough parts.
    """
    width = min(range(8, 33), key=lambda w: AGREE**-w * (ROW_COST + n / 2 ** (w + 1)))
    return ceil(log(1 / MISSED) / AGREE**width), width


def near_words(parts: int, width: int) -> int:
    """Words of a fingerprint that hold the parts, each within one word."""
    return ceil(parts / (BITS // width))


def near_order(vertices: DataFrame, parts: int, width: int) -> list[int]:
    """The bits of the fingerprints ``fp``, ``width`` for each part: correlated bits of a word together, and of all such groups those in which the fewest pairs agree."""
    count = near_words(parts, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, BITS * BITS + 1), np.int64)
        for batch in batches:
            prints = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(batch.num_rows, -1)
            for k in range(count):
                total[k] += _moments(prints[:, k])
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], names=["word", "sums"])

    def ordered(table: pa.Table) -> pa.Table:
        sums = np.sum([np.array(x.values) for x in table.column("sums")], axis=0)
        joint, strength = _correlations(sums)
        groups = _grown(strength, width)[: BITS // width]
        word = table.column("word")[0].as_py()
        return pa.table({"agree": [agreement(joint, g) for g in groups], "word": pa.array([word] * len(groups), pa.int32()), "bits": pa.array([[BITS * word + b for b in g] for g in groups], pa.list_(pa.int32()))})

    sums = vertices.select("fp").mapInArrow(partial, "word int, sums array<long>")
    groups = sums.groupBy("word").applyInArrow(ordered, "agree double, word int, bits array<int>").collect()
    if not groups:
        return list(range(parts * width))
    least = sorted(groups, key=lambda r: (r.agree, r.word, r.bits))[:parts]
    return [b for r in sorted(least, key=lambda r: (r.word, r.bits)) for b in r.bits]


def agreement(joint: np.ndarray, group: list[int]) -> float:
    """The estimated chance that two rows agree in all bits of ``group``, each bit depending on the one before it; ``joint`` is how often two bits are both set."""
    rate = np.diag(joint)
    single = rate**2 + (1 - rate) ** 2
    chance = single[group[0]]
    for a, b in zip(group, group[1:]):
        both = joint[a, b]
        cells = np.array([both, rate[a] - both, rate[b] - both, 1 - rate[a] - rate[b] + both])
        chance *= (cells**2).sum() / single[a]
    return float(chance)


def near_fingerprint(held: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of a set of hashes in ``size`` words: bits set in over half of the hashes, mixed anew for each word."""
    counts = np.zeros(BITS * size, np.int64)
    salts = np.arange(1, size + 1, dtype=np.uint64)
    for low in range(0, len(held), 255):
        bits = np.unpackbits(_mixed_by(held[low : low + 255, None], salts).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(held), bitorder="little").view("<u8")


def small_keys(held: np.ndarray) -> list[int]:
    """Keys that sets of 4 and 5 hashes share if one holds the other: all, and all but one."""
    subsets = [held] if len(held) == 4 else [np.delete(held, k) for k in range(5)] if len(held) == 5 else []
    return [-1 - (xxhash.xxh64_intdigest(x.tobytes(), SEED) >> 1) for x in subsets]


def parity(held: np.ndarray) -> np.ndarray:
    """For each bit of a sketch, whether the set has an odd number of the hashes that fall on it.

    The bits in which two sketches differ are at most as many as the hashes
    that only one of the sets has.
    """
    odd = np.bincount((held % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def may_be_near(n: Column, m: Column, one: Column, other: Column) -> Column:
    """False only for sets of n and m hashes whose sketches show that they are below 0.8; no pair of 0.8 is left out."""
    apart = sum((F.bit_count(one[k].bitwiseXOR(other[k])) for k in range(1, PARITY)), F.bit_count(one[0].bitwiseXOR(other[0])))
    sizes = NEAR_IN * F.least(n, m) >= NEAR_OF * F.greatest(n, m)
    return sizes & ((NEAR_IN + NEAR_OF) * apart <= (NEAR_IN - NEAR_OF) * (n + m))


def _with_sets(docs: DataFrame, schema: str, columns: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """The columns of ``docs`` but for text, and those that ``columns`` makes of the texts' shingle sets."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [*(f.name for f in keep), *(c.split()[0] for c in schema.split(", "))]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *columns(found)], names=names)

    return docs.mapInArrow(made, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), schema]))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Vertex (a 128-bit hash of the shingle set), n (its size), its fingerprint in ``size`` words, the keys of small sets and its parity sketch for each row of ``docs`` (text and others)."""

    def columns(found: list[np.ndarray]) -> list[pa.Array]:
        vertex = pa.array([xxhash.xxh3_128_digest(f.tobytes(), SEED) for f in found], pa.binary())
        prints = pa.array([near_fingerprint(f, size).view(np.int64) for f in found], pa.list_(pa.int64()))
        small = pa.array(list(map(small_keys, found)), pa.list_(pa.int64()))
        sketches = pa.array([parity(f) for f in found], pa.list_(pa.int64()))
        return [vertex, pa.array(list(map(len, found)), pa.int32()), prints, small, sketches]

    return _with_sets(docs, "vertex binary, n int, fp array<long>, small array<long>, parity array<long>", columns)


def part_rows(vertices: DataFrame, parts: int, width: int, order: list[int] | None = None) -> DataFrame:
    """(key, vertex, fp0, ...): a row for each of ``vertices`` (vertex, fp, small) and part of its fingerprint, and for each key of small sets.

    ``order`` has the bits of one part after the other.
    """
    places = np.arange(parts * width) if order is None else np.array(order)
    powers = np.left_shift(1, np.arange(width, dtype=np.int64))
    names = ["key", "vertex", *(f"fp{k}" for k in range(CARRIED))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                vertex = batch.column("vertex").to_numpy(zero_copy_only=False).astype(np.int64)
                prints = batch.column("fp").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(vertex), -1)
                bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, places].reshape(len(vertex), parts, width)
                keys = (bits @ powers) + (np.arange(parts, dtype=np.int64) << width)
                lists = batch.column("small")
                small = np.repeat(np.arange(len(vertex)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                at = np.append(np.repeat(np.arange(len(vertex)), parts), small)
                key = np.append(keys.ravel(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, vertex[at], *(prints[at, k] for k in range(-CARRIED, 0)))], names=names)

    return vertices.select("vertex", "fp", "small").mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def close_rows(rows: DataFrame, most: int = MOST_IN_KEY) -> DataFrame:
    """(key, vertex): the vertices of ``rows`` (key, vertex, fp0, ...) that others of their key are close to, by the bits they carry."""

    def close(fps: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(f[a] ^ f[b]).astype(np.int64) for f in fps) <= CARRIED_APART

    return _joined_rows(rows.select("key", "vertex", *(f"fp{k}" for k in range(CARRIED))), close, most)


def near_rows(rows: DataFrame, most: int = MOST_IN_KEY) -> DataFrame:
    """(key, vertex): the vertices of ``rows`` (key, vertex, n, parity) that may be near others of their key, as ``may_be_near`` says."""

    def near(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = (columns[0][x].astype(np.int64) for x in (a, b))
        apart = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in columns[1:])
        return (NEAR_IN * np.minimum(n, m) >= NEAR_OF * np.maximum(n, m)) & ((NEAR_IN + NEAR_OF) * apart <= (NEAR_IN - NEAR_OF) * (n + m))

    return _joined_rows(rows.select("key", "vertex", F.col("n").cast("long").alias("n"), *(F.col("parity")[k].alias(f"p{k}") for k in range(PARITY))), near, most)


def _joined_rows(rows: DataFrame, test: Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray], most: int) -> DataFrame:
    """(key, vertex): the vertices of ``rows`` (key, vertex and others) that ``test`` joins with others of their key, named by what they join.

    ``test`` gets the other columns and two arrays of row numbers.  Groups of
    the same vertices have the same name, from whatever part they come.  A
    key of more than ``most`` rows is passed on whole.
    """
    names = rows.columns

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if large is not None:
                end = int(np.searchsorted(columns[0], large, "right"))
                yield named(columns[0][:end], columns[1][:end])
                columns = [c[end:] for c in columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if len(held[0]) >= 1 << 15:
                end = int(np.searchsorted(held[0], held[0][-1]))
                yield grouped_keys([c[:end] for c in held])
                held = [c[end:] for c in held]
                if len(held[0]) > most:
                    large = held[0][0]
                    yield named(*held[:2])
                    held = None
        if held is not None and len(held[0]):
            yield grouped_keys(held)

    def named(key: np.ndarray, vertex: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(vertex)], names=["key", "vertex"])

    def grouped_keys(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, vertex, others = *columns[:2], [c.view(np.uint64) for c in columns[2:]]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(key)))
        sizes, ends = np.repeat(times, times), np.repeat(starts + times, times)
        root = np.arange(len(key))
        live = np.flatnonzero((sizes > 1) & (sizes <= most))
        step = 1
        while len(live):
            live = live[live + step < ends[live]]
            a = live[test(others, live, live + step)]
            _unite(root, a, a + step)
            step += 1
        name = np.zeros(len(key), np.uint64)
        np.add.at(name, root, _mixed(vertex.view(np.uint64), 1))
        held = np.flatnonzero(np.bincount(root, minlength=len(key))[root] > 1)
        whole = np.flatnonzero(sizes > most)
        return named(np.append(name[root[held]].view(np.int64), key[whole]), np.append(vertex[held], vertex[whole]))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(joined, "key long, vertex long").distinct()


def content(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The name of a row's id and text, 128 bits."""
    return F.xxhash64(F.lit(1), id_col, text_col), F.xxhash64(F.lit(2), text_col, id_col)


def checked(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(vertex, held): the shingle sets of the vertices in ``wanted`` (vertex, one, two: a row that has it), read from the texts again."""
    one, two = content(id_col, text_col)
    texts = docs.select(one.alias("one"), two.alias("two"), F.col(text_col).alias("text"))
    asked = texts.join(checked(wanted, wanted.count()), ["one", "two"]).select("vertex", "text")
    lists = _with_sets(asked, "held array<long>", lambda found: [pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))])
    return lists.dropDuplicates(["vertex"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (vertex, held) are of similarity 0.8 and more, by their exact intersection."""
    both = pairs.join(sets.select(F.col("vertex").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("vertex").alias("b"), F.col("held").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(NEAR_IN * shared >= NEAR_OF * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) between vertices of ``rows`` (key, vertex, n, parity): enough of the near pairs to join what they all join.

    In each round, one vertex of a key is held against those of the key's
    vertices that it is not joined with.  Each key draws its own, from one
    of its components so far, so that a large group that many keys share is
    held against many of its members.  Keys whose vertices are joined by then
    are done; only between what is still apart in a key are all pairs held
    against each other.  Sizes and parity sketches decide inside the joins
    which pairs come out of them, so no row is made for other pairs.
    """
    near = may_be_near(F.col("n"), F.col("m"), F.col("p"), F.col("q"))
    links, held = None, rows.withColumn("component", F.col("vertex"))
    for k in range(STAR_ROUNDS):
        drawn = F.struct(F.xxhash64(F.lit(k), "key", "component"), F.xxhash64(F.lit(k), "key", "vertex"), "component", "vertex", "n", "parity")
        lead = held.groupBy("key").agg(F.max(drawn).alias("o")).select("key", F.col("o.vertex").alias("a"), F.col("o.n").alias("m"), F.col("o.component").alias("c"), F.col("o.parity").alias("q"))
        chosen = held.select("key", F.col("vertex").alias("b"), "n", F.col("component").alias("d"), F.col("parity").alias("p")).join(lead, "key").where((F.col("c") != F.col("d")) & near)
        found = cut(alike(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets), "near-star")
        links = found if links is None else links.union(found)
        joined = rows.join(components(links), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
        apart = joined.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        held = cut(joined.join(apart, "key", "left_semi"), "near-apart")
        if held.isEmpty():
            return links
    one = held.select("key", F.col("vertex").alias("a"), "n", F.col("component").alias("c"), F.col("parity").alias("p"))
    other = held.select("key", F.col("vertex").alias("b"), F.col("n").alias("m"), F.col("component").alias("d"), F.col("parity").alias("q"))
    rest = one.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & near).select("a", "b").distinct()
    return links.union(alike(rest, sets))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those that are near another of smaller id; of rows that repeat id and text, one.

    Rows without an id stay if no document with one is near them.
    """
    one, two = content(id_col, text_col)
    ids = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), one.alias("one"), two.alias("two"))
    parts, width = near_parts(docs.count())
    made = cut(signatures(docs.select(ids.alias("id"), F.col(text_col).alias("text")), near_words(parts, width) + CARRIED), "signatures")
    least = made.groupBy("vertex").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "fp", "small", "parity")])
    vertices = cut(least, "vertices")
    short = F.xxhash64("vertex")
    large = vertices.where(F.col("n") >= NEAR_LEAST).withColumn("vertex", short)
    close = cut(close_rows(part_rows(large, parts, width, near_order(large, parts, width))), "close")
    sketched = vertices.select(short.alias("short"), "vertex", "n", "parity")
    near = near_rows(close.withColumnRenamed("vertex", "short").join(sketched.drop("vertex"), "short").withColumnRenamed("short", "vertex"))
    rows = cut(near.withColumnRenamed("vertex", "short").join(sketched, "short").drop("short"), "near-rows")
    wanted = vertices.join(rows.select("vertex").distinct(), "vertex", "left_semi").select("vertex", "id.one", "id.two")
    sets = cut(sets_of(docs, cut(wanted, "wanted"), id_col, text_col), "sets")
    linked = components(near_links(rows, sets))
    named = vertices.select("vertex", "id").join(linked, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    stays = named.groupBy("component").agg(F.min("id").alias("stays"))
    stay = named.join(stays, "component").where(F.col("id") == F.col("stays")).select("vertex", F.lit(True).alias("stay"))
    contents = made.select("vertex", "id").join(named.select("vertex", F.col("id").alias("first")), "vertex").join(stay, "vertex", "left")
    goes = F.col("stay").isNull() | (F.col("id") != F.col("first"))
    marked = contents.groupBy("id.one", "id.two").agg(F.max(goes).alias("goes"), F.count("*").alias("times")).where("goes OR times > 1")
    marks = cut(marked.drop("times"), "marks")
    return _marked_dropped(docs, marks, one, two)


def _marked_dropped(docs: DataFrame, marks: DataFrame, one: Column, two: Column) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (one, two, goes) does not name, and one of each name that it does not drop."""
    small = checked(marks, marks.count())
    named = docs.select(one.alias("one"), two.alias("two"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    plain = named.join(small, ["one", "two"], "left_anti").select("row.*")
    repeats = named.join(small.where("NOT goes"), ["one", "two"], "left_semi").dropDuplicates(["one", "two"])
    return plain.union(repeats.select("row.*"))


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of`` (a flat array of ``size`` numbers for a batch): one partial sum for each task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for row in fps.mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row.at] = row.n
    return out


def _moments(values: np.ndarray) -> np.ndarray:
    """How often each two of the 64 bits are both set, and the number of rows."""
    bits = _unpacked(values).astype(np.float32)
    return np.append(np.rint(bits.T @ bits).astype(np.int64).ravel(), len(values))


def _correlations(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often two bits are both set, as a share, and how strongly they are correlated, from summed ``_moments``."""
    n = max(1, int(sums[-1]))
    joint = sums[:-1].reshape(BITS, BITS) / n
    rate = np.diag(joint)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    strength = np.abs((joint - np.outer(rate, rate)) / np.outer(spread, spread)).round(9)
    np.fill_diagonal(strength, 0)
    return joint, strength


def _grown(strength: np.ndarray, size: int) -> list[list[int]]:
    """Groups of ``size`` bits, each grown greedily around the bit that is most correlated with those left; the last may be smaller."""
    left, groups = list(range(BITS)), []
    while left:
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(group[0])
        while left and len(group) < size:
            group.append(max(left, key=lambda b: (strength[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(group)
    return groups


def correlated_order(fps: DataFrame) -> list[int]:
    """The 64 bits, in bytes of correlated bits."""
    _, strength = _correlations(_summed(fps, BITS * BITS + 1, _moments))
    return [b for group in _grown(strength, 8) for b in group]


def reorder(fps: np.ndarray, order: list[int]) -> np.ndarray:
    return np.packbits(np.ascontiguousarray(_unpacked(fps)[:, order]), axis=1, bitorder="little").view("<u8").ravel()


def byte_distances(fps: DataFrame, order: list[int]) -> tuple[int, np.ndarray]:
    """The number of rows, and for each byte in the new order the chance of each distance between two rows."""

    def histograms(values: np.ndarray) -> np.ndarray:
        rows = reorder(values, order).view(np.uint8).reshape(-1, 8)
        return np.concatenate([np.bincount(rows[:, k], minlength=256) for k in range(8)])

    counts = _summed(fps, 8 * 256, histograms).reshape(8, 256).astype(np.float64)
    n = counts[0].sum()
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    chances = np.zeros((8, 9))
    for k in range(8):
        pairs = np.outer(counts[k], counts[k]) / max(n * n, 1)
        chances[k] = [pairs[apart == d].sum() for d in range(9)]
    return int(n), chances


def choose_parts(n: int, chances: np.ndarray, threshold: int) -> list[Part]:
    """Parts of whole bytes and their thresholds of least estimated cost, with sum(t + 1) = threshold + 1.

    Bytes that no part takes have threshold -1: nothing is looked up there.
    """

    def cost(low: int, high: int, t: int) -> float:
        width = 8 * (high - low)
        pmf = np.ones(1)
        for k in range(low, high):
            pmf = np.convolve(pmf, chances[k])
        candidates = sum(pmf[d] * comb(width - d, t - d) for d in range(t + 1)) * n * n / 2
        return candidates + ROW_COST * n * comb(width, t)

    best: dict[tuple[int, int], tuple[float, list[Part]]] = {(0, 0): (0.0, [])}
    for at in range(1, 9):
        for units in range(threshold + 2):
            options = [best[at - 1, units]] if (at - 1, units) in best else []
            for low in range(at):
                for t in range(min(units, 8 * (at - low))):
                    if (low, units - t - 1) in best and t <= 5:
                        before = best[low, units - t - 1]
                        options.append((before[0] + cost(low, at, t), [*before[1], (low, at, t)]))
            if options:
                best[at, units] = min(options, key=lambda o: o[0])
    return best[8, threshold + 1][1]


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    return _mixed_by(values, np.uint64(salt))


def _mixed_by(values: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """``values`` mixed with ``salts``, broadcast against each other."""
    with np.errstate(over="ignore"):
        x = (values ^ (salts * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def masks_of(parts: list[Part]) -> list[int]:
    """The bits that each way of probing a part compares."""
    out = []
    for low, high, t in parts:
        bits = range(8 * low, 8 * high)
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in gone) for gone in combinations(bits, t)]
    return out


def probe_rows(fps: DataFrame, order: list[int], parts: list[Part]) -> DataFrame:
    """(key, used, *fps): a row for each fingerprint and way of probing; used are the bits that the key compares.

    ``fps`` has vertex, fp0, reordered here, and further fingerprints that only verify.
    """
    masks = masks_of(parts)
    names = fps.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
                fp = reorder(columns[1], order)
                keys = np.concatenate([_mixed(fp & np.uint64(m), k + 1) for k, m in enumerate(masks)]).view(np.int64)
                used = np.repeat(np.array(masks, np.uint64), len(fp)).view(np.int64)
                wide = [np.tile(c, len(masks)) for c in (columns[0], fp.view(np.int64), *columns[2:])]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(used), *map(pa.array, wide)], names=["key", "used", *names])

    return fps.mapInArrow(rows, "key long, used long, " + ", ".join(f"{n} long" for n in names))


def refine(rows: DataFrame, threshold: int) -> DataFrame:
    """The rows once for each of threshold + 1 groups of the bits not used yet, with keys that compare a group as well."""
    names = rows.columns

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            key, used, _, fp = (c.view(np.uint64) for c in columns[:4])
            for mask in np.unique(used):
                at = used == mask
                free = [b for b in range(BITS) if not int(mask) >> b & 1]
                for k in range(threshold + 1):
                    group = np.uint64(sum(1 << b for b in free[k :: threshold + 1]))
                    keys = _mixed(key[at] ^ _mixed(fp[at] & group, k + 1), k + 101)
                    wide = [keys, np.full(at.sum(), mask | group), *(c[at] for c in columns[2:])]
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)) for w in wide], names=names)

    return rows.mapInArrow(refined, rows.schema)


def in_blocks(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Rows of large keys, once for each pair of blocks that their own block is in."""
    sized = rows.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    other = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(rows.columns)


def verified(rows: DataFrame, accept: Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): links between vertices of one key that ``accept`` takes, as stars around one of each group that they join.

    Rows are sorted by key; row i is compared with row i + 1, i + 2, ... for
    as long as any key is that long.  ``accept`` gets the fingerprint columns
    and two arrays of row numbers.
    """
    names = [c for c in rows.columns if c not in ("key", "used")]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", *names)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if len(held[0]) >= 1 << 15 and held[0][0] != held[0][-1]:
                end = int(np.searchsorted(held[0], held[0][-1]))
                yield stars([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield stars(held)

    def stars(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, fps = columns[0], [c.view(np.uint64) for c in columns[2:]]
        root = np.arange(len(key))
        live = np.arange(len(key))
        step = 1
        while len(live):
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            other = live + step
            new = root[live] != root[other]
            a, b = live[new], other[new]
            good = accept(fps, a, b)
            _unite(root, a[good], b[good])
            step += 1
        at = np.flatnonzero(root != np.arange(len(key)))
        pairs = np.unique(np.stack([columns[1][root[at]], columns[1][at]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.select("key", *names).repartition("key").sortWithinPartitions("key", "vertex").mapInArrow(linked, "a long, b long")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i]; ``root`` holds the smallest member of each set before and after."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def within(threshold: int) -> Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
    return lambda fps, a, b: np.bitwise_count(fps[0][a] ^ fps[0][b]) <= threshold


def links(vertices: DataFrame, threshold: int, accept: Callable | None = None, most: int = MOST_IN_KEY, refinements: int = REFINEMENTS) -> DataFrame:
    """(a, b) between vertices (vertex, fp0, ...), which is read several times: the links, or enough of them to join what they join."""
    order = correlated_order(vertices.select("fp0"))
    n, chances = byte_distances(vertices.select("fp0"), order)
    rows = probe_rows(vertices, order, choose_parts(n, chances, threshold))
    accept = accept or within(threshold)
    found = []
    for level in range(refinements + 1):
        large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "large-keys")
        if large.isEmpty():
            found.append(verified(rows, accept))
            break
        found.append(verified(rows.join(large, "key", "left_anti"), accept))
        hot = cut(rows.join(large, "key", "left_semi"), "large-rows")
        if level == refinements:
            found.append(verified(in_blocks(hot, large, most), accept))
        else:
            rows = refine(hot, threshold)
    return reduce(DataFrame.union, found)


def grouped(fps: DataFrame, threshold: int, accept: Callable | None = None, id_col: str = "doc_id", most: int = MOST_IN_KEY) -> DataFrame:
    """``fps`` (id, fp0, ...) with component_id: the smallest id that links reach from the row, itself included.

    Rows with the same fingerprints are one vertex.
    """
    columns = [c for c in fps.columns if c != id_col]
    vertex = F.col("fp0") if len(columns) == 1 else F.xxhash64(*columns)
    named = fps.withColumn("vertex", vertex)
    vertices = cut(named.groupBy("vertex").agg(*[F.first(c).alias(c) for c in columns], F.min(id_col).alias("least")), "vertices")
    linked = components(links(vertices.drop("least"), threshold, accept, most))
    joined = vertices.select("vertex", "least").join(linked, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = joined.join(least, "component").select("vertex", "component_id")
    return named.join(labels, "vertex").select(*fps.columns, "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fps = cut(fingerprints(docs, lambda tokens: shingles(tokens, WORDS)), "fingerprints")
    out = grouped(fps, THRESHOLD)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
