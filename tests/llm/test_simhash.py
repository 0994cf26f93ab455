import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import simhash
from gristmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, component_id long"


def brute_components(values, threshold):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= threshold:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(values)):
        least[find(i)] = min(least.get(find(i), i), i)
    return [least[find(i)] for i in range(len(values))]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def scattered(seed, centres, members, flips, base_bits=64):
    """Fingerprints around a few centres; the first centre has most of them."""
    rng = random.Random(seed)
    out = []
    for c in range(centres):
        centre = rng.getrandbits(base_bits)
        for _ in range(members * 10 if c == 0 else members):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << bit
            out.append(value)
    return out


@pytest.mark.parametrize(("threshold", "most", "flips"), [(2, 2048, 4), (2, 12, 4), (8, 2048, 8), (8, 40, 7)])
def test_components_equal_brute_force(spark, threshold, most, flips):
    values = scattered(threshold + most, 12, 20, flips)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp0 long")
    got = {r.doc_id: r.component_id for r in simhash.grouped(fps, threshold, most=most).collect()}
    assert [got[i] for i in range(len(values))] == brute_components(values, threshold)


def test_fingerprints_equal_brute_force_and_edge_cases(spark):
    texts = [None, "", " \n\t", "one", "One two", "a b c", "a b c d a b c d", "x " * 5000, "Éa\xa0b\x1cc d", "a b c"]
    rows = [(i, t, None, None, None, 1, 2) for i, t in enumerate(texts)] + [(None, "a b c", "en", "s", 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    fps = simhash.fingerprints(docs, lambda t: simhash.shingles(t, 3))
    got = {r.doc_id: r.fp0 % (1 << 64) for r in fps.collect()}
    assert got == {r[0]: brute_fingerprint(r[1]) for r in rows}
    out = {r.doc_id: r.component_id for r in simhash.grouped(fps, 2).collect()}
    assert out[0] == out[1] == out[2] == 0 and out[9] == 5 and out[None] == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    fps = simhash.fingerprints(docs, lambda t: simhash.shingles(t, 3))
    assert simhash.grouped(fps, 2).count() == 0


def test_parts_keep_the_pigeonhole_sum(spark):
    values = [v - (1 << 63) for v in scattered(3, 5, 30, 3, 63)]
    fps = spark.createDataFrame([(v,) for v in values], "fp0 long")
    order = simhash.correlated_order(fps)
    assert sorted(order) == list(range(64))
    n, chances = simhash.byte_distances(fps, order)
    assert n == len(values) and abs(chances.sum(axis=1) - 1).max() < 1e-9
    for threshold in range(12):
        parts = simhash.choose_parts(10**6, chances, threshold)
        assert sum(t + 1 for _, _, t in parts) == threshold + 1
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0


def edited(seed=5):
    """Texts of 80 to 600 words, each with copies that a tail or a replaced block takes to similarities of 0.6 to 0.97."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(80, 600))]
        size = rng.randint(1, len(base) // 3)
        low = rng.randrange(len(base) - size)
        out += [base, base + [word() for _ in range(size)], base[:low] + [word() for _ in range(size)] + base[low + size :]]
    return [" ".join(t) for t in out]


def test_near_duplicates_equal_brute_force(spark):
    texts = edited()
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(root))
    names = {f"_{n}": F.lit(n) for n in ("one", "two", "goes", "times")} | {n: F.lit(n) for n in ("row", "one", "two", "goes", "vertex", "key", "keys", "n")}
    twice = docs.union(docs.limit(5)).withColumns(names)
    rows = simhash.drop_near_duplicates(twice).collect()
    assert sorted(r.doc_id for r in rows) == sorted(set(root)) and all(r[n] == n.removeprefix("_") for r in rows for n in names)


def test_near_candidates_come_from_parts_of_simhash_fingerprints(spark):
    rng = np.random.default_rng(8)
    parts, width = simhash.near_parts(400)
    size = -(-parts * width // 64) + simhash.CARRIED
    sets = [np.unique(rng.integers(1 << 63, size=n, dtype=np.uint64)) for n in [4, 5] * 20 + [300] * 100 + [301] * 60]
    near = [np.union1d(s[len(s) // 9 :], rng.integers(1 << 63, size=len(s) // 9, dtype=np.uint64)) if len(s) > 5 else s[1:] if len(s) == 5 else np.union1d(s, rng.integers(1 << 63, size=1, dtype=np.uint64)) for s in sets]
    prints = [simhash.near_fingerprint(s, size) for s in sets + near]
    majority = [2 * int(sum(int(h) >> 9 & 1 for h in simhash._mixed(s, 1))) > len(s) for s in sets]
    assert majority == [bool(int(f[0]) >> 9 & 1) for f in prints[: len(sets)]]
    rows = [(k, f.view(np.int64).tolist(), simhash.small_keys(s)) for k, (s, f) in enumerate(zip(sets + near, prints))]
    made = simhash.part_rows(spark.createDataFrame(rows, "vertex long, fp array<long>, small array<long>"), parts, width)
    keys, words = {}, {}
    for r in made.collect():
        keys.setdefault(r.key, set()).add(r.vertex)
        words[r.vertex] = np.array([r[f"fp{k}"] for k in range(simhash.CARRIED)]).view(np.uint64)
    distance = {(a, b): np.bitwise_count(words[a] ^ words[b]).sum() for g in keys.values() for a in g for b in g if a < b}
    expected = {p for p, d in distance.items() if d <= simhash.CARRIED_APART}
    assert {(k, k + len(sets)) for k in range(len(sets))} <= expected
    for most in (2048, 3):
        groups = {}
        for r in simhash.close_rows(made, most).collect():
            groups.setdefault(r.key, set()).add(r.vertex)
        found = {(a, b) for g in groups.values() for a in g for b in g if a < b}
        assert expected <= found and (most < 2048 or len(found) < 1.5 * len(expected))


def test_parts_of_near_fingerprints_are_correlated_bits(spark, monkeypatch):
    rng = np.random.default_rng(9)
    parts, width = 5, 10
    assert simhash.near_words(parts, width) == 1 and simhash.near_words(164, 18) == 55
    deal = rng.permutation(64)
    bits = rng.integers(2, size=(3000, 64), dtype=np.uint8)
    for k in range(6):  # ten places that mostly say the same, those of k = 0 nearly always 1
        bits[:, deal[10 * k : 10 * k + 10]] = (bits[:, [deal[10 * k]]] | (k == 0)) ^ (rng.random((3000, 10)) < 0.1)
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    frame = spark.createDataFrame([(k, [int(w[0]), 0, 0, 0], []) for k, w in enumerate(words)], "vertex long, fp array<long>, small array<long>").repartition(3)
    order = simhash.near_order(frame, parts, width)
    made = {frozenset(order[k : k + width]) for k in range(0, parts * width, width)}
    assert made == {frozenset(deal[10 * k : 10 * k + 10].tolist()) for k in range(1, 6)}
    keys = {(r.key, r.vertex) for r in simhash.part_rows(frame, parts, width, order).select("key", "vertex").collect()}
    assert keys == {((p << width) + sum(int(bits[v, b]) << k for k, b in enumerate(order[p * width : (p + 1) * width])), v) for v in range(3000) for p in range(parts)}
    assert simhash.near_order(frame.limit(0), parts, width) and abs(simhash.agreement(np.full((64, 64), 0.25) + np.eye(64) / 4, [1, 2, 3]) - 1 / 8) < 1e-12
    used, rows_of = [], simhash.part_rows
    monkeypatch.setattr(simhash, "part_rows", lambda vertices, *a: used.append(a) or rows_of(vertices, *a))
    simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(edited()[:40])), "doc_id long, text string")).count()
    assert len(used[0][2]) == used[0][0] * used[0][1] == len(set(used[0][2]))


def test_parity_sketches_leave_out_no_near_pair(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(300):
        shared, one, two = (rng.integers(1 << 63, size=n, dtype=np.uint64) for n in (rng.integers(0, 900), rng.integers(0, 120), rng.integers(0, 120)))
        pairs.append((np.union1d(shared, one), np.union1d(shared, two)))
    rows = [(len(a), len(b), simhash.parity(a).tolist(), simhash.parity(b).tolist(), bool(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))) for a, b in pairs]
    frame = spark.createDataFrame(rows, "n int, m int, p array<long>, q array<long>, near boolean")
    got = frame.select("near", simhash.may_be_near(F.col("n"), F.col("m"), F.col("p"), F.col("q")).alias("may")).collect()
    assert all(r.may for r in got if r.near) and sum(r.may and not r.near for r in got) < 60 and any(r.near for r in got)


def test_a_large_group_that_is_close_but_not_near_reaches_no_join(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(320)]
    texts = []
    for _ in range(60):
        low = rng.randrange(280)
        texts.append(" ".join(base[:low] + [word() for _ in range(40)] + base[low + 40 :]))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    near = {(i, j) for j in range(60) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    seen, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda rows, sets: seen.append(rows.collect()) or links(rows, sets))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    parts, _ = simhash.near_parts(60)
    assert len(seen[0]) < 60 * parts / 8
    root = brute_links(60, near)
    assert kept == set(root)


def brute_links(n, pairs):
    root = list(range(n))
    for i, j in sorted(pairs):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("most", [2048, 6])
def test_rows_that_may_be_near_keep_every_pair(spark, most):
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(30):
        s = rng.integers(1 << 63, size=int(rng.integers(20, 200)), dtype=np.uint64)
        sets += [np.unique(s), np.unique(s[len(s) // 20 :]), np.unique(s[len(s) // 3 :])]
    rows = [(k % 3, v, len(sets[v]), simhash.parity(sets[v]).tolist()) for v in range(len(sets)) for k in (v // 30, v // 45)]
    frame = spark.createDataFrame(sorted(set((k, v, n, tuple(p)) for k, v, n, p in rows)), "key long, vertex long, n int, parity array<long>")
    one, other = (frame.select("key", F.col("vertex").alias(v), F.col("n").alias(n), F.col("parity").alias(p)) for v, n, p in (("a", "n", "p"), ("b", "m", "q")))
    may = one.join(other, "key").where(F.col("a") < F.col("b")).where(simhash.may_be_near(F.col("n"), F.col("m"), F.col("p"), F.col("q")))
    expected = {(r.a, r.b) for r in may.select("a", "b").collect()}
    groups = {}
    for r in simhash.near_rows(frame, most).collect():
        groups.setdefault(r.key, set()).add(r.vertex)
    found = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(expected) >= 30 and expected <= found and (most < 2048 or len(found) < 3 * len(expected))
