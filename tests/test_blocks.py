"""Work on ordered keys in blocks against plain Python, with a key that holds most rows, nulls and ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import blocks


def test_lag_is_carried_over_block_edges_and_empty_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), t, rng.choice([None, 1, 2, 3])) for t in rng.sample(range(0, 4000), 900)]
    got = blocks.lagged(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], F.floor(F.col("t") / 50), ["t"], "v", "before").collect()
    before, want = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        want[k, t] = before.get(k)
        before[k] = v
    assert {(r.k, r.t): r.before for r in got} == want
    assert blocks.lagged(spark.createDataFrame([], "k string, t int, v int"), ["k"], F.col("t"), ["t"], "v", "before").count() == 0


def test_runs_cross_blocks(spark):
    rng = random.Random(4)
    held = {"long": set(range(-17, 95)), "holes": {n for n in range(200) if n % 10 not in (0, 9)}, "edges": {9, 10, 19, 20, 21, 30, 39}, None: set(rng.sample(range(-50, 50), 60))}
    rows = [(k, n) for k, ns in held.items() for n in ns] * 2 + [("long", None)]
    got = sorted(((r.k or "", r.first, r.last) for r in blocks.runs(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", 10).collect()))
    want = []
    for k, ns in held.items():
        for n in sorted(ns):
            if n - 1 not in ns:
                last = n
                while last + 1 in ns:
                    last += 1
                want.append((k or "", n, last))
    assert got == sorted(want)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantiles_are_exact(spark, share):
    rng = random.Random(5)
    held = {"hot": [int(rng.paretovariate(0.6)) for _ in range(30_000)], "ties": [7] * 50 + [8] * 50, "one": [4], None: [-3, -2, 5]}
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("one", None), ("void", None)]
    got = {r.k: (r.n, r.q) for r in blocks.nearest_rank(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", share, "q").collect()}
    assert got == {k: (len(vs), sorted(vs)[max(1, math.ceil(round(share * len(vs), 9))) - 1]) for k, vs in held.items()}


def test_least_rows_of_a_large_key(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.randrange(300), limit) for k, n, limit in (("hot", 4000, 250), ("few", 3, 10), ("none", 40, 0)) for i in range(n)]
    got = blocks.least(spark.createDataFrame(rows, "k string, i int, v int, most int"), ["k"], ["v", "i"], "most", F.col("i") % 16).collect()
    want = {(k, i, p) for key, most in (("hot", 250), ("few", 10)) for p, (v, i, k) in enumerate(sorted((v, i, k) for k, i, v, _ in rows if k == key)[:most], 1)}
    assert {(r.k, r.i, r.place) for r in got} == want
