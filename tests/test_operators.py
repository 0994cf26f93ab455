"""Operators that no SQL states, against plain Python on small frames."""

from datetime import date, datetime
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from gristmill.functions import days
from gristmill.operators import fits, graph, search, spatial


def test_greedy_cover_equals_plain_python(spark):
    pairs = [(f, e) for f in range(6) for e in range(20) if (f * 7 + e * 3) % 5 < 2]
    weight = {e: float(1 + e % 4) for e in range(20)}
    got = graph.greedy_cover(spark.createDataFrame(pairs + pairs[:3], "family int, element int"), spark.createDataFrame(list(weight.items()), "element int, weight double"), 4)
    left, expected = set(range(20)), []
    for _ in range(4):
        new = {f: {e for g, e in pairs if g == f} & left for f in range(6)}
        best = min(new, key=lambda f: (-sum(weight[e] for e in new[f]), -len(new[f]), f))
        if not new[best]:
            break
        expected.append((best, sum(weight[e] for e in new[best]), len(new[best])))
        left -= new[best]
    assert got == expected


def test_bounded_fit_has_no_slope_inside_its_bounds(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (3000, 3)).astype(float)
    x[:, 0] = 1
    y = rng.random(3000) < 1 / (1 + np.exp(-(x @ [-1.0, 0.8, -0.7])))
    rows = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, y int")
    beta = fits.bounded_logistic(rows, ["a", "b", "c"], "y", 1.0, [-5.0, 0.0, 0.0], [5.0, 2.0, 2.0])
    slope = x.T @ (y - 1 / (1 + np.exp(-(x @ beta)))) - beta
    assert np.abs(slope[:2]).max() < 1e-6 and beta[2] == 0 and slope[2] < 0
    assert fits.bounded_logistic(rows.limit(0), ["a"], "y", 1.0, [0.5], [1.0]).tolist() == [0.5]


def test_bootstrap_upper_lies_above_the_mean_and_repeats(spark):
    rows = spark.createDataFrame([(k % 40, float(k % 40)) for k in range(4000)], "c int, v double")
    one, two = (fits.bootstrap_upper(rows, "c", "v", 100, 0.95, 3).first().upper for _ in range(2))
    assert one == two and 19.5 < one < 26


def test_local_windows_over_changes_of_clock(spark):
    cases = [(date(2024, 3, 9), "America/New_York"), (date(2024, 11, 2), "America/Denver"), (date(2024, 7, 1), "America/Chicago")]
    begin, end = days.local_window(F.col("day"), F.col("zone"), "18:00:00", "06:00:00")
    got = spark.createDataFrame(cases, "day date, zone string").select("day", "zone", F.unix_timestamp(begin).alias("b"), F.unix_timestamp(end).alias("e")).collect()
    for r in got:
        zone = ZoneInfo(r.zone)
        assert r.b == datetime(r.day.year, r.day.month, r.day.day, 18, tzinfo=zone).timestamp()
        assert r.e == datetime(r.day.year, r.day.month, r.day.day + 1, 6, tzinfo=zone).timestamp()


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (40, 45)]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[50] == got[45] == got[40] == 40
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_names_within_edits_lose_no_pair(spark):
    import itertools
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(60)})
    got = {(r.name, r.other) for r in search.within_edits(spark.createDataFrame([(n,) for n in names], "name string"), "name", 2).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(names, 2) if distance(a, b) <= 2}


def test_inside_equals_plain_ray_casting(spark):
    ring = [(0.0, 0.0), (4.0, 0.5), (3.0, 3.0), (2.0, 1.0), (0.5, 3.5)]
    corners = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(ring)], "ring int, seq int, x double, y double")
    points = [(k, (k % 17) * 0.31 - 0.4, (k // 17) * 0.29 - 0.3) for k in range(255)]
    got = {r.id for r in spatial.inside(spark.createDataFrame(points, "id int, x double, y double"), corners, "ring", 0.7).collect()}

    def holds(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    assert got == {k for k, x, y in points if holds(x, y)} and got


def test_alignment_counts_swaps_and_finds_prefixes(spark):
    assert [search.near(*p)[0] for p in (("ca", "ac"), ("ca", "abc"), ("", "ab"), ("abcd", "acbd"), ("kitten", "sitting"))] == [1, 3, 2, 1, 3]
    assert search.near("lancastr", "lancaster")[1:] == (1, 9) and search.near("the", "theory")[1:] == (0, 3) and search.near("ab", "")[1:] == (2, 0)


def test_search_finds_every_token_within_its_budget(spark, tmp_path):
    import random

    rng = random.Random(8)
    tokens_ = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(500)})
    docs = spark.createDataFrame([(k, " ".join(tokens_[k::7])) for k in range(7)] + [(8, None), (9, "")], "doc_id long, text string")
    search.store(docs, str(tmp_path / "index"))
    index = search.opened(spark, str(tmp_path / "index"))
    words = ["abca", "abcabcab", "cabbacabca", "ab", "aab1", "bbbbbbbb"]
    got = {(r.word, r.token): r.level for r in search.expand(words, index).collect()}
    want = {}
    for w in words:
        for t in tokens_:
            if t == w or t.startswith(w):
                want[w, t] = int(t != w)
            elif search.near(w, t)[0] <= search.budget(w):
                want[w, t] = 2
    assert got == want and sum(v == 2 for v in got.values()) > 5
    plan = search.search(index, ["abca", "ab"], docs.selectExpr("doc_id", "1 AS weight"), 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
