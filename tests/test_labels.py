"""Folds, comparisons, snapshots, shares and plans of captures against plain Python."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from gristmill.operators import labels

FIRST = date(2024, 3, 1)
READS = "unit string, place int, day date, closed boolean"


def made(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "rare", None]), rng.choice([*range(8), None]), FIRST + timedelta(rng.randrange(20)), rng.choice([True, False, False, None])) for _ in range(n)]
    return [r for r in rows if r[0] != "rare" or r[2].day % 7 == 0] + [("thin", 3, FIRST, True)]


def plain_labels(rows, before=None):
    rows = [r for r in rows if r[0] is not None and (before is None or r[2] < before)]
    sizes, days, shut = defaultdict(int), defaultdict(set), {}
    for unit, place, day, closed in rows:
        sizes[unit, day] += 1
        if place is not None:
            days[unit, place].add(day)
            shut[unit, place, day] = shut.get((unit, place, day), False) or bool(closed)
    per_unit = defaultdict(list)
    for (unit, _), n in sizes.items():
        per_unit[unit].append(n)
    out = {}
    for (unit, place), seen in days.items():
        if len(seen) < 3:
            continue
        for (other, day), n in sizes.items():
            if other == unit and day >= min(seen):
                counted = len(per_unit[unit]) >= 2 and n >= 0.5 * sum(per_unit[unit]) / len(per_unit[unit])
                held = out.setdefault((place, day), [False, False])
                held[0] |= counted
                held[1] |= counted and shut.get((unit, place, day), False)
    return {k: "unknown" if not counted else "closed" if closed else "open" for k, (counted, closed) in out.items()}


def built(spark, rows, before=None):
    return labels.fold_labels(spark.createDataFrame(rows, READS), F.col("closed"), before)


def test_fold_labels_and_what_changed(spark):
    rows, fold = made(1, 700), FIRST + timedelta(12)
    whole, mine = plain_labels(rows), plain_labels(rows, fold)
    assert {(r.place, r.day): r.outcome for r in built(spark, rows).collect()} == whole
    assert {(r.place, r.day): r.outcome for r in built(spark, rows, fold).collect()} == mine
    changed = {(r.was, r.now): (r.kind, r.n) for r in labels.compared(built(spark, rows), built(spark, rows, fold)).collect()}
    want = defaultdict(int)
    for key in whole.keys() | mine.keys():
        want[whole.get(key, "missing"), mine.get(key, "missing")] += 1
    assert {k: n for k, (_, n) in changed.items()} == want
    assert all(kind == ("same" if was == now else "changed") for (was, now), (kind, _) in changed.items() if was in labels.KNOWN)
    assert built(spark, []).count() == 0


def test_a_fold_ignores_all_that_comes_later(spark):
    rows, fold = made(2, 500), FIRST + timedelta(9)
    other = [r for r in rows if r[2] < fold] + [("hot", 5, fold + timedelta(k), True) for k in range(9)]
    assert {tuple(r) for r in built(spark, rows, fold).collect()} == {tuple(r) for r in built(spark, other, fold).collect()}


def test_snapshots_and_shares_of_neighbours(spark):
    rng, start = random.Random(7), datetime(2024, 3, 1)
    captures = [(rng.choice("abc"), start + timedelta(hours=rng.randrange(0, 24 * 12), minutes=rng.randrange(60))) for _ in range(120)] + [("a", start + timedelta(days=2, hours=6)), ("b", start + timedelta(days=2, hours=18))]
    carried = [(u, p, FIRST + timedelta(rng.randrange(6))) for u in "abc" for p in range(6) if rng.random() < 0.5]
    posted = {(p, FIRST + timedelta(k)): start + timedelta(days=k, hours=rng.choice([5, 6, 7, 12])) for p in range(6) for k in range(12) if rng.random() < 0.4}
    labelled = [(p, FIRST + timedelta(k)) for p in range(7) for k in range(1, 12)]
    want = {}
    for p, day in labelled:
        lo, hi = (datetime(day.year, day.month, day.day) + timedelta(hours=h) for h in (-6, 6))
        found = [at for u, q, since in carried if q == p and since <= day for v, at in captures if v == u and lo <= at < hi]
        want[p, day] = max(found, default=None) if posted.get((p, day), hi + timedelta(1)) > hi else None
    midnight = F.col("day").cast("timestamp_ntz")
    six = F.expr("interval 6 hours")
    frame = labels.snapshots(
        spark.createDataFrame(labelled * 2, "place int, day date"), spark.createDataFrame(captures, "unit string, at timestamp_ntz"), spark.createDataFrame(carried, "unit string, place int, since date"),
        spark.createDataFrame([(*k, at) for k, at in posted.items()], "place int, day date, first timestamp_ntz"), midnight - six, midnight + six,
    )
    assert {(r.place, r.day): r.snapshot_at for r in frame.collect()} == want
    near = [(p, q) for p in range(6) for q in range(6) if p != q and p != 5]
    shut = {(p, FIRST + timedelta(k)): start + timedelta(days=k, hours=rng.randrange(-6, 6)) for p in range(6) for k in range(12) if rng.random() < 0.6}
    shares = labels.neighbour_shares(frame, spark.createDataFrame(near, "place int, other int"), spark.createDataFrame([(*k, at) for k, at in shut.items()], "place int, day date, first timestamp_ntz"))
    for r in shares.collect():
        at = want[r.place, r.day]
        others = [q for p, q in near if p == r.place]
        met = [q for q in others if at and (q, r.day) in shut and shut[q, r.day] <= at]
        assert r.share == (None if at is None else len(met) / len(others) if others else 0.0)


def test_levels_and_named_shares(spark):
    values = [None, 0.0, 0.2, 0.5, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", labels.level(F.col("v"), [0.1, 0.5]).alias("n")).collect()
    assert {r.v: r.n for r in rows} == {None: -1, 0.0: 0, 0.2: 1, 0.5: 2, 1.0: 2}
    found = labels.named_shares(
        spark.createDataFrame([("p", FIRST, "closed"), ("q", FIRST, "closed"), ("p", FIRST + timedelta(1), "open")], "place string, day date, outcome string"),
        spark.createDataFrame([("p", 1), ("p", 2), ("p", 2)], "place string, member int"), spark.createDataFrame([(1, FIRST), (1, FIRST), (9, FIRST)], "member int, day date"), ("closed",),
    )
    assert {(r.place, r.eligible, r.share) for r in found.collect()} == {("p", 2, 0.5), ("q", 0, 0.0)}


def test_captures_planned(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), 2023 + rng.randrange(2), FIRST + timedelta(rng.randrange(30)), i, rng.randrange(50)) for i in range(300)] + [("flat", 2023, FIRST + timedelta(3), 900 + i, 5) for i in range(3)]
    storms = {FIRST + timedelta(k) for k in (4, 11)}
    groups = defaultdict(list)
    for unit, season, day, at, size in rows:
        groups[unit, season].append((day in storms, size, at))
    want = set()
    for (unit, season), held in groups.items():
        chosen = [h for h in held if h[0]] or [h for h in held if h[1] > sum(s for _, s, _ in held) / len(held)] or [h for h in held if h[1] == max(s for _, s, _ in held)]
        want |= {(unit, season, at, size, "storm" if storm else "large") for storm, size, at in sorted(chosen, key=lambda h: (-h[1], h[2]))[:4]}
    got = labels.captures_planned(spark.createDataFrame(rows, "unit string, season int, day date, at int, size int"), spark.createDataFrame([(d,) for d in storms] * 2, "day date"), 4)
    assert {tuple(r) for r in got.collect()} == want
