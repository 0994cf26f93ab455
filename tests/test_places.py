"""Verdicts of places against plain Python: nulls, unknown towns, repeats and a town with most points."""

import math
import random

from gristmill.operators import places


def plain(row, matches, stated, records, towns, reach):
    located = [records[r] for i, r in matches if i == row and r in records and records[r][1] is not None]
    found = set()
    for i, state, town in stated:
        if i != row or (state is None and town is None) or not located:
            continue
        mine = [r for r in located if state is None or r[0] == state]
        if not mine:
            found.add("conflict")
            continue
        seen = [any(math.hypot(r[1] - x, r[2] - y) <= reach for r in mine if r[0] == s for z, t, x, y in towns if (z, t) == (s, town)) for s in {r[0] for r in mine} if any((z, t) == (s, town) for z, t, *_ in towns)]
        found.add(("agrees" if any(seen) else "conflict") if seen else "agrees" if state is not None else "unknown")
    return min(found, default="unknown")


def test_place_verdicts(spark):
    rng = random.Random(12)
    records = {r: (rng.choice("AB"), *((rng.uniform(-5, 5), rng.uniform(-5, 5)) if r % 9 else (None, None))) for r in range(40)}
    towns = [(rng.choice("AB"), rng.choice(["big"] * 6 + ["p", "q"]), rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(60)] + [("A", "only", 0.0, 0.0)]
    matches = [(rng.randrange(150), rng.randrange(44)) for _ in range(260)] * 2
    stated = [(rng.randrange(160), rng.choice(["A", "B", "C", None]), rng.choice(["big", "p", "q", "only", "none", None])) for _ in range(220)]
    frames = [
        spark.createDataFrame(matches, "id int, record int"), spark.createDataFrame(stated + stated[:50], "id int, state string, town string"),
        spark.createDataFrame([(r, *v) for r, v in records.items()], "record int, state string, x double, y double"), spark.createDataFrame(towns, "state string, town string, x double, y double"),
    ]
    got = {r.id: r.verdict for r in places.place_verdicts(*frames, 1.5, "id").collect()}
    want = {row: plain(row, matches, stated, records, towns, 1.5) for row, _ in matches}
    assert got == want and set(want.values()) == {"agrees", "conflict", "unknown"}
