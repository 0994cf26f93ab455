"""Gains, swaps, terms, declines, fallbacks, tile numbers and hashes against plain Python."""

import hashlib
import math
import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import days, numeric
from gristmill.operators import evaluation
from tests.test_inference import plain_cll

CASES = "id int, day date, klass string, on double, off double, y int"


def cases(n):
    rng = random.Random(n)
    out = []
    for i in range(n):
        klass, off = rng.choice(["a"] * 6 + ["b", "c"]), rng.random()
        out.append((i, date(2024, 1, 1) + timedelta(rng.choice([0] * 5 + list(range(9)))), klass, off if klass == "c" else min(1.0, off * rng.choice([0.5, 1, 1.4])), off, int(rng.random() < off)))
    return out


def test_switch_evaluation(spark):
    rows = cases(900)
    groups = defaultdict(list)
    for _, day, klass, on, off, y in rows:
        groups[day, klass].append((on, off, y))
    plain = {}
    for key, held in groups.items():
        if 0 < sum(y for *_, y in held) < len(held):
            diff = plain_cll([(on, y) for on, _, y in held]) - plain_cll([(off, y) for _, off, y in held])
            plain[key] = (len(held), diff, any(on != off for on, off, _ in held))
    frame = spark.createDataFrame(rows + [(9000, date(2024, 1, 1), "a", None, 0.5, 1)], CASES)
    found = evaluation.conditional_groups(frame, "on", "off", "y", "id")
    got = {(r.day, r.klass): (r.n, r["diff"], r.moved) for r in found.collect()}
    assert got.keys() == plain.keys()
    for key, (n, diff, moved) in plain.items():
        assert got[key] == (n, pytest.approx(diff, abs=1e-7), moved)
    by_day = defaultdict(lambda: [0.0, 0])
    for (day, _), (n, diff, _) in plain.items():
        by_day[day][0] += diff
        by_day[day][1] += n
    blocks = [by_day[d] for d in sorted(by_day)]
    means = []
    for draw in range(60):
        picks = [int(int(hashlib.md5(f"5:{draw}:{slot}".encode()).hexdigest()[:8], 16) / 2**32 * len(blocks)) for slot in range(len(blocks))]
        means.append(sum(blocks[p][0] for p in picks) / sum(blocks[p][1] for p in picks))
    out = {r.scope: r for r in evaluation.evaluated(found, 60, 0.8, 5, 50, 2).collect()}
    whole = out["all"]
    assert whole.gain == pytest.approx(sum(b[0] for b in blocks) / sum(b[1] for b in blocks))
    assert (whole.lower, whole.upper) == (pytest.approx(np.percentile(means, 10)), pytest.approx(np.percentile(means, 90)))
    assert whole.last_gain == pytest.approx(blocks[-1][0] / blocks[-1][1]) and whole.largest_share == max(b[1] for b in blocks) / whole.rows
    for klass in {k for _, k in plain}:
        mine = [v for (_, k), v in plain.items() if k == klass]
        moved = sum(m for *_, m in mine)
        assert (out[klass].rows, out[klass].moved, out[klass].binding) == (sum(n for n, *_ in mine), moved, sum(n for n, *_ in mine) >= 50 and moved >= 2)
    assert not out["c"].binding and out["c"].gain == pytest.approx(0, abs=1e-9)


SCORED = "new double, base double, y int, s string"


@pytest.mark.parametrize(
    ("rows", "why"),
    [
        ([], "rows"),
        ([(0.5, 0.4, 0, "a")] * 4, "brier"),
        ([(0.1, 0.9, 0, "a")] * 4 + [(0.6, 0.5, 0, "b")], "situation b"),
        ([(0.9, 0.8, 1, "a"), (0.9, 0.8, 1, "a"), (0.9, 0.8, 1, "a"), (0.85, 0.9, 0, "a")], None),
        ([(0.2, 0.5, 0, "a")] * 5 + [(0.8, 0.5, 1, "a")] * 5, "bins"),
        ([(0.05, 0.5, 0, "a")] * 5 + [(0.95, 0.5, 1, "a")] * 5, "calibration"),
    ],
)
def test_swaps(spark, rows, why):
    found = evaluation.swap(spark.createDataFrame(rows, SCORED), "new", "base", "y", "s", 10, 0.1, 0.002).first()
    assert (found.kind, found.why) == ("swap" if why is None else "keep", why)


def test_raised_and_lowered(spark):
    got = {r.split: (r.n, r.rate, round(r.sse_base, 6), round(r.sse_new, 6)) for r in evaluation.raised_lowered(spark.createDataFrame([(0.6, 0.5, 1, ""), (0.7, 0.5, 0, ""), (0.1, 0.5, 0, ""), (0.5, 0.5, 1, "")], SCORED), "new", "base", "y").collect()}
    assert got == {"raised": (2, 0.5, 0.5, 0.65), "lowered": (1, 0.0, 0.25, 0.01), "unchanged": (1, 1.0, 0.25, 0.25)}


def test_terms_are_added_by_level_and_held_above_zero(spark):
    rows = [(i, i % 3 - 1, 0 if i % 2 else None, int(i % 3 == 2), i % 4 == 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, snow int, ice int, y int, up boolean")
    fits = evaluation.step_fits(frame, ["snow", "ice"], "y")
    odds = lambda s, n: math.log((s + 1) / (n - s + 1))
    want = {("snow", 0): odds(0, 20) - odds(20, 40), ("snow", 1): odds(20, 20) - odds(20, 40), ("ice", 0): 0.0}
    assert {(r.term, r.level): pytest.approx(r.value) for r in fits.collect()} == want
    got = {(r.id, r.term): r.value for r in evaluation.contributions(frame, "id", ["snow", "ice"], fits.where("n > 0"), {"snow": F.col("up")}).collect()}
    for i, snow, ice, _, up in rows:
        value = want.get(("snow", snow), 0.0)
        assert got[i, "snow"] == pytest.approx(max(value, 0.0) if up else value) and got[i, "ice"] == 0.0
    assert evaluation.contributions(frame, "id", ["snow"], fits.where("false"), {}).where("value <> 0").count() == 0


def test_declines(spark):
    rng = random.Random(8)
    rows = [(k, e, rng.choice([None, -20, 3, 40, 90, 200]), rng.random() < 0.15) for k in range(12) for e in range(0, 600, 30)]
    got = {(r.k, r.e): (r.x, r.delta) for r in evaluation.declined(spark.createDataFrame(rows, "k int, e int, past int, ended boolean"), ["k"], "e", "past", "ended", 25.0, 0.4, 50.0).collect()}
    x = {}
    for k, e, past, ended in rows:
        if not ended and past is not None:
            x[k] = max(x.get(k, 0.0), min(float(past), x.get(k, 0.0) + 25.0))
        shown = 0.0 if ended else x.get(k, 0.0)
        assert got[k, e] == (shown, pytest.approx(math.log(0.4 + 0.6 * math.exp(-shown / 50))))


def test_thin_situations_take_anothers_rates(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 0), ("c", 9), ("x", 2), ("y", 2), ("own", 30), ("alone", 1)], "s string, n int")
    fallback = {"a": "b", "b": "c", "x": "y", "y": "x", "c": "a", "ghost": "own"}
    got = {r.s: r.published for r in evaluation.published_as(counts, "s", "n", fallback, 5).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": None, "y": None, "own": "own", "alone": None, "ghost": "own"}


def plain_tile(x, y, zoom):
    d, side = ((1 << 2 * zoom) - 1) // 3, 1 << zoom
    s = side >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        s >>= 1
    return d


@pytest.mark.parametrize("zoom", [0, 1, 2, 5])
def test_hilbert_numbers_walk_neighbouring_tiles(spark, zoom):
    tiles = [(x, y) for x in range(1 << zoom) for y in range(1 << zoom)]
    rows = spark.createDataFrame(tiles, "x int, y int").select("x", "y", numeric.hilbert_tile(F.col("x"), F.col("y"), zoom).alias("d")).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(((1 << 2 * zoom) - 1) // 3, ((1 << 2 * zoom + 2) - 1) // 3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))
    assert all(r.d == plain_tile(r.x, r.y, zoom) for r in rows)


def test_hashes_of_texts(spark):
    texts = ["", "a", "foobar", "é€😀", "x" * 3000, None]
    want = {}
    for t in texts[:-1]:
        h = 14695981039346656037
        for b in t.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        want[t] = f"{h:016x}"
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", numeric.fnv64(F.col("t")).alias("h")).collect()}
    assert got.pop(None) is None and got == want and want["a"] == "af63dc4c8601ec8c"


def test_local_days(spark):
    zones, start = ["America/New_York", "Pacific/Honolulu", "America/Adak"], datetime(2024, 3, 9, 23)
    rows = [(start + timedelta(minutes=37 * k), z) for k in range(120) for z in zones]
    frame = spark.createDataFrame(rows, "at timestamp_ntz, zone string").select("at", "zone", days.local_day(F.col("at").cast("timestamp"), F.col("zone")).alias("day"))
    assert all(r.day == r.at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(r.zone)).date() for r in frame.collect())
