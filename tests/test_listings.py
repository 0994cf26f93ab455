"""Bulletins in English, and listings against plain Python."""

import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from gristmill.functions import bulletins
from gristmill.operators import listings

AMOUNTS = {
    "Heavy snow. Total snow accumulations between 6 and 10 inches, with up to 14 inches on peaks.": (6.0, 10.0, None, None),
    "Snow accumulations of\ntwo to one inches.": (1.0, 2.0, None, None),
    "Additional snow accumulations of up to 3 inches.": (0.0, 3.0, None, None),
    "Snow of 4.5 inches. Around one quarter of an inch of ice.": (4.5, 4.5, 0.25, None),
    "Wind chills as low as 15 below zero. Wind chills near minus 20 later. Wind chills of 3 above.": (None, None, None, -20),
    "Rain of 6 inches.": (None, None, None, None),
    "": (None, None, None, None),
    None: (None, None, None, None),
}
#: 2024-12-30 is a Monday.
OPEN = {
    "Open today": [date(2024, 12, 30)],
    "open Mon. and TUESDAY": [date(2024, 12, 30), date(2024, 12, 31)],
    "Open tomorrow, open tomorrow": [date(2024, 12, 31)],
    "open Sunday": [date(2025, 1, 5)],
    "Open 1/2 as planned": [date(2025, 1, 2)],
    "Open Jan. 3rd and this morning": [date(2024, 12, 30), date(2025, 1, 3)],
    "Open 1/9": [],
    "Open 2/30": [],
    "Open today and tonight": [],
    "Open today through Friday": [],
    "Open": [],
    "": [],
    None: [],
}


def test_amounts_that_bulletins_name(spark):
    rows = spark.createDataFrame([(t,) for t in AMOUNTS], "t string").select("t", bulletins.amounts(F.col("t")).alias("a")).collect()
    assert {r.t: tuple(r.a) for r in rows} == AMOUNTS


def test_days_that_open_statements_name(spark):
    rows = spark.createDataFrame([(t, date(2024, 12, 30)) for t in OPEN], "t string, p date").select("t", bulletins.open_days(F.col("t"), F.col("p")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == OPEN
    unposted = spark.createDataFrame([("open today", None)], "t string, p date").select(bulletins.open_days(F.col("t"), F.col("p")).alias("d"))
    assert unposted.first().d == []


def test_aliases_hold_in_their_market_and_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([("m", " The  Oak\tSCHOOL", 1), ("n", "the oak school", 2), (None, "the oak school", 3), ("m", None, 4), ("m", "the oak school", 5)], "market string, text string, _key int")
    aliases = spark.createDataFrame([("m", "the oak school", "x"), ("m", "The Oak School", "x"), ("m", "the oak school", "y"), (None, "the oak school", "z")], "market string, text string, target string")
    got = sorted((r._key, r.target) for r in listings.alias_join(rows, aliases, "market", "text", "target").fillna("-").collect())
    assert got == [(1, "x"), (1, "y"), (2, "-"), (3, "-"), (4, "-"), (5, "x"), (5, "y")]


@pytest.mark.parametrize("seed", [1, 2])
def test_agreed_details_equal_a_plain_reading(spark, seed):
    draw = random.Random(seed)
    group = {k: f"g{k % 3}" for k in range(7)}
    stated = [(draw.randrange(12), draw.randrange(3), draw.randrange(9)) for _ in range(150)]
    said = defaultdict(lambda: defaultdict(set))
    for unit, row, detail in stated:
        if detail in group:
            said[unit, group[detail]][row].add(detail)
    want = sorted((u, g, d) for (u, g), rows in said.items() if len({frozenset(s) for s in rows.values()}) == 1 for d in next(iter(rows.values())))
    out = listings.agreed(spark.createDataFrame(stated, "u int, r int, d int"), spark.createDataFrame(list(group.items()), "d int, g string"), ["u"], ["r"], "d", "g")
    assert want and sorted((r.u, r.g, r.d) for r in out.collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_slot_runs_equal_a_plain_fold_and_turn_back(spark, seed):
    draw = random.Random(seed)
    reads = [(draw.randrange(3), draw.randrange(9), draw.randrange(5)) for _ in range(90)]
    held = defaultdict(set)
    for source, slot, member in reads:
        held[source, slot].add(member)
    want, last = [], defaultdict(set)
    for source, slot in sorted(held):
        now = held[source, slot]
        want += [(source, slot, m, "added") for m in now - last[source]] + [(source, slot, m, "removed") for m in last[source] - now]
        last[source] = now
    df = spark.createDataFrame(reads, "s int, k int, m int")
    runs = listings.slot_runs(df, "s", "k", "m")
    assert sorted(map(tuple, runs.collect())) == sorted(want)
    assert sorted(map(tuple, listings.slot_states(runs, df, "s", "k", "m").collect())) == sorted(set(reads))
    assert listings.slot_runs(df.limit(0), "s", "k", "m").count() == 0
