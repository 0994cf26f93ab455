"""Notices sent once, changed content shipped once, products remembered."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.streaming import notices, sink

SCHEMA = "account int, day int, at long, percent int"


def candidates(seed, batches=4):
    rng = random.Random(seed)
    return [[(rng.randrange(3), rng.randrange(2), 100 * b + k, rng.randrange(101)) for k in range(12)] for b in range(batches)]


def fold(rows, sent):
    """What is due of ``rows`` after ``sent``, one by one."""
    out = []
    last, n = {}, defaultdict(int)
    for account, day, at, percent in sorted(sent, key=lambda r: r[2]):
        last[account, day] = percent
        n[account, day] += 1
    for account, day, at, percent in sorted(rows, key=lambda r: (r[2], r[3])):
        key = account, day
        if n[key] < 4 and (key not in last or percent >= last[key] + 20):
            last[key] = percent
            n[key] += 1
            out.append((account, day, at, percent))
    return sorted(out)


def test_killed_and_repeated_batches_send_nothing_twice(spark, tmp_path):
    log, sent, delivered = str(tmp_path / "log"), [], []
    for number, rows in enumerate(candidates(1)):
        frame = spark.createDataFrame(rows, SCHEMA)
        want = fold(rows, sent)

        def broken(part):
            delivered.extend(part.collect())
            raise RuntimeError("killed")

        with pytest.raises(RuntimeError):
            notices.send_once(frame, number, log, ["account", "day"], broken)
        notices.send_once(frame, number, log, ["account", "day"], lambda part: delivered.extend(part.collect()))
        sent += want
        got = spark.read.parquet(log).where(F.col("batch") == number)
        assert sorted(map(tuple, got.select("account", "day", "at", "percent").collect())) == want
    assert len({r.digest for r in delivered}) == len(sent) == spark.read.parquet(log).count()
    assert all(n <= 4 for n in [r["count"] for r in spark.read.parquet(log).groupBy("account", "day").count().collect()])


def test_quiet_hours(spark):
    rows = [(m, b, e, (b <= m < e) if b <= e else (m >= b or m < e)) for m in (0, 299, 300, 1259, 1260, 1439) for b, e in ((1260, 300), (300, 1260), (60, 60))]
    got = spark.createDataFrame(rows, "m int, b int, e int, want boolean").select("want", notices.quiet(F.col("m"), F.col("b"), F.col("e")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_versions_ship_what_changed(spark, tmp_path):
    folder = str(tmp_path / "shipped")
    versions = [[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "x")], [("a", "3"), ("b", "2"), ("c", None)], [("a", "3"), ("b", "1"), ("c", None)]]
    shipped = []
    for number, rows in enumerate(versions):
        frame = spark.createDataFrame(rows, "entity string, content string")
        counts = [sink.ship_changed(frame, number, folder) for _ in range(2)]
        assert counts[0] == counts[1]
        shipped.append(counts[0])
    assert shipped == [2, 2, 2, 1]
    assert sink.ship_changed(spark.createDataFrame(versions[0], "entity string, content string"), 1, folder) == 0


def test_products_are_remembered_for_some_hours(spark, tmp_path):
    folder = tmp_path / "products"
    folder.mkdir()
    moment = lambda h: f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00Z"
    batches = [[("k", 0, 0), ("k", 0, 1), ("j", 0, 1)], [("k", 0, 5), ("k", 4, 5)], [("x", 0, 90)], [("x", 1, 91)], [("k", 0, 92), ("j", 0, 92)]]
    for number, rows in enumerate(batches):
        (folder / f"{number}.json").write_text("\n".join(json.dumps({"key": k, "zones": "z", "sent": moment(s), "withdraws": False, "seen": moment(t)}) for k, s, t in rows))
        os.utime(folder / f"{number}.json", (10**9 + number, 10**9 + number))  # read in this order
    stream = spark.readStream.schema("key string, zones string, sent timestamp, withdraws boolean, seen timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    query = notices.product_log(stream).writeStream.format("memory").queryName("products").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = sorted((r.key, r.sent.hour, (r.seen.day - 1) * 24 + r.seen.hour) for r in spark.table("products").collect())
    assert [g for g in got if g[0] == "k" and g[1] == 4] == [("k", 4, 5)] and len(got) == 7  # k and j again, since they are forgotten
