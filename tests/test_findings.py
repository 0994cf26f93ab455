"""Small tables on which queries once went wrong, against their SQL, and the bounds of joins that once grew with a group."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from gristmill.operators import graph, joins, listings, search
from gristmill.plans import QUERIES, SQL


def saved(spark, folder, **frames):
    """A folder of tables, and DuckDB's views of them."""
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), duck


def test_brier_logloss_counts_certain_chances(spark, tmp_path):
    docs = spark.createDataFrame([(1, 500), (2, 2000), (3, 90000)], "doc_id long, n_chars long")
    for k, qualities in enumerate([(0, 1, 0), (0, 1, 1), (1, 0, None)]):
        labels = spark.createDataFrame([(n + 1, q) for n, q in enumerate(qualities)], "doc_id long, quality int")
        folder, duck = saved(spark, tmp_path / str(k), documents=docs, labels=labels)
        got = QUERIES["brier_logloss"](spark, folder).select("brier", "log_loss", "caught", "called").first()
        expected = duck.execute(f"SELECT brier, log_loss, caught, called FROM ({SQL['brier_logloss']})").fetchone()
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got, expected)), (got, expected)


def test_target_expansion_gives_every_member_once(spark, tmp_path):
    supplier = spark.createDataFrame([(1, 0), (2, 24), (3, 5), (4, None)], "s_suppkey long, s_nationkey int")
    customer = spark.createDataFrame([(1, 0), (1, 1), (2, 7), (5, 0), (6, 1), (7, 24), (8, None), (5, 0)], "c_custkey long, c_nationkey int")
    folder, duck = saved(spark, tmp_path / "t", supplier=supplier, customer=customer)
    got = sorted(map(tuple, QUERIES["target_expansion"](spark, folder).select("s_suppkey", "c_custkey").collect()))
    assert got == sorted(duck.execute(f"SELECT s_suppkey, c_custkey FROM ({SQL['target_expansion']})").fetchall())
    assert (1, 6) in got and (4, 4) in got and len(got) == len(set(got))


def test_expanded_pairs_are_written_small_and_whole(spark, tmp_path, monkeypatch):
    targets = spark.range(30).selectExpr("id AS t", "CAST(0 AS INT) AS g")
    members = spark.range(1000, 101000).selectExpr("id AS m", "CAST(0 AS INT) AS g")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where both sides are large
    try:
        joins.expanded(targets, members, "t", "m", "g").write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 30 * 100000 + 30
    size = sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet"))
    assert size < 30 * 100000 * 0.5, size / (30 * 100000)
    monkeypatch.setattr(joins, "BLOCK", 2)
    monkeypatch.setattr(joins, "EXPANDED", 3)
    supplier = spark.createDataFrame([(1, 0), (2, 24), (3, 5), (4, None), (None, 5), (3, 6), (5, 0), (6, 0), (7, 0), (None, None)], "s_suppkey long, s_nationkey int")
    customer = spark.createDataFrame([(k, k % 3) for k in range(40)] + [(5, 6), (None, 0), (None, 6), (41, None), (7, 24), (5, 6)], "c_custkey long, c_nationkey int")
    folder, duck = saved(spark, tmp_path / "t", supplier=supplier, customer=customer)
    key = lambda r: tuple((c is None, c or 0) for c in r)
    got = sorted(map(tuple, QUERIES["target_expansion"](spark, folder).select("s_suppkey", "c_custkey").collect()), key=key)
    assert got == sorted(duck.execute(f"SELECT s_suppkey, c_custkey FROM ({SQL['target_expansion']})").fetchall(), key=key)
    empty = joins.expanded(targets.limit(0), members, "t", "m", "g")
    assert empty.count() == 0 and joins.expanded(targets, members.limit(0), "t", "m", "g").count() == 30


def test_membership_lists_hold_a_ring_whole(spark, tmp_path):
    nation = spark.createDataFrame([(n, n % 5) for n in range(25)], "n_nationkey int, n_regionkey int")
    customer = spark.range(-500, 5500).selectExpr("id AS c_custkey", "CAST(0 AS INT) AS c_nationkey").repartition(3)
    folder, duck = saved(spark, tmp_path / "t", nation=nation, customer=customer)
    got = sorted((r.ring, r.members, r.n) for r in QUERIES["membership_lists"](spark, folder).collect())
    assert got == sorted(duck.execute(f"SELECT ring, members, n FROM ({SQL['membership_lists']})").fetchall())
    assert len({ring for ring, *_ in got}) == len(got) and max(m[-1] - m[0] for _, m, _ in got) > 4000


def brute_nearest(points, others, radius, k):
    out = set()
    for a, x, y in points:
        found = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), b) for b, u, v in others if b != a)
        out |= {(a, b, n) for n, (far, b) in enumerate([f for f in found if f[0] <= radius][:k], 1)}
    return out


def test_nearest_within_equals_brute_force_and_meets_few_pairs(spark):
    rng = np.random.default_rng(5)
    dense, wide = rng.normal(0, 0.01, (600, 2)), rng.uniform(-3, 3, (200, 2))
    places = np.concatenate([dense, wide, np.repeat(dense[:3], 40, axis=0)])
    rows = [(n, *map(float, p)) for n, p in enumerate(places)]
    points, others = spark.createDataFrame(rows, "a long, x double, y double"), spark.createDataFrame(rows, "b long, x double, y double")
    found = joins.nearest_within(points, others, 0.5, 4, "a", "b")
    assert {(r.a, r.b, r["rank"]) for r in found.collect()} == brute_nearest(rows, rows, 0.5, 4)
    spread = [(n, float(x), float(y)) for n, (x, y) in enumerate(rng.uniform(0, 1, (3000, 2)))]
    many = spark.createDataFrame(spread, "a long, x double, y double")
    found = joins.nearest_within(many, many.withColumnRenamed("a", "b"), 1.0, 1, "a", "b")
    assert {(r.a, r.b, r["rank"]) for r in found.collect()} == brute_nearest(spread, spread, 1.0, 1)
    plan = found._jdf.queryExecution().executedPlan()
    assert 3000 < largest_output(plan) < 3000 * 400


def test_knn_radius_asks_every_place(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(n, n % 3, [float(v) for v in p]) for n, p in enumerate(rng.normal(0, 0.05, (90, 2)))]
    rows += [(100 + n, 0, [0.001, float("nan") if n % 2 else float("inf")]) for n in range(40)] + [(200, 0, None), (201, 1, [0.0, None]), (202, 1, [5.0, 5.0])]
    folder, duck = saved(spark, tmp_path / "t", embeddings=spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    got = sorted(map(tuple, QUERIES["knn_radius"](spark, folder).select("vec_id", "near_id", "rank").collect()))
    places = [(a, float(np.float32(p[0])), float(np.float32(p[1]))) for a, _, p in rows if a < 100]
    assert got == sorted(brute_nearest(places, places, 0.05, 4)) and {a % 20 for a, *_ in got} == set(range(20))
    duck.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet' WHERE vec_id < 100")
    assert got == sorted(duck.execute(f"SELECT vec_id, near_id, rank FROM ({SQL['knn_radius']})").fetchall())


def largest_output(plan):
    """The most rows that any step of an executed plan put out."""
    text = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan
    metric = text.metrics().get("numOutputRows")
    own = metric.get().value() if metric.isDefined() else 0
    children = text.children()
    parts = [children.apply(k) for k in range(children.size())] + ([text.plan()] if "QueryStage" in text.nodeName() else [])
    return max([own, *map(largest_output, parts)])


def test_token_queries_merge_rows_that_repeat_a_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SLICE_TOKENS", 5)
    texts = ["the license of the house", "a b a b a b a b", None, "", "Licnese of the  THE the", "of the", "the of"]
    rows = [(k, t, len(t or "")) for k, t in enumerate(texts)] + [(0, "the house of", 12), (None, "of the lamp", 11), (None, "the lamp", 8)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for part, docs in (("all", documents), ("once", documents.where("doc_id > 0"))):
        folder, duck = saved(spark, tmp_path / part, documents=docs)
        for name in ("token_index", "token_typos"):
            out = QUERIES[name](spark, folder)
            expected = duck.execute(f"SELECT {', '.join(out.columns)} FROM ({SQL[name]})").fetchall()
            assert sorted(map(tuple, out.collect())) == sorted(expected), (part, name)
        search.store(docs, f"{folder}/index")
        got = {(r.token, r.doc_id): (r.times, r.first) for r in search.opened(spark, f"{folder}/index").postings.collect()}
        assert got["the", 4] == (3, 2) and got["b", 1] == (4, 1)
        assert part == "once" or got["the", 0] == (3, 0) and got["lamp", None] == (2, 1)


def test_phrase_search_equals_its_sql_and_shuffles_nothing(spark, tmp_path):
    texts = ["Out OF, -- the\nhouse", "of thé lamp", "of then", "off the", "of a the", "of_the", "of1 the", "the of", "ofthe", "of of the", "of\u00a0the", None, "", "of", "of the", "of the0"]
    rows = [*enumerate(texts), (None, "one of the lamps"), (0, "of the"), (None, "of")]
    folder, duck = saved(spark, tmp_path / "t", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    out = QUERIES["phrase_search"](spark, folder)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(map(tuple, out.collect()), key=key)
    assert got == sorted(duck.execute(SQL["phrase_search"]).fetchall(), key=key) and (None,) in got
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_index_shuffles_fewer_rows_than_postings(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'one two three four one' AS text").coalesce(1)
    assert search.packed_postings(docs, "doc_id", "text").count() <= 4 * 2000 / 500


def test_open_intervals_with_nulls_equal_their_sql(spark, tmp_path):
    day = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(days=n)
    rows = [(1, day(n), flag) for n, flag in [(0, "A"), (0, "N"), (3, "N"), (5, "N"), (40, "R"), (39, "A"), (70, None), (None, "N"), (None, "A"), (31, "N"), (36, "N")]]
    rows += [(2, day(1), "N"), (None, day(2), "N"), (3, None, "N")]
    items = spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_returnflag string")
    folder, duck = saved(spark, tmp_path / "t", lineitem=items)
    got = sorted(map(tuple, QUERIES["open_interval_overlap"](spark, folder).select("l_suppkey", "n").collect()))
    assert got == sorted(duck.execute(f"SELECT l_suppkey, n FROM ({SQL['open_interval_overlap']})").fetchall())


def test_agreed_details_shuffle_by_unit_alone(spark):
    said = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (2, 1, "a"), (2, 3, "a"), (None, 1, "a")], "u int, r int, d string")
    found = listings.agreed(said, spark.createDataFrame([("a", "g"), ("b", "h")], "d string, g string"), ["u"], ["r"], "d", "g")
    assert sorted(map(tuple, found.collect())) == [(1, "g", "a"), (1, "h", "b"), (2, "g", "a")]
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_greedy_cover_sends_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    first = DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), first(df))[1])
    pairs = spark.createDataFrame([(f, e) for f in range(5) for e in range(f, 9)], "family int, element int")
    assert graph.greedy_cover(pairs, spark.range(9).selectExpr("CAST(id AS INT) AS element", "1.0D AS weight"), 3) == [(0, 9.0, 9)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_alert_amounts_flatten_each_text_once(spark, tmp_path):
    items = spark.createDataFrame([(n, n % 3, 3.0) for n in range(12)], "l_orderkey long, l_linenumber int, l_quantity double")
    folder, duck = saved(spark, tmp_path / "t", lineitem=items)
    out = QUERIES["alert_amounts"](spark, folder)
    expected = duck.execute(f"SELECT {', '.join(out.columns)} FROM ({SQL['alert_amounts']})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_search_of_texts_equals_search_of_the_index_and_builds_none(spark, tmp_path, monkeypatch):
    rng = random.Random(31)
    words = ["licnese", "abcdefgh", "the", "2024"]
    letters = "abcdefghilnstec"
    texts = [None, "", "The Théory of LICENSE", "license-2024 abdcefgh the"]
    for _ in range(300):
        held = []
        for _ in range(rng.randint(1, 12)):
            w = list(rng.choice(words))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w)) if w else 0
                w[at : at + rng.randint(0, 2)] = rng.choice(["", rng.choice(letters), rng.choice(letters) + rng.choice(letters)]) if rng.random() < 0.6 else w[at : at + 2][::-1]
            held.append("".join(w))
        texts.append(rng.choice([" ", ", ", "-É-"]).join(held))
    docs = spark.createDataFrame([*enumerate(texts), (3, "the again")], "doc_id long, text string")
    search.store(docs, f"{tmp_path}/index")
    index = search.opened(spark, f"{tmp_path}/index")
    indexed = search.rows_of(index, search.expand(words, index)).groupBy("doc_id", "word").agg(F.min("level").alias("level"))
    read = search.standing(docs, words, "doc_id", "text").groupBy("doc_id", "word").agg(F.min("level").alias("level"))
    got = sorted(map(tuple, read.collect()))
    assert got == sorted(map(tuple, indexed.select(read.columns).collect())) and {(w, k) for _, w, k in got} >= {("licnese", 2), ("abcdefgh", 2), ("the", 0), ("the", 1), ("2024", 0)}
    weights = docs.selectExpr("doc_id", "doc_id % 7 AS weight").distinct()
    assert search.search_texts(docs, words[:3], weights, 9).collect() == search.search(index, words[:3], weights, 9).collect() != []
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "store", lambda *a, **k: pytest.fail("an index is built"))
    assert QUERIES["search_topk"](spark, str(tmp_path)).count() > 0
