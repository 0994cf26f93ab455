"""Files written and read back, feeds and contracts over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.plans.places import _shared
from gristmill.plans.registry import query
from gristmill.session import table
from gristmill.sources import files


def _folder(spark, name: str) -> str:
    return f"{_shared(spark)}/gristmill-{name}-{uuid.uuid4().hex}"


@query("delimited_roundtrip", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")
def delimited_roundtrip(spark, d):
    """Text columns through a delimited file; leading zeros stay, and the filter is part of the read."""
    path = _folder(spark, "delimited")
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    files.write_delimited(table(spark, d, "customer").select(key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), path)
    return files.delimited(spark, path, ["id", "name", "segment"], where=F.col("segment") == "BUILDING")


@query("feature_roundtrip", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, '[' || CAST(n_nationkey AS VARCHAR) || '.0,' || CAST(n_regionkey AS VARCHAR) || '.0]' AS coordinates FROM nation")
def feature_roundtrip(spark, d):
    """Nations as a collection of point features, one file a region, read back with a fixed schema."""
    path = _folder(spark, "features")
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("coordinates")))
    feature = F.concat(F.lit('{"type":"Feature","id":"'), F.col("n_nationkey").cast("string"), F.lit('","geometry":'), point, F.lit(',"properties":'), F.to_json(F.create_map(F.lit("name"), F.col("n_name"))), F.lit("}"))
    body = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("body"))
    body.select("body", "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = files.features(spark, path)
    return found.select("id", F.col("properties")["name"].alias("name"), F.get_json_object("geometry", "$.coordinates").alias("coordinates"))


@query(
    "rows_tied_to_reads",
    """WITH r AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id % 3 <> 0)
    SELECT e.event_type, count(r.day) AS tied, count(*) - count(r.day) AS orphans FROM events e LEFT JOIN r ON e.user_id = r.user_id AND CAST(e.ts AS DATE) = r.day GROUP BY 1""",
)
def rows_tied_to_reads(spark, d):
    """Rows and reads as JSON lines; every row is tied to the read it came in or counted as an orphan."""
    rows, reads = _folder(spark, "rows"), _folder(spark, "reads")
    events = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "event_id")
    files.write_json_lines(events, rows)
    files.write_json_lines(events.where("user_id % 3 <> 0").select("user_id", "day").distinct(), reads)
    tied, orphans = files.tied(files.json_lines(spark, rows, "user_id long, day string, event_type string, event_id long"), files.json_lines(spark, reads, "user_id long, day string"), ["user_id", "day"])
    both = tied.select("event_type", F.lit(1).alias("t"), F.lit(0).alias("o")).union(orphans.select("event_type", F.lit(0), F.lit(1)))
    return both.groupBy("event_type").agg(F.sum("t").alias("tied"), F.sum("o").alias("orphans"))


@query("edition_roundtrip", "SELECT s_suppkey, s_name FROM supplier")
def edition_roundtrip(spark, d):
    """Two editions of a table under one folder; a reader asks for one."""
    path, supplier = _folder(spark, "editions"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    files.write_edition(supplier.where("s_suppkey < 3"), path, "old")
    files.write_edition(supplier, path, "new")
    return files.read_edition(spark, path, "new")


@query(
    "contract_check",
    """SELECT 'price' AS rule, count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS rows FROM orders UNION ALL SELECT 'status', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders UNION ALL SELECT 'key', count(*) FILTER (o_orderkey IS NULL) FROM orders""",
)
def contract_check(spark, d):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "key": F.col("o_orderkey").isNotNull()}
    return files.broken(table(spark, d, "orders"), rules)


@query("sorted_json", """SELECT n_nationkey, '{"key":' || CAST(n_nationkey AS VARCHAR) || ',"name":"' || n_name || '","region":' || CAST(n_regionkey AS VARCHAR) || '}' AS line FROM nation""")
def sorted_json(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("line"))


@query("json_payloads", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"user\":' || CAST(user_id AS VARCHAR) || '}' AS again FROM events")
def json_payloads(spark, d):
    """Payloads parsed with a fixed schema and written again with another field."""
    parsed = table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.select("event_id", "k", F.to_json(F.struct("k", F.col("user_id").alias("user"))).alias("again"))


@query(
    "registry_gate",
    """WITH r AS (SELECT n_nationkey AS c_nationkey, n_nationkey % 4 = 0 AS barred, n_nationkey % 5 = 1 AS terms FROM nation WHERE n_nationkey < 20)
    SELECT c_custkey, CASE WHEN r.c_nationkey IS NULL THEN 'unlisted' WHEN barred THEN 'barred' WHEN terms THEN 'terms' WHEN c_acctbal < 0 THEN 'status' END AS dropped FROM customer LEFT JOIN r USING (c_nationkey)""",
)
def registry_gate(spark, d):
    """The first reason of a registry of sources for which a row is dropped."""
    registry = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 4 == 0).alias("barred"), (F.col("n_nationkey") % 5 == 1).alias("terms"))
    joined = table(spark, d, "customer").join(registry, "c_nationkey", "left")
    why = F.when(F.col("barred").isNull(), "unlisted").when(F.col("barred"), "barred").when(F.col("terms"), "terms").when(F.col("c_acctbal") < 0, "status")
    return joined.select("c_custkey", why.alias("dropped"))


@query("allowed_events", "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN 'type' WHEN value IS NULL OR value < 50 THEN 'scope' END AS dropped FROM events")
def allowed_events(spark, d):
    """Rows of the types on a list, each other one with its reason; the list is a table."""
    allowed = table(spark, d, "events").select("event_type").distinct().where(F.col("event_type").isin("error", "click")).withColumn("listed", F.lit(True))
    joined = table(spark, d, "events").join(allowed, "event_type", "left")
    return joined.select("event_id", F.when(F.col("listed").isNull(), "type").when(F.col("value").isNull() | (F.col("value") < 50), "scope").alias("dropped"))


@query(
    "usable_labels",
    "SELECT l.doc_id, quality FROM labels l SEMI JOIN documents d ON l.doc_id = d.doc_id WHERE quality IN (0, 1) AND toxic = 0",
)
def usable_labels(spark, d):
    known = table(spark, d, "documents").select("doc_id")
    return table(spark, d, "labels").where(F.col("quality").isin(0, 1) & (F.col("toxic") == 0)).join(known, "doc_id", "left_semi").select("doc_id", "quality")


@query("merged_reads", "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def merged_reads(spark, d):
    """Reads of two runs that overlap, each once: one until the 20th of a month and one from the 10th on, which together lose nothing."""
    reads = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("on"))
    both = reads.where(F.day("on") <= 20).unionByName(reads.where(F.day("on") >= 10))
    return both.select("user_id", "event_type", F.col("on").cast("string").alias("day")).dropDuplicates()


@query(
    "united_directory",
    "SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey + 1000000, c_name, 'customer', c_acctbal, c_mktsegment FROM customer",
)
def united_directory(spark, d):
    """Tables of different columns as one directory."""
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    customer = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return supplier.unionByName(customer, allowMissingColumns=True)
