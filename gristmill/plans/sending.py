"""Notices, shipped versions and remembered products over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.plans.registry import query
from gristmill.session import table
from gristmill.streaming import notices


@query(
    "notices_due",
    """WITH RECURSIVE c AS (SELECT user_id, date_trunc('day', ts) AS day, ts AS told, CAST(floor(value) AS INTEGER) % 101 AS percent, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, CAST(floor(value) AS INTEGER) % 101) AS k
        FROM events WHERE value IS NOT NULL),
    f AS (SELECT user_id, day, k, told, percent, percent AS before, 1 AS n, true AS goes FROM c WHERE k = 1
        UNION ALL SELECT c.user_id, c.day, c.k, c.told, c.percent, CASE WHEN f.n < 4 AND c.percent >= f.before + 20 THEN c.percent ELSE f.before END, f.n + CASE WHEN f.n < 4 AND c.percent >= f.before + 20 THEN 1 ELSE 0 END, f.n < 4 AND c.percent >= f.before + 20
        FROM f JOIN c ON c.user_id = f.user_id AND c.day = f.day AND c.k = f.k + 1)
    SELECT user_id, day, told, percent FROM f WHERE goes""",
    days=("day", "told"),
)
def notices_due(spark, d):
    """A user's day gets the first percentage and each that lies twenty points over the last one sent, four at most."""
    percent = (F.floor("value").cast("int") % 101).alias("percent")
    candidates = table(spark, d, "events").where("value is not null").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("ts").alias("at"), percent)
    return notices.due(candidates, candidates.limit(0), ["user_id", "day"]).select("user_id", "day", F.col("at").alias("told"), "percent")


@query(
    "changed_content",
    """WITH v AS (SELECT o_custkey AS entity, year(o_orderdate) AS version, count(*) || ' ' || max(o_orderpriority) AS content FROM orders GROUP BY 1, 2),
    l AS (SELECT *, sha256(content) AS digest, lag(sha256(content)) OVER (PARTITION BY entity ORDER BY version) AS before FROM v)
    SELECT entity, version, content, digest FROM l WHERE before IS DISTINCT FROM digest""",
)
def changed_content(spark, d):
    """What each yearly version of a customer's summary would ship: content that differs from the version before it."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("version"), "o_orderpriority")
    content = F.concat_ws(" ", F.count("*").cast("string"), F.max("o_orderpriority")).alias("content")
    told = orders.groupBy("entity", "version").agg(content).withColumn("digest", F.sha2(F.encode("content", "UTF-8"), 256))
    before = F.lag("digest").over(Window.partitionBy("entity").orderBy("version"))
    return told.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("digest"))).drop("before")


_PRODUCTS = """SELECT event_type AS key, user_id % 40 AS zone, ts AS sent, ts AS start, ts + INTERVAL 12 HOUR AS "end", value < 20 AS withdraws, ts + to_hours(CAST(event_id % 48 AS INTEGER)) AS last_seen FROM events WHERE value IS NOT NULL"""


@query(
    "products_stood_at",
    f"""WITH p AS ({_PRODUCTS}), m AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 12 HOUR)) AS moment FROM events),
    z AS (SELECT DISTINCT key, zone FROM p), r AS (SELECT moment, p.*, row_number() OVER (PARTITION BY moment, p.key, p.zone ORDER BY sent DESC, withdraws) AS k FROM m JOIN p ON p.sent <= moment)
    SELECT moment, key, zone, sent, start, CASE WHEN last_seen < moment THEN least("end", last_seen) ELSE "end" END AS ends FROM r WHERE k = 1 AND NOT withdraws AND last_seen >= moment - INTERVAL 30 HOUR""",
    days=("moment", "sent", "start", "ends"),
)
def products_stood_at(spark, d):
    """Which product of an event type and zone stood at each noon and midnight; low values withdraw."""
    events = table(spark, d, "events")
    seen = F.timestamp_add("HOUR", (F.col("event_id") % 48).cast("int"), F.col("ts"))
    told = events.where("value is not null").select(F.col("event_type").alias("key"), (F.col("user_id") % 40).alias("zone"), F.col("ts").alias("sent"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(12), F.col("ts")).alias("end"), (F.col("value") < 20).alias("withdraws"), seen.alias("last_seen"))
    ends = events.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b"))
    moments = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 12 hours"))).alias("moment"))
    return notices.stood_at(told, moments)
