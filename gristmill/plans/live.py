"""Holds, breakers, change logs and counters over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.plans.registry import query
from gristmill.session import table


@query(
    "change_log",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1, 2), n AS (SELECT day, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM s)),
    a AS (SELECT n.next AS day, user_id, status AS was FROM s JOIN n USING (day) WHERE next IS NOT NULL), b AS (SELECT s.* FROM s JOIN n ON s.day = n.next)
    SELECT CAST(coalesce(a.day, b.day) AS VARCHAR) AS day, coalesce(a.user_id, b.user_id) AS user_id, was, status AS now, CASE WHEN was IS NULL THEN 'lit' WHEN status IS NULL THEN 'dark' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.day = b.day AND a.user_id = b.user_id WHERE was IS DISTINCT FROM status""",
)
def change_log(spark, d):
    """What differs between each day's statuses and those of the day before that has any."""
    status = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("now"))
    days = status.select("day").distinct().withColumn("next", F.lead("day").over(Window.orderBy("day"))).where("next is not null")
    before = status.join(days, "day").select(F.col("next").alias("day"), "user_id", F.col("now").alias("was"))
    after = status.join(days.select(F.col("next").alias("day")), "day")
    joined = before.join(after, ["day", "user_id"], "full").where("NOT (was <=> now)")
    change = F.when(F.col("was").isNull(), "lit").when(F.col("now").isNull(), "dark").otherwise("changed")
    return joined.select(F.col("day").cast("string"), "user_id", "was", "now", change.alias("change"))


@query(
    "source_breaker",
    """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM n)
    SELECT user_id, CAST(day AS VARCHAR) AS day, n, n > greatest(3, 1.5 * coalesce(most, 0)) AS tripped FROM m""",
)
def source_breaker(spark, d):
    """Days on which a source brings more than half again of its largest day before, and more than three rows."""
    sizes = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    limit = F.greatest(F.lit(3.0), 1.5 * F.coalesce(most, F.lit(0)))
    return sizes.select("user_id", F.col("day").cast("string"), "n", (F.col("n") > limit).alias("tripped"))


@query(
    "spike_hold",
    """WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS lit, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS share FROM events GROUP BY 1), b AS (SELECT *, lag(lit) OVER (ORDER BY day) AS before FROM n),
    h AS (SELECT *, coalesce(lit - before > 3 AND share < 0.5, false) AS spike FROM b)
    SELECT CAST(day AS VARCHAR) AS day, lit, spike AND NOT coalesce(lag(spike) OVER (ORDER BY day), false) AS held FROM h""",
)
def spike_hold(spark, d):
    """A rise without alerts holds a day's publishing, unless the day before was held for one: the second confirms the first."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("lit"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("share"))
    by_day = Window.orderBy("day")
    spike = F.coalesce((F.col("lit") - F.lag("lit").over(by_day) > 3) & (F.col("share") < 0.5), F.lit(False))
    marked = daily.withColumn("spike", spike)
    held = F.col("spike") & ~F.coalesce(F.lag("spike").over(by_day), F.lit(False))
    return marked.select(F.col("day").cast("string"), "lit", held.alias("held"))


@query(
    "freshness_hold",
    """WITH g AS (SELECT user_id, ts, event_id, event_type, max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good FROM events)
    SELECT event_id, coalesce(good >= ts - INTERVAL 129600 SECOND, false) AS held FROM g""",
)
def freshness_hold(spark, d):
    """Whether a source's last good read is recent enough for its statuses to stand."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    good = F.max(F.when(F.col("event_type") != "error", F.col("ts"))).over(order)
    return table(spark, d, "events").select("event_id", F.coalesce(good >= F.col("ts") - F.expr("interval 129600 seconds"), F.lit(False)).alias("held"))


@query(
    "hold_backout",
    """WITH k AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS dark FROM events GROUP BY 1), r AS (SELECT e.user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS before FROM events e)
    SELECT r.user_id, event_id, event_type FROM r JOIN k USING (user_id) WHERE before IS DISTINCT FROM event_type AND (dark IS NULL OR ts <= dark)""",
)
def hold_backout(spark, d):
    """Runs of a user's statuses without those since the last dark one."""
    events = table(spark, d, "events")
    dark = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("dark"))
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    runs = events.withColumn("before", before).where("NOT (before <=> event_type)")
    return runs.join(dark, "user_id").where("dark IS NULL OR ts <= dark").select("user_id", "event_id", "event_type")


@query(
    "successor_links",
    """WITH s AS (SELECT o_custkey % 50 AS place, o_orderpriority AS ident, o_orderkey AS key, o_orderdate AS seen FROM orders),
    r AS (SELECT a.key, b.key AS before, rank() OVER (PARTITION BY a.key ORDER BY b.seen DESC) AS place FROM s a JOIN s b ON a.place = b.place AND a.ident = b.ident AND b.seen < a.seen)
    SELECT key, CASE WHEN count(*) = 1 THEN min(before) END AS predecessor, count(*) > 1 AS unknown FROM r WHERE place = 1 GROUP BY 1""",
)
def successor_links(spark, d):
    """The key of the same listing seen last before a new one; ties are unknown.

    Times of a listing are put in order once and each takes the keys of the
    time before, so earlier keys are never paired with all later ones.
    """
    place = [(F.col("o_custkey") % 50).alias("place"), F.col("o_orderpriority").alias("ident")]
    seen = table(spark, d, "orders").select(*place, F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("seen"))
    times = seen.groupBy("place", "ident", "seen").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    by_time = Window.partitionBy("place", "ident").orderBy("seen")
    linked = times.select("place", "ident", "seen", F.lag("least").over(by_time).alias("before"), F.lag("n").over(by_time).alias("ties")).where("ties is not null")
    return seen.join(linked, ["place", "ident", "seen"]).select("key", F.when(F.col("ties") == 1, F.col("before")).alias("predecessor"), (F.col("ties") > 1).alias("unknown"))


@query(
    "counter_windows",
    """WITH e AS (SELECT user_id, ts, event_id, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) > 2 AS limited FROM e""",
)
def counter_windows(spark, d):
    """A counter that starts again with each window, and whether it is past its limit."""
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", n.alias("n"), (n > 2).alias("limited"))


@query("audit_targets", "SELECT event_id, coalesce((SELECT c_name FROM customer WHERE c_custkey = user_id), 'user ' || CAST(user_id AS VARCHAR)) AS target FROM events")
def audit_targets(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, d, "events").join(names, "user_id", "left").select("event_id", F.coalesce("c_name", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("target"))


@query("listed_page", "SELECT c_custkey, c_name, n_name, (SELECT count(*) FROM customer WHERE c_name LIKE '%5%') AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name LIKE '%5%' ORDER BY c_custkey DESC LIMIT 10 OFFSET 10")
def listed_page(spark, d):
    """The second page of ten of the names with a five, with how many there are."""
    found = table(spark, d, "customer").where("c_name LIKE '%5%'")
    page = found.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name").orderBy(F.desc("c_custkey")).offset(10).limit(10)
    return page.join(found.agg(F.count("*").alias("total")), F.lit(True))


@query("epoch_days", """SELECT event_id, '["' || strftime(to_timestamp(epoch(ts) - 43200) AT TIME ZONE 'UTC', '%Y-%m-%d') || '"]' AS days FROM events""")
def epoch_days(spark, d):
    """The day of a moment twelve hours earlier, as a JSON list."""
    return table(spark, d, "events").select("event_id", F.to_json(F.array(F.to_date(F.col("ts") - F.expr("interval 12 hours")))).alias("days"))


@query("unexpired", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def unexpired(spark, d):
    """Rows of the last two weeks of the table."""
    events = table(spark, d, "events")
    return events.join(events.agg(F.max("ts").alias("newest")), F.col("ts") >= F.col("newest") - F.expr("interval 14 days")).select("event_id")


@query(
    "state_snapshots",
    """SELECT e.user_id, d.day::VARCHAR AS day, arg_max(event_type, (ts, event_id)) AS status FROM events e JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d ON e.ts < d.day + INTERVAL 1 DAY AND e.ts >= d.day - INTERVAL 6 DAY GROUP BY 1, 2""",
)
def state_snapshots(spark, d):
    """Each user's last status of the seven days up to each day: rows stand in the days they can be seen from."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.to_date("ts").alias("own"))
    seen = events.withColumn("day", F.explode(F.sequence("own", F.date_add("own", 6))))
    days = events.select(F.col("own").alias("day")).distinct()
    return seen.join(days, "day", "left_semi").groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
