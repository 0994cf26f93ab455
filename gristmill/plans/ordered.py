"""Runs, islands, slots, ledgers and encodings over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import blocks, ledger, sequences
from gristmill.plans.registry import query
from gristmill.session import table


@query(
    "run_compaction",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS DISTINCT FROM event_type""",
)
def run_compaction(spark, d):
    return sequences.drop_unchanged(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


_NUMBER = "(date_diff('day', DATE '1969-12-29', day) // 7) * 5 + least(date_diff('day', DATE '1969-12-29', day) % 7, 4)"


@query(
    "weekday_gap_storms",
    f"""WITH d AS (SELECT DISTINCT o_custkey % 100 AS place, CAST(o_orderdate AS DATE) AS day FROM orders WHERE isodow(o_orderdate) <= 5),
    n AS (SELECT *, {_NUMBER} AS number FROM d),
    s AS (SELECT *, CASE WHEN number - lag(number) OVER (PARTITION BY place ORDER BY day) <= 2 THEN 0 ELSE 1 END AS starts FROM n),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY place ORDER BY day) AS storm FROM s)
    SELECT place, CAST(min(day) AS DATE) AS first_day, CAST(max(day) AS DATE) AS last_day, count(*) AS days FROM i GROUP BY place, storm""",
    ("first_day", "last_day"),
)
def weekday_gap_storms(spark, d):
    days = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("place"), F.to_date("o_orderdate").alias("day")).where(F.weekday("day") < 5).distinct()
    numbered = days.withColumn("number", sequences.weekday_number(F.col("day")))
    gap = F.col("number") - F.lag("number").over(Window.partitionBy("place").orderBy("day"))
    marked = sequences.islands(numbered.withColumn("gap", gap), ["place"], ["day"], F.coalesce(F.col("gap") > 2, F.lit(True)), "storm")
    return marked.groupBy("place", "storm").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("storm")


_SPANS = "SELECT event_id, user_id, event_type, ts AS lo, ts + to_seconds(CAST(floor(value * 3600) AS BIGINT)) AS hi FROM events"


@query(
    "latest_wins_overlap",
    f"""WITH e AS ({_SPANS}), l AS (SELECT *, max(hi) OVER (PARTITION BY user_id) AS latest FROM e),
    s AS (SELECT *, min(CASE WHEN hi = latest THEN lo END) OVER (PARTITION BY user_id) AS since FROM l)
    SELECT user_id, count(*) AS rows_on_top, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' ELSE min(event_type) END AS verdict FROM s WHERE hi = latest OR hi > since GROUP BY 1""",
)
def latest_wins_overlap(spark, d):
    hi = F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 3600))
    top = sequences.simultaneous_latest(table(spark, d, "events").select("user_id", "event_type", F.col("ts").alias("lo"), hi.alias("hi")), "user_id", "lo", "hi")
    verdict = F.when(F.countDistinct("event_type") > 1, "conflict").otherwise(F.min("event_type"))
    return top.groupBy("user_id").agg(F.count("*").alias("rows_on_top"), verdict.alias("verdict"))


@query(
    "supersede_fold",
    """WITH o AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, CAST(count(*) FILTER (before <> event_type) AS INTEGER) AS changes FROM o GROUP BY 1""",
)
def supersede_fold(spark, d):
    return sequences.supersede(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query(
    "churn_detect",
    """WITH k AS (SELECT event_type, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(user_id))) AS users FROM events GROUP BY 1, 2),
    p AS (SELECT *, lag(users) OVER (PARTITION BY event_type ORDER BY day) AS before FROM k),
    c AS (SELECT event_type, day, len(list_filter(users, lambda x: NOT list_contains(before, x))) AS new, len(list_filter(before, lambda x: NOT list_contains(users, x))) AS gone, len(users) AS now, len(before) AS was FROM p WHERE before IS NOT NULL)
    SELECT event_type, day, CAST(new AS INTEGER) AS new, CAST(gone AS INTEGER) AS gone, was >= 5 AND new >= 0.5 * now AND gone >= 0.5 * was AS churn FROM c""",
    ("day",),
)
def churn_detect(spark, d):
    """Reads whose keys are half new while half of the read before is gone: rows of keys, counted, never gathered."""
    keys = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id").distinct()
    days = keys.groupBy("event_type", "day").agg(F.count("*").alias("now"))
    by_day = Window.partitionBy("event_type").orderBy("day")
    days = days.withColumn("before", F.lag("day").over(by_day)).withColumn("was", F.lag("now").over(by_day)).where("before is not null")
    later = keys.join(days.select("event_type", "day", "before"), ["event_type", "day"])
    both = later.join(keys.withColumnRenamed("day", "before"), ["event_type", "before", "user_id"]).groupBy("event_type", "day").agg(F.count("*").alias("both"))
    counted = days.join(both, ["event_type", "day"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    new, gone = (F.col("now") - F.col("both")).cast("int"), (F.col("was") - F.col("both")).cast("int")
    churn = (F.col("was") >= 5) & (new >= 0.5 * F.col("now")) & (gone >= 0.5 * F.col("was"))
    return counted.select("event_type", "day", new.alias("new"), gone.alias("gone"), churn.alias("churn"))


@query(
    "usual_value_prior_only",
    """WITH o AS (SELECT o_orderkey, o_custkey, c_mktsegment, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
    pool AS (SELECT c_mktsegment, median(o_totalprice) AS middle FROM o GROUP BY 1),
    p AS (SELECT o.o_orderkey, pool.middle, list(b.o_totalprice) FILTER (b.o_totalprice IS NOT NULL) AS own FROM o JOIN pool USING (c_mktsegment)
        LEFT JOIN o b ON b.o_custkey = o.o_custkey AND b.o_orderdate < o.o_orderdate GROUP BY 1, 2)
    SELECT o_orderkey, round(list_median(list_concat(coalesce(own, []), [middle, middle, middle])), 6) AS usual FROM p""",
)
def usual_value_prior_only(spark, d):
    """The median of a customer's earlier values and three copies of its segment's median."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment", "o_orderdate", "o_totalprice")
    pool = joined.groupBy("c_mktsegment").agg(F.median("o_totalprice").alias("middle"))
    placed = joined.join(pool, "c_mktsegment")
    out = sequences.running_medians(placed, "o_custkey", "o_orderdate", "o_totalprice", "middle", 3, "o_orderkey", "usual")
    return out.select("o_orderkey", F.round("usual", 6).alias("usual"))


@query(
    "incident_state",
    """WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'),
    s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 172800 SECOND THEN 0 ELSE 1 END AS starts FROM e),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS incident FROM s)
    SELECT user_id, min(ts) AS opened, max(ts) AS last_seen, count(*) AS ticks FROM i GROUP BY user_id, incident""",
)
def incident_state(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    starts = F.coalesce(F.col("ts") > F.col("before") + F.expr("interval 172800 seconds"), F.lit(True))
    marked = sequences.islands(errors.withColumn("before", before), ["user_id"], ["ts", "event_id"], starts, "incident")
    return marked.groupBy("user_id", "incident").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_seen"), F.count("*").alias("ticks")).drop("incident")


@query(
    "tumbling_slots",
    "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS slot, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
)
def tumbling_slots(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "30 minutes")["start"].alias("slot"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    "sliding_health",
    """WITH s AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) + to_minutes(5 * k) - INTERVAL 10 MINUTE AS slot, event_type FROM events, range(0, 3) t(k))
    SELECT slot, count(*) AS n, round(avg(CAST(event_type <> 'error' AS INTEGER)), 9) AS good FROM s GROUP BY 1""",
)
def sliding_health(spark, d):
    """The share of good reads in every 15 minutes, each 5 minutes."""
    good = F.avg((F.col("event_type") != "error").cast("int"))
    return table(spark, d, "events").groupBy(F.window("ts", "15 minutes", "5 minutes")["start"].alias("slot")).agg(F.count("*").alias("n"), F.round(good, 9).alias("good"))


@query(
    "interval_days_explode",
    """WITH j AS (SELECT l_suppkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY),
    x AS (SELECT DISTINCT l_suppkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM j)
    SELECT l_suppkey, CAST(CASE WHEN month(day) >= 8 THEN year(day) ELSE year(day) - 1 END AS INTEGER) AS season, count(*) AS days FROM x WHERE isodow(day) <= 5 GROUP BY 1, 2""",
)
def interval_days_explode(spark, d):
    """Distinct weekdays that any interval of a supplier covers, by season (August to July)."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = joined.where((F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 30 days"))).select("l_suppkey", F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("b"))
    days = spans.select("l_suppkey", F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5).distinct()
    season = F.year("day") - F.when(F.month("day") >= 8, 0).otherwise(1)
    return days.groupBy("l_suppkey", season.alias("season")).agg(F.count("*").alias("days"))


@query(
    "prorated_window",
    """WITH e AS (SELECT event_type, value, epoch_us(ts) / 1000000.0::DOUBLE AS a, epoch_us(ts) / 1000000.0::DOUBLE + 5400 AS b FROM events),
    x AS (SELECT *, unnest(range(CAST(floor(a / 3600) AS BIGINT), CAST(floor(b / 3600) AS BIGINT) + 1)) AS hour FROM e)
    SELECT event_type, hour, round(sum(value * (least(b, (hour + 1) * 3600) - greatest(a, hour * 3600)) / 5400), 6) AS amount FROM x GROUP BY 1, 2""",
)
def prorated_window(spark, d):
    """Amounts of 90-minute spans, shared among the clock hours that they touch."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = table(spark, d, "events").select("event_type", "value", start.alias("a"), (start + 5400).alias("b"))
    hours = spans.withColumn("hour", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("b") / 3600))))
    share = (F.least(F.col("b"), (F.col("hour") + 1) * 3600) - F.greatest(F.col("a"), F.col("hour") * 3600)) / 5400
    return hours.groupBy("event_type", "hour").agg(F.round(F.sum(F.col("value") * share), 6).alias("amount"))


@query("delta_gap_encode", "SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS gap FROM orders")
def delta_gap_encode(spark, d):
    return sequences.index_gaps(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("delta_gap_roundtrip", 'SELECT o_custkey, o_orderkey AS "index" FROM orders')
def delta_gap_roundtrip(spark, d):
    """Gap arrays of each customer's block of 10,000 numbers and back: the columnar form of a file, and its rows again."""
    base = blocks.block_of(F.col("o_orderkey"), 10_000)
    numbers = table(spark, d, "orders").select(F.struct("o_custkey", base.alias("base")).alias("part"), (F.col("o_orderkey") - base).alias("offset"))
    coded = sequences.index_gaps(numbers, "part", "offset")
    arrays = coded.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "gap"))), lambda r: r["gap"]).alias("gaps"))
    rows = arrays.select("part", F.posexplode("gaps").alias("pos", "gap"))
    return sequences.from_gaps(rows, "part").select("part.o_custkey", (F.col("part.base") + F.col("index")).alias("index"))


@query(
    "range_runs",
    """WITH d AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders), r AS (SELECT *, o_custkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS run FROM d)
    SELECT o_orderstatus, min(o_custkey) AS first, max(o_custkey) AS last FROM r GROUP BY o_orderstatus, run""",
)
def range_runs(spark, d):
    return blocks.runs(table(spark, d, "orders"), ["o_orderstatus"], "o_custkey", 100_000)


@query(
    "peak_window",
    """WITH h AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, sum(value) AS v FROM events GROUP BY 1, 2),
    w AS (SELECT user_id, day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING), 6) AS total FROM h)
    SELECT user_id, arg_min(day, (-total, day)) AS starts, max(total) AS total FROM w GROUP BY 1""",
)
def peak_window(spark, d):
    """The heaviest three consecutive days of a user; the earliest on a tie."""
    daily = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    number = F.unix_date(F.col("day").cast("date"))
    ahead = Window.partitionBy("user_id").orderBy(number).rangeBetween(0, 2)
    totals = daily.withColumn("total", F.round(F.sum("v").over(ahead), 6))
    best = F.min(F.struct((-F.col("total")).alias("less"), "day"))
    return totals.groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.day").alias("starts"), (-F.col("b.less")).alias("total"))


@query(
    "gap_statistics",
    """WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events)
    SELECT event_type, quantile_disc(gap, 0.95) AS p95, max(gap) AS longest FROM g WHERE gap IS NOT NULL GROUP BY 1""",
)
def gap_statistics(spark, d):
    """Gaps between an event and the one before of its type: windows of a type's hour, and a quantile that sorts no type whole."""
    events = table(spark, d, "events").select("event_type", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    after = blocks.lagged(events, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "at", "before")
    gaps = after.select("event_type", (F.col("at") - F.col("before")).alias("gap")).where("gap is not null")
    longest = gaps.groupBy("event_type").agg(F.max("gap").alias("longest"))
    return blocks.nearest_rank(gaps, ["event_type"], "gap", 0.95, "p95").drop("n").join(longest, "event_type")


@query("first_seen_ledger")
def first_seen_ledger(spark, d):
    """Events as reads of sources: a read is a user's hour, its keys are event types and hundreds of the value, and a type is what a row is about. No SQL: an ordered state machine."""
    listed = F.concat_ws("-", "event_type", F.floor(F.col("value") / 100).cast("string"))
    rows = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp").alias("read_at"), listed.alias("listed"), "event_type")
    return ledger.observe(ledger.reads_of(rows, "user_id", "read_at", "listed", "event_type"))
