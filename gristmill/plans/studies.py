"""Splits, influence, strata, screens and completeness over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.plans.registry import query
from gristmill.session import table


@query(
    "held_out_split",
    """WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
    r AS (SELECT day, n, row_number() OVER (ORDER BY day DESC) AS k, sum(n) OVER (ORDER BY day DESC) AS held_rows, sum(urgent) OVER (ORDER BY day DESC) AS held_urgent, count(*) OVER () AS days FROM n),
    c AS (SELECT min(k) AS least FROM r WHERE k >= 30 AND held_rows >= 100 AND held_urgent >= 20 AND k <= 0.2 * days)
    SELECT CAST(day AS VARCHAR) AS day, n, coalesce(k <= least, false) AS held FROM r, c""",
)
def held_out_split(spark, d):
    """The newest days that together meet every minimum, if these are at most a fifth of all days; none otherwise.

    Rows are counted by day first, so the ordered window sees days alone.
    """
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    newest = Window.orderBy(F.desc("day"))
    running = daily.withColumns({"k": F.row_number().over(newest), "held_rows": F.sum("n").over(newest), "held_urgent": F.sum("urgent").over(newest)})
    running = running.join(daily.agg(F.count("*").alias("days")), F.lit(True))
    enough = (F.col("k") >= 30) & (F.col("held_rows") >= 100) & (F.col("held_urgent") >= 20) & (F.col("k") <= 0.2 * F.col("days"))
    least = running.where(enough).agg(F.min("k").alias("least"))
    return running.join(least, F.lit(True)).select(F.col("day").cast("string"), "n", F.coalesce(F.col("k") <= F.col("least"), F.lit(False)).alias("held"))


_SCORED = "SELECT *, 0.05 + (o_orderkey % 10) / 10.0::DOUBLE AS p, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders"


def _scored(spark, d):
    return table(spark, d, "orders").withColumns({"p": 0.05 + (F.col("o_orderkey") % 10) / 10.0, "y": (F.col("o_orderstatus") == "F").cast("int")})


@query(
    "drop_one_month",
    f"""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum((p - y) * (p - y)) AS part, count(*) AS n FROM ({_SCORED}) GROUP BY 1), t AS (SELECT sum(part) AS whole, sum(n) AS total FROM m)
    SELECT month, round((whole - part) / (total - n), 6) AS brier, round((whole - part) / (total - n) - whole / total, 6) AS influence FROM m, t WHERE total > n""",
)
def drop_one_month(spark, d):
    """The score without each month, from the sums of all and of the month: no row is read twice for it."""
    squared = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    months = _scored(spark, d).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(squared).alias("part"), F.count("*").alias("n"))
    both = months.join(months.agg(F.sum("part").alias("whole"), F.sum("n").alias("total")), F.lit(True)).where("total > n")
    without = (F.col("whole") - F.col("part")) / (F.col("total") - F.col("n"))
    return both.select("month", F.round(without, 6).alias("brier"), F.round(without - F.col("whole") / F.col("total"), 6).alias("influence"))


@query(
    "best_constant_shift",
    f"""WITH c AS (SELECT ln(p / (1 - p)) AS z, y, count(*) AS n FROM ({_SCORED}) GROUP BY 1, 2), g AS (SELECT unnest(range(-20, 21)) AS k),
    l AS (SELECT k, round(sum(n * ln(1 + exp(CASE WHEN y = 1 THEN -1 ELSE 1 END * (z + k / 10.0::DOUBLE)))) / sum(n), 6) AS loss FROM c, g GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS tenths, loss, row_number() OVER (ORDER BY loss, k) = 1 AS best FROM l""",
)
def best_constant_shift(spark, d):
    """The loss of each shift of the log odds; the least one is best, the smaller shift of equal ones.

    Rows of the same chance and outcome are counted once and met by the grid as one.
    """
    cells = _scored(spark, d).groupBy(F.log(F.col("p") / (1 - F.col("p"))).alias("z"), "y").agg(F.count("*").alias("n"))
    grid = cells.withColumn("tenths", F.explode(F.sequence(F.lit(-20), F.lit(20))))
    sign = F.when(F.col("y") == 1, -1).otherwise(1)
    losses = grid.groupBy("tenths").agg(F.round(F.sum(F.col("n") * F.log(1 + F.exp(sign * (F.col("z") + F.col("tenths") / 10.0)))) / F.sum("n"), 6).alias("loss"))
    return losses.withColumn("best", F.row_number().over(Window.orderBy("loss", "tenths")) == 1)


@query(
    "stratum_check",
    f"""SELECT c_mktsegment AS segment, o_orderpriority AS moment, n_regionkey = 1 AS inside, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier
    FROM ({_SCORED}) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND count(DISTINCT CAST(o_orderdate AS DATE)) >= 10""",
)
def stratum_check(spark, d):
    """The score of each stratum that has enough rows and days; a stratum's days are counted before the rows are put together."""
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = _scored(spark, d).join(places, F.col("o_custkey") == F.col("c_custkey"))
    strata = [F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("moment"), (F.col("n_regionkey") == 1).alias("inside")]
    squared = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    daily = joined.groupBy(*strata, F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum(squared).alias("part"))
    sums = daily.groupBy("segment", "moment", "inside").agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.sum("part").alias("part"))
    return sums.where("n >= 20 AND days >= 10").select("segment", "moment", "inside", "n", F.round(F.col("part") / F.col("n"), 6).alias("brier"))


@query(
    "fast_vanish",
    """SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS reads, max(ts) - min(ts) <= INTERVAL 60 MINUTE AND max(ts) < CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 23 HOUR AS vanished
    FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)""",
)
def fast_vanish(spark, d):
    """Statuses of a day last seen within an hour of their first sight, with an hour of the day left in which they were not."""
    claims = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("reads"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    short = F.col("last") <= F.col("first") + F.expr("interval 60 minutes")
    absent = F.col("last") < F.col("date").cast(claims.schema["last"].dataType) + F.expr("interval 23 hours")
    return claims.select("user_id", "event_type", F.col("date").cast("string").alias("day"), "reads", (short & absent).alias("vanished"))


@query(
    "carriage_proof",
    """WITH s AS (SELECT l_suppkey, c_nationkey, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    f AS (SELECT l_suppkey, c_nationkey, min(l_shipdate) AS first FROM s GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS n, count(*) FILTER (o_orderdate >= first) AS carried FROM s JOIN f USING (l_suppkey, c_nationkey) GROUP BY 1""",
)
def carriage_proof(spark, d):
    """A supplier carries a nation from the first day it has shipped there; only orders from then on count as carried.

    Rows are counted by supplier, nation and day before they meet the first day.
    """
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    daily = lines.groupBy("l_suppkey", "c_nationkey", "o_orderdate").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("shipped"))
    first = F.min("shipped").over(Window.partitionBy("l_suppkey", "c_nationkey"))
    return daily.withColumn("first", first).groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("o_orderdate") >= F.col("first"), F.col("n")).otherwise(0)).alias("carried"))


@query(
    "taken_back",
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events), w AS (SELECT day FROM e GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') * 4 > count(*)), p AS (SELECT DISTINCT day, user_id FROM e WHERE event_type = 'error')
    SELECT event_id FROM e WHERE day NOT IN (SELECT day FROM w) AND NOT EXISTS (SELECT 1 FROM p WHERE p.day = e.day AND p.user_id = e.user_id)""",
)
def taken_back(spark, d):
    """Rows outside the days, and the pairs of a day and a user, that are taken back when read."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    days = events.groupBy("day").agg((F.count_if(F.col("event_type") == "error") * 4 > F.count("*")).alias("out")).where("out").select("day")
    pairs = events.where("event_type = 'error'").select("day", "user_id").distinct()
    return events.join(days, "day", "left_anti").join(pairs, ["day", "user_id"], "left_anti").select("event_id")


@query("published_text_screen", "SELECT doc_id, coalesce(regexp_matches(text, 'https?://|www[.]') OR contains(lower(text), lower(source)), false) AS refused FROM documents")
def published_text_screen(spark, d):
    """Texts that name a page or their own source."""
    refused = F.col("text").rlike("https?://|www[.]") | F.contains(F.lower("text"), F.lower("source"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(refused, F.lit(False)).alias("refused"))


@query(
    "strongest_of_day",
    """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(CASE WHEN event_type = 'error' THEN 3 WHEN value >= 50 THEN 2 ELSE 1 END) AS strongest FROM events GROUP BY 1, 2""",
)
def strongest_of_day(spark, d):
    level = F.when(F.col("event_type") == "error", 3).when(F.col("value") >= 50, 2).otherwise(1)
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max(level).alias("strongest"))


@query(
    "uptime_bars",
    """WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS reads, count(*) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1), b AS (SELECT CAST(unnest(generate_series(CAST(max(ts) AS DATE) - INTERVAL 89 DAY, CAST(CAST(max(ts) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM events)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(reads, 0) AS reads, round(good / reads::DOUBLE, 6) AS share FROM b LEFT JOIN n USING (day)""",
)
def uptime_bars(spark, d):
    """One bar for each of the last 90 days; a day without reads has no share."""
    events = table(spark, d, "events")
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("reads"), F.count_if(F.col("event_type") != "error").alias("good"))
    newest = events.agg(F.to_date(F.max("ts")).alias("newest")).where("newest is not null")
    bars = newest.select(F.explode(F.sequence(F.date_sub("newest", 89), "newest")).alias("day"))
    return bars.join(daily, "day", "left").select(F.col("day").cast("string"), F.coalesce("reads", F.lit(0)).cast("long").alias("reads"), F.round(F.col("good") / F.col("reads"), 6).alias("share"))


_OFFERED = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "reduced": "l_discount > 0.05", "bulk": "l_quantity > 25"}


@query(
    "offer_check",
    f"""WITH o AS (SELECT l_orderkey, l_linenumber, {_OFFERED['returned']} OR {_OFFERED['open']} AS wanted, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _OFFERED.items())}], lambda x: x IS NOT NULL) AS offered FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN wanted THEN NULL WHEN len(offered) = 0 THEN 'offers nothing' ELSE 'offers only ' || array_to_string(offered, ', ') END AS reason FROM o""",
)
def offer_check(spark, d):
    """Why a row is dropped that offers nothing wanted, naming what it does offer; null for a row that stays."""
    offered = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _OFFERED.items()]))
    wanted = F.expr(_OFFERED["returned"]) | F.expr(_OFFERED["open"])
    reason = F.when(wanted, None).when(F.size(offered) == 0, "offers nothing").otherwise(F.concat(F.lit("offers only "), F.array_join(offered, ", ")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(
    "newest_complete_cycle",
    """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts) // 6) = 4 AS whole FROM events GROUP BY 1, 2),
    r AS (SELECT event_type, day, max(CASE WHEN whole THEN day END) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cycle FROM c)
    SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN day - cycle <= 3 THEN CAST(cycle AS VARCHAR) END AS cycle FROM r""",
)
def newest_complete_cycle(spark, d):
    """For each day the newest cycle, at most three days old, all of whose quarters were posted.

    Rows are first counted by quarter and then by day, so what is put in order has one row for a cycle.
    """
    quarters = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).alias("quarter")).distinct()
    cycles = quarters.groupBy("event_type", "day").agg((F.count("*") == 4).alias("whole"))
    up_to = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    found = cycles.withColumn("cycle", F.max(F.when(F.col("whole"), F.col("day"))).over(up_to))
    return found.select("event_type", F.col("day").cast("string"), F.when(F.datediff("day", "cycle") <= 3, F.col("cycle").cast("string")).alias("cycle"))


@query("raw_extras", "SELECT doc_id, list_filter(['lang=' || lang, 'source=' || source], lambda x: x IS NOT NULL) AS extras FROM documents")
def raw_extras(spark, d):
    """The further columns of a row as a map without its nulls, shown as sorted entries."""
    extras = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    return table(spark, d, "documents").select("doc_id", F.transform(F.array_sort(F.map_entries(extras)), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("extras"))
