"""Days, calendars, posting times and uptime over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import days
from gristmill.operators import sequences
from gristmill.plans.registry import query
from gristmill.session import table

_SPANS = """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate + (l_linenumber * 5) * INTERVAL 1 HOUR AS b, l_shipdate + (l_linenumber * 5 + CAST(l_quantity AS INTEGER)) * INTERVAL 1 HOUR AS e,
    l_shipdate + (l_linenumber * 5 - CAST(l_tax * 100 AS INTEGER)) * INTERVAL 1 HOUR AS i FROM lineitem"""
_COUNTED = f"""SELECT * FROM (SELECT *, unnest(generate_series(CAST(b AS DATE), CAST(e AS DATE), INTERVAL 1 DAY)) AS d0 FROM ({_SPANS})),
    LATERAL (SELECT d0 + INTERVAL 6 HOUR AS six, d0 + INTERVAL 15 HOUR AS three)
    WHERE (b <= six AND six < e) OR (i <= six AND six < e AND six < b AND b < three) OR (i <= six AND six < b AND b < three AND b < e)"""
_SCHOOL = "isodow(day) <= 5 AND (month(day) * 100 + day(day) >= 815 OR month(day) * 100 + day(day) <= 615)"
_YEAR = "year(day) - CASE WHEN month(day) < 7 THEN 1 ELSE 0 END"


def _spans(spark, d):
    hours = F.col("l_linenumber") * 5

    def later(h):
        return F.col("l_shipdate") + F.make_dt_interval(hours=h)

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", later(hours).alias("b"), later(hours + F.col("l_quantity").cast("int")).alias("e"), later(hours - F.round(F.col("l_tax") * 100).cast("int")).alias("i"))


def _counted(spark, d):
    found = days.counted_days(F.col("b"), F.col("e"), F.col("i"))
    return _spans(spark, d).withColumn("day", F.explode(found)).where(days.school_day(F.col("day")))


@query("rows_to_school_days", f"SELECT l_orderkey, l_linenumber, CAST(d0 AS DATE) AS day FROM ({_COUNTED}) WHERE {_SCHOOL.replace('(day)', '(CAST(d0 AS DATE))')}", ("day",))
def rows_to_school_days(spark, d):
    """The school days a span counts for by the rule of six in the morning."""
    return _counted(spark, d).select("l_orderkey", "l_linenumber", "day")


_BY_DAY = f"SELECT l_suppkey, day, max(l_quantity) AS weight FROM (SELECT *, CAST(d0 AS DATE) AS day FROM ({_COUNTED})) WHERE {_SCHOOL} GROUP BY 1, 2"


@query("weighted_school_days", f"SELECT l_suppkey, {_YEAR} AS year, count(*) AS days, sum(weight) AS weight FROM ({_BY_DAY}) GROUP BY 1, 2")
def weighted_school_days(spark, d):
    """Distinct days of each supplier and school year; a day weighs as its largest span."""
    by_day = _counted(spark, d).groupBy("l_suppkey", "day").agg(F.max("l_quantity").alias("weight"))
    return by_day.groupBy("l_suppkey", days.school_year(F.col("day")).alias("year")).agg(F.count("*").alias("days"), F.sum("weight").alias("weight"))


@query(
    "yearly_summary",
    f"""WITH y AS (SELECT l_suppkey, {_YEAR} AS year, count(*) AS days FROM ({_BY_DAY}) GROUP BY 1, 2), whole AS (SELECT year FROM y GROUP BY 1 HAVING count(*) * 2 > (SELECT count(*) FROM supplier))
    SELECT l_suppkey, round(avg(days), 6) AS mean_days, count(*) AS years FROM y SEMI JOIN whole USING (year) GROUP BY 1""",
)
def yearly_summary(spark, d):
    """Mean days a year, without the years that half of the suppliers lack."""
    by_day = _counted(spark, d).select("l_suppkey", "day").distinct()
    yearly = by_day.groupBy("l_suppkey", days.school_year(F.col("day")).alias("year")).agg(F.count("*").alias("days"))
    suppliers = table(spark, d, "supplier").agg(F.count("*").alias("all"))
    whole = yearly.groupBy("year").agg(F.count("*").alias("n")).join(suppliers, F.col("n") * 2 > F.col("all")).select("year")
    return yearly.join(whole, "year", "left_semi").groupBy("l_suppkey").agg(F.round(F.avg("days"), 6).alias("mean_days"), F.count("*").alias("years"))


def _nth(month: int, weekday: int, n: int) -> str:
    first = f"make_date(year(day), {month}, 1)"
    return f"{first} + CAST(({weekday} - (isodow({first}) - 1) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"


@query(
    "likely_breaks",
    f"""WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), y AS (SELECT DISTINCT CAST(year(day) AS BIGINT) AS year FROM t), a AS (SELECT year, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM y),
    h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), r AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS r FROM h),
    m AS (SELECT year, h + r - 7 * ((a + 11 * h + 22 * r) // 451) + 114 AS m FROM r), s AS (SELECT year, make_date(year, m // 31, m % 31 + 1) AS sunday FROM m)
    SELECT day, month(day) * 100 + day(day) >= 1218 OR month(day) * 100 + day(day) <= 103 OR (day >= {_nth(11, 3, 4)} - 3 AND day < {_nth(11, 3, 4)})
        OR day IN (sunday - 2, {_nth(11, 0, 1)} + 1, {_nth(1, 0, 3)}, {_nth(2, 0, 3)}, {_nth(10, 0, 2)}, CASE isodow(make_date(year(day), 11, 11)) WHEN 6 THEN make_date(year(day), 11, 10) WHEN 7 THEN make_date(year(day), 11, 12) ELSE make_date(year(day), 11, 11) END) AS off
    FROM t JOIN s ON year(day) = year""",
    ("day",),
)
def likely_breaks(spark, d):
    found = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return found.select("day", days.likely_break(F.col("day")).alias("off"))


@query(
    "board_dates",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%-d %b %Y') ELSE 'soon' END AS written FROM orders)
    SELECT o_orderkey, written, CAST(coalesce(try_strptime(written, '%Y-%m-%d'), try_strptime(written, '%m/%d/%Y'), try_strptime(written, '%b %d, %Y'), try_strptime(written, '%d %b %Y')) AS DATE) AS day FROM t""",
    ("day",),
)
def board_dates(spark, d):
    """Dates as boards write them, read back."""
    forms = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "M/d/yyyy"))
    forms = forms.when(F.col("o_orderkey") % 5 == 2, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 5 == 3, F.date_format("o_orderdate", "d MMM yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", forms.alias("written")).withColumn("day", days.board_date(F.col("written")))


@query(
    "open_status_days",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS today FROM orders),
    a AS (SELECT o_orderkey, first, list_filter(generate_series(first + 1, today, INTERVAL 1 DAY), lambda x: isodow(x) <= 5)[1:2] AS more FROM t)
    SELECT o_orderkey, strftime(unnest(list_concat([CAST(first AS TIMESTAMP)], more)), '%Y-%m-%d') AS day FROM a""",
)
def open_status_days(spark, d):
    """A status without an end holds on its first day and on the weekdays up to today, three days at most."""
    first = F.to_date("o_orderdate")
    held = days.following_school_days(F.col("first"), F.col("today"), 3)
    spans = table(spark, d, "orders").select("o_orderkey", first.alias("first"), F.date_add(first, (F.col("o_orderkey") % 9).cast("int")).alias("today"))
    return spans.select("o_orderkey", F.explode(held).alias("day")).select("o_orderkey", F.col("day").cast("string"))


@query("night_slots", "SELECT event_id, CASE WHEN (hour(ts) + 6) % 24 < 21 THEN (hour(ts) + 6) % 24 // 3 END AS slot FROM events")
def night_slots(spark, d):
    return table(spark, d, "events").select("event_id", days.night_slot(F.col("ts")).alias("slot"))


@query("local_school_nights")
def local_school_nights(spark, d):
    """18:00 to 06:00 of each customer's local night as instants of UTC; no SQL, zones being a table of the JVM's."""
    zones = F.array(*map(F.lit, ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles")))
    begin, end = days.local_window(F.col("day"), F.col("zone"), "18:00:00", "06:00:00")
    nights = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.element_at(zones, (F.col("o_custkey") % 4 + 1).cast("int")).alias("zone"))
    return nights.select("o_orderkey", "zone", begin.alias("begin"), end.alias("end"))


@query(
    "events_by_gap",
    """WITH t AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R'),
    s AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY l_suppkey ORDER BY day) <= 3 THEN 0 ELSE 1 END AS starts FROM t), i AS (SELECT *, sum(starts) OVER (PARTITION BY l_suppkey ORDER BY day) AS event FROM s)
    SELECT l_suppkey, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS days FROM i GROUP BY l_suppkey, event""",
)
def events_by_gap(spark, d):
    """Days of a supplier's returns at most three apart are one event."""
    found = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", F.to_date("l_shipdate").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy("l_suppkey").orderBy("day"))
    apart = found.withColumn("apart", F.datediff("day", before))
    marked = sequences.islands(apart, ["l_suppkey"], ["day"], F.coalesce(F.col("apart") > 3, F.lit(True)), "event")
    return marked.groupBy("l_suppkey", "event").agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count("*").alias("days")).drop("event")


@query(
    "alternating_values",
    """WITH t AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, event_type, count(*) AS runs FROM t WHERE before IS DISTINCT FROM event_type GROUP BY 1, 2 HAVING count(*) > 1""",
)
def alternating_values(spark, d):
    """Values that a user returns to after another one, and how many runs they have."""
    runs = sequences.drop_unchanged(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "event_type").agg(F.count("*").alias("runs")).where("runs > 1")


@query(
    "share_reached_at",
    """WITH e AS (SELECT c_nationkey, count(*) AS eligible FROM customer GROUP BY 1), f AS (SELECT c_nationkey, c_custkey, min(o_orderdate) AS moment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT c_nationkey, moment, sum(count(*)) OVER (PARTITION BY c_nationkey ORDER BY moment) AS reached FROM f GROUP BY 1, 2)
    SELECT e.c_nationkey, min(moment) FILTER (reached >= 0.5 * eligible) AS moment FROM e LEFT JOIN r USING (c_nationkey) GROUP BY 1""",
)
def share_reached_at(spark, d):
    """When half of a nation's customers had ordered."""
    customer = table(spark, d, "customer")
    eligible = customer.groupBy("c_nationkey").agg(F.count("*").alias("eligible"))
    first = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.min("o_orderdate").alias("moment"))
    times = first.groupBy("c_nationkey", "moment").agg(F.count("*").alias("n"))
    reached = times.withColumn("reached", F.sum("n").over(Window.partitionBy("c_nationkey").orderBy("moment")))
    joined = eligible.join(reached, "c_nationkey", "left")
    return joined.groupBy("c_nationkey").agg(F.min(F.when(F.col("reached") >= 0.5 * F.col("eligible"), F.col("moment"))).alias("moment"))


@query(
    "usual_posting_minute",
    """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, min(hour(ts) * 60 + minute(ts)) AS minute FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(quantile_disc(minute, 0.5) AS INTEGER) AS minute, count(*) AS days FROM p GROUP BY 1 HAVING count(*) >= 3""",
)
def usual_posting_minute(spark, d):
    """The median over days of a user's first minute, for users of three days and more."""
    first = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min(F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    return first.groupBy("user_id").agg(F.expr("percentile_disc(0.5) within group (order by minute)").cast("int").alias("minute"), F.count("*").alias("days")).where("days >= 3")


@query(
    "daily_uptime",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, bool_or(event_type = 'error') AS down FROM events GROUP BY 1, 2)
    SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (NOT down) AS ok, count(*) FILTER (down) AS down, 48 - count(*) AS missing, round(count(*) FILTER (NOT down) / 48.0::DOUBLE, 6) AS share FROM s GROUP BY 1""",
)
def daily_uptime(spark, d):
    """Half hours of a day that were good, down or without a sample."""
    slots = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.window("ts", "30 minutes")["start"].alias("slot")).agg(F.bool_or(F.col("event_type") == "error").alias("down"))
    ok, down = F.count_if(~F.col("down")), F.count_if("down")
    return slots.groupBy(F.col("day").cast("string").alias("day")).agg(ok.alias("ok"), down.alias("down"), (48 - F.count("*")).alias("missing"), F.round(ok / 48.0, 6).alias("share"))


@query(
    "interval_samples",
    """WITH o AS (SELECT o_orderkey, o_orderdate AS d, o_orderdate + (o_custkey % 60) * INTERVAL 1 MINUTE AS b FROM orders),
    s AS (SELECT o_orderkey, b, unnest(generate_series(b, d + INTERVAL 2 HOUR, INTERVAL 15 MINUTE)) AS moment FROM o UNION SELECT o_orderkey, b, d + unnest([0, 30, 60, 90, 120]) * INTERVAL 1 MINUTE FROM o)
    SELECT o_orderkey, moment FROM s WHERE moment >= b""",
)
def interval_samples(spark, d):
    """Quarter hours from a span's begin, and the full and half hours within it."""
    begin, end = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_custkey") % 60).cast("int")), F.col("o_orderdate") + F.expr("interval 2 hours")
    steps = F.sequence(begin, end, F.expr("interval 15 minutes"))
    halves = F.filter(F.sequence(F.col("o_orderdate"), end, F.expr("interval 30 minutes")), lambda t: t >= begin)
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.array_union(steps, halves)).alias("moment"))
