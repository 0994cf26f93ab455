"""Validation, joins and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import joins, quality
from gristmill.operators.sequences import weekday_number
from gristmill.plans.registry import query
from gristmill.session import table

REASONS = """
    CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'no_price'
         WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status'
         WHEN NOT o_totalprice BETWEEN 10000 AND 400000 THEN 'bounds'
         WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'customer' END"""


def _judged(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    price = F.col("o_totalprice")
    checks = [
        (price.isNull() | (price <= 0), "no_price"),
        (~F.col("o_orderstatus").isin("O", "F"), "status"),
        (quality.out_of_bounds(price, 10000, 400000), "bounds"),
        (F.col("c_custkey").isNull() | (F.col("c_acctbal") < 0), "customer"),
    ]
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    return joined.withColumn("drop_reason", quality.first_reason(checks))


@query("reject_reasons", f"SELECT o_orderkey, {REASONS} AS drop_reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def reject_reasons(spark, d):
    return _judged(spark, d).select("o_orderkey", "drop_reason")


@query(
    "reconcile_rollup",
    f"""WITH j AS (SELECT r_name, {REASONS} AS drop_reason FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason IS NOT NULL) AS dropped, count(*) AS total
    FROM j GROUP BY ROLLUP (r_name)""",
)
def reconcile_rollup(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    placed = _judged(spark, d).join(nation, F.col("c_nationkey") == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return quality.reconcile(placed, "drop_reason", "r_name")


@query(
    "unique_key_audit",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL
    HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
)
def unique_key_audit(spark, d):
    return quality.key_violations(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query(
    "left_join_reference",
    """SELECT o_orderkey, c_name, n_name, r_name, CAST(i AS BIGINT) AS nation_index FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT *, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation) ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def left_join_reference(spark, d):
    orders, customer, region = (table(spark, d, t) for t in ("orders", "customer", "region"))
    nation = table(spark, d, "nation").withColumn("nation_index", (F.row_number().over(Window.orderBy("n_name")) - 1).cast("long"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
    return joined.join(region, F.col("n_regionkey") == region.r_regionkey, "left").select("o_orderkey", "c_name", "n_name", "r_name", "nation_index")


@query(
    "full_outer_compare",
    """SELECT day, coalesce(ordered, 0) AS ordered, coalesce(shipped, 0) AS shipped,
        CASE WHEN shipped IS NULL THEN 'only_ordered' WHEN ordered IS NULL THEN 'only_shipped' WHEN ordered = shipped THEN 'agree' ELSE 'differ' END AS verdict
    FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS ordered FROM orders GROUP BY 1)
    FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem GROUP BY 1) USING (day)""",
    ("day",),
)
def full_outer_compare(spark, d):
    ordered = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("ordered"))
    shipped = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("shipped"))
    verdict = F.when(F.col("shipped").isNull(), "only_ordered").when(F.col("ordered").isNull(), "only_shipped").when(F.col("ordered") == F.col("shipped"), "agree").otherwise("differ")
    return ordered.join(shipped, "day", "full").select("day", F.coalesce("ordered", F.lit(0)).alias("ordered"), F.coalesce("shipped", F.lit(0)).alias("shipped"), verdict.alias("verdict"))


@query(
    "anti_join_uncovered",
    """SELECT c_nationkey, count(*) AS n, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
    FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) GROUP BY 1""",
)
def anti_join_uncovered(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    free = customer.join(orders.where("o_orderpriority = '1-URGENT'"), customer.c_custkey == F.col("o_custkey"), "left_anti").select("c_nationkey", "c_mktsegment").distinct()
    return free.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ",").alias("segments"))


@query(
    "semi_topk_days",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
    WHERE CAST(o_orderdate AS DATE) IN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS x FROM orders ORDER BY x DESC LIMIT 5)""",
    ("day",),
)
def semi_topk_days(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    latest = orders.select("day").distinct().orderBy(F.desc("day")).limit(5)
    return orders.join(F.broadcast(latest), "day", "left_semi")


@query("busiest_days", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, day LIMIT 10", ("day",))
def busiest_days(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(10)


@query(
    "asof_latest_within",
    """SELECT p.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS click_id FROM events p
    LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') b
        ON p.user_id = b.user_id AND b.ts <= p.ts AND b.ts >= p.ts - INTERVAL 21600 SECOND
    WHERE p.event_type = 'error' GROUP BY 1""",
)
def asof_latest_within(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    probes, builds = events.where("event_type = 'error'").drop("event_type"), events.where("event_type = 'click'")
    return joins.asof_within(probes, builds, "user_id", "ts", "event_id", 21600, "click_id").select("event_id", "click_id")


@query(
    "interval_overlap",
    """WITH a AS (SELECT o_orderkey, o_orderdate AS s, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 DAY END AS e FROM orders),
    c AS (SELECT l_shipdate AS t, sum(count(*)) OVER (ORDER BY l_shipdate) AS c FROM lineitem GROUP BY 1), w AS (SELECT count(*) AS whole FROM lineitem)
    SELECT o_orderkey, CAST(CASE WHEN e IS NULL THEN whole ELSE coalesce(b.c, 0) END - coalesce(d.c, 0) AS BIGINT) AS n FROM a CROSS JOIN w
    ASOF LEFT JOIN c b ON a.e > b.t ASOF LEFT JOIN c d ON a.s - INTERVAL 2 DAY >= d.t""",
)
def interval_overlap(spark, d):
    """For each order, the shipments of two days each that meet its three days; pending orders have no end."""
    end = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 3 days"))
    spans = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), end.alias("end"))
    others = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("interval 2 days")).alias("end"))
    return joins.overlap_counts(spans, others, "o_orderkey").select("o_orderkey", "n")


@query(
    "open_interval_overlap",
    """WITH s AS (SELECT l_suppkey AS k, l_shipdate AS a, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_shipdate + INTERVAL 5 DAY END AS b FROM lineitem)
    SELECT x.k AS l_suppkey, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND (y.b IS NULL OR x.a < y.b) AND (x.b IS NULL OR y.a < x.b) GROUP BY 1""",
)
def open_interval_overlap(spark, d):
    """Pairs of a supplier's shipments whose spans overlap, each with itself as well; returned ones have no end."""
    end = F.when(F.col("l_returnflag") == "A", None).otherwise(F.col("l_shipdate") + F.expr("interval 5 days"))
    spans = table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("start"), end.alias("end"))
    return joins.overlapping_pairs(spans, "l_suppkey")


@query(
    "effective_dated_join",
    """WITH dim AS (SELECT o_custkey, o_orderdate AS valid_from, o_orderpriority, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
    facts AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, l_shipdate, f.o_custkey, o_orderpriority FROM facts f
    JOIN dim ON f.o_custkey = dim.o_custkey AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)""",
)
def effective_dated_join(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    facts = items.join(orders.select("o_orderkey", "o_custkey"), items.l_orderkey == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    return joins.asof_latest(facts, orders, "o_custkey", "l_shipdate", "o_orderdate", "o_orderkey", ["o_orderpriority"])


_POINTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(
    "knn_radius",
    f"""WITH p AS ({_POINTS}), j AS (SELECT a.vec_id, b.vec_id AS near_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id)
    SELECT vec_id, near_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, near_id) AS INTEGER) AS rank FROM j WHERE distance <= 0.05) WHERE rank <= 4""",
)
def knn_radius(spark, d):
    points = _points(spark, d)
    near = joins.nearest_within(points, points.select(F.col("vec_id").alias("near_id"), "x", "y"), 0.05, 4, "vec_id", "near_id")
    return near.drop("distance")


@query(
    "nearest_with_limit",
    f"""WITH p AS ({_POINTS}), j AS (SELECT a.vec_id, b.vec_id AS near_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id AND b.label = 1)
    SELECT vec_id, near_id FROM p LEFT JOIN (SELECT vec_id, arg_min(near_id, (distance, near_id)) AS near_id FROM j WHERE distance <= 0.02 GROUP BY 1) USING (vec_id)""",
)
def nearest_with_limit(spark, d):
    points = _points(spark, d)
    nearest = joins.nearest_within(points, points.where("label = 1").select(F.col("vec_id").alias("near_id"), "x", "y"), 0.02, 1, "vec_id", "near_id").select("vec_id", "near_id")
    return points.select("vec_id").join(nearest, "vec_id", "left")


@query(
    "same_market_corroboration",
    """WITH s AS (SELECT DISTINCT time_bucket(INTERVAL 30 MINUTE, ts) AS slot, event_type, user_id FROM events)
    SELECT slot, event_type, user_id, count(*) OVER (PARTITION BY slot, event_type) - 1 AS others FROM s""",
)
def same_market_corroboration(spark, d):
    slot = F.window("ts", "30 minutes")["start"].alias("slot")
    seen = table(spark, d, "events").select(slot, "event_type", "user_id").distinct()
    return seen.withColumn("others", F.count("*").over(Window.partitionBy("slot", "event_type")) - 1)


@query(
    "peer_share_exclude_self",
    """WITH m AS (SELECT o_orderkey, c_mktsegment, date_trunc('month', o_orderdate) AS month, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, CASE WHEN count(*) OVER w > 1 THEN round((sum(y) OVER w - y) / (count(*) OVER w - 1), 9) END AS share FROM m WINDOW w AS (PARTITION BY c_mktsegment, month)""",
)
def peer_share_exclude_self(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_mktsegment", F.date_trunc("month", "o_orderdate").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    sums = joined.groupBy("c_mktsegment", "month").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    share = F.when(F.col("n") > 1, F.round((F.col("s") - F.col("y")) / (F.col("n") - 1), 9))
    return joined.join(sums, ["c_mktsegment", "month"]).select("o_orderkey", share.alias("share"))


_DAYS = """WITH days AS (SELECT n_nationkey, CAST(o_orderdate AS DATE) AS day, avg(CAST(o_orderstatus = 'F' AS INTEGER)) >= 0.5 AS closed
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2)"""


@query(
    "prev_school_day_after",
    f"""{_DAYS} SELECT a.n_nationkey, a.day, coalesce(b.closed, false) AS after FROM days a
    LEFT JOIN days b ON a.n_nationkey = b.n_nationkey AND b.day = a.day - CASE WHEN isodow(a.day) = 1 THEN 3 ELSE 1 END""",
    ("day",),
)
def prev_school_day_after(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("c_nationkey").alias("n_nationkey"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    days = joined.where(F.weekday("day") < 5).groupBy("n_nationkey", "day").agg((F.avg("y") >= 0.5).alias("closed")).withColumn("number", weekday_number(F.col("day")))
    before = days.select("n_nationkey", (F.col("number") + 1).alias("number"), F.col("closed").alias("after"))
    return days.join(before, ["n_nationkey", "number"], "left").select("n_nationkey", "day", F.coalesce("after", F.lit(False)).alias("after"))


@query(
    "relational_division",
    """SELECT l_suppkey, count(DISTINCT p_type) AS members FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)""",
)
def relational_division(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joins.divided(pairs, "l_suppkey", "p_type", part)


@query(
    "overlay_override",
    """WITH over AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'F' END AS status FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM over)
    UNION ALL SELECT o_orderkey, status FROM over WHERE status IS NOT NULL""",
)
def overlay_override(spark, d):
    orders = table(spark, d, "orders")
    overrides = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", "F").alias("status"))
    base = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return base.join(overrides, "o_orderkey", "left_anti").unionByName(overrides.where("status is not null"))


@query("join_number_rank", "SELECT c_custkey, (SELECT 1 + count(*) FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_custkey < a.c_custkey) AS join_number FROM customer a")
def join_number_rank(spark, d):
    number = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    return table(spark, d, "customer").select("c_custkey", number.alias("join_number"))


@query(
    "versioned_merge",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def versioned_merge(spark, d):
    latest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(latest.alias("r")).select("o_custkey", "r.*")


@query(
    "overview_counts",
    """SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers,
        CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders""",
    ("first_day", "last_day"),
)
def overview_counts(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.countDistinct("o_custkey").alias("customers"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
