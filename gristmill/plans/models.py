"""Grids, weights, ladders and encodings over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import blocks, joins
from gristmill.plans.registry import query
from gristmill.session import table


@query(
    "class_posterior",
    """WITH c AS (SELECT c_mktsegment AS class, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), g AS (SELECT unnest(range(-40, 41)) / 10.0::DOUBLE AS a),
    l AS (SELECT class, a, y * a - n * ln(1 + exp(a)) - a * a / 8 AS l FROM c, g), m AS (SELECT *, max(l) OVER (PARTITION BY class) AS top FROM l)
    SELECT class, round(sum(exp(l - top) / (1 + exp(-a))) / sum(exp(l - top)), 6) AS mean, round(max(top) + ln(sum(exp(l - top))), 6) AS evidence FROM m GROUP BY 1""",
)
def class_posterior(spark, d):
    """The posterior mean chance of each class on a grid of log odds with a normal prior; counts meet the grid, never rows."""
    counts = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("y"))
    a = F.col("a")
    grid = counts.withColumn("k", F.explode(F.sequence(F.lit(-40), F.lit(40)))).withColumn("a", F.col("k") / 10.0)
    logs = grid.withColumn("l", F.col("y") * a - F.col("n") * F.log1p(F.exp(a)) - a * a / 8)
    topped = logs.withColumn("top", F.max("l").over(Window.partitionBy("class")))
    weight = F.exp(F.col("l") - F.col("top"))
    return topped.groupBy("class").agg(F.round(F.sum(weight / (1 + F.exp(-a))) / F.sum(weight), 6).alias("mean"), F.round(F.max("top") + F.log(F.sum(weight)), 6).alias("evidence"))


@query(
    "storm_weights",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) - CAST(o_orderdate AS DATE) % 1 AS x, date_trunc('month', o_orderdate) AS storm, count(*)::DOUBLE AS size FROM orders GROUP BY 1, 2), t AS (SELECT storm, sum(size) AS size FROM s GROUP BY 1),
    o AS (SELECT storm, size, row_number() OVER (ORDER BY size DESC, storm) AS k, sum(size) OVER (ORDER BY size, storm DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest FROM t),
    l AS (SELECT max(cap) AS cap FROM (SELECT rest * 0.012 / (1 - 0.012 * (k - 1)) AS cap, size, lag(size) OVER (ORDER BY k) AS above FROM o WHERE 1 - 0.012 * (k - 1) > 0) WHERE size <= cap AND (above IS NULL OR above > cap))
    SELECT strftime(storm, '%Y-%m-%d') AS storm, round(least(1, coalesce(cap, size) / size), 6) AS weight FROM t, l""".replace("CAST(o_orderdate AS DATE) - CAST(o_orderdate AS DATE) % 1 AS x, ", "1 AS x, "),
)
def storm_weights(spark, d):
    """The largest weights for which no storm has over 1.2 % of all weight.

    With storms by falling size, if the first k - 1 are cut to a level, that
    level is share * rest / (1 - share * (k - 1)); the k that fits is unique.
    """
    share = 0.012
    storms = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("storm")).agg(F.count("*").cast("double").alias("size"))
    falling = Window.orderBy(F.desc("size"), "storm")
    rest = F.sum("size").over(Window.orderBy("size", F.desc("storm")).rowsBetween(Window.unboundedPreceding, 0))
    k = F.row_number().over(falling)
    levels = storms.withColumn("k", k).withColumn("above", F.lag("size").over(falling)).withColumn("rest", rest).withColumn("cap", F.col("rest") * share / (1 - share * (F.col("k") - 1)))
    fits = (1 - share * (F.col("k") - 1) > 0) & (F.col("size") <= F.col("cap")) & (F.col("above").isNull() | (F.col("above") > F.col("cap")))
    level = levels.where(fits).agg(F.max("cap").alias("level"))
    return storms.join(level, F.lit(True)).select(F.date_format("storm", "yyyy-MM-dd").alias("storm"), F.round(F.least(F.lit(1.0), F.coalesce("level", "size") / F.col("size")), 6).alias("weight"))


@query(
    "case_cube",
    """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS night, coalesce(n_regionkey, -1) AS region, o_orderpriority AS moment, o_orderstatus AS outcome, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4""",
)
def case_cube(spark, d):
    """Cases by night, region, moment and outcome; a region that is not known has a code of its own."""
    customer = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    joined = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    cells = [F.to_date("o_orderdate").cast("string").alias("night"), F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.col("o_orderpriority").alias("moment"), F.col("o_orderstatus").alias("outcome")]
    return joined.groupBy(*cells).agg(F.count("*").alias("n"))


@query("error_share_by_month", "SELECT strftime(l_shipdate, '%Y-%m') AS month, round(avg(CASE WHEN CASE WHEN l_linenumber < 7 THEN l_returnflag = 'R' END THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def error_share_by_month(spark, d):
    bad = F.coalesce(F.when(F.col("l_linenumber") < 7, F.col("l_returnflag") == "R"), F.lit(False))
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(F.avg(bad.cast("double")), 6).alias("share"))


@query(
    "transition_backoff",
    """WITH o AS (SELECT o_custkey, c_mktsegment AS seg, o_orderpriority AS heads, o_orderstatus AS now, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders JOIN customer ON o_custkey = c_custkey),
    t AS (SELECT * FROM o WHERE next IS NOT NULL), f AS (SELECT now, seg, heads, count(*) AS n, count(*) FILTER (next = 'F') AS y FROM t GROUP BY 1, 2, 3), m AS (SELECT now, seg, count(*) AS n, count(*) FILTER (next = 'F') AS y FROM t GROUP BY 1, 2), w AS (SELECT now, count(*) AS n, count(*) FILTER (next = 'F') AS y FROM t GROUP BY 1)
    SELECT f.now, f.seg, f.heads, CASE WHEN f.n >= 20 THEN 'cell' WHEN m.n >= 60 THEN 'segment' ELSE 'class' END AS level,
        round((CASE WHEN f.n >= 20 THEN f.y WHEN m.n >= 60 THEN m.y ELSE w.y END + 10 * (w.y / w.n::DOUBLE)) / (CASE WHEN f.n >= 20 THEN f.n WHEN m.n >= 60 THEN m.n ELSE w.n END + 10), 6) AS p
    FROM f JOIN m ON f.now = m.now AND f.seg = m.seg JOIN w ON f.now = w.now""",
)
def transition_backoff(spark, d):
    """The chance that the next status is F, from the finest level with enough cases, shrunk to its class."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    following = F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    cells = joined.select(F.col("o_orderstatus").alias("now"), F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("heads"), following.alias("next")).where("next is not null")
    fine = cells.groupBy("now", "seg", "heads").agg(F.count("*").alias("n"), F.count_if(F.col("next") == "F").alias("y"))
    middle = fine.groupBy("now", "seg").agg(F.sum("n").alias("m_n"), F.sum("y").alias("m_y"))
    whole = fine.groupBy("now").agg(F.sum("n").alias("w_n"), F.sum("y").alias("w_y"))
    out = fine.join(middle, ["now", "seg"]).join(whole, "now")
    enough, some = F.col("n") >= 20, F.col("m_n") >= 60

    def pick(c: str):
        return F.when(enough, F.col(c)).when(some, F.col(f"m_{c}")).otherwise(F.col(f"w_{c}"))

    p = (pick("y") + 10 * F.col("w_y") / F.col("w_n")) / (pick("n") + 10)
    return out.select("now", "seg", "heads", F.when(enough, "cell").when(some, "segment").otherwise("class").alias("level"), F.round(p, 6).alias("p"))


@query("unit_conversions", "SELECT l_orderkey, l_linenumber, round(l_quantity / 100 * 39.37007874015748, 6) AS inches, round(l_extendedprice / 25.4, 6) AS from_mm, round((l_quantity + 250 - 273.15) * 9 / 5 + 32, 6) AS fahrenheit FROM lineitem")
def unit_conversions(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(q / 100 * 39.37007874015748, 6).alias("inches"), F.round(F.col("l_extendedprice") / 25.4, 6).alias("from_mm"), F.round((q + 250 - 273.15) * 9 / 5 + 32, 6).alias("fahrenheit"))


_FLAGS = ("l_returnflag = 'R'", "l_linestatus = 'O'", "l_discount > 0.05", "l_quantity > 25")


@query("flag_lists", f"SELECT l_orderkey, l_linenumber, list_filter([{', '.join(f'CASE WHEN {f} THEN {k} END' for k, f in enumerate(_FLAGS))}], lambda x: x IS NOT NULL) AS flags FROM lineitem")
def flag_lists(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_compact(F.array(*[F.when(F.expr(f), k) for k, f in enumerate(_FLAGS)])).alias("flags"))


@query("sparse_decode", "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN value END AS shift FROM events")
def sparse_decode(spark, d):
    """A column kept only for the rows that have it, as lists of a user's thousand values, put back to its rows by rank."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    shifted = F.col("event_type") == "error"
    ranked = events.withColumn("pos", F.when(shifted, F.sum(shifted.cast("int")).over(order) - 1))
    lists = ranked.where("pos is not null").groupBy("user_id", blocks.block_of(F.col("pos"), 1000).alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("packed"))
    unpacked = lists.select("user_id", "base", F.posexplode(F.col("packed.value")).alias("at", "shift")).select("user_id", (F.col("base") + F.col("at")).alias("pos"), "shift")
    return ranked.join(unpacked, ["user_id", "pos"], "left").select("user_id", "event_id", "shift")


@query("first_day_maps", "WITH f AS (SELECT c_nationkey, c_mktsegment, CAST(min(o_orderdate) AS DATE)::VARCHAR AS day FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey, list(c_mktsegment || '=' || day ORDER BY c_mktsegment) AS first_days FROM f GROUP BY 1")
def first_day_maps(spark, d):
    """The first day of each segment of a nation as a map, shown as its sorted entries."""
    first = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.to_date(F.min("o_orderdate")).cast("string").alias("day"))
    maps = first.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "day"))).alias("m"))
    return maps.select("c_nationkey", F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("first_days"))


@query("shard_of", "WITH s AS (SELECT c_custkey AS first, row_number() OVER (ORDER BY c_custkey) - 1 AS shard FROM customer WHERE c_custkey % 40 = 0) SELECT c_custkey, CAST(shard AS INTEGER) AS shard FROM customer ASOF JOIN s ON c_custkey >= first")
def shard_of(spark, d):
    """The shard of an id among shards named by their first ids: both sides in order within ranges of ids."""
    ids = table(spark, d, "customer").select("c_custkey")
    return joins.rank_among(ids, ids.where("c_custkey % 40 = 0"), "c_custkey", "c_custkey", 100_000, "shard").where("shard >= 0")


@query(
    "slot_changes",
    """WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS slot, event_type FROM events), n AS (SELECT user_id, slot, lag(slot) OVER (PARTITION BY user_id ORDER BY slot) AS before FROM (SELECT DISTINCT user_id, slot FROM s)),
    a AS (SELECT n.user_id, n.slot, s.event_type, 1 AS now, 0 AS was FROM n JOIN s ON n.user_id = s.user_id AND n.slot = s.slot UNION ALL SELECT n.user_id, n.slot, s.event_type, 0, 1 FROM n JOIN s ON n.user_id = s.user_id AND n.before = s.slot),
    c AS (SELECT user_id, slot, event_type, sum(now) AS now, sum(was) AS was FROM a GROUP BY 1, 2, 3)
    SELECT user_id, CAST(slot AS VARCHAR) AS slot, coalesce(list(event_type ORDER BY event_type) FILTER (was = 0), []) AS added, coalesce(list(event_type ORDER BY event_type) FILTER (now = 0), []) AS removed FROM c GROUP BY 1, 2""",
)
def slot_changes(spark, d):
    """What a source's slot adds to and takes from the slot before."""
    slots = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("slot")).agg(F.array_sort(F.collect_set("event_type")).alias("now"))
    was = F.coalesce(F.lag("now").over(Window.partitionBy("user_id").orderBy("slot")), F.array().cast("array<string>"))
    changed = slots.withColumn("was", was)
    return changed.select("user_id", F.col("slot").cast("string"), F.array_except("now", "was").alias("added"), F.array_except("was", "now").alias("removed"))


@query(
    "log_odds",
    "WITH p AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) / count(*)::DOUBLE AS p FROM customer GROUP BY 1) SELECT c_nationkey, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) AS logit FROM p",
)
def log_odds(spark, d):
    from gristmill.functions import numeric

    share = table(spark, d, "customer").groupBy("c_nationkey").agg((F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("p"))
    return share.select("c_nationkey", F.round(numeric.logit(F.col("p")), 6).alias("logit"))
