"""Exact tests, permutations, root finding, switches and sweeps over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import fits, inference, switches
from gristmill.plans.registry import query
from gristmill.session import table


def _cases(spark, d):
    """Orders with a chance that their price gives, and whether they are done."""
    chance = F.greatest(F.least(F.col("o_totalprice") / 400000, F.lit(0.95)), F.lit(0.05))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), chance.alias("chance"), (F.col("o_orderstatus") == "F").alias("done"))


_CASES = "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS month, greatest(least(o_totalprice / 400000, 0.95), 0.05) AS chance, o_orderstatus = 'F' AS done FROM orders"


@query("conditional_likelihoods")
def conditional_likelihoods(spark, d):
    """How likely the done orders of each month are, given how many there are. No SQL: a product of polynomials."""
    found = inference.conditional_likelihood(_cases(spark, d), "month", "chance", "done", "o_orderkey")
    return found.select("month", "n", "closed", F.round("value", 6).alias("value"))


@query(
    "sign_test",
    f"""WITH d AS (SELECT o_custkey, avg(CASE WHEN done THEN ln(chance) - ln(0.5) ELSE ln(1 - chance) - ln(0.5) END) AS delta FROM ({_CASES}) GROUP BY 1),
    c AS (SELECT count(*) AS units, count(*) FILTER (delta < 0) AS worse, count(*) FILTER (delta > 0) AS better FROM d)
    SELECT units, worse, better, round(list_sum(list_transform(range(worse, worse + better + 1), lambda k: exp(lgamma(worse + better + 1) - lgamma(k + 1) - lgamma(worse + better - k + 1) - (worse + better) * ln(2)))), 9) AS p FROM c""",
)
def sign_test(spark, d):
    """Whether more customers are scored worse by the chance than by a half than a fair coin would have it."""
    gain = F.when(F.col("done"), F.log("chance")).otherwise(F.log(1 - F.col("chance"))) - F.log(F.lit(0.5))
    return inference.sign_test(_cases(spark, d).groupBy("o_custkey").agg(F.avg(gain).alias("delta")), "delta").withColumn("p", F.round("p", 9))


_UNITS = f"SELECT o_orderkey, month, o_custkey % 40 AS unit, CAST(done AS INTEGER) AS done FROM ({_CASES})"
_DEALT = f"""WITH r AS ({_UNITS}), n AS (SELECT r.*, draw, row_number() OVER (PARTITION BY draw, month ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY draw, month ORDER BY md5('17:' || draw || ':' || o_orderkey), o_orderkey) AS b
        FROM r, (SELECT unnest(range(0, 8)) AS draw)), p AS (SELECT x.draw, x.o_orderkey, x.done, y.unit FROM n x JOIN n y ON x.draw = y.draw AND x.month = y.month AND x.a = y.b)"""


def _units(spark, d):
    return _cases(spark, d).select("o_orderkey", "month", (F.col("o_custkey") % 40).alias("unit"), F.col("done").cast("int").alias("done"))


@query(
    "shuffle_null",
    f"""{_DEALT}, m AS (SELECT -1 AS draw, unit, avg(done) AS m FROM r GROUP BY 2 UNION ALL SELECT draw, unit, avg(done) FROM p GROUP BY 1, 2)
    SELECT CAST(draw AS INTEGER) AS draw, round(var_pop(m), 9) AS spread FROM m GROUP BY 1""",
)
def shuffle_null(spark, d):
    """The spread of units' shares of done orders (draw -1) beside those of draws in which units are dealt anew within each month."""
    rows = _units(spark, d)
    dealt = inference.shuffled(rows, "month", "unit", "o_orderkey", 8, 17).join(rows.select("o_orderkey", "done"), "o_orderkey")
    real = inference.spread(rows.withColumn("draw", F.lit(-1)), ["draw"], "unit", "done")
    return real.union(inference.spread(dealt, ["draw"], "unit", "done")).select("draw", F.round("spread", 9).alias("spread"))


@query(
    "usual_amounts",
    """WITH c AS (SELECT c_custkey, least(greatest(c_acctbal / 10000, 0.02), 0.9) AS level FROM customer),
    s AS (WITH RECURSIVE b AS (SELECT c_custkey, level, 0 AS k, 0.0::DOUBLE AS low, 20.0::DOUBLE AS high FROM c
        UNION ALL SELECT c_custkey, level, k + 1, CASE WHEN 1 - exp(-((low + high) / 2) / 3) > level THEN low ELSE (low + high) / 2 END, CASE WHEN 1 - exp(-((low + high) / 2) / 3) > level THEN (low + high) / 2 ELSE high END FROM b WHERE k < 40)
        SELECT * FROM b WHERE k = 40)
    SELECT c_custkey, round((low + high) / 2, 6) AS amount FROM s""",
)
def usual_amounts(spark, d):
    """The amount at which a chance that rises with it meets a customer's level, by forty halvings."""
    level = F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.02)), F.lit(0.9))
    levels = table(spark, d, "customer").select("c_custkey", level.alias("level"))
    amount = inference.bisected(F.lit(0.0), F.lit(20.0), lambda u: 1 - F.exp(-u / 3) > F.col("level"))
    return levels.select("c_custkey", F.round(amount, 6).alias("amount"))


@query(
    "pulled_odds",
    """WITH RECURSIVE x AS (SELECT s_suppkey, 0 AS k, ln((s_suppkey % 97 + 1) / 98.0) - ln(1 - (s_suppkey % 97 + 1) / 98.0) AS x FROM supplier
        UNION ALL SELECT s_suppkey, k + 1, x + 0.5 * CASE WHEN x < -1.001 THEN -1 - x WHEN x > 1.501 THEN 1.5 - x ELSE 0 END FROM x WHERE k < 30)
    SELECT s_suppkey, round(x, 6) AS x FROM x WHERE k = 30""",
)
def pulled_odds(spark, d):
    """Log odds pulled half of the way into their bounds until they are inside."""
    p = (F.col("s_suppkey") % 97 + 1) / 98.0
    return table(spark, d, "supplier").select("s_suppkey", F.round(inference.pull(F.log(p) - F.log(1 - p), F.lit(-1.0), F.lit(1.5)), 6).alias("x"))


_SYMBOLS = "SELECT user_id, ts, event_id, CASE WHEN value >= 60 THEN 0 WHEN value >= 25 THEN 1 WHEN value >= 5 THEN 2 ELSE 3 END AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL"


@query(
    "switch_replay",
    f"""WITH RECURSIVE e AS ({_SYMBOLS}), t AS (SELECT * FROM (VALUES {", ".join(f"({y}, {s}, {n})" for y, row in enumerate(switches.steps(2, 3)) for s, n in enumerate(row))}) AS t(symbol, state, after)),
    f AS (SELECT e.user_id, e.event_id, e.k, t.after AS state FROM e JOIN t ON t.symbol = e.symbol AND t.state = 0 WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, t.after FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1 JOIN t ON t.symbol = e.symbol AND t.state = f.state)
    SELECT user_id, event_id, CASE WHEN state >= 2 THEN 'on' ELSE 'off' END AS arm, CAST(CASE WHEN state >= 2 THEN state - 2 ELSE state END AS INTEGER) AS streak FROM f""",
)
def switch_replay(spark, d):
    """A user's switch after each event: on after two good values, off after three bad ones or an awful one; weeks are composed."""
    value = F.col("value")
    symbol = F.when(value >= 60, switches.GOOD).when(value >= 25, switches.EVEN).when(value >= 5, switches.BAD).otherwise(switches.AWFUL)
    rows = table(spark, d, "events").where("value is not null").select("user_id", "ts", "event_id", symbol.alias("symbol"))
    found = switches.replayed(rows, "user_id", ["ts", "event_id"], "symbol", F.date_trunc("week", "ts"), 2, 3)
    on = F.col("state") >= 2
    return found.select("user_id", "event_id", F.when(on, "on").otherwise("off").alias("arm"), F.when(on, F.col("state") - 2).otherwise(F.col("state")).alias("streak"))


_SPANS = """SELECT user_id % 60 AS place, ts AS start, CASE WHEN event_id % 11 = 0 THEN ts + to_hours(2) ELSE ts + to_hours(CAST(4 + event_id % 40 AS INTEGER)) END AS "end", CAST(1 + event_id % 4 AS INTEGER) AS level FROM events"""


@query(
    "swept_states",
    f"""WITH s AS ({_SPANS}), m AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 6 HOUR)) AS moment FROM events), k AS (SELECT DISTINCT place FROM s)
    SELECT k.place, m.moment, CAST(coalesce(max(s.level), 0) AS INTEGER) AS level FROM k CROSS JOIN m LEFT JOIN s ON s.place = k.place AND s.start <= moment AND moment < s."end" GROUP BY 1, 2""",
    days=("moment",),
)
def swept_states(spark, d):
    """The largest level that holds at a place every six hours; every eleventh span is withdrawn after two."""
    events = table(spark, d, "events")
    hours = F.when(F.col("event_id") % 11 == 0, 2).otherwise(4 + F.col("event_id") % 40).cast("int")
    spans = events.select((F.col("user_id") % 60).alias("place"), F.col("ts").alias("start"), F.timestamp_add("HOUR", hours, F.col("ts")).alias("end"), (1 + F.col("event_id") % 4).cast("int").alias("level"))
    ends = events.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b"))
    return switches.swept(spans, ends.select(F.explode(F.sequence("a", "b", F.expr("interval 6 hours"))).alias("moment")), "place", 4)


@query("own_parts")
def own_parts(spark, d):
    """What is each customer's own beside the chance of its orders, with the spread that fits. No SQL: a fit."""
    cases = _cases(spark, d).withColumn("offset", F.log("chance") - F.log(1 - F.col("chance")))
    found = fits.own_parts(cases, "o_custkey", "offset", "done")
    return found.units.select("o_custkey", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.lit(round(found.spread, 4)).alias("spread"))
