"""Models held against each other over orders: gains, splits, swaps, terms, declines, fallbacks and states by moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import days, numeric
from gristmill.operators import evaluation
from gristmill.plans.registry import query
from gristmill.session import table

DRAWS, BOUND, SEED = 200, 0.9, 11
TERMS = ["price", "priority", "segment"]

_CASES = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS klass, c_mktsegment AS situation, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, greatest(least(o_totalprice / 300000, 0.9), 0.1) AS base,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN greatest(least(o_totalprice / 300000 - 0.05, 0.9), 0.1) WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE greatest(least(o_totalprice / 300000, 0.9), 0.1) END AS new FROM orders JOIN customer ON o_custkey = c_custkey"""


def _cases(spark, d) -> DataFrame:
    """Orders with the chances of two models: one reads the price alone, one the priority too."""
    held = lambda p: F.greatest(F.least(p, F.lit(0.9)), F.lit(0.1))
    price = F.col("o_totalprice") / 300000
    new = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), held(price - 0.05)).when(F.col("o_orderpriority") == "5-LOW", 0.5).otherwise(held(price))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("klass"), F.col("c_mktsegment").alias("situation"), y.alias("y"), held(price).alias("base"), new.alias("new"))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n, kind in df.dtypes if kind == "double"})


@query(
    "arm_evaluation",
    f"""WITH c AS (SELECT day - CAST((day - DATE '1970-01-01') % 30 AS INTEGER) AS day, klass, y, base, new FROM ({_CASES})), g AS (SELECT day, klass, count(*) AS n, sum(CASE WHEN y = 1 THEN ln(new / base) ELSE ln((1 - new) / (1 - base)) END) AS diff, bool_or(new <> base) AS moved FROM c GROUP BY 1, 2),
    b AS (SELECT day, sum(diff) AS d, sum(n) AS n, bool_or(moved) AS moved FROM g GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS slot, count(*) OVER () AS size FROM b),
    p AS (SELECT draw, CAST(floor(('0x' || md5('{SEED}:' || draw || ':' || slot)[1:8])::BIGINT / 4294967296.0::DOUBLE * size) AS BIGINT) AS slot FROM k, (SELECT unnest(range(0, {DRAWS})) AS draw)),
    m AS (SELECT draw, sum(d) / sum(n) AS mean FROM p JOIN k USING (slot) GROUP BY 1), q AS (SELECT quantile_cont(mean, {(1 - BOUND) / 2:.6g}) AS lower, quantile_cont(mean, {1 - (1 - BOUND) / 2:.6g}) AS upper FROM m)
    SELECT 'all' AS scope, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (moved) AS moved, round(sum(d) / sum(n), 6) AS gain, round((SELECT lower FROM q), 6) AS lower, round((SELECT upper FROM q), 6) AS upper, round(max(n) / sum(n), 6) AS largest_share, round(arg_max(d / n, day), 6) AS last_gain, NULL::BOOLEAN AS binding FROM b
    UNION ALL SELECT klass, CAST(sum(n) AS BIGINT), count(DISTINCT CASE WHEN moved THEN day END), round(sum(diff) / sum(n), 6), NULL, NULL, NULL, NULL, sum(n) >= 100 AND count(DISTINCT CASE WHEN moved THEN day END) >= 5 FROM g GROUP BY klass""",
)
def arm_evaluation(spark, d):
    """Log likelihood that the second model adds to a row, with bounds from redrawn months of thirty days, for all and by class."""
    cases = _cases(spark, d).withColumn("day", F.date_sub("day", F.pmod(F.unix_date("day"), F.lit(30))))
    gain = F.when(F.col("y") == 1, F.log(F.col("new") / F.col("base"))).otherwise(F.log((1 - F.col("new")) / (1 - F.col("base"))))
    groups = cases.groupBy("day", "klass").agg(F.count("*").alias("n"), F.sum(gain).alias("diff"), F.max(F.col("new") != F.col("base")).alias("moved"))
    return _rounded(evaluation.evaluated(groups, DRAWS, BOUND, SEED, 100, 5))


@query("switch_evaluation")
def switch_evaluation(spark, d):
    """The same with likelihoods conditional on how many orders of a month and class are done. No SQL: products of polynomials."""
    cases = _cases(spark, d).withColumn("day", F.trunc("day", "month"))
    return _rounded(evaluation.evaluated(evaluation.conditional_groups(cases, "new", "base", "y", "o_orderkey"), DRAWS, BOUND, SEED, 100, 5))


@query(
    "raised_lowered",
    f"""SELECT CASE WHEN new > base THEN 'raised' WHEN new < base THEN 'lowered' ELSE 'unchanged' END AS split, count(*) AS n, round(avg(y), 6) AS rate, round(sum(pow(base - y, 2)), 6) AS sse_base, round(sum(pow(new - y, 2)), 6) AS sse_new FROM ({_CASES}) GROUP BY 1""",
)
def raised_lowered(spark, d):
    return _rounded(evaluation.raised_lowered(_cases(spark, d), "new", "base", "y"))


@query(
    "swap_decision",
    f"""WITH c AS ({_CASES}), s AS (SELECT situation, count(*) AS n, sum(pow(new - y, 2)) AS en, sum(pow(base - y, 2)) AS eb FROM c GROUP BY 1),
    p AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sum(en) / sum(n) AS brier_new, sum(eb) / sum(n) AS brier_base, min(situation) FILTER (en / n > eb / n + 1e-12) AS worse FROM s),
    b AS (SELECT 'new' AS m, new AS p, y FROM c UNION ALL SELECT 'base', base, y FROM c), k AS (SELECT m, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY 1, 2),
    e AS (SELECT sum(gap * n) FILTER (m = 'new') / sum(n) FILTER (m = 'new') AS ece_new, sum(gap * n) FILTER (m = 'base') / sum(n) FILTER (m = 'base') AS ece_base, count(*) FILTER (m = 'new' AND gap > 0.1) AS out_new, count(*) FILTER (m = 'base' AND gap > 0.1) AS out_base FROM k),
    w AS (SELECT *, CASE WHEN n = 0 THEN 'rows' WHEN brier_new > brier_base + 1e-12 THEN 'brier' WHEN worse IS NOT NULL THEN 'situation ' || worse WHEN out_new > out_base THEN 'bins' WHEN ece_new > ece_base + 0.002 + 1e-12 THEN 'calibration' END AS why FROM p, e)
    SELECT CASE WHEN why IS NULL THEN 'swap' ELSE 'keep' END AS kind, why, n, round(brier_new, 6) AS brier_new, round(brier_base, 6) AS brier_base, out_new, out_base, round(ece_new, 6) AS ece_new, round(ece_base, 6) AS ece_base FROM w""",
)
def swap_decision(spark, d):
    """Whether the second model may take the first one's place, and the first reason against it."""
    return _rounded(evaluation.swap(_cases(spark, d), "new", "base", "y", "situation", 10, 0.1, 0.002))


_LEVELS = f"""SELECT o_orderkey, y, situation, CAST(CASE WHEN base > 0.8 THEN 2 WHEN base > 0.3 THEN 1 ELSE 0 END AS INTEGER) AS price, CAST(CASE klass WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN -1 ELSE 0 END AS INTEGER) AS priority, CAST(CASE WHEN situation = 'BUILDING' THEN 1 ELSE 0 END AS INTEGER) AS segment FROM ({_CASES})"""
_LONG = "(UNPIVOT l ON price, priority, segment INTO NAME term VALUE level)"
_FITS = f"""l AS ({_LEVELS}), u AS (SELECT * FROM {_LONG}), f AS (SELECT term, level, sum(y) AS s, count(*) AS n FROM u WHERE level >= 0 GROUP BY 1, 2), t AS (SELECT term, sum(s) AS s, sum(n) AS n FROM f GROUP BY 1),
    v AS (SELECT f.term, f.level, f.n, ln((f.s + 1) / (f.n + 2) / (1 - (f.s + 1) / (f.n + 2))) - ln((t.s + 1) / (t.n + 2) / (1 - (t.s + 1) / (t.n + 2))) AS value FROM f JOIN t USING (term))"""


def _levels(spark, d) -> DataFrame:
    klass = F.col("klass")
    price = F.when(F.col("base") > 0.8, 2).when(F.col("base") > 0.3, 1).otherwise(0)
    priority = F.when(klass == "1-URGENT", 2).when(klass == "2-HIGH", 1).when(klass == "5-LOW", -1).otherwise(0)
    return _cases(spark, d).select("o_orderkey", "y", "situation", price.alias("price"), priority.alias("priority"), F.when(F.col("situation") == "BUILDING", 1).otherwise(0).alias("segment"))


@query("step_fits", f"WITH {_FITS} SELECT term, level, n, round(value, 6) AS value FROM v")
def step_fits(spark, d):
    """What each level of a term adds to the log odds that an order is done."""
    return _rounded(evaluation.step_fits(_levels(spark, d), TERMS, "y"))


@query(
    "term_contributions",
    f"""WITH {_FITS} SELECT u.o_orderkey, u.term, u.level, round(CASE WHEN u.term = 'price' AND u.situation = 'MACHINERY' THEN greatest(coalesce(v.value, 0), 0) ELSE coalesce(v.value, 0) END, 6) AS value FROM u LEFT JOIN v ON v.term = u.term AND v.level = u.level""",
)
def term_contributions(spark, d):
    """What each term adds to an order's log odds; the price of machinery only ever raises them."""
    levels = _levels(spark, d)
    return _rounded(evaluation.contributions(levels, "o_orderkey", TERMS, evaluation.step_fits(levels, TERMS, "y"), {"price": F.col("situation") == "MACHINERY"}))


_SLOTS = """SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + 60 AS INTEGER) AS slot_end, CAST(max(CASE WHEN value IS NOT NULL THEN minute(ts) + 60 * (hour(ts) - 8) END) AS DOUBLE) AS past, coalesce(bool_or(value >= 80), FALSE) AS ended FROM events GROUP BY 1, 2, 3"""


@query(
    "call_declines",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY slot_end) AS k FROM ({_SLOTS})),
    r AS (SELECT user_id, day, slot_end, k, ended, CASE WHEN past IS NULL OR ended THEN 0.0::DOUBLE ELSE greatest(0.0, least(past, 45.0)) END AS x FROM s WHERE k = 1
        UNION ALL SELECT s.user_id, s.day, s.slot_end, s.k, s.ended, CASE WHEN s.past IS NULL OR s.ended THEN r.x ELSE greatest(r.x, least(s.past, r.x + 45.0)) END FROM r JOIN s ON s.user_id = r.user_id AND s.day = r.day AND s.k = r.k + 1),
    o AS (SELECT user_id, day, slot_end, CASE WHEN ended THEN 0.0 ELSE x END AS x FROM r) SELECT user_id, day, slot_end, round(x, 6) AS x, round(ln(0.3 + 0.7 * exp(-x / 60)), 6) AS delta FROM o""",
    days=("day",),
)
def call_declines(spark, d):
    """How far a user's chance has fallen by the end of each hour with events, past eight in the morning; a large value ends it."""
    at = F.col("ts")
    past = F.max(F.when(F.col("value").isNotNull(), F.minute(at) + 60 * (F.hour(at) - 8))).cast("double")
    slots = table(spark, d, "events").groupBy("user_id", F.to_date(at).alias("day"), (F.hour(at) * 60 + 60).alias("slot_end")).agg(past.alias("past"), F.max(F.col("value") >= 80).alias("ended"))
    return _rounded(evaluation.declined(slots, ["user_id", "day"], "slot_end", "past", "ended", 45.0, 0.3, 60.0))


_FALLBACK = {"1-URGENT": "2-HIGH", "2-HIGH": "3-MEDIUM", "3-MEDIUM": "1-URGENT", "4-NOT SPECIFIED": "5-LOW"}


@query(
    "published_situations",
    f"""WITH RECURSIVE c AS (SELECT o_orderpriority AS situation, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1), b AS (SELECT situation FROM c WHERE n >= (SELECT avg(n) FROM c)), f AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _FALLBACK.items())}) AS t(situation, other)),
    e AS (SELECT situation FROM c UNION SELECT situation FROM f UNION SELECT other FROM f), w AS (SELECT situation, situation AS at_, 0 AS k FROM e UNION ALL SELECT w.situation, f.other, k + 1 FROM w JOIN f ON f.situation = w.at_ WHERE k < 9)
    SELECT situation, arg_min(at_, k) FILTER (at_ IN (FROM b)) AS published FROM w GROUP BY 1""",
)
def published_situations(spark, d):
    """The priority whose record stands for a thin one; three of them fall back on one another in a circle."""
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("situation")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    usual = counts.agg(F.avg("n").alias("usual"))
    above = counts.crossJoin(F.broadcast(usual)).select("situation", (F.col("n") >= F.col("usual")).cast("int").alias("backed"))
    return evaluation.published_as(above, "situation", "backed", _FALLBACK, 1)


@query(
    "states_by_moment",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) // 6 AS moment, CAST(max(CASE WHEN value >= 60 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END) AS INTEGER) AS level FROM events GROUP BY 1, 2, 3)
    SELECT user_id, day, coalesce(max(level) FILTER (moment = 0), 13) AS m0, coalesce(max(level) FILTER (moment = 1), 13) AS m1, coalesce(max(level) FILTER (moment = 2), 13) AS m2, coalesce(max(level) FILTER (moment = 3), 13) AS m3 FROM s GROUP BY 1, 2""",
    days=("day",),
)
def states_by_moment(spark, d):
    """A user's worst level in each quarter of a day, 13 where it has none."""
    level = F.when(F.col("value") >= 60, 2).when(F.col("value") >= 20, 1).otherwise(0)
    states = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).cast("int").alias("moment"), level.alias("level"))
    return evaluation.states_by_moment(states, ["user_id", "day"], "moment", "level", [0, 1, 2, 3], 13)


@query(
    "hilbert_tiles",
    """WITH RECURSIVE p AS (SELECT c_custkey, c_custkey * 37 % 256 AS x0, c_custkey * 53 % 256 AS y0 FROM customer),
    h AS (SELECT c_custkey, x0 AS x, y0 AS y, 128 AS bit, CAST(21845 AS BIGINT) AS d FROM p
        UNION ALL SELECT c_custkey, CASE WHEN y & bit = 0 THEN CASE WHEN x & bit <> 0 THEN 255 - y ELSE y END ELSE x END, CASE WHEN y & bit = 0 THEN CASE WHEN x & bit <> 0 THEN 255 - x ELSE x END ELSE y END, bit // 2,
            d + bit * bit * xor(CASE WHEN x & bit <> 0 THEN 3 ELSE 0 END, CASE WHEN y & bit <> 0 THEN 1 ELSE 0 END) FROM h WHERE bit > 0)
    SELECT c_custkey, d AS tile FROM h WHERE bit = 0""",
)
def hilbert_tiles(spark, d):
    """Numbers of tiles of zoom 8 along the curve that keeps near ones together."""
    at = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 256).alias("x"), (F.col("c_custkey") * 53 % 256).alias("y"))
    return at.select("c_custkey", numeric.hilbert_tile(F.col("x"), F.col("y"), 8).alias("tile"))


@query(
    "name_hashes",
    """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, hex(p_name) AS h FROM part), f AS (SELECT name, h, 0 AS k, 14695981039346656037::UHUGEINT AS v FROM n
        UNION ALL SELECT name, h, k + 1, xor(v, ('0x' || h[2 * k + 1:2 * k + 2])::INT::UHUGEINT) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT FROM f WHERE 2 * k < len(h))
    SELECT name, lower(lpad(hex(v::UBIGINT), 16, '0')) AS hash FROM f WHERE 2 * k = len(h)""",
)
def name_hashes(spark, d):
    """FNV-1a of each name, and so whether two names of a pool meet."""
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", numeric.fnv64(F.col("name")).alias("hash"))


@query("zone_days")
def zone_days(spark, d):
    """Events of each local day in each zone. No SQL: zones of the JVM."""
    zones = F.explode(F.array(*[F.lit(z) for z in ("America/New_York", "America/Denver", "Pacific/Honolulu", "America/Adak")])).alias("zone")
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), zones)
    return events.groupBy("zone", days.local_day(F.col("ts"), F.col("zone")).cast("string").alias("day")).agg(F.count("*").alias("n"))
