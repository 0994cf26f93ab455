"""Grouped statistics, hierarchical rates and rankings over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import numeric
from gristmill.operators import aggregates, blocks, hierarchy
from gristmill.plans.registry import query
from gristmill.session import table


@query(
    "audience_min_days",
    "SELECT event_type, user_id, CAST(min(ts) AS DATE) AS first_day, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 2",
    ("first_day",),
)
def audience_min_days(spark, d):
    days = table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("day")).distinct()
    return days.groupBy("event_type", "user_id").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).where("days >= 2")


@query(
    "mode_deterministic",
    """SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r
    FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1""",
)
def mode_deterministic(spark, d):
    return aggregates.most_common(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query(
    "argmax_market",
    """SELECT user_id, event_type, days AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, event_type) AS r
    FROM (SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2)) WHERE r = 1""",
)
def argmax_market(spark, d):
    days = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    return aggregates.most_common(days, "user_id", "event_type")


@query(
    "conditional_shares",
    """SELECT l_suppkey, round(r, 9) AS returned, round(f, 9) AS finished,
        CASE WHEN r >= 0.5 THEN 'no' WHEN f >= 0.5 THEN 'late' WHEN n >= 10 AND r + f <= 0.7 THEN 'open' ELSE 'unknown' END AS outcome
    FROM (SELECT l_suppkey, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS r, avg(CAST(l_linestatus = 'F' AS INTEGER)) AS f, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def conditional_shares(spark, d):
    share = lambda c: F.count_if(c) / F.count("*")
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(share(F.col("l_returnflag") == "R").alias("r"), share(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("n"))
    outcome = F.when(F.col("r") >= 0.5, "no").when(F.col("f") >= 0.5, "late").when((F.col("n") >= 10) & (F.col("r") + F.col("f") <= 0.7), "open").otherwise("unknown")
    return sums.select("l_suppkey", F.round("r", 9).alias("returned"), F.round("f", 9).alias("finished"), outcome.alias("outcome"))


@query(
    "covered_share_class",
    """WITH c AS (SELECT l_suppkey, CAST(p_size // 10 AS INTEGER) AS level, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    h AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY level DESC) AS held, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM c)
    SELECT l_suppkey, max(level) AS level FROM h WHERE held >= 0.5 * total GROUP BY 1""",
)
def covered_share_class(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("level"))
    joined = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.covered_class(joined, "l_suppkey", "level", 0.5)


@query(
    "best_rank_merge",
    """WITH k AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank FROM lineitem),
    b AS (SELECT *, min(rank) OVER (PARTITION BY l_orderkey) AS best FROM k)
    SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first_ship, CAST(max(l_shipdate) AS DATE) AS last_ship,
        array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM b WHERE rank = best GROUP BY 1""",
    ("first_ship", "last_ship"),
)
def best_rank_merge(spark, d):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    kept = aggregates.best_rank_only(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", "l_suppkey"), "l_orderkey", rank)
    suppliers = F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",")
    return kept.groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first_ship"), F.to_date(F.max("l_shipdate")).alias("last_ship"), suppliers.alias("suppliers"))


_LEAVES = """WITH leaves AS (SELECT n_regionkey AS region, c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS customer,
        sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS y, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
LEVELS = ["region", "nation", "segment", "customer"]
STRENGTHS = {"region": 256.0, "nation": 64.0, "segment": 16.0, "customer": 4.0}


def _leaves(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    # Orders are summed by customer before they meet the dimensions.
    sums = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("y"), F.count("*").alias("n"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("customer"))
    return sums.join(placed, F.col("o_custkey") == F.col("customer")).drop("o_custkey")


def _levels_sql(then: str) -> str:
    sums = "".join(f", CAST(sum(y) OVER (PARTITION BY {', '.join(LEVELS[: k + 1])}) AS BIGINT) AS y_{name}, CAST(sum(n) OVER (PARTITION BY {', '.join(LEVELS[: k + 1])}) AS BIGINT) AS n_{name}" for k, name in enumerate(LEVELS))
    return f"{_LEAVES}, c AS (SELECT customer{sums}, CAST(sum(y) OVER () AS BIGINT) AS y_all, CAST(sum(n) OVER () AS BIGINT) AS n_all FROM leaves) {then}"


@query("level_counts", _levels_sql("SELECT * FROM c"))
def level_counts(spark, d):
    counts = hierarchy.level_counts(_leaves(spark, d), LEVELS, "y", "n")
    return counts.select("customer", *[f"{k}_{name}" for name in [*LEVELS, "all"] for k in ("y", "n")])


def _chain_sql() -> str:
    steps, above = ["r0 AS (SELECT *, y_all / n_all AS rate_all FROM c)"], "rate_all"
    for k, name in enumerate(LEVELS):
        m = STRENGTHS[name]
        steps.append(f"r{k + 1} AS (SELECT *, (y_{name} + {m}::DOUBLE * {above}) / (n_{name} + {m}::DOUBLE) AS rate_{name} FROM r{k})")
        above = f"rate_{name}"
    rates = ", ".join(f"round(rate_{name}, 9) AS rate_{name}" for name in ["all", *LEVELS])
    return _levels_sql(", " + ", ".join(steps) + f" SELECT customer, {rates}, greatest(0.01, least(0.99, round_even(rate_customer, 2)))::DOUBLE AS published FROM r{len(LEVELS)}")


@query("shrinkage_chain", _chain_sql())
def shrinkage_chain(spark, d):
    """The flagship: orders rolled up a place hierarchy and shrunk level by level."""
    counts = hierarchy.level_counts(_leaves(spark, d), LEVELS, "y", "n")
    rated = hierarchy.shrinkage_chain(counts, LEVELS, STRENGTHS)
    return rated.select("customer", *[F.round(f"rate_{name}", 9).alias(f"rate_{name}") for name in ["all", *LEVELS]], hierarchy.published(F.col("rate_customer")).alias("published"))


_SEASONS = """WITH s AS (SELECT c_nationkey AS nation, year(o_orderdate) AS season, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS y, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _seasons(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    joined = orders.select("o_custkey", F.year("o_orderdate").cast("long").alias("season"), "o_orderstatus").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("nation", "season").agg(F.count_if(F.col("o_orderstatus") == "F").alias("y"), F.count("*").alias("n"))


@query("leave_one_season_out", f"{_SEASONS} SELECT *, CAST(sum(y) OVER w - y AS BIGINT) AS y_others, CAST(sum(n) OVER w - n AS BIGINT) AS n_others FROM s WINDOW w AS (PARTITION BY nation)")
def leave_one_season_out(spark, d):
    return hierarchy.left_out(_seasons(spark, d), "nation", "season", "y", "n")


@query(
    "walk_forward_rates",
    f"""{_SEASONS} SELECT a.nation, a.season, CAST(sum(b.y) AS BIGINT) AS y_before, CAST(sum(b.n) AS BIGINT) AS n_before, round((sum(b.y) + 10 * 0.3) / (sum(b.n) + 10), 9) AS rate
    FROM s a JOIN s b ON a.nation = b.nation AND b.season < a.season GROUP BY 1, 2""",
)
def walk_forward_rates(spark, d):
    before = Window.partitionBy("nation").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    sums = _seasons(spark, d).withColumn("y_before", F.sum("y").over(before)).withColumn("n_before", F.sum("n").over(before))
    rate = F.round((F.col("y_before") + 3.0) / (F.col("n_before") + 10), 9)
    return sums.where("n_before is not null").select("nation", "season", "y_before", "n_before", rate.alias("rate"))


GRID = (1, 4, 16, 64, 256, 1024)


@query(
    "grid_tune_shrinkage",
    f"""{_SEASONS}, o AS (SELECT *, sum(y) OVER w - y AS yo, sum(n) OVER w - n AS no, (sum(y) OVER () - sum(y) OVER z)::DOUBLE / (sum(n) OVER () - sum(n) OVER z) AS above FROM s
        WINDOW w AS (PARTITION BY nation), z AS (PARTITION BY season)),
    g AS (SELECT m, (yo + m * above) / (no + m) AS p, y, n FROM o, (VALUES {", ".join(f"({m})" for m in GRID)}) t(m))
    SELECT CAST(m AS INTEGER) AS m, round(-sum(y * ln(p) + (n - y) * ln(1 - p)) / sum(n), 6) AS loss FROM g GROUP BY 1""",
)
def grid_tune_shrinkage(spark, d):
    """The log loss of each strength, each season scored by the others; the least is the strength to take."""
    own = hierarchy.left_out(_seasons(spark, d), "nation", "season", "y", "n")
    by_season = own.groupBy("season").agg(F.sum("y").alias("ys"), F.sum("n").alias("ns"))
    whole = Window.partitionBy()
    above = by_season.select("season", ((F.sum("ys").over(whole) - F.col("ys")) / (F.sum("ns").over(whole) - F.col("ns"))).alias("above"))
    rows = own.join(above, "season").withColumn("m", F.explode(F.array(*map(F.lit, GRID))))
    p = (F.col("y_others") + F.col("m") * F.col("above")) / (F.col("n_others") + F.col("m"))
    loss = -F.sum(F.col("y") * numeric.natural_log(F.col("p")) + (F.col("n") - F.col("y")) * numeric.natural_log(1 - F.col("p"))) / F.sum("n")
    return rows.withColumn("p", p).groupBy("m").agg(F.round(loss, 6).alias("loss"))


@query(
    "status_pivot",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P,
        arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS final FROM orders GROUP BY 1""",
)
def status_pivot(spark, d):
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")]
    return table(spark, d, "orders").groupBy("o_custkey").agg(*counts, F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("final"))


@query(
    "median_rows",
    "SELECT user_id, round(median(value), 6) AS middle, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1",
)
def median_rows(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("middle"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.count("*").alias("n"))


@query(
    "half_value_null_poison",
    """WITH v AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 AND l_discount = 0 AND l_suppkey % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC NULLS LAST) AS place, count(*) OVER (PARTITION BY l_suppkey) AS n, count(q) OVER (PARTITION BY l_suppkey) AS known FROM v)
    SELECT l_suppkey, CASE WHEN n = known THEN q END AS q FROM r WHERE place = greatest(1, ceil(0.5 * n - 1e-9))""",
)
def half_value_null_poison(spark, d):
    missing = (F.col("l_linenumber") == 7) & (F.col("l_discount") == 0) & (F.col("l_suppkey") % 3 == 0)
    return aggregates.reached_by(table(spark, d, "lineitem").select("l_suppkey", F.when(~missing, F.col("l_quantity")).alias("q")), "l_suppkey", "q", 0.5)


@query(
    "evidence_rollup",
    """SELECT source, count(*) AS rows_seen, count(quality) AS labelled, coalesce(bool_or(toxic = 1), false) AS any_toxic, min(d.doc_id) AS first_id, max(d.doc_id) AS last_id,
        array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def evidence_rollup(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels")
    langs = F.array_join(F.array_sort(F.collect_set("lang")), ",")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("rows_seen"), F.count("quality").alias("labelled"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("any_toxic"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), langs.alias("langs"))


@query(
    "multi_grain_coverage",
    """SELECT n_regionkey, c_nationkey, c_mktsegment, count(*) AS n, round(avg(CAST(c_acctbal > 0 AS INTEGER)), 9) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey
    GROUP BY GROUPING SETS ((), (n_regionkey), (n_regionkey, c_nationkey), (c_mktsegment))""",
)
def multi_grain_coverage(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    region, nation, segment = F.col("n_regionkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    grouped = joined.groupingSets([[], [region], [region, nation], [segment]], region, nation, segment)
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 9).alias("share"))


@query(
    "weighted_tally",
    """SELECT r_name, count(*) FILTER (c_acctbal > 0) AS seen, count(*) AS n, round(sum(c_acctbal * CAST(c_acctbal > 0 AS INTEGER)) / sum(abs(c_acctbal)), 6) AS weighted
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)""",
)
def weighted_tally(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    joined = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    seen = F.col("c_acctbal") > 0
    return joined.rollup("r_name").agg(F.count_if(seen).alias("seen"), F.count("*").alias("n"), F.round(F.sum(F.when(seen, F.col("c_acctbal")).otherwise(0)) / F.sum(F.abs("c_acctbal")), 6).alias("weighted"))


@query(
    "clustered_se",
    """WITH y AS (SELECT o_orderpriority, c_nationkey, CAST(o_orderstatus = 'F' AS INTEGER) - 0.3::DOUBLE AS res FROM orders JOIN customer ON o_custkey = c_custkey),
    c AS (SELECT o_orderpriority, c_nationkey, sum(res) AS s, count(*) AS n FROM y GROUP BY 1, 2)
    SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, round(sqrt(sum(s * s)) / sum(n), 9) AS se FROM c GROUP BY 1""",
)
def clustered_se(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    residual = (F.col("o_orderstatus") == "F").cast("int") - F.lit(0.3)
    return aggregates.clustered_error(joined, "c_nationkey", residual, "o_orderpriority").withColumn("se", F.round("se", 9))


_SCORED = "WITH s AS (SELECT round(1 / (1 + exp(-(n_chars - 1500) / 1500.0::DOUBLE)), 9) AS p, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_BINS = f"{_SCORED}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM s GROUP BY 1)"


def _scored(spark, d):
    p = F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1500.0)), 9)
    return table(spark, d, "documents").select("doc_id", p.alias("p")).join(table(spark, d, "labels"), "doc_id").select("p", F.col("quality").alias("y"))


@query("reliability_bins", f"{_BINS} SELECT bin, n, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM b")
def reliability_bins(spark, d):
    return aggregates.reliability(_scored(spark, d), "p", "y", 10).withColumns({c: F.round(c, 9) for c in ("mean_p", "observed")})


@query(
    "brier_logloss",
    f"""{_SCORED} SELECT round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-y * ln(p) - (1 - y) * ln(1 - p)), 9) AS log_loss,
        count(*) FILTER (p >= 0.5 AND y = 1) AS caught, count(*) FILTER (p >= 0.5) AS called FROM s""",
)
def brier_logloss(spark, d):
    p, y = F.col("p"), F.col("y")
    return _scored(spark, d).agg(F.round(F.avg((p - y) * (p - y)), 9).alias("brier"), F.round(F.avg(-y * numeric.natural_log(p) - (1 - y) * numeric.natural_log(1 - p)), 9).alias("log_loss"), F.count_if((p >= 0.5) & (y == 1)).alias("caught"), F.count_if(p >= 0.5).alias("called"))


@query("ece", f"{_BINS} SELECT round(sum(n * abs(mean_p - observed)) / sum(n), 9) AS ece FROM b")
def ece(spark, d):
    return aggregates.calibration_error(aggregates.reliability(_scored(spark, d), "p", "y", 10)).withColumn("ece", F.round("ece", 9))


@query(
    "concordance_within_group",
    """SELECT a.user_id, round(avg(CASE WHEN a.value > b.value THEN 1.0::DOUBLE WHEN a.value = b.value THEN 0.5 ELSE 0 END), 9) AS concordance
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' GROUP BY 1""",
)
def concordance_within_group(spark, d):
    return aggregates.concordance(table(spark, d, "events"), "user_id", "value", F.col("event_type") == "error").withColumn("concordance", F.round("concordance", 9))


_ALLOTTED = """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, n * 100 / sum(n) OVER () AS exact FROM g),
    f AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source) AS r FROM e)"""


@query("largest_remainder", f"{_ALLOTTED} SELECT source, CAST(base + CASE WHEN r <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f")
def largest_remainder(spark, d):
    return aggregates.largest_remainder(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "n", 100, "source")


@query(
    "stratified_sample",
    f"""{_ALLOTTED}, q AS (SELECT source, base + CASE WHEN r <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS seats FROM f),
    p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) AS place FROM documents)
    SELECT doc_id, p.source FROM p JOIN q ON p.source = q.source WHERE place <= seats""",
)
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    seats = aggregates.largest_remainder(docs.groupBy("source").agg(F.count("*").alias("n")), "n", 100, "source")
    """Seats of each source by its least digests: those of 64 parts of a source first, then of what is left."""
    drawn = docs.join(seats, "source").withColumn("draw", F.md5(F.concat_ws(":", "doc_id", F.lit("7"))))
    return blocks.least(drawn, ["source"], ["draw", "doc_id"], "seats", F.pmod(F.xxhash64("doc_id"), F.lit(64))).select("doc_id", "source")


@query(
    "exposure_rates",
    """SELECT c_mktsegment, o_orderpriority, round(count(*) / (SELECT count(DISTINCT year(o_orderdate)) FROM orders), 9) AS per_year
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def exposure_rates(spark, d):
    orders = table(spark, d, "orders")
    years = orders.agg(F.countDistinct(F.year("o_orderdate")).alias("years"))
    counts = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(years)).select("c_mktsegment", "o_orderpriority", F.round(F.col("n") / F.col("years"), 9).alias("per_year"))


@query(
    "transition_matrix",
    """WITH t AS (SELECT o_orderstatus AS a, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
    SELECT a AS from_status, b AS to_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 9) AS share FROM t WHERE b IS NOT NULL GROUP BY 1, 2""",
)
def transition_matrix(spark, d):
    after = F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    counts = table(spark, d, "orders").select(F.col("o_orderstatus").alias("from_status"), after.alias("to_status"), "o_custkey").where("to_status is not null").groupBy("from_status", "to_status").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_status")), 9))


@query(
    "mixture_chance",
    """WITH t AS (SELECT o_orderstatus AS a, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
    m AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS share FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT o_orderstatus AS b, o_orderpriority, avg(CAST(o_totalprice > 200000 AS INTEGER)) AS p FROM orders GROUP BY 1, 2)
    SELECT a AS from_status, o_orderpriority, round(sum(share * p), 9) AS chance FROM m JOIN r ON m.b = r.b GROUP BY 1, 2""",
)
def mixture_chance(spark, d):
    shares = transition_matrix(spark, d)
    shares = shares.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_status")))
    rates = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("to_status"), "o_orderpriority").agg(F.avg((F.col("o_totalprice") > 200000).cast("int")).alias("p"))
    return shares.join(rates, "to_status").groupBy("from_status", "o_orderpriority").agg(F.round(F.sum(F.col("share") * F.col("p")), 9).alias("chance"))


def _subset_terms():
    """Coefficients of the exact Shapley value of three terms: (others present, weight)."""
    return [((), 1 / 3), ((0,), 1 / 6), ((1,), 1 / 6), ((0, 1), 1 / 3)]


def _shapley_sql(k: int) -> str:
    others = [j for j in range(3) if j != k]
    parts = []
    for chosen, weight in _subset_terms():
        base = " + ".join(["-1.0", *[f"t{others[c]}" for c in chosen]])
        parts.append(f"{weight!r} * (1 / (1 + exp(-({base} + t{k}))) - 1 / (1 + exp(-({base}))))")
    return f"round({' + '.join(parts)}, 9) AS s{k}"


@query(
    "shapley_terms",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 10::DOUBLE AS t0, l_tax * -5::DOUBLE AS t1, l_quantity / 50::DOUBLE AS t2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, {", ".join(_shapley_sql(k) for k in range(3))} FROM t""",
)
def shapley_terms(spark, d):
    """How much each of three terms adds to a probability, over all orders of adding them: a closed form in columns."""
    terms = [F.col("l_discount") * 10.0, F.col("l_tax") * -5.0, F.col("l_quantity") / 50.0]
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    out = []
    for k in range(3):
        others = [terms[j] for j in range(3) if j != k]
        gains = [F.lit(w) * (sigmoid(reduce(lambda a, b: a + b, (others[c] for c in chosen), F.lit(-1.0)) + terms[k]) - sigmoid(reduce(lambda a, b: a + b, (others[c] for c in chosen), F.lit(-1.0)))) for chosen, w in _subset_terms()]
        out.append(F.round(reduce(lambda a, b: a + b, gains), 9).alias(f"s{k}"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *out)


@query(
    "bucket_priority",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount END AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN i >= 0.09 THEN 5 WHEN q >= 40 THEN 4 WHEN i IS NULL AND (q IS NULL OR q < 40) THEN 13 WHEN i >= 0.05 THEN 3 WHEN q >= 20 THEN 2 WHEN q IS NULL THEN 13 ELSE 0 END AS code FROM v""",
)
def bucket_priority(spark, d):
    """The strongest bucket that is known to hold; unknown (13) where a missing value could still beat what is known."""
    q = F.when(F.col("l_linenumber") != 6, F.col("l_quantity"))
    i = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    code = F.when(i >= 0.09, 5).when(q >= 40, 4).when(i.isNull(), 13).when(i >= 0.05, 3).when(q >= 20, 2).when(q.isNull(), 13).otherwise(0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
