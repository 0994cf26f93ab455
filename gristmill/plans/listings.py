"""Aliases, details, bulletins, open statements and slots over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import bulletins
from gristmill.operators import listings
from gristmill.plans.registry import query
from gristmill.session import table


@query(
    "alias_targets",
    r"""WITH a AS (SELECT p_type, p_name, min(p_brand) AS brand FROM part GROUP BY 1, 2 HAVING min(p_size) < 10 UNION SELECT p_type, p_name, max(p_brand) FROM part GROUP BY 1, 2 HAVING min(p_size) < 10)
    SELECT p_partkey, brand FROM part p LEFT JOIN a ON a.p_type = p.p_type AND a.p_name = p.p_name""",
)
def alias_targets(spark, d):
    """The targets of each listing's alias in its market, however the listing is spaced and cased."""
    parts = table(spark, d, "part")
    named = parts.groupBy("p_type", "p_name").agg(F.min("p_brand").alias("low"), F.max("p_brand").alias("high"), F.min("p_size").alias("least")).where("least < 10")
    aliases = named.select("p_type", "p_name", F.explode(F.array("low", "high")).alias("brand"))
    said = parts.select("p_partkey", "p_type", F.concat(F.lit("  "), F.upper(F.regexp_replace("p_name", " ", " \t ")), F.lit(" ")).alias("p_name"))
    return listings.alias_join(said, aliases, "p_type", "p_name", "brand").select("p_partkey", "brand")


_GROUPS = {"view": "seen", "click": "seen", "purchase": "deal", "signup": "deal"}
_GROUPED = "CASE WHEN event_type IN ('view', 'click') THEN 'seen' WHEN event_type IN ('purchase', 'signup') THEN 'deal' END"


@query(
    "agreed_details",
    f"""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) AS h, {_GROUPED} AS grp, list_sort(list_distinct(list(event_type))) AS said FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3, 4),
    k AS (SELECT user_id, day, grp, min(said) AS said FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT said) = 1) SELECT user_id, day, grp, unnest(said) AS event_type FROM k""",
    days=("day",),
)
def agreed_details(spark, d):
    """Kinds of a user's day in groups on which all its hours that speak say the same."""
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("h"), "event_type")
    groups = spark.createDataFrame(list(_GROUPS.items()), "event_type string, grp string")
    return listings.agreed(events, groups, ["user_id", "day"], ["h"], "event_type", "grp")


@query(
    "alert_amounts",
    """WITH l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 6 AS f, CAST(l_quantity AS INTEGER) AS q, CAST(l_orderkey % 7 + 1 AS INTEGER) AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(CASE f WHEN 0 THEN least(q, r) WHEN 1 THEN 0 WHEN 2 THEN q WHEN 3 THEN 0.1 END AS DOUBLE) AS snow_low, CAST(CASE f WHEN 0 THEN greatest(q, r) WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN q END AS DOUBLE) AS snow_high,
    CAST(CASE f WHEN 3 THEN q WHEN 4 THEN 0.5 END AS DOUBLE) AS ice, CASE f WHEN 2 THEN -q WHEN 5 THEN -r END AS wind_chill FROM l""",
)
def alert_amounts(spark, d):
    """Figures of bulletins that the quantities are written into, in six forms."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).alias("f"), F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_orderkey") % 7 + 1).cast("string").alias("r"))
    forms = [
        F.concat(F.lit("* WHAT...Heavy snow expected. Total snow accumulations of "), "q", F.lit(" to\n"), "r", F.lit(" inches.")),
        F.concat(F.lit("Snow accumulations up to "), "q", F.lit(" inches are possible.")),
        F.concat(F.lit("Snow around "), "q", F.lit(" inches. Wind chills as low as "), "q", F.lit(" below zero, then wind chills near 5 above.")),
        F.concat(F.lit("Ice accumulations of one tenth to "), "q", F.lit(" inches.")),
        F.lit("Around a half inch of ice."),
        F.concat(F.lit("Wind chills of 20 above early. Wind chill to MINUS "), "r", F.lit(" later.")),
    ]
    text = F.coalesce(*[F.when(F.col("f") == k, form) for k, form in enumerate(forms)])
    flat = rows.select("l_orderkey", "l_linenumber", bulletins.flat_text(text).alias("flat"))
    return flat.select("l_orderkey", "l_linenumber", bulletins.flat_amounts(F.col("flat")).alias("a")).select("l_orderkey", "l_linenumber", "a.*")


@query(
    "open_statements",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(p AS VARCHAR) || ',' || CAST(p + 1 AS VARCHAR) WHEN 1 THEN CAST(p + CAST((12 - isodow(p)) % 7 AS INTEGER) AS VARCHAR) WHEN 2 THEN CAST(p + 3 AS VARCHAR) WHEN 4 THEN CAST(p + 6 AS VARCHAR) ELSE '' END AS days FROM o""",
)
def open_statements(spark, d):
    """The days that statements name, against the day each was posted."""
    posted, key = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    forms = [
        F.lit("Open tomorrow and  TODAY"), F.lit("Schools are open Friday"), F.concat(F.lit("Open "), F.date_format(F.date_add(posted, 3), "M/d"), F.lit(" as planned")), F.lit("Open today, activities tonight"),
        F.concat(F.lit("Open "), F.date_format(F.date_add(posted, 6), "MMMM d"), F.lit("th")), F.concat(F.lit("Open "), F.date_format(F.date_add(posted, 9), "M/d")),
    ]
    text = F.coalesce(*[F.when(key == k, form) for k, form in enumerate(forms)])
    days = bulletins.open_days(text, posted)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(days, lambda x: x.cast("string")), ",").alias("days"))


_HELD = "SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, user_id FROM events"


@query(
    "slot_runs",
    f"""WITH h AS ({_HELD}), s AS (SELECT event_type, day, lead(day) OVER (PARTITION BY event_type ORDER BY day) AS later, lag(day) OVER (PARTITION BY event_type ORDER BY day) AS past FROM (SELECT DISTINCT event_type, day FROM h))
    SELECT h.event_type, h.day, h.user_id, 'added' AS change FROM h JOIN s USING (event_type, day) WHERE NOT EXISTS (FROM h b WHERE b.event_type = h.event_type AND b.day = s.past AND b.user_id = h.user_id)
    UNION ALL SELECT h.event_type, s.later, h.user_id, 'removed' FROM h JOIN s USING (event_type, day) WHERE s.later IS NOT NULL AND NOT EXISTS (FROM h b WHERE b.event_type = h.event_type AND b.day = s.later AND b.user_id = h.user_id)""",
    days=("day",),
)
def slot_runs(spark, d):
    """Who a kind of event gains and loses from one of its days to the next."""
    return listings.slot_runs(table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id"), "event_type", "day", "user_id")


@query("slot_states", _HELD, days=("day",))
def slot_states(spark, d):
    """Gains and losses put back into the members of every slot."""
    reads = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return listings.slot_states(listings.slot_runs(reads, "event_type", "day", "user_id"), reads, "event_type", "day", "user_id")
