"""Labels for training: folds, what changed between builds, snapshots, neighbours' shares and levels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gristmill.operators import labels
from gristmill.plans.registry import query
from gristmill.session import table

FOLD = date(2024, 1, 20)

_READS = "SELECT event_type AS unit, user_id AS place, CAST(ts AS DATE) AS day, coalesce(value >= 60, FALSE) AS closed FROM events"


def _labels_sql(where: str) -> str:
    return f"""(WITH r AS (SELECT * FROM ({_READS}) WHERE {where}), a AS (SELECT unit, place, min(day) AS since FROM r GROUP BY 1, 2 HAVING count(DISTINCT day) >= 3),
    s AS (SELECT unit, day, count(*) AS n FROM r GROUP BY 1, 2), u AS (SELECT unit, count(*) AS reads, avg(n) AS usual FROM s GROUP BY 1), c AS (SELECT s.unit, day, reads >= 2 AND n >= 0.5 * usual AS counted FROM s JOIN u USING (unit)),
    n AS (SELECT unit, place, day, bool_or(closed) AS closed FROM r GROUP BY 1, 2, 3),
    e AS (SELECT a.place, c.day, c.counted, coalesce(n.closed, FALSE) AS closed FROM a JOIN c ON a.unit = c.unit AND c.day >= a.since LEFT JOIN n ON n.unit = a.unit AND n.place = a.place AND n.day = c.day)
    SELECT place, day, CASE WHEN NOT bool_or(counted) THEN 'unknown' WHEN bool_or(counted AND closed) THEN 'closed' ELSE 'open' END AS outcome FROM e GROUP BY 1, 2)"""


def _reads(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("unit"), F.col("user_id").alias("place"), F.to_date("ts").alias("day"), (F.col("value") >= 60).alias("closed"))


@query("fold_labels", _labels_sql(f"day < DATE '{FOLD}'"), days=("day",))
def fold_labels(spark, d):
    """Labels of a fold: lists are event types, places users; nothing read on the fold's first day or later is used."""
    return labels.fold_labels(_reads(spark, d), F.col("closed"), FOLD)


@query(
    "label_changes",
    f"""WITH w AS (SELECT * FROM {_labels_sql('TRUE')} WHERE day < DATE '{FOLD}'), f AS {_labels_sql(f"day < DATE '{FOLD}'")}, j AS (SELECT coalesce(w.outcome, 'missing') AS was, coalesce(f.outcome, 'missing') AS now FROM w FULL JOIN f ON w.place = f.place AND w.day = f.day)
    SELECT was, now, CASE WHEN was IN ('closed', 'open') THEN CASE WHEN was = now THEN 'same' ELSE 'changed' END WHEN now IN ('closed', 'open') THEN 'added' ELSE 'neither' END AS kind, count(*) AS n FROM j GROUP BY 1, 2, 3""",
)
def label_changes(spark, d):
    """What a fold's labels differ in from those that all reads give the same days."""
    reads = _reads(spark, d)
    return labels.compared(labels.fold_labels(reads, F.col("closed")).where(F.col("day") < F.lit(FOLD)), labels.fold_labels(reads, F.col("closed"), FOLD))


@query(
    "named_shares",
    """WITH l AS (SELECT c_nationkey AS place, CAST(o_orderdate AS DATE) AS day, bool_or(o_orderstatus = 'F') AS shut FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    e AS (SELECT c_nationkey AS place, count(*) AS eligible FROM customer GROUP BY 1), n AS (SELECT c_nationkey AS place, CAST(o_orderdate AS DATE) AS day, count(DISTINCT c_custkey) AS named FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
    SELECT l.place, l.day, eligible, round(coalesce(named, 0) / eligible::DOUBLE, 9) AS share FROM l JOIN e USING (place) LEFT JOIN n ON n.place = l.place AND n.day = l.day WHERE shut""",
    days=("day",),
)
def named_shares(spark, d):
    """Of a nation's customers, the share with an urgent order on a day that closed one."""
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("place"), F.col("c_custkey").alias("member"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority")
    outcome = F.when(F.max(F.col("o_orderstatus") == "F"), labels.CLOSED).otherwise(labels.OPEN).alias("outcome")
    found = labels.named_shares(orders.join(members, "member").groupBy("place", "day").agg(outcome), members, orders.where("o_orderpriority = '1-URGENT'"), (labels.CLOSED,))
    return found.withColumn("share", F.round("share", 9))


_SNAPSHOTS = """(WITH r AS (SELECT event_type AS unit, user_id AS place, ts AS took, CAST(ts AS DATE) AS day, value FROM events), l AS (SELECT DISTINCT place, day FROM r), a AS (SELECT unit, place, min(day) AS since FROM r GROUP BY 1, 2 HAVING count(DISTINCT day) >= 3),
    p AS (SELECT place, day, min(took) AS first FROM r WHERE value >= 60 GROUP BY 1, 2), w AS (SELECT DISTINCT day, day - INTERVAL 6 HOUR AS lo, day + INTERVAL 6 HOUR AS hi FROM l),
    c AS (SELECT unit, w.day, max(took) AS took FROM r JOIN w ON r.took >= lo AND r.took < hi GROUP BY 1, 2), s AS (SELECT a.place, c.day, max(c.took) AS took FROM a JOIN c ON a.unit = c.unit AND c.day >= a.since GROUP BY 1, 2)
    SELECT l.place, l.day, CASE WHEN p.first IS NULL OR p.first > w.hi THEN s.took END AS snapshot_at FROM l JOIN w USING (day) LEFT JOIN s ON s.place = l.place AND s.day = l.day LEFT JOIN p ON p.place = l.place AND p.day = l.day)"""


def _snapshots(spark, d):
    reads = table(spark, d, "events").select(F.col("event_type").alias("unit"), F.col("user_id").alias("place"), F.col("ts").alias("at"), F.to_date("ts").alias("day"), "value")
    posted = reads.where("value >= 60").groupBy("place", "day").agg(F.min("at").alias("first"))
    midnight = F.col("day").cast("timestamp_ntz")
    found = labels.snapshots(reads.select("place", "day").distinct(), reads.select("unit", "at"), labels.audiences(reads, 3), posted, midnight - F.expr("interval 6 hours"), midnight + F.expr("interval 6 hours"))
    return found


@query("snapshots", f"SELECT place, day, epoch_us(snapshot_at) AS snapshot_at FROM {_SNAPSHOTS}", days=("day",))
def snapshots(spark, d):
    """When the lists that carry a user were last read in the night before each of its days, in microseconds."""
    return _snapshots(spark, d).withColumn("snapshot_at", F.unix_micros(F.col("snapshot_at").cast("timestamp")))


@query(
    "training_levels",
    f"""WITH s AS {_SNAPSHOTS}, u AS (SELECT DISTINCT user_id AS place FROM events), n AS (SELECT a.place, b.place AS other FROM u a JOIN u b ON b.place <> a.place AND b.place BETWEEN a.place - 2 AND a.place + 2),
    h AS (SELECT user_id AS place, CAST(ts AS DATE) AS day, min(ts) AS first FROM events WHERE value >= 40 GROUP BY 1, 2), z AS (SELECT place, count(*) AS n FROM n GROUP BY 1),
    m AS (SELECT s.place, s.day, count(*) AS met FROM s JOIN n ON n.place = s.place JOIN h ON h.place = n.other AND h.day = s.day WHERE h.first <= s.snapshot_at GROUP BY 1, 2),
    v AS (SELECT user_id AS place, CAST(ts AS DATE) AS day, max(value) AS most FROM events WHERE event_type = 'error' GROUP BY 1, 2),
    r AS (SELECT s.place, s.day, CASE WHEN s.snapshot_at IS NOT NULL THEN CASE WHEN z.n > 0 THEN coalesce(met, 0) / z.n::DOUBLE ELSE 0 END END AS share, most FROM s LEFT JOIN z ON z.place = s.place LEFT JOIN m ON m.place = s.place AND m.day = s.day LEFT JOIN v ON v.place = s.place AND v.day = s.day)
    SELECT place, day, round(share, 9) AS share, CASE WHEN share IS NULL THEN -1 ELSE CAST(share > 0 AS INTEGER) + CAST(share >= 0.5 AS INTEGER) END AS neighbours, CASE WHEN most IS NULL THEN -1 ELSE CAST(most >= 20 AS INTEGER) + CAST(most >= 50 AS INTEGER) END AS severity FROM r""",
    days=("day",),
)
def training_levels(spark, d):
    """Levels of each user's day: neighbours (users within two ids) that had shown it by the snapshot, and the worst error; -1 where nothing is known."""
    snapshot = _snapshots(spark, d)
    events = table(spark, d, "events")
    users = events.select(F.col("user_id").alias("place")).distinct()
    near = users.select("place", F.explode(F.array(*[F.col("place") + k for k in (-2, -1, 1, 2)])).alias("other")).join(users.select(F.col("place").alias("other")), "other", "left_semi")
    by = (F.col("user_id").alias("place"), F.to_date("ts").alias("day"))
    shut = events.where("value >= 40").groupBy(*by).agg(F.min("ts").alias("first"))
    worst = events.where("event_type = 'error'").groupBy(*by).agg(F.max("value").alias("most"))
    rows = labels.neighbour_shares(snapshot, near, shut).join(worst, ["place", "day"], "left")
    share, most = F.col("share"), F.col("most")
    return rows.select("place", "day", F.round(share, 9).alias("share"), labels.level(share, [1e-9, 0.5]).alias("neighbours"), labels.level(most, [20, 50]).alias("severity"))


@query(
    "captures_planned",
    """WITH c AS (SELECT c_nationkey AS unit, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS day, o_orderkey AS capture, o_totalprice AS size FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_discount >= 0.09 GROUP BY 1), m AS (SELECT c.*, day IN (FROM s) AS storm FROM c),
    b AS (SELECT unit, season, bool_or(storm) AS stormy, avg(size) AS usual, max(size) AS largest FROM m GROUP BY 1, 2),
    k AS (SELECT m.*, row_number() OVER (PARTITION BY unit, season ORDER BY size DESC, capture) AS place FROM m JOIN b USING (unit, season) WHERE storm OR NOT stormy AND (size > usual OR size = largest))
    SELECT unit, season, capture, size, CASE WHEN storm THEN 'storm' ELSE 'large' END AS why FROM k WHERE place <= 3""",
)
def captures_planned(spark, d):
    """Three orders to look at for each nation and year: those of days with a dear return, else large ones."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"))
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    captures = orders.select("unit", F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("size"))
    storms = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49 and l_discount >= 0.09").select(F.to_date("l_shipdate").alias("day"))
    return labels.captures_planned(captures, storms, 3).withColumnRenamed("at", "capture")


@query(
    "matched_shares",
    """WITH r AS (SELECT user_id AS unit, CAST(ts AS DATE) AS day, count(*) FILTER (value IS NOT NULL AND event_type <> 'error') / count(*)::DOUBLE AS share FROM events GROUP BY 1, 2)
    SELECT unit, count(*) AS reads, CASE WHEN count(*) >= 3 THEN round(median(share), 9) END AS usual FROM r GROUP BY 1""",
)
def matched_shares(spark, d):
    """The share of a read's rows that were matched, and its median over a unit's reads; none with fewer than three."""
    matched = F.count_if(F.col("value").isNotNull() & (F.col("event_type") != "error"))
    reads = table(spark, d, "events").groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("day")).agg((matched / F.count("*")).alias("share"))
    return reads.groupBy("unit").agg(F.count("*").alias("reads"), F.when(F.count("*") >= 3, F.round(F.percentile("share", 0.5), 9)).alias("usual"))
