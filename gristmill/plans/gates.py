"""Gates in order: why a reading makes no claim, and why a day is not published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import quality
from gristmill.plans.registry import query
from gristmill.session import table

_READINGS = """SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic, min(d.doc_id) OVER (PARTITION BY md5(d.text)) AS first_id, max(d.doc_id) OVER (PARTITION BY d.source) AS newest
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)"""
_CLAIMS = r"""CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s]') THEN 'empty' WHEN source IS NULL THEN 'source' WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es') THEN 'language' WHEN first_id < doc_id THEN 'repeated'
    WHEN newest - doc_id > 900 THEN 'stale' WHEN toxic = 1 THEN 'toxic' WHEN length(text) < 40 THEN 'short' WHEN regexp_matches(text, '[0-9]{7}') THEN 'digits' WHEN regexp_matches(text, '[A-Z]{6}') THEN 'capitals' WHEN quality = 0 THEN 'quality' END"""


def claim_reason() -> Column:
    """The first of ten predicates that keeps a reading from making a claim."""
    text = F.col("text")
    checks = [
        (text.isNull() | ~text.rlike(r"\S"), "empty"),
        (F.col("source").isNull(), "source"),
        (F.col("lang").isNull() | ~F.col("lang").isin("en", "de", "fr", "es"), "language"),
        (F.col("first_id") < F.col("doc_id"), "repeated"),
        (F.col("newest") - F.col("doc_id") > 900, "stale"),
        (F.col("toxic") == 1, "toxic"),
        (F.length(text) < 40, "short"),
        (text.rlike("[0-9]{7}"), "digits"),
        (text.rlike("[A-Z]{6}"), "capitals"),
        (F.col("quality") == 0, "quality"),
    ]
    return quality.first_reason(checks)


def _readings(spark, d) -> DataFrame:
    """Readings with their labels, the first document of the same text and the newest of the source; repeats and newest ones are joined sums, so no group is gathered."""
    docs = table(spark, d, "documents").withColumn("said", F.md5("text"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    first = docs.groupBy(F.col("said").alias("same")).agg(F.min("doc_id").alias("first_id"))
    newest = docs.groupBy(F.col("source").alias("from")).agg(F.max("doc_id").alias("newest"))
    joined = docs.join(labels, "doc_id", "left").join(first, F.col("said").eqNullSafe(F.col("same"))).join(newest, F.col("source").eqNullSafe(F.col("from")))
    return joined.select("doc_id", "text", "lang", "source", "quality", "toxic", "first_id", "newest")


@query("claim_gate", f"SELECT doc_id, {_CLAIMS} AS reason FROM ({_READINGS})")
def claim_gate(spark, d):
    return _readings(spark, d).select("doc_id", claim_reason().alias("reason"))


@query("claim_reasons", f"SELECT reason, count(*) AS n FROM (SELECT {_CLAIMS} AS reason FROM ({_READINGS})) GROUP BY 1")
def claim_reasons(spark, d):
    """How many readings each gate stops; without a reason, how many pass."""
    return _readings(spark, d).groupBy(claim_reason().alias("reason")).agg(F.count("*").alias("n"))


_DAYS = """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, avg(CASE WHEN event_type = 'error' OR value IS NULL THEN 0.0 ELSE 1.0 END) AS healthy, max(value) AS most FROM events GROUP BY 1"""
_GATES = """list_filter([CASE WHEN n < 100 THEN 'rows' END, CASE WHEN users < 0.6 * before_users THEN 'users' END, CASE WHEN healthy < 0.6 THEN 'healthy' END, CASE WHEN healthy < 0.5 * before_healthy THEN 'worse' END, CASE WHEN n > 1.05 * before_n THEN 'jump' END, CASE WHEN most > 1.1 * before_most THEN 'spike' END], lambda x: x IS NOT NULL)"""


@query(
    "publish_gate",
    f"""WITH d AS ({_DAYS}), b AS (SELECT *, lag(n) OVER w AS before_n, lag(users) OVER w AS before_users, lag(healthy) OVER w AS before_healthy, lag(most) OVER w AS before_most FROM d WINDOW w AS (ORDER BY day)),
    g AS (SELECT day, {_GATES} AS failed FROM b)
    SELECT day, array_to_string(failed, ',') AS failed, failed[1] AS reason, max(CASE WHEN len(failed) = 0 THEN day END) OVER (ORDER BY day) AS served FROM g""",
    days=("day", "served"),
)
def publish_gate(spark, d):
    """The gates that a day fails, the first of them, and the day whose figures are served: the last one that failed none. Days are few, so they stand in one window."""
    healthy = F.when((F.col("event_type") == "error") | F.col("value").isNull(), 0.0).otherwise(1.0)
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.avg(healthy).alias("healthy"), F.max("value").alias("most"))
    by_day = Window.orderBy("day")
    before = daily.withColumns({f"before_{c}": F.lag(c).over(by_day) for c in ("n", "users", "healthy", "most")})
    checks = [
        (F.col("n") < 100, "rows"), (F.col("users") < 0.6 * F.col("before_users"), "users"), (F.col("healthy") < 0.6, "healthy"),
        (F.col("healthy") < 0.5 * F.col("before_healthy"), "worse"), (F.col("n") > 1.05 * F.col("before_n"), "jump"), (F.col("most") > 1.1 * F.col("before_most"), "spike"),
    ]
    judged = before.select("day", quality.all_reasons(checks).alias("failed"), quality.first_reason(checks).alias("reason"))
    served = F.max(F.when(F.size("failed") == 0, F.col("day"))).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return judged.select("day", F.array_join("failed", ",").alias("failed"), "reason", served.alias("served"))


@query(
    "publishable",
    f"""WITH r AS (SELECT source, {_CLAIMS} AS reason FROM ({_READINGS}))
    SELECT source, count(*) AS readings, count(*) FILTER (reason IS NULL) AS claims, CASE WHEN count(*) < 20 THEN 'few' WHEN count(*) FILTER (reason IS NULL) < 0.5 * count(*) THEN 'share' WHEN count(*) FILTER (reason = 'toxic') > 0 THEN 'toxic' END AS held FROM r GROUP BY 1""",
)
def publishable(spark, d):
    """Sources whose readings may be published: enough of them, half of them claims, none toxic; else the first reason that holds them back."""
    counted = _readings(spark, d).select("source", claim_reason().alias("reason")).groupBy("source").agg(F.count("*").alias("readings"), F.count_if(F.col("reason").isNull()).alias("claims"), F.count_if(F.col("reason") == "toxic").alias("toxic"))
    held = quality.first_reason([(F.col("readings") < 20, "few"), (F.col("claims") < 0.5 * F.col("readings"), "share"), (F.col("toxic") > 0, "toxic")])
    return counted.select("source", "readings", "claims", held.alias("held"))
