"""Notices, codes and names over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import notices, text
from gristmill.plans.registry import query
from gristmill.session import table

_MARKS = "'''''''" + '""---' + "'"
_NORMAL = rf"trim(regexp_replace(regexp_replace(translate(lower(text), '‘’`“”–—−', {_MARKS}), '\s+', ' ', 'g'), ' ?- ?', '-', 'g'))"
RULES = {"question": r"wh(?:o|at|en|ere)\b", "answer": r"an(?:d|swer)\b", "article": r"th(?:e|at|is)\b"}
_ALL = "|".join(sorted(RULES.values(), key=len, reverse=True))
_KINDS = "list_transform(regexp_extract_all(lower(text), '(" + _ALL + ")', 1), lambda w: CASE " + " ".join(f"WHEN regexp_full_match(w, '{p.removesuffix(chr(92) + 'b')}') THEN '{n}'" for n, p in RULES.items()) + " END)"


@query("normal_lines", f"SELECT conv_id, turn, {_NORMAL} AS line FROM conversations")
def normal_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", notices.normal(F.col("text")).alias("line"))


@query("ordered_mentions", f"SELECT conv_id, turn, {_KINDS} AS kinds FROM conversations")
def ordered_mentions(spark, d):
    """The rules' mentions of each text, from left to right."""
    found = notices.mentions(F.lower("text"), RULES)
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(found, lambda m: m["kind"]).alias("kinds"))


@query(
    "revocations",
    f"""WITH k AS (SELECT conv_id, turn, {_KINDS} AS kinds FROM conversations)
    SELECT conv_id, turn, list_transform(list_filter(generate_series(1, len(kinds)), lambda i: kinds[i] <> 'answer' AND (i = len(kinds) OR kinds[i + 1] <> 'answer')), lambda i: kinds[i]) AS kinds FROM k""",
)
def revocations(spark, d):
    """Mentions that nothing just after them takes back."""
    kinds = F.transform(notices.mentions(F.lower("text"), RULES), lambda m: m["kind"])
    return table(spark, d, "conversations").select("conv_id", "turn", kinds.alias("kinds")).select("conv_id", "turn", notices.revoked(F.col("kinds"), "answer").alias("kinds"))


_CODES = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no code' ELSE 'x /O.' || CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' ELSE 'CAN' END || '.KABC.WS.' || CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'W' END || '.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
    || '.' || CASE WHEN o_orderkey % 5 = 0 THEN '000000T0000Z' ELSE strftime(o_orderdate + INTERVAL 3652 DAY, '%y%m%dT%H%MZ') END || '-' || strftime(o_orderdate + INTERVAL 3653 DAY, '%y%m%dT%H%MZ') || '/' END AS code FROM orders"""


@query(
    "event_codes",
    rf"""WITH c AS ({_CODES}), p AS (SELECT o_orderkey, regexp_extract(code, '/([OTEX])\.([A-Z]{{3}})\.([A-Z0-9]{{4}})\.([A-Z0-9]{{2}})\.([A-Z])\.(\d{{4}})\.(\d{{6}}T\d{{4}}Z)-(\d{{6}}T\d{{4}}Z)/', ['status', 'action', 'office', 'phenomena', 'significance', 'number', 'b', 'e']) AS p FROM c)
    SELECT o_orderkey, p.action, p.office, p.significance, CAST(p.number AS INTEGER) AS number, try_strptime('20' || p.b, '%Y%m%dT%H%MZ') AS begins, try_strptime('20' || p.e, '%Y%m%dT%H%MZ') AS ends FROM p WHERE p.action <> ''""",
)
def event_codes(spark, d):
    """Action, office, significance, number and times of the codes in made-up bulletins."""
    key = F.col("o_orderkey")

    def stamp(days):
        return F.date_format(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days)), "yyMMdd'T'HHmm'Z'")

    begins = F.when(key % 5 == 0, "000000T0000Z").otherwise(stamp(3652))
    code = F.concat(F.lit("x /O."), F.when(key % 2 == 0, "NEW").otherwise("CAN"), F.lit(".KABC.WS."), F.when(key % 3 == 0, "A").otherwise("W"), F.lit("."), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("."), begins, F.lit("-"), stamp(3653), F.lit("/"))
    parsed = table(spark, d, "orders").select("o_orderkey", notices.event_code(F.when(key % 7 == 0, "no code").otherwise(code)).alias("c")).where("c is not null")
    return parsed.select("o_orderkey", "c.action", "c.office", "c.significance", "c.number", F.col("c.begin").cast("timestamp_ntz").alias("begins"), F.col("c.end").cast("timestamp_ntz").alias("ends"))


@query(
    "zone_lists",
    """WITH c AS (SELECT n_nationkey, n_nationkey + 1 AS low, n_nationkey + 3 AS high FROM nation)
    SELECT n_nationkey, list_concat(list_transform(generate_series(low, high), lambda n: 'CTZ' || lpad(CAST(n AS VARCHAR), 3, '0')), ['CTZ050', 'NJC002']) AS codes FROM c""",
)
def zone_lists(spark, d):
    """Zone lists with ranges, carried letters and a closing time, spelled out."""
    key = F.col("n_nationkey")
    code = F.concat(F.lit("CTZ"), F.lpad((key + 1).cast("string"), 3, "0"), F.lit(">"), F.lpad((key + 3).cast("string"), 3, "0"), F.lit("-050-NJC002-281015-"))
    return table(spark, d, "nation").select("n_nationkey", text.expanded_zones(code).alias("codes"))


@query("county_keys", r"SELECT n_nationkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(n_name || ' County'), '[^a-z ]', '', 'g'), '\b(county|parish|borough)\b', '', 'g')), ' +', ' ', 'g') AS key FROM nation")
def county_keys(spark, d):
    return table(spark, d, "nation").select("n_nationkey", notices.county_key(F.concat("n_name", F.lit(" County"))).alias("key"))


@query("name_skeletons", r"WITH s AS (SELECT c_custkey, regexp_replace(translate(lower(c_name), '0134578@$!', 'oieastbasi'), '[^a-z]', '', 'g') AS s FROM customer) SELECT c_custkey, array_to_string(list_filter(list_transform(generate_series(1, len(s)), lambda i: CASE WHEN i = 1 OR s[i] <> s[i - 1] THEN s[i] ELSE '' END), lambda x: x <> ''), '') AS skeleton FROM s")
def name_skeletons(spark, d):
    return table(spark, d, "customer").select("c_custkey", notices.skeleton(F.col("c_name")).alias("skeleton"))


@query(
    "display_names",
    """WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' OF THE p.s. west'), ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ('of', 'the', 'and', 'at', 'for', 'in') THEN x WHEN x = 'p.s.' THEN 'P.S.' ELSE upper(x[1]) || x[2:] END), ' ') AS name FROM w""",
)
def display_names(spark, d):
    return table(spark, d, "part").select("p_partkey", notices.display_name(F.concat("p_name", F.lit(" OF THE p.s. west"))).alias("name"))


@query(
    "highlight_ranges",
    """WITH k AS (SELECT DISTINCT p_name, unnest(generate_series(1, len(p_name))) AS k FROM part), h AS (SELECT p_name, k, CASE WHEN substr(p_name, k, 2) = 'wi' THEN 2 WHEN substr(p_name, k, 1) = 'c' THEN 1 ELSE 0 END AS n FROM k WHERE k = 1 OR NOT regexp_matches(substr(p_name, k - 1, 1), '[a-z0-9]'))
    SELECT p_name, k - 1 AS start, k - 1 + n AS stop FROM h WHERE n > 0""",
)
def highlight_ranges(spark, d):
    """Where two asked words begin a word of a name."""
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.explode(notices.highlights(F.col("p_name"), ["wi", "c"])).alias("r")).select("p_name", F.col("r.start"), F.col("r.end").alias("stop"))


@query(
    "similar_names",
    """WITH t AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS a FROM part), b AS (SELECT *, ['blue', 'widgets'] AS b FROM t), s AS (SELECT p_name, len(list_filter(a, lambda x: len(list_filter(b, lambda y: levenshtein(x, y) <= 1)) > 0)) AS shared, len(a) + 2 AS whole FROM b)
    SELECT p_name, round(shared / (whole - shared)::DOUBLE, 6) AS score FROM s""",
)
def similar_names(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.round(text.name_similarity(F.col("p_name"), F.lit("blue widgets")), 6).alias("score"))
