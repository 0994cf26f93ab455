"""Archives and feeds: orders written in the archive's forms, and read back by its rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.plans.feeds import _folder
from gristmill.plans.registry import query
from gristmill.session import table
from gristmill.sources import archives, files

STATES, CODES = ["CT", "NJ"], ["BZ.W", "WS.W", "WW.Y"]

#: An order as an event of the archive, in SQL.
_EVENT = """SELECT o_orderkey, o_custkey, o_orderstatus AS st, 'KAB' AS wfo, CASE o_orderpriority WHEN '1-URGENT' THEN 'BZ' WHEN '2-HIGH' THEN 'WS' ELSE 'WW' END AS ph, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'W' ELSE 'Y' END AS sig, o_custkey % 10000 AS etn, year(o_orderdate) AS yr,
    CASE o_custkey % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'NJ' WHEN 2 THEN 'AK' ELSE 'PR' END || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'Z' END || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS place, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7305 DAY + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS b, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7305 DAY + to_hours(CAST(o_orderkey % 24 + o_orderkey % 7 - 1 AS INTEGER)) AS e FROM orders"""
_KEYED = f"SELECT *, ph || '.' || sig AS code, wfo || '.' || ph || '.' || sig || '.' || lpad(CAST(etn AS VARCHAR), 4, '0') || '.' || CAST(yr AS VARCHAR) AS event FROM ({_EVENT})"
_SEASON = f"""SELECT event, code, CASE WHEN st <> 'P' THEN place END AS ugc, b AS begins, e AS ends, e <= b AS ended_early, CASE WHEN st = 'P' THEN 'polygon' WHEN place[1:2] NOT IN ('CT', 'NJ') THEN 'state' END AS left_out FROM ({_KEYED})"""
_DAYS = f"SELECT event, code, CASE WHEN st = 'P' THEN 'P' ELSE 'C' END AS gtype, CASE WHEN st <> 'P' THEN place END AS ugc, b AS issued, CASE WHEN o_orderkey % 5 > 0 THEN e END AS expired FROM ({_KEYED})"
_LATER = f"SELECT event, code, CASE WHEN st = 'P' THEN 'P' ELSE 'C' END AS gtype, CASE WHEN st <> 'P' THEN place END AS ugc, b AS issued, e + INTERVAL 1 DAY AS expired FROM ({_KEYED}) WHERE etn % 3 = 0"


def _events(spark, d):
    """Each order as an event, twenty years on, since codes have years of two digits: the columns of ``_EVENT``."""
    key, customer, urgency = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    state = F.when(customer % 4 == 0, "CT").when(customer % 4 == 1, "NJ").when(customer % 4 == 2, "AK").otherwise("PR")
    begin = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(7305), (key % 24).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("st"), F.lit("KAB").alias("wfo"),
        F.when(urgency == "1-URGENT", "BZ").when(urgency == "2-HIGH", "WS").otherwise("WW").alias("ph"),
        F.when(urgency.isin("1-URGENT", "2-HIGH"), "W").otherwise("Y").alias("sig"),
        (customer % 10000).alias("etn"), F.year("o_orderdate").alias("yr"),
        F.concat(state, F.when(key % 2 == 0, "C").otherwise("Z"), F.lpad((customer % 1000).cast("string"), 3, "0")).alias("place"),
        begin.alias("b"), (begin + F.make_dt_interval(hours=(key % 7 - 1).cast("int"))).alias("e"),
    )


def _plain(df, *times):
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


def _season(spark, d):
    path = _folder(spark, "season")
    said = lambda t: F.date_format(t, archives.SECONDS)
    ugc = F.when(F.col("st") != "P", F.col("place")).otherwise("")
    files.write_delimited(
        _events(spark, d).select(
            "wfo", F.col("ph").alias("phenomena"), F.col("sig").alias("significance"), F.col("etn").cast("string").alias("eventid"), F.col("yr").cast("string").alias("vtec_year"), F.lit("NEW").alias("status"),
            F.when(F.col("st") == "P", "P").otherwise("C").alias("gtype"), ugc.alias("ugc"), said("b").alias("utc_issue"), said("e").alias("utc_expire"), said("b").alias("utc_prodissue"), F.lit("").alias("product_id"), F.lit("12.5").alias("area2d"),
        ), path, ",",
    )
    return archives.season_rows(files.delimited(spark, path, archives.SEASON_COLUMNS, ","), STATES, CODES)


def _days(spark, d, events):
    path = _folder(spark, "days")
    said = lambda t: F.date_format(t, archives.STAMP)
    outline = F.col("st") == "P"
    files.write_delimited(
        events.select(
            F.col("wfo").alias("WFO"), F.col("ph").alias("PHENOM"), F.col("sig").alias("SIG"), F.col("etn").cast("string").alias("ETN"), F.col("yr").cast("string").alias("VTEC_YR"), F.lit("NEW").alias("STATUS"),
            F.when(outline, "P").otherwise("C").alias("GTYPE"), F.when(~outline, F.col("place")).otherwise("").alias("NWS_UGC"), said("b").alias("ISSUED"), F.coalesce(said("expired"), F.lit("")).alias("EXPIRED"),
            F.when(outline, said(F.col("b") + F.expr("interval 1 hour"))).otherwise("").alias("POLY_BEG"), F.when(outline, said(F.col("b") + F.expr("interval 4 hours"))).otherwise("").alias("POLY_END"),
            F.when(F.col("o_orderkey") % 2 == 0, F.concat(said(F.col("b") - F.expr("interval 2 hours")), F.lit("-KAB-X"))).otherwise("none").alias("PROD_ID"),
        ), path, ",",
    )
    return archives.day_rows(files.delimited(spark, path, archives.DAY_COLUMNS, ","))


def _open_ended(events):
    return events.withColumn("expired", F.when(F.col("o_orderkey") % 5 > 0, F.col("e")))


@query("season_archive", _SEASON)
def season_archive(spark, d):
    """Every row of a season's file with the reason for which it is left out."""
    return _plain(_season(spark, d).drop("issued", "area"), "begins", "ends")


@query("season_counts", f"SELECT code, coalesce(left_out, 'kept') AS left_out, count(*) AS rows, count(DISTINCT event) AS events, count(*) FILTER (ended_early) AS ended_early, max(epoch(ends) - epoch(begins)) / 3600.0 AS longest_hours FROM ({_SEASON}) GROUP BY 1, 2")
def season_counts(spark, d):
    return archives.season_counts(_season(spark, d))


@query("day_archive", _DAYS)
def day_archive(spark, d):
    rows = _days(spark, d, _open_ended(_events(spark, d)))
    return _plain(rows.select("event", "code", "gtype", "ugc", "issued", "expired"), "issued", "expired")


@query(
    "storm_outlines",
    f"""SELECT event, code, b + INTERVAL 1 HOUR AS begins, least(b + INTERVAL 4 HOUR, CASE WHEN o_orderkey % 5 > 0 THEN e END) AS ends, CASE WHEN o_orderkey % 2 = 0 THEN b - INTERVAL 2 HOUR ELSE b + INTERVAL 1 HOUR END AS issued,
    least(b + INTERVAL 4 HOUR, CASE WHEN o_orderkey % 5 > 0 THEN e END) <= b + INTERVAL 1 HOUR AS ended_early FROM ({_KEYED}) WHERE st = 'P'""",
)
def storm_outlines(spark, d):
    """Outlines while both they and their events hold."""
    return _plain(archives.outline_rows(_days(spark, d, _open_ended(_events(spark, d))), CODES), "begins", "ends", "issued")


@query("carried_events", f"WITH r AS ({_LATER}) SELECT * FROM ({_DAYS}) d WHERE NOT EXISTS (FROM r WHERE r.event = d.event) UNION ALL FROM r")
def carried_events(spark, d):
    """Rows of the day files, but for events that a range file holds, whose rows are the range's."""
    events = _events(spark, d)
    ranges = _days(spark, d, events.where("etn % 3 = 0").withColumn("expired", F.col("e") + F.expr("interval 1 day")))
    rows = archives.carried(_days(spark, d, _open_ended(events)), ranges)
    return _plain(rows.select("event", "code", "gtype", "ugc", "issued", "expired"), "issued", "expired")


@query(
    "archive_snapshot",
    f"""SELECT event, min(least(CASE WHEN o_orderkey % 3 > 0 THEN b END, CASE WHEN o_orderkey % 2 = 0 THEN b - INTERVAL 2 HOUR END)) AS first, max(e) AS last_expire, list_sort(list_distinct(list(place[1:2]))) AS states FROM ({_KEYED}) GROUP BY 1""",
)
def archive_snapshot(spark, d):
    """Events that snapshots list, one snapshot a day, each event once."""
    path = _folder(spark, "snapshots")
    said = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.struct(
        "wfo", F.col("ph").alias("phenomena"), F.col("sig").alias("significance"), F.col("etn").alias("eventid"), F.col("yr").alias("year"), F.when(F.col("o_orderkey") % 3 > 0, said("b")).alias("issue"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format(F.col("b") - F.expr("interval 2 hours"), archives.STAMP), F.lit("-KAB-X"))).alias("issue_product_id"), said("e").alias("expire"), F.concat(F.lit("Some ["), F.substring("place", 1, 2), F.lit("]")).alias("locations"),
    )
    day = _events(spark, d).groupBy(F.to_date("b"), (F.col("o_orderkey") / 1024).cast("long")).agg(F.collect_list(row).alias("data"))
    day.select(F.to_json(F.struct("data"))).write.text(path)
    return _plain(archives.snapshot_events(spark, path, lines=True), "first", "last_expire")


_RELEASES = """SELECT DATE '2016-03-05' AS release, s_suppkey, s_nationkey FROM supplier UNION ALL SELECT DATE '2019-10-10', s_suppkey + 1, s_nationkey FROM supplier WHERE s_suppkey % 3 > 0"""
_ZONES = f"SELECT release, chr(CAST(65 + s_nationkey AS INTEGER)) || chr(CAST(65 + (s_suppkey // 1000) % 26 AS INTEGER)) || 'Z' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS ugc, lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS fips FROM ({_RELEASES})"
_ASKED = "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7305 AS day, chr(CAST(65 + o_custkey % 25 AS INTEGER)) || chr(CAST(65 + (o_custkey // 1000) % 26 AS INTEGER)) || 'Z' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS ugc FROM orders"


@query(
    "zones_in_effect",
    f"""WITH z AS (SELECT DISTINCT * FROM ({_ZONES})), a AS ({_ASKED}), r AS (SELECT a.*, max(z.release) FILTER (z.release <= a.day) AS past, min(z.release) AS first FROM a LEFT JOIN z USING (ugc) GROUP BY 1, 2, 3)
    SELECT r.o_orderkey, CAST(r.day AS VARCHAR) AS day, r.ugc, z.fips, CASE WHEN first IS NULL THEN 'unmapped' WHEN past IS NULL THEN 'before_first' ELSE 'in_effect' END AS resolution FROM r LEFT JOIN z ON r.ugc = z.ugc AND z.release = coalesce(past, first)""",
)
def zones_in_effect(spark, d):
    """The counties of an order's zone by the release that was in effect on its day."""
    path, supplier = _folder(spark, "zones"), table(spark, d, "supplier")

    def letters(number, key):
        return F.concat(F.chr((number + 65).cast("int")), F.chr((F.floor(key / 1000) % 26 + 65).cast("int")))

    records = supplier.select("s_suppkey", "s_nationkey", F.lit("bp05mr16").alias("release")).union(supplier.where("s_suppkey % 3 > 0").select(F.col("s_suppkey") + 1, "s_nationkey", F.lit("bp10oc19")))
    key, zone = F.col("s_suppkey"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")
    state = letters(F.col("s_nationkey"), key)
    line = F.concat_ws("|", state, zone, F.lit("KAB"), F.lit(" a zone "), F.concat(state, zone), F.lit("a county"), F.lpad((key % 100000).cast("string"), 5, "0"), F.lit("E"), F.lit(""), F.lit("1"), F.lit("2"))
    records.select(line.alias("value"), "release").repartition("release").write.partitionBy("release").text(path)
    asked = table(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 7305).alias("day"), F.concat(letters(F.col("o_custkey") % 25, F.col("o_custkey")), F.lit("Z"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")).alias("ugc"))
    return archives.counties_in_effect(asked, archives.zone_releases(spark, path), "ugc", "day").withColumn("day", F.col("day").cast("string"))


#: An order as an alert: an onset for two of three, an end of its own for half, else its code's end, which every fifth leaves open.
_ALERT = f"""SELECT 'a' || CAST(o_orderkey AS VARCHAR) AS id, code AS event, CASE WHEN sig = 'W' THEN 'Severe' ELSE 'Minor' END AS severity, date_trunc('day', CASE WHEN o_orderkey % 3 > 0 THEN b ELSE b - INTERVAL 1 DAY END) AS begins,
    date_trunc('day', CASE WHEN o_orderkey % 2 = 0 THEN e + INTERVAL 1 DAY WHEN o_orderkey % 5 > 0 THEN e + INTERVAL 2 DAY END) AS until, place AS zone, st <> 'F' AND o_orderkey % 7 > 0 AS stands FROM ({_KEYED})"""


def _alerts(spark, d):
    path = _folder(spark, "alerts")
    day = lambda t: F.date_trunc("day", t)
    said = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")
    coded = lambda t: F.date_format(t, "yyMMdd'T'HHmm'Z'")
    key, more = F.col("o_orderkey"), F.expr("interval 1 day")
    end = F.when(key % 5 > 0, coded(day(F.col("e") + more + more))).otherwise("000000T0000Z")
    number = F.lpad(F.col("etn").cast("string"), 4, "0")
    code = F.concat(F.lit("/O."), F.when(key % 7 == 0, "CAN").otherwise("NEW"), F.lit(".KABC."), "ph", F.lit("."), "sig", F.lit("."), number, F.lit("."), coded(day("b")), F.lit("-"), end, F.lit("/"))
    props = F.struct(
        F.concat(F.lit("a"), key.cast("string")).alias("id"), F.concat_ws(".", "ph", "sig").alias("event"), F.when(F.col("st") == "F", "Test").otherwise("Actual").alias("status"), F.lit("Alert").alias("messageType"),
        F.when(F.col("sig") == "W", "Severe").otherwise("Minor").alias("severity"), said("b").alias("sent"), said(day(F.col("b") - more)).alias("effective"), F.when(key % 3 > 0, said(day("b"))).alias("onset"),
        F.when(key % 2 == 0, said(day(F.col("e") + more))).alias("ends"), F.array(F.concat(F.lit("https://x/zones/forecast/"), "place"), F.lit("https://x/zones/other")).alias("affectedZones"), F.struct(F.array("place").alias("UGC")).alias("geocode"), F.struct(F.array(code).alias("VTEC")).alias("parameters"),
    )
    feeds = _events(spark, d).groupBy(F.to_date("b"), (key / 1024).cast("long")).agg(F.collect_list(F.struct(F.lit("Feature").alias("type"), props.alias("properties"))).alias("features"))
    feeds.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))).write.text(path)
    return archives.alerts(spark, path, lines=True)


@query("alert_feed", _ALERT)
def alert_feed(spark, d):
    """Alerts of many collections with the spans they hold for, and whether they stand."""
    return _plain(_alerts(spark, d).select("id", "event", "severity", "begins", "until", F.get("zones", F.lit(0)).alias("zone"), "stands"), "begins", "until")


@query("alert_groups", f"SELECT event, severity, begins, until, min(id) AS first_id, count(*) AS alerts, count(DISTINCT zone) AS zones FROM ({_ALERT}) WHERE stands GROUP BY 1, 2, 3, 4")
def alert_groups(spark, d):
    """Standing alerts of one event, severity and span as one, with how many zones they reach."""
    groups, zones = archives.grouped_alerts(_alerts(spark, d).where("stands"))
    key = ["event", "severity", "begins", "until"]
    reached = zones.groupBy(*key).agg(F.count("*").alias("zones"))
    same = groups["begins"].eqNullSafe(reached["begins"]) & groups["until"].eqNullSafe(reached["until"]) & (groups["event"] == reached["event"]) & (groups["severity"] == reached["severity"])
    return _plain(groups.join(reached, same).select(*[groups[k] for k in key], "first_id", "alerts", "zones"), "begins", "until")
