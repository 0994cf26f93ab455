"""Archives of weather events and feeds of alerts: files of a fixed form, read strictly.

A row that is out of form stops the job with its value, so nothing is lost
unseen; a row that is in form but not wanted comes out with ``left_out``, the
reason, and is counted by an ordinary aggregate.  Nulls and empty fields are
out of form where a field is demanded, and null where it may be missing.
Empty files give no rows.  Repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.notices import event_codes

#: The columns of a season's file and of a day's file, as the archive writes them.
SEASON_COLUMNS = ["wfo", "phenomena", "significance", "eventid", "vtec_year", "status", "gtype", "ugc", "utc_issue", "utc_expire", "utc_prodissue", "product_id", "area2d"]
DAY_COLUMNS = ["WFO", "PHENOM", "SIG", "ETN", "VTEC_YR", "STATUS", "GTYPE", "NWS_UGC", "ISSUED", "EXPIRED", "POLY_BEG", "POLY_END", "PROD_ID"]
#: The fields of a correlation file, and the months of its name.
ZONE_COLUMNS = ["state", "zone", "cwa", "name", "state_zone", "county", "fips", "time_zone", "area", "lat", "lon"]
MONTHS = ["ja", "fe", "mr", "ap", "my", "jn", "jl", "au", "se", "oc", "nv", "de"]
#: The forms of times, product ids, zones and places.
STAMP, SECONDS = "yyyyMMddHHmm", "yyyy-MM-dd HH:mm"
ZONE_URL = r"/zones/(?:forecast|county|fire)/([A-Z]{2}[CZ]\d{3})$"

SNAPSHOT = "data array<struct<wfo: string, phenomena: string, significance: string, eventid: int, year: int, issue: string, issue_product_id: string, expire: string, locations: string>>"
ALERTS = """type string, updated string, features array<struct<geometry: string, properties: struct<id: string, event: string, status: string, messageType: string, severity: string, sent: string,
    effective: string, onset: string, expires: string, ends: string, headline: string, description: string, affectedZones: array<string>, geocode: struct<UGC: array<string>>, parameters: struct<VTEC: array<string>, NWSheadline: array<string>>>>>"""


def demanded(value: Column, good: Column, what: str, source: Column | None = None) -> Column:
    """``value`` where ``good`` holds; elsewhere the job stops and names ``what`` and the text of ``source``."""
    said = F.coalesce((value if source is None else source).cast("string"), F.lit("nothing"))
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), said)))


def instant(text: Column, form: str, what: str, may_miss: bool = False) -> Column:
    """A time in UTC; an empty one is null where it may be missing, and any other text stops the job."""
    read = F.try_to_timestamp(text, F.lit(form))
    good = demanded(read, read.isNotNull(), what, text)
    return F.when(F.coalesce(text, F.lit("")) != "", good) if may_miss else good


def whole(text: Column, what: str) -> Column:
    return demanded(text.try_cast("int"), text.rlike(r"^\d+$"), what, text)


def event_key(office: Column, code: Column, number: Column, year: Column) -> Column:
    return F.concat_ws(".", office, code, F.format_string("%04d", number), year.cast("string"))


def product_time(product: Column) -> Column:
    """The time at the head of a product's id; null where it has none."""
    return F.try_to_timestamp(F.regexp_extract(product, r"^(\d{12})-", 1), F.lit(STAMP))


def season_rows(raw: DataFrame, states: list[str], codes: list[str]) -> DataFrame:
    """Rows of a season's file (text columns ``SEASON_COLUMNS``): event, code, ugc, begins, ends, issued, area, ended_early, left_out.

    ``left_out`` is polygon for a storm's outline, whose counties come as rows
    of their own, state for a place outside ``states``, else null.  A code that
    was not asked for, and a place that is no county or zone, stop the job.
    """
    code = F.concat_ws(".", "phenomena", "significance")
    outline = F.col("gtype") == "P"
    place = demanded(F.col("ugc"), (F.col("gtype") == "C") & F.col("ugc").rlike(r"^[A-Z]{2}[CZ]\d{3}$"), "place")
    area = F.col("area2d").try_cast("double")
    left_out = F.when(outline, "polygon").when(~F.substring("ugc", 1, 2).isin(states), "state")
    out = raw.select(
        event_key(F.col("wfo"), code, whole(F.col("eventid"), "eventid"), whole(F.col("vtec_year"), "vtec_year")).alias("event"),
        demanded(code, code.isin(codes), "code").alias("code"),
        F.when(~outline, place).alias("ugc"),
        instant(F.col("utc_issue"), SECONDS, "utc_issue").alias("begins"),
        instant(F.col("utc_expire"), SECONDS, "utc_expire").alias("ends"),
        instant(F.col("utc_prodissue"), SECONDS, "utc_prodissue").alias("issued"),
        F.when(F.coalesce(F.col("area2d"), F.lit("")) != "", demanded(area, area > 0, "area2d", F.col("area2d"))).alias("area"),
        left_out.alias("left_out"),
    )
    return out.withColumn("ended_early", F.col("ends") <= F.col("begins"))


def season_counts(rows: DataFrame) -> DataFrame:
    """(code, left_out, rows, events, ended_early, longest_hours): what a season's rows hold and what they leave out."""
    hours = (F.unix_timestamp("ends") - F.unix_timestamp("begins")) / 3600.0
    return rows.groupBy("code", F.coalesce("left_out", F.lit("kept")).alias("left_out")).agg(
        F.count("*").alias("rows"), F.count_distinct("event").alias("events"), F.count_if("ended_early").alias("ended_early"), F.max(hours).alias("longest_hours")
    )


def day_rows(raw: DataFrame) -> DataFrame:
    """Rows of a day's file (text columns ``DAY_COLUMNS``): event, code, status, gtype, ugc, issued, expired, polygon_begin, polygon_end, product.

    An outline has no place and every other row has one, or the job stops.
    """
    code = F.concat_ws(".", "PHENOM", "SIG")
    place = F.when(F.coalesce(F.col("NWS_UGC"), F.lit("")) != "", F.col("NWS_UGC"))
    fits = F.col("GTYPE").isin("P", "C") & ((F.col("GTYPE") == "C") == place.isNotNull())
    return raw.select(
        event_key(F.col("WFO"), code, whole(F.col("ETN"), "ETN"), whole(F.col("VTEC_YR"), "VTEC_YR")).alias("event"),
        code.alias("code"),
        F.col("STATUS").alias("status"),
        demanded(F.col("GTYPE"), fits, "gtype").alias("gtype"),
        place.alias("ugc"),
        instant(F.col("ISSUED"), STAMP, "ISSUED", True).alias("issued"),
        instant(F.col("EXPIRED"), STAMP, "EXPIRED", True).alias("expired"),
        instant(F.col("POLY_BEG"), STAMP, "POLY_BEG", True).alias("polygon_begin"),
        instant(F.col("POLY_END"), STAMP, "POLY_END", True).alias("polygon_end"),
        F.col("PROD_ID").alias("product"),
    )


def outline_rows(days: DataFrame, codes: list[str]) -> DataFrame:
    """Outlines of ``day_rows``: event, code, begins, ends, issued, ended_early; a code not asked for stops the job.

    An outline holds while both it and its event do; an event without times
    holds as long as the outline.  It is issued at the time in its product's
    id, or else when it begins.
    """
    begin = demanded(F.col("polygon_begin"), F.col("polygon_begin").isNotNull(), "POLY_BEG")
    end = demanded(F.col("polygon_end"), F.col("polygon_end").isNotNull(), "POLY_END")
    out = days.where(F.col("gtype") == "P").select(
        "event",
        demanded(F.col("code"), F.col("code").isin(codes), "code").alias("code"),
        F.greatest(begin, "issued").alias("begins"),
        F.least(end, "expired").alias("ends"),
        F.coalesce(product_time(F.col("product")), begin).alias("issued"),
    )
    return out.withColumn("ended_early", F.col("ends") <= F.col("begins"))


def carried(days: DataFrame, ranges: DataFrame, key: str = "event") -> DataFrame:
    """Rows of the day files, but for events of which a range file holds the rows: those are the range file's."""
    return days.join(ranges.select(key).distinct(), key, "left_anti").select(days.columns).unionByName(ranges.select(days.columns))


def snapshot_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(event, first, last_expire, states): one row for each event that the snapshots under ``path`` list, one a file or one a line.

    ``first`` is the earliest of its issues and product times, ``states`` the
    states that its places name, in order.
    """
    rows = spark.read.schema(SNAPSHOT).options(multiLine=not lines, mode="FAILFAST").json(path).select(F.explode("data").alias("r")).select("r.*")
    code = F.concat_ws(".", "phenomena", "significance")
    parts = rows.select(
        event_key(F.col("wfo"), code, demanded(F.col("eventid"), F.col("eventid").isNotNull(), "eventid"), demanded(F.col("year"), F.col("year").isNotNull(), "year")).alias("event"),
        F.least(F.to_timestamp("issue"), product_time(F.col("issue_product_id"))).alias("first"),
        F.to_timestamp("expire").alias("expire"),
        F.regexp_extract_all("locations", F.lit(r"\[([A-Z]{2})\]"), F.lit(1)).alias("states"),
    )
    whole_row = parts.groupBy("event").agg(F.min("first").alias("first"), F.max("expire").alias("last_expire"))
    states = parts.select("event", F.explode("states").alias("state")).groupBy("event").agg(F.array_sort(F.collect_set("state")).alias("states"))
    return whole_row.join(states, "event", "left").withColumn("states", F.coalesce("states", F.array().cast("array<string>")))


def zone_releases(spark: SparkSession, path: str) -> DataFrame:
    """(release, ugc, name, cwa, county, fips, time_zone, agrees): records of the correlation files under ``path``.

    The day of a release is in the name of its file or folder, ``bpDDmmYY``; another name, a
    record without eleven fields and a code out of form stop the job.
    ``agrees`` tells whether the record repeats its state and zone rightly.
    """
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"[/=](bp\d{2}[a-z]{2}\d{2})[./]", 1).alias("file")).where(F.trim("value") != "")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring("file", 5, 2))
    day = F.try_to_date(F.concat(F.lit("20"), F.substring("file", 7, 2), F.format_string("-%02d-", month), F.substring("file", 3, 2)))
    fields = F.split("value", r"\|", -1)
    record = lines.select(demanded(day, day.isNotNull(), "release", F.col("file")).alias("release"), demanded(fields, F.size(fields) == len(ZONE_COLUMNS), "record", F.col("value")).alias("f"))
    field = {name: F.col("f")[k] for k, name in enumerate(ZONE_COLUMNS)}
    ugc = F.concat(field["state"], F.lit("Z"), field["zone"])
    return record.select(
        "release",
        demanded(ugc, ugc.rlike(r"^[A-Z]{2}Z\d{3}$"), "zone").alias("ugc"),
        F.trim(field["name"]).alias("name"),
        field["cwa"].alias("cwa"),
        field["county"].alias("county"),
        demanded(field["fips"], field["fips"].rlike(r"^\d{5}$"), "fips").alias("fips"),
        field["time_zone"].alias("time_zone"),
        (field["state_zone"] == F.concat(field["state"], field["zone"])).alias("agrees"),
    )


def counties_in_effect(asked: DataFrame, releases: DataFrame, ugc: str, day: str) -> DataFrame:
    """``asked`` with ``fips`` and ``resolution``, a row for each county of the zone by the release in effect on ``day``.

    That is the zone's latest release until then (in_effect), or its first one
    where all are later (before_first); a zone in no release comes once, with
    no county (unmapped).  Releases are few, so their days by zone are an array
    of known length in a small table; the rows join on zone and release.
    """
    days = releases.groupBy(F.col("ugc").alias("_zone")).agg(F.array_sort(F.collect_set("release")).alias("_days"))
    until = F.filter("_days", lambda r: r <= F.col(day))
    found = asked.join(days, asked[ugc] == days["_zone"], "left").withColumn("_release", F.coalesce(F.try_element_at(until, F.lit(-1)), F.try_element_at("_days", F.lit(1))))
    named = F.when(F.col("_days").isNull(), "unmapped").when(F.col("_release") <= F.col(day), "in_effect").otherwise("before_first")
    counties = releases.select(F.col("ugc").alias("_ugc"), F.col("release").alias("_day"), "fips").distinct()
    joined = found.join(counties, (found["_zone"] == counties["_ugc"]) & (found["_release"] == counties["_day"]), "left")
    return joined.select(*[asked[c] for c in asked.columns], "fips", named.alias("resolution"))


def alerts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Alerts of the collections under ``path``, one a file or one a line: their texts, zones, codes, and the span that they hold for.

    ``begins`` is the onset, or else the effective time.  ``until`` is ``ends``,
    or else the latest end that an event code names; null is open.  ``expires``
    says when the message does, and ends nothing.  ``stands`` holds for actual
    alerts and updates that are not wholly cancelled or upgraded.  An alert
    without id, event or sent time stops the job.
    """
    props = spark.read.schema(ALERTS).options(multiLine=not lines, mode="FAILFAST").json(path).select(F.explode("features").alias("f")).select("f.geometry", "f.properties.*")
    codes = event_codes(F.array_join(F.col("parameters.VTEC"), " "))
    read = props.withColumn("codes", F.coalesce(codes, F.array()))
    zones = F.transform(F.filter("affectedZones", lambda u: u.rlike(ZONE_URL)), lambda u: F.regexp_extract(u, ZONE_URL, 1))
    undone = (F.size("codes") > 0) & F.forall("codes", lambda c: c["action"].isin("CAN", "UPG"))
    return read.select(
        demanded(F.col("id"), F.col("id").isNotNull(), "alert").alias("id"),
        demanded(F.col("event"), F.col("event").isNotNull(), "event").alias("event"),
        "severity",
        instant(F.col("sent"), "yyyy-MM-dd'T'HH:mm:ssXXX", "sent").alias("sent"),
        F.coalesce(F.to_timestamp("onset"), F.to_timestamp("effective")).alias("begins"),
        F.coalesce(F.to_timestamp("ends"), F.array_max(F.transform("codes", lambda c: c["end"]))).alias("until"),
        F.coalesce(zones, F.array().cast("array<string>")).alias("zones"),
        F.coalesce("geocode.UGC", F.array().cast("array<string>")).alias("ugc"),
        "codes",
        "geometry",
        "headline",
        "description",
        ((F.col("status") == "Actual") & F.col("messageType").isin("Alert", "Update") & ~undone).alias("stands"),
    )


def grouped_alerts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts drawn as one: groups of one event, severity, begin and end (first_id, alerts), and the zones of each, one row a zone.

    Zones are rows and no list, so a group of any size stays spread out.
    """
    key = ["event", "severity", "begins", "until"]
    groups = found.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("alerts"))
    return groups, found.select(*key, F.explode("ugc").alias("zone")).distinct()
