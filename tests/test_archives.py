"""Readers of archives and feeds on small files: what stops a job, what is left out, open and missing times."""

import json
from datetime import date, datetime

import pytest

from gristmill.sources import archives

SEASON = dict(wfo="ABC", phenomena="WS", significance="W", eventid="7", vtec_year="2024", status="NEW", gtype="C", ugc="CTZ001", utc_issue="2024-01-01 10:00", utc_expire="2024-01-01 12:00", utc_prodissue="2024-01-01 08:00", product_id="", area2d="")


def season(spark, *changes):
    rows = [tuple({**SEASON, **c}[k] for k in archives.SEASON_COLUMNS) for c in changes]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in archives.SEASON_COLUMNS))
    return archives.season_rows(raw, ["CT"], ["WS.W"])


def test_a_season_leaves_out_outlines_and_other_states_and_counts_them(spark):
    rows = season(spark, {}, {}, {"gtype": "P", "ugc": ""}, {"ugc": "AKZ001"}, {"utc_expire": "2024-01-01 09:00"})
    assert sorted((r.left_out or "kept", r.ended_early) for r in rows.collect()) == [("kept", False), ("kept", False), ("kept", True), ("polygon", False), ("state", False)]
    kept = {r.left_out: r for r in archives.season_counts(rows).collect()}
    assert (kept["kept"].rows, kept["kept"].events, kept["kept"].ended_early, kept["kept"].longest_hours) == (3, 1, 1, 2.0)
    assert archives.season_counts(rows.limit(0)).count() == 0


@pytest.mark.parametrize("change", [{"ugc": "CTX001"}, {"ugc": None}, {"utc_issue": "soon"}, {"eventid": "7.5"}, {"phenomena": "XX"}, {"area2d": "-1"}, {"gtype": "Q"}, {"utc_expire": ""}])
def test_a_season_row_out_of_form_stops_the_job(spark, change):
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        season(spark, change).collect()


def test_snapshots_merge_the_rows_of_an_event(spark, tmp_path):
    row = dict(wfo="ABC", phenomena="WS", significance="W", eventid=7, year=2024, issue="2024-01-02T00:00:00Z", issue_product_id="202401011200-KABC-X", expire="2024-01-03T00:00:00Z", locations="A [CT], B [NY]")
    other = {**row, "issue": None, "issue_product_id": "none", "expire": None, "locations": None}
    bare = {**other, "eventid": 8}
    (tmp_path / "one.json").write_text(json.dumps({"data": [row, {**row, "locations": "C [CT]", "expire": "2024-01-04T00:00:00Z"}]}, indent=1))
    (tmp_path / "two.json").write_text(json.dumps({"data": [other, bare]}))
    (tmp_path / "none.json").write_text(json.dumps({"data": []}))
    found = {r.event: r for r in archives.snapshot_events(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["ABC.WS.W.0007.2024", "ABC.WS.W.0008.2024"]
    whole, empty = found["ABC.WS.W.0007.2024"], found["ABC.WS.W.0008.2024"]
    assert (whole.first, whole.last_expire, whole.states) == (datetime(2024, 1, 1, 12), datetime(2024, 1, 4), ["CT", "NY"])
    assert (empty.first, empty.last_expire, empty.states) == (None, None, [])


def test_releases_are_dated_by_their_names_and_zones_take_the_one_in_effect(spark, tmp_path):
    record = "CT|{}|BOX|Some Zone |{}|A county|{}|E|nw|1|2"
    (tmp_path / "bp05mr16.dbx").write_text("\n".join([record.format("001", "CT001", "09001"), "", record.format("001", "CT009", "09003")]))
    (tmp_path / "bp10oc19.dbx").write_text(record.format("001", "CT001", "09005"))
    releases = archives.zone_releases(spark, str(tmp_path))
    assert sorted((r.release, r.name, r.fips, r.agrees) for r in releases.collect()) == [(date(2016, 3, 5), "Some Zone", "09001", True), (date(2016, 3, 5), "Some Zone", "09003", False), (date(2019, 10, 10), "Some Zone", "09005", True)]
    asked = spark.createDataFrame([("CTZ001", date(2018, 1, 1)), ("CTZ001", date(2019, 10, 10)), ("CTZ001", date(2000, 1, 1)), ("CTZ002", date(2020, 1, 1)), (None, None)], "z string, d date")
    got = sorted(((r.z or "", r.d, r.fips, r.resolution) for r in archives.counties_in_effect(asked, releases, "z", "d").collect()), key=str)
    want = [("", None, None, "unmapped"), ("CTZ002", date(2020, 1, 1), None, "unmapped"), ("CTZ001", date(2019, 10, 10), "09005", "in_effect")]
    want += [("CTZ001", day, fips, said) for day, said in ((date(2018, 1, 1), "in_effect"), (date(2000, 1, 1), "before_first")) for fips in ("09001", "09003")]
    assert got == sorted(want, key=str)
    (tmp_path / "bad.dbx").write_text(record.format("001", "CT001", "09001"))
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        archives.zone_releases(spark, str(tmp_path)).collect()


def test_alerts_end_by_their_own_end_or_their_codes_and_may_be_open(spark, tmp_path):
    base = dict(id="a", event="Storm", status="Actual", messageType="Alert", severity="Severe", sent="2024-01-01T00:00:00-05:00", effective="2024-01-01T01:00:00+00:00")
    code = "/O.{}.KABC.WS.W.0001.240101T0000Z-{}/"
    cases = {
        "own": {"ends": "2024-01-02T00:00:00+00:00", "onset": "2024-01-01T02:00:00+00:00", "parameters": {"VTEC": [code.format("NEW", "240105T0000Z")]}},
        "code": {"parameters": {"VTEC": [code.format("NEW", "240103T0000Z"), code.format("CAN", "240104T0000Z")]}, "expires": "2024-01-01T03:00:00+00:00"},
        "open": {"parameters": {"VTEC": [code.format("NEW", "000000T0000Z")]}},
        "gone": {"parameters": {"VTEC": [code.format("CAN", "240103T0000Z"), code.format("UPG", "240103T0000Z")]}},
        "test": {"status": "Test"},
        "bare": {"affectedZones": ["https://x/zones/county/CTC001", "https://x/zones/what"], "geocode": {"UGC": ["CTC001"]}},
    }
    features = [{"type": "Feature", "geometry": None, "properties": {**base, **more, "id": name}} for name, more in cases.items()]
    (tmp_path / "feed.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    found = {r.id: r for r in archives.alerts(spark, str(tmp_path)).collect()}
    assert {k: r.until for k, r in found.items()} == {"own": datetime(2024, 1, 2), "code": datetime(2024, 1, 4), "open": None, "gone": datetime(2024, 1, 3), "test": None, "bare": None}
    assert {k for k, r in found.items() if not r.stands} == {"gone", "test"}
    assert (found["own"].begins, found["code"].begins, found["own"].sent) == (datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 5))
    assert (found["bare"].zones, found["bare"].ugc, found["own"].zones) == (["CTC001"], ["CTC001"], [])
    groups, zones = archives.grouped_alerts(archives.alerts(spark, str(tmp_path)))
    assert sorted((r.first_id, r.alerts) for r in groups.collect()) == [("bare", 3), ("code", 1), ("gone", 1), ("own", 1)]
    assert [r.zone for r in zones.collect()] == ["CTC001"]
