import json

import pytest

from recordlens import jobs, sinks
from tests.helpers import as_list
from tests.test_wording import PAGE

BODY = "run_date string, snapshot string, doc int, body string"


def test_register_nights(spark, tmp_path):
    base = str(tmp_path / "register")

    def night(day, ids, status=200, previous=None):
        storms = json.dumps({"activeStorms": [{"id": i, "name": i, "intensity": s} for i, s in ids]})
        bodies = spark.createDataFrame([(day, f"nhc/{day}", 0, storms)] if status == 200 else [], BODY)
        fetches = spark.createDataFrame([("NHC", day, status, storms)], "source string, run_date string, http_status int, body string")
        jobs.register_night(spark, base, day, {"NHC": bodies}, fetches, previous)

    night("2026-08-08", [("a", "40"), ("b", "50")])
    night("2026-08-09", [], status=503, previous="2026-08-08")
    night("2026-08-10", [("a", "45")], previous="2026-08-09")
    with pytest.raises(sinks.AlreadyRecorded):
        night("2026-08-10", [], previous="2026-08-09")
    night("2026-08-11", [("a", "45"), ("b", "50")], previous="2026-08-10")
    events = spark.read.parquet(f"{base}/events")
    assert as_list(events, "run_date", "id", "event") == [
        ("2026-08-08", "nhc-a", "NOTARIZED"), ("2026-08-08", "nhc-b", "NOTARIZED"), ("2026-08-10", "nhc-a", "REVISED"),
        ("2026-08-10", "nhc-b", "DISSIPATED"), ("2026-08-11", "nhc-b", "REAPPEARED"),
    ]
    assert as_list(spark.read.parquet(f"{base}/verdicts"), "id", "verdict") == [("nhc-b", "NO_ALERT_MATCH")]


def test_wording_day(spark):
    day, old, new = "2026-08-14", "20260801120000", "20260814120000"
    rows, bodies = [], []
    for n in range(15):
        rows.append((f"same{n}", old, 0, "u", "200", "A"))
    for page in ("changed", "wall", "lost"):
        rows += [(page, old, 0, "u", "200", "A"), (page, new, 1, "u", "200", "B")]
    rows += [("gone", old, 0, "u", "200", "A"), ("gone", new, 1, "u", "404", "B"), ("alive", old, 0, "u", "200", "A"), ("alive", new, 1, "u", "403", "B")]
    html = lambda t: f"<html><body><p>{t}</p></body></html>"
    bodies += [("changed", old, html(PAGE)), ("changed", new, html(PAGE.replace("65 percent", "55 percent")))]
    bodies += [("wall", old, html(PAGE)), ("wall", new, html("Just a moment... Ray ID: 1"))]
    captures = spark.createDataFrame(rows, "page string, timestamp string, pos int, original string, statuscode string, digest string")
    pages = captures.select("page").distinct().selectExpr("page", "'A' AS category")
    texts = spark.createDataFrame(bodies, "page string, timestamp string, html string")
    live = spark.createDataFrame([("gone", 404), ("alive", 200)], "page string, http_code int")
    out = jobs.wording_night(pages, captures, texts, live, day)
    rates = out["rates"].collect()[0]
    assert (rates["unchanged"], rates["changed"], rates["unverifiable"], rates["gone"], rates["examined"]) == (15, 1, 3, 1, 20)
    assert as_list(out["reasons"], "reason", "n") == [
        ("deletion_candidate_survived_recheck_ok", 1), ("gate_after_challenge_fingerprint", 1), ("snapshot_unavailable", 1)
    ]
    assert as_list(out["events"], "page", "type") == [("changed", "number_revised")]
    assert (out["deletion"].collect()[0]["decided"], out["deletion"].collect()[0]["gone"]) == (2, 1)


def test_coverage_and_lookback(spark):
    from tests.test_coverage_drift import FIELDS, PAGE as CATALOGUE, POINTS, bodies

    out = jobs.coverage_night(bodies(spark, CATALOGUE), bodies(spark, POINTS))
    assert out["figures"].collect()[0]["cells_observed_silent"] == 5 and out["cells"].count() == 7
    seen = spark.createDataFrame([("a", "d1", 0, True, "e1", None, {}), ("b", "d1", 1, True, "e1", "m", {})], FIELDS)
    now = spark.createDataFrame([("a", "d2", 0, False, "e1", "m1", {})], FIELDS)
    none = spark.createDataFrame([], "id string, field string, value string, date string")
    got = jobs.lookback_night(seen, none, now, spark.createDataFrame([("a", True), ("b", True)], "id string, answered boolean"))
    assert as_list(got["catches"], "id", "kind") == [("a", "changed"), ("b", "gone_from_catalog")]
    assert as_list(got["baselines"], "id", "field", "value") == [("a", "modification_date", "m1")]
