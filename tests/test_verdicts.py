from pyspark.sql import functions as F

from recordlens.functions import text as tx
from recordlens.operators import register as reg
from recordlens.operators import reports as rp
from recordlens.operators import verdicts as ver
from tests.helpers import as_list, ob, observations


def _parts(spark, rows):
    ev = reg.register_fold(observations(spark, rows))
    return ev, reg.register_current(ev)


def test_storm_names(spark):
    rows = spark.createDataFrame([("Tropical Cyclone DOLPHIN-26",), ("Dolphin (TS)",), ("Tropical Storm",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.storm_token(F.col("t"))).collect()] == ["DOLPHIN", "DOLPHIN", None, None]


def test_episode_length_and_escalation(spark):
    rows = [
        ob("a", "2026-08-08", frm="2026-07-27T00:00:00", to="2026-08-08T12:00:00"),
        ob("a", "2026-08-09", sev="Red", frm="2026-07-27T00:00:00", to="2026-08-08T12:00:00"),
        ob("a", "2026-08-10", sev="Orange", frm="2026-07-27T00:00:00", to="2026-08-08T12:00:00"),
        ob("z", "2026-08-08", 1), ob("z", "2026-08-11"),
    ]
    ev, cur = _parts(spark, rows)
    r = ver.verdicts(cur, ev).collect()
    assert [(x["id"], x["verdict"], x["episode_days"], x["escalated"], x["cold_start"]) for x in r] == [
        ("a", "EPISODE_ENDED", 12.5, True, True)
    ]
    assert r[0]["severity_path"] == ["Orange", "Red", "Orange"] and r[0]["revisions"] == 2


def test_forecast_that_became_an_alert(spark):
    rows = [
        ob("nhc-1", "2026-08-08", source="N", kind="FORECAST", hazard="tropical cyclone", what="Dolphin (TS)"),
        ob("nhc-2", "2026-08-08", 1, source="N", kind="FORECAST", hazard="tropical cyclone", what="Erin (TS)"),
        ob("nhc-3", "2026-08-09", source="N", kind="FORECAST", hazard="tropical cyclone", what="Fay (TS)"),
        ob("gdacs-tc-2", "2026-08-09", hazard="tropical cyclone", what="Tropical Cyclone DOLPHIN-26", frm="2026-08-10T00:00:00"),
        ob("gdacs-tc-1", "2026-08-09", 1, hazard="tropical cyclone", what="Tropical Cyclone DOLPHIN-26", frm="2026-08-10T00:00:00"),
        ob("gdacs-fl-1", "2026-08-09", 2, hazard="flood", what="Erin"),
    ]
    ev, cur = _parts(spark, rows)
    out = ver.verdicts(cur, ev)
    assert as_list(out, "id", "verdict", "matched", "lead_time_hours") == [
        ("nhc-1", "MATERIALIZED_AS_ALERT", "gdacs-tc-1", 48.0),
        ("nhc-2", "NO_ALERT_MATCH", None, None),
    ]
    assert out.filter("id = 'nhc-1'").collect()[0]["evidence"] == ["N/2026-08-08.json", "S/2026-08-09.json"]
    done = spark.createDataFrame([("nhc-1",)], "id string")
    assert as_list(ver.verdicts(cur, ev, done=done), "id") == [("nhc-2",)]


def test_moments_leave_out_the_founding_night(spark):
    rows = [
        ob("a", "2026-08-08"), ob("b", "2026-08-09", 1), ob("a", "2026-08-09"), ob("old", "2026-08-10", 2, to="2026-08-01T00:00:00"),
        ob("a", "2026-08-11", sev="Red"), ob("old", "2026-08-11", 1, to="2026-08-01T00:00:00"),
    ]
    ev, cur = _parts(spark, rows)
    cur = cur.join(reg.window_at_first_sight(ev), "id")
    got = rp.moments(ev, cur, ver.verdicts(cur, ev), first_night="2026-08-08")
    assert as_list(got, "id", "occurred_at", "mode", "span") == [
        ("a", "2026-08-10", "closure", None), ("a", "2026-08-11", "reappearance", None), ("a", "2026-08-11", "revision", "3 days"),
        ("b", "2026-08-09", "notarization", None), ("b", "2026-08-10", "closure", None), ("b", "2026-08-10", "resolution", None),
    ]
