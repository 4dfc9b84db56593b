import random
import statistics

import pytest

from recordlens.operators import reaction as rx
from recordlens.sources import finance
from tests.helpers import as_list

BODY = "run_date string, snapshot string, doc int, body string"


def bodies(spark, *docs):
    return spark.createDataFrame([("2026-08-08", "s", n, d) for n, d in enumerate(docs)], BODY)


PLANS = """{"data": [{"id": 1516, "revisedRequirements": 900, "origRequirements": 800, "planVersion": {"name": "Somalia 2026"},
 "locations": [{"iso3": "SOM"}, {"iso3": "KEN"}]}, {"id": 1520, "revisedRequirements": 0, "origRequirements": 500,
 "planVersion": {"name": "Yemen 2026"}, "locations": [{"iso3": "YEM"}]}, {"origRequirements": 1}]}"""
FUNDING = """{"data": {"report3": {"fundingTotals": {"objects": [{"singleFundingObjects": [
 {"name": "Not specified", "totalFunding": 42}, {"id": 1516, "totalFunding": 300}, {"id": 1520, "totalFunding": 7},
 {"id": 1520, "totalFunding": 100}]}]}}}}"""


def export_line(country, mentions, articles):
    cols = [""] * 58
    cols[31], cols[33], cols[51] = str(mentions), str(articles), country
    return "\t".join(cols)


def test_export_lines_to_daily_volume(spark):
    lines = [export_line("SO", 3, 2), export_line("SO", 1, 1), export_line("KE", 5, 4), export_line("", 9, 7), "too\tshort", export_line("SO", "x", 1)]
    rows = finance.export_rows(spark.createDataFrame([("2026-08-07", x) for x in lines], "day string, value string"))
    assert rows.filter("malformed").count() == 2
    vol = rx.daily_volume(rows.filter("NOT malformed"))
    assert as_list(vol.fillna("", ["country"]), "scope", "country", "events", "articles", "mentions") == [
        ("country", "KE", 1, 4, 5), ("country", "SO", 2, 3, 4), ("unlocated", "", 1, 7, 9), ("world", "", 4, 14, 18)
    ]


def test_plans_and_funding(spark):
    assert as_list(finance.plans(bodies(spark, PLANS)), "plan_id", "iso3", "requirements_usd") == [
        (1516, ["KEN", "SOM"], 900), (1520, ["YEM"], 500)
    ]
    assert as_list(finance.funding(bodies(spark, FUNDING)), "plan_id", "funded_usd") == [(1516, 300), (1520, 100)]


def _reading(spark):
    cur = spark.createDataFrame(
        [("a", "ALERT_EPISODE", "OPEN", ["SOM"]), ("b", "ALERT_EPISODE", "OPEN", ["DEU", "ZZZ"]), ("c", "FORECAST", "OPEN", []),
         ("d", "ALERT_EPISODE", "DISSIPATED", ["SOM"])],
        "id string, kind string, status string, iso3 array<string>",
    )
    cw = spark.createDataFrame([("SOM", "SO", "2026-08-01"), ("KEN", "KE", "2026-08-01"), ("DEU", "GM", "2026-08-01")], "iso3 string, fips string, valid_from string")
    rows = [("2026-08-01", "SO", 10), ("2026-08-01", "XX", 90), ("2026-08-02", "SO", 30), ("2026-08-02", "XX", 70), ("2026-08-03", "SO", 40), ("2026-08-03", "XX", 60)]
    vol = rx.daily_volume(spark.createDataFrame([(*r, 1) for r in rows], "day string, country string, articles bigint, mentions bigint"))
    return rx.nightly_reading(
        cur, finance.plans(bodies(spark, PLANS)), finance.funding(bodies(spark, FUNDING)), cw, vol,
        run_date="2026-08-08", attention_day="2026-08-03",
    )


def test_nightly_reading(spark):
    got = {r["id"]: r for r in _reading(spark).collect()}
    assert sorted(got) == ["a", "b", "c"]
    a = got["a"]
    assert (a["plans"], a["plan_requirements_usd"], a["plan_funded_usd"], a["has_plan_match"]) == ([1516], 900, 300, True)
    assert (a["articles"], a["baseline_median"], a["ratio_to_baseline"], a["share_per_10k"]) == (40, 20.0, 2.0, 4000.0)
    b = got["b"]
    assert (b["has_plan_match"], b["plans"], b["plan_funded_usd"]) == (False, [], 0)
    assert (b["fips"], b["unmapped_iso3"]) == (["GM"], ["ZZZ"])
    assert (b["articles"], b["baseline_median"], b["ratio_to_baseline"]) == (0, 0.0, None)
    assert (got["c"]["fips"], got["c"]["articles"]) == ([], None)


def test_coverage(spark):
    row = rx.coverage(_reading(spark)).collect()[0]
    assert tuple(row) == (2, 1, 0.5)
    assert rx.coverage(_reading(spark).filter("kind = 'x'")).collect()[0]["match_rate"] == 0.0


@pytest.mark.parametrize("seed,rows", [(1, 3), (2, 28)])
def test_trailing_median_counts_silent_days_as_zero(spark, seed, rows):
    rng = random.Random(seed)
    days = [f"2026-{m:02d}-{d:02d}" for m in (5, 6) for d in range(1, 29) if rng.random() < 0.7]
    daily = {(k, d): rng.randint(1, 50) for d in days for k in "abc" if rng.random() < 0.6}
    df = spark.createDataFrame([(k, d, x) for (k, d), x in daily.items()], "key string, day string, articles bigint")
    committed = spark.createDataFrame([(d,) for d in days], "day string")
    got = rx.trailing_baseline(df, committed, key="key", rows=rows)
    want = []
    for (k, d), x in daily.items():
        window = sorted(y for y in days if y < d)[-rows:]
        base = float(statistics.median([daily.get((k, y), 0) for y in window])) if window else None
        want.append((k, d, x, base))
    assert sorted(as_list(got, "key", "day", "articles", "baseline_median"), key=str) == sorted(want, key=str)


def test_crosswalk_counts_from_its_day(spark):
    doc = """{"authored": "2026-08-05", "entries": {"SOM": {"fips": "SO"}, "KEN": {"fips": "KE"}},
     "revisions": [{"date": "2026-08-10", "added": {"KEN": "K1"}}, {"date": "2026-08-12", "added": {"KEN": "K2"}}]}"""
    cw = finance.crosswalk(bodies(spark, doc))
    facts = spark.createDataFrame([(c, d) for c in ("SOM", "KEN") for d in ("2026-08-04", "2026-08-06", "2026-08-11", "2026-08-12")], "iso3 string, day string")
    got = {(r["iso3"], r["day"][-2:]): r["fips"] for r in rx.asof_lookup(facts, cw).collect()}
    assert got == {
        ("SOM", "04"): None, ("SOM", "06"): "SO", ("SOM", "11"): "SO", ("SOM", "12"): "SO",
        ("KEN", "04"): None, ("KEN", "06"): None, ("KEN", "11"): "K1", ("KEN", "12"): "K2",
    }


def test_match_rate_sensor(spark):
    rows = [("r", f"2026-08-{d:02d}", x) for d, x in ((8, 0.3), (9, 0.3), (10, 0.3), (11, 0.45), (12, 0.2), (13, 0.6))]
    got = rx.match_rate_sensor(spark.createDataFrame(rows, "register string, run_date string, match_rate double"))
    r = {x["run_date"][-2:]: x for x in got.collect()}
    assert [r[d]["firing"] for d in ("08", "09", "10")] == ["DEFERRED", "DEFERRED", "ARMED"]
    assert [r[d]["fired"] for d in ("10", "11", "12", "13")] == [False, True, True, True]
    assert r["12"]["why"] == "match rate 20% below 25%; match rate moved 25% from the previous reading"


def test_latency_sensor(spark):
    rows = [("r", f"2026-08-{d:02d}", 2, True) for d in range(8, 13)] + [("q", f"2026-08-{d:02d}", None if d == 10 else 2, True) for d in range(8, 13)]
    got = rx.latency_sensor(spark.createDataFrame(rows, "register string, run_date string, gap_days int, newest_day_failed boolean"))
    fired = as_list(got.filter("fired"), "register", "run_date", "gap_days")
    assert fired == [("r", "2026-08-12", 2)]


def test_series_and_missing_days(spark):
    rows = [
        ("a", "2026-08-08", 5, 1.5, True, 100, 10), ("a", "2026-08-09", 9, 2.5, True, 100, 40), ("a", "2026-08-10", 7, 2.5, False, 0, 0),
        ("b", "2026-08-08", 1, None, False, 0, 0),
    ]
    readings = spark.createDataFrame(
        rows, "id string, run_date string, articles bigint, ratio_to_baseline double, has_plan_match boolean, plan_requirements_usd bigint, plan_funded_usd bigint"
    )
    got = {r["id"]: r for r in rx.reaction_series(readings).collect()}
    a, b = got["a"], got["b"]
    assert (a["nights_watched"], a["peak_date"], a["peak_articles"], a["money_funded_delta_usd"]) == (3, "2026-08-10", 7, 30)
    assert (b["peak_date"], b["money_plan_match"], b["money_funded_delta_usd"]) == (None, False, None)
    days = spark.createDataFrame([("r", "2026-08-01"), ("r", "2026-08-03")], "register string, day string")
    assert as_list(rx.missing_days(days, "2026-08-07"), "day") == [("2026-08-04",), ("2026-08-05",), ("2026-08-06",)]
    assert as_list(rx.missing_days(days, "2026-08-07", backfill=6), "day")[0] == ("2026-08-02",)
    assert rx.missing_days(days, "2026-12-31").count() == 149
    assert rx.missing_days(days, "2026-12-31", cap=30).count() == 30


def test_overlap_pairs_unite_the_codes_of_a_key_and_hold_no_pairs(spark):
    left = spark.createDataFrame([(1, ["A", "B"]), (1, ["B", "C"]), (1, None), (2, []), (3, ["D", "A"])], "id int, codes array<string>")
    right = spark.createDataFrame([(10, ["B", "B", "A"]), (11, ["C"]), (11, ["D"]), (12, None)], "plan int, codes array<string>")
    got = rx.overlap_pairs(left, right, left_key="id", right_key="plan", left_codes="codes", right_codes="codes")
    assert as_list(got, "id", "plan") == [(1, 10), (1, 11), (3, 10), (3, 11)]
    # the pairs themselves are neither shuffled nor grouped
    assert not got._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate")
