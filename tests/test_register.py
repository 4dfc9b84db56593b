import random

import pytest
from pyspark.sql import functions as F

from recordlens.operators import register as reg
from recordlens.sources import feeds
from tests.helpers import answered, as_list, ob, observations

NIGHTS = [f"2026-08-{d:02d}" for d in range(8, 20)]


def simple_fold(rows, answers):
    """Night by night in plain Python: the result the fold must have."""
    held, out = {}, []
    nights = sorted({r[1] for r in rows} | {n for _, n in answers})
    for night in nights:
        tonight = sorted((r for r in rows if r[1] == night), key=lambda r: r[2])
        present = {r[0] for r in tonight}
        for r in tonight:
            fields = (r[8], r[9], r[10], r[11])
            if r[0] not in held:
                held[r[0]] = [fields, True, r[3], r[4]]
                out.append((r[0], night, "NOTARIZED"))
                continue
            entry = held[r[0]]
            if not entry[1]:
                out.append((r[0], night, "REAPPEARED"))
            if entry[0] != fields:
                out.append((r[0], night, "REVISED"))
            entry[0], entry[1] = fields, True
        spoke = {r[3] for r in tonight} | {s for s, n in answers if n == night}
        for fid, entry in held.items():
            if entry[1] and fid not in present and entry[2] in spoke:
                entry[1] = False
                out.append((fid, night, "DISSIPATED" if entry[3] == "FORECAST" else "CLOSED_BY_SOURCE"))
    return sorted(out)


def random_rows(seed):
    rng = random.Random(seed)
    rows, answers = [], []
    for night in NIGHTS:
        for source in ("S", "T"):
            if rng.random() < 0.25:
                continue
            answers.append((source, night))
            pos = 0
            for k in range(6):
                for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                    rows.append(
                        ob(f"{source}{k}", night, pos, source=source, kind="FORECAST" if k % 2 else "ALERT_EPISODE",
                           sev=rng.choice(("Orange", "Red")), what=rng.choice(("x", "y")),
                           to=rng.choice((None, "2026-08-20T00:00:00")))
                    )
                    pos += 1
    return rows, answers


@pytest.mark.parametrize("seed,segment", [(1, 2), (2, 3), (3, 100_000)])
def test_fold_equals_the_nightly_walk(spark, seed, segment):
    rows, answers = random_rows(seed)
    ev = reg.register_fold(observations(spark, rows), answered(spark, answers), segment_rows=segment)
    assert as_list(ev, "id", "run_date", "event") == simple_fold(rows, answers)


@pytest.mark.parametrize("seed", [4, 5])
def test_fold_in_batches_equals_the_fold_at_once(spark, tmp_path, seed):
    rows, answers = random_rows(seed)
    want = simple_fold(rows, answers)
    got, state = [], None
    for n, part in enumerate((NIGHTS[:4], NIGHTS[4:5], NIGHTS[5:9], NIGHTS[9:])):
        obs = observations(spark, [r for r in rows if r[1] in part])
        ans = answered(spark, [a for a in answers if a[1] in part])
        ev = reg.register_fold(obs, ans, state=state, segment_rows=2)
        got += as_list(ev, "id", "run_date", "event")
        path = str(tmp_path / f"s{n}")
        reg.advance_state(ev, state).write.parquet(path)
        state = spark.read.parquet(path)
    assert sorted(got) == want


def test_a_source_that_is_down_proves_nothing(spark):
    rows = [ob("a", "2026-08-08"), ob("b", "2026-08-08", 1), ob("b", "2026-08-10")]
    ev = reg.register_fold(observations(spark, rows))
    assert ("a", "2026-08-09", "CLOSED_BY_SOURCE") not in as_list(ev, "id", "run_date", "event")
    assert ("a", "2026-08-10", "CLOSED_BY_SOURCE") in as_list(ev, "id", "run_date", "event")
    quiet = reg.register_fold(observations(spark, rows), answered(spark, [("S", "2026-08-09")]))
    assert ("a", "2026-08-09", "CLOSED_BY_SOURCE") in as_list(quiet, "id", "run_date", "event")


def test_changes_name_both_values_and_reappearing_comes_first(spark):
    rows = [ob("a", "2026-08-08"), ob("a", "2026-08-10", sev="Red"), ob("b", "2026-08-08", 1), ob("b", "2026-08-09")]
    ev = reg.register_fold(observations(spark, rows)).filter("id = 'a'")
    got = [
        (r["event"], r["changes"]["severity"] if r["changes"] else None)
        for r in ev.orderBy("run_date", "phase", "pos", "step").collect()
    ]
    assert [g[0] for g in got] == ["NOTARIZED", "CLOSED_BY_SOURCE", "REAPPEARED", "REVISED"]
    assert (got[3][1]["from"], got[3][1]["to"]) == ("Orange", "Red")


def test_current_table_keeps_first_sight_and_last_values(spark):
    rows = [ob("a", "2026-08-08"), ob("a", "2026-08-09", sev="Red", iso3=("BBB",))]
    cur = reg.register_current(reg.register_fold(observations(spark, rows)), with_history=True).collect()[0]
    assert (cur["announced_at"], cur["severity"], cur["iso3"], cur["status"]) == ("2026-08-08", "Red", ["AAA"], "OPEN")
    assert [h["event"] for h in cur["history"]] == ["NOTARIZED", "REVISED"]


def _trajectory(spark, ends, as_of):
    rows = [ob("a", n, to=to, hazard="drought") for n, to in ends]
    ev = reg.register_fold(observations(spark, rows))
    return [r.asDict() for r in reg.trajectory_class(ev, as_of).collect()]


def test_trajectory_classes(spark):
    ends = [("2026-08-08", "2026-08-06"), ("2026-08-09", "2026-08-07"), ("2026-08-10", "2026-08-08")]
    assert _trajectory(spark, ends, "2026-08-10")[0]["class"] == "rolling"
    late = _trajectory(spark, ends, "2026-08-11")[0]
    assert late["class"] == "irregular"
    assert (late["since"], late["day_delta"], late["todate_delta"]) == ("2026-08-11", 1, 0)
    same = [("2026-08-08", "2026-08-20")]
    assert _trajectory(spark, same, "2026-08-09")[0]["class"] == "frozen"
    assert _trajectory(spark, same, "2026-08-08") == []


def test_crossing_between_classes(spark):
    ends = [("2026-08-08", "2026-08-06"), ("2026-08-09", "2026-08-07"), ("2026-08-10", "2026-08-07")]
    ev = reg.register_fold(observations(spark, [ob("a", n, to=t) for n, t in ends]))
    got = reg.class_crossings(ev, "2026-08-10", "2026-08-09").collect()
    assert [(r["from_class"], r["to_class"]) for r in got] == [("rolling", "irregular")]


@pytest.mark.parametrize("mode", ["parsed", "text"])
def test_overdue_kinds(spark, mode):
    rows = spark.createDataFrame(
        [("OPEN", "2026-08-05T00:00:00", "2026-08-05T00:00:00"), ("OPEN", "2026-08-10T00:00:00", "2026-08-12T00:00:00"),
         ("OPEN", "2026-09-01T00:00:00", "2026-08-05T00:00:00"), ("DISSIPATED", "2026-08-05T00:00:00", "2026-08-05T00:00:00")],
        "status string, to string, first string",
    )
    kind = reg.overdue_kind(F.col("status"), F.col("to"), F.col("first"), F.lit("2026-08-08T01:00:00+00:00"), F.lit("2026-08-22T00:00:00+00:00"), mode)
    assert [r[0] for r in rows.select(kind).collect()] == ["cold_start_overdue", "drift_overdue", None, None]


def test_offsets_matter_when_times_are_parsed(spark):
    row = spark.createDataFrame([("OPEN", "2026-08-22T02:00:00-05:00")], "status string, to string")
    now = F.lit("2026-08-22T06:00:00+00:00")
    parsed, text = (reg.is_overdue(F.col("status"), F.col("to"), now, m) for m in ("parsed", "text"))
    assert tuple(row.select(parsed, text).collect()[0]) == (False, True)


def test_correction_only_adds_and_only_once(spark):
    rows = [ob("gdacs-tc-1", "2026-08-08", iso3=("JPN", "MHL")), ob("gdacs-tc-2", "2026-08-08", 1, iso3=("VNM",))]
    cur = reg.register_current(reg.register_fold(observations(spark, rows)))
    body = '{"features":[{"properties":{"eventid":1,"eventtype":"TC","iso3":"VNM"}},{"properties":{"eventid":2,"eventtype":"TC","iso3":" "}}]}'
    feed = feeds.primary_codes(spark.createDataFrame([("d", "s", 0, body)], "run_date string, snapshot string, doc int, body string"))
    fixed, events = reg.correct_register(cur, feed, cause="c", at="2026-08-09", snapshot="s")
    assert as_list(fixed, "id", "iso3") == [("gdacs-tc-1", ["JPN", "MHL", "VNM"]), ("gdacs-tc-2", ["VNM"])]
    assert as_list(events, "id", "event", "added") == [("gdacs-tc-1", "CORRECTED", ["VNM"])]
    again, none = reg.correct_register(fixed, feed, cause="c", at="2026-08-10", snapshot="s")
    assert none.count() == 0 and as_list(again, "id", "iso3") == as_list(fixed, "id", "iso3")


def test_several_rows_of_a_night_fold_in_feed_order(spark):
    """Also where the caller promises one row a night."""
    rows = [ob("a", "2026-08-01", 1, sev="Orange"), ob("a", "2026-08-01", 0, sev="Green"), ob("a", "2026-08-02", 0, sev="Orange")]
    for flag in (False, True):
        events = reg.register_fold(observations(spark, rows), one_per_night=flag).orderBy("run_date", "phase", "pos", "step").collect()
        assert [(e["run_date"], e["event"]) for e in events] == [("2026-08-01", "NOTARIZED"), ("2026-08-01", "REVISED")]


def test_events_are_spread_before_a_task_sorts_them(spark, sf_dir):
    from recordlens.plans import register_plans as rgp

    plan = rgp.nightly_observations(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in plan
