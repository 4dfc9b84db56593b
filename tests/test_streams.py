"""Streams against their batch forms: buckets of state, late rows, order within a feed."""

import os

from pyspark.sql import functions as F

from recordlens.operators import register as reg
from recordlens.streaming import nights as st
from tests.helpers import as_list, ob, observations
from tests.test_register import NIGHTS, random_rows, simple_fold

FIELDS = ("id", "run_date", "event")


def fold_stream(spark, base, parts, obs, **options):
    obs.write.partitionBy("run_date").parquet(f"{base}/obs")
    stored = spark.read.schema(obs.schema).parquet(f"{base}/obs")
    for part in parts:
        spark.createDataFrame([(n,) for n in part], "run_date string").coalesce(1).write.mode("append").parquet(f"{base}/announced")
    told = spark.readStream.schema("run_date string").option("maxFilesPerTrigger", 1).parquet(f"{base}/announced")
    return st.fold_night_batches(told, lambda ns: stored.filter(F.col("run_date").isin(ns)), base, **options)


def written_files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{base}/state") for f in names if f.endswith(".parquet")}


def test_bucketed_fold_equals_the_nightly_walk(spark, tmp_path):
    """In order, with a night that comes late, and with a night that nobody announces twice."""
    rows, _ = random_rows(6)
    obs = observations(spark, rows)
    nights = sorted({r[1] for r in rows})
    base = str(tmp_path / "late")
    st.run_to_end(fold_stream(spark, base, [nights[:3], nights[4:6], nights[3:4] + nights[6:]], obs, buckets=3))
    assert as_list(st.folded_events(spark, base), *FIELDS) == simple_fold(rows, [])
    held = st.BucketedState(spark, base, "id", 3).read(3)
    want = reg.advance_state(reg.register_fold(obs))
    assert as_list(held, "id", "run_date", "status", "severity") == as_list(want, "id", "run_date", "status", "severity")


def test_a_batch_writes_the_buckets_it_touches_and_replaces_old_ones(spark, tmp_path):
    keys = [f"k{n}" for n in range(40)]
    day = lambda n: f"2026-08-{n:02d}"
    # every night all records are seen; from the second on only k0 changes
    rows = [ob(k, day(n), p, sev=f"v{n}" if k == "k0" else "Green") for n in range(1, 6) for p, k in enumerate(keys)]
    base = str(tmp_path / "buckets")
    writer = fold_stream(spark, base, [[day(1)]], observations(spark, rows), buckets=8)
    st.run_to_end(writer)
    seen = written_files(base)
    assert len(seen) == 8
    for n in range(2, 6):
        spark.createDataFrame([(day(n),)], "run_date string").coalesce(1).write.mode("append").parquet(f"{base}/announced")
        st.run_to_end(writer)
        now = written_files(base)
        new = {os.path.relpath(f, f"{base}/state").split(os.sep)[0] for f in now - seen}
        assert len(now - seen) == 1 and len(new) == 1
        assert len(now) <= 9, "a bucket holds two versions at most"
        seen = now
    assert as_list(st.BucketedState(spark, base, "id", 8).read(5).filter("id = 'k0'"), "severity") == [("v5",)]


def test_a_repeated_batch_finds_what_it_found(spark, tmp_path):
    base = str(tmp_path / "again")
    held = st.BucketedState(spark, base, "id", 4)
    fold = lambda rows, state=None: reg.register_fold(observations(spark, rows), state=state)
    first = [ob(f"r{n}", NIGHTS[0], n) for n in range(12)]
    held.advance(0, fold(first), None, reg.advance_state)
    second = [ob(f"r{n}", NIGHTS[1], n, sev="Red") for n in range(12)]
    results = []
    for _ in range(2):
        state = held.read(1)
        events = fold(second, state)
        results.append(as_list(events, *FIELDS))
        held.advance(1, events, None, reg.advance_state)
    assert results[0] == results[1] and {e for _, _, e in results[0]} == {"REVISED"}
    assert {r[0] for r in as_list(held.read(2), "severity")} == {"Red"}


def test_rows_later_than_the_watermark_are_dropped_and_counted(spark, tmp_path):
    at = lambda day, hour=12: f"2026-08-{day:02d} {hour:02d}:00:00"
    deliveries = [[(at(1), "A", 1), (at(4), "A", 1)], [(at(3), "A", 10), (at(9), "B", 1)], [(at(1), "A", 100), (at(8), "A", 2), (at(12), "A", 1)], [(at(7), "B", 5), (at(20), "A", 1)]]
    for rows in deliveries:
        df = spark.createDataFrame(rows, "t string, country string, n bigint").selectExpr("to_timestamp(t) AS at", "country", "n AS articles", "n AS mentions")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = st.run_to_end(st.append_stream(st.daily_volume_stream(stream, "at", "country"), str(tmp_path)))
    marks = [t["watermark"][:10] for t in told]
    assert marks == sorted(marks) and len(set(marks)) > 2
    # the hundred of the first day and the five of the seventh come after their days were reported
    assert [t["dropped"] for t in told if t["rows"]] == [0, 0, 1, 1] and sum(t["dropped"] for t in told) == 2
    got = as_list(spark.read.parquet(str(tmp_path / "data")), "day", "country", "articles")
    assert got == [("2026-08-01", "A", 1), ("2026-08-03", "A", 10), ("2026-08-04", "A", 1), ("2026-08-08", "A", 2), ("2026-08-09", "B", 1), ("2026-08-12", "A", 1)]


def test_first_message_follows_feed_order_not_arrival(spark, tmp_path):
    rows = [(f"2026-08-0{d} 0{h}:00:00", p, k, f"{d}{h}{p}{k}") for d in (1, 2, 9) for h in (3, 1, 2) for p in (2, 1) for k in "ab"]
    want = [(d, k, f"{d}1" + "1" + k) for d in (1, 2) for k in "ab"]
    for name, parts in (("one", [rows]), ("two", [rows[1::2], rows[::2]]), ("turned", [rows[::-1]])):
        for part in parts:
            spark.createDataFrame(part, "t string, pos int, key string, body string").selectExpr("to_timestamp(t) AS at", "pos", "key", "body").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema("at timestamp, pos int, key string, body string").parquet(str(tmp_path / name / "in"))
        first = st.least_message_stream(stream, ["key"], "at", ["at", "pos"], ["body"]).withColumn("d", F.dayofmonth("starts"))
        st.run_to_end(st.append_stream(first, str(tmp_path / name)))
        assert as_list(spark.read.parquet(str(tmp_path / name / "data")), "d", "key", "body") == want


def test_a_late_night_derives_the_state_before_it_once(spark, tmp_path):
    rows, _ = random_rows(6)
    nights, base = sorted({r[1] for r in rows}), str(tmp_path / "late")
    st.run_to_end(fold_stream(spark, base, [nights[:3], nights[4:6], nights[3:4] + nights[6:]], observations(spark, rows), buckets=3))
    early = observations(spark, [r for r in rows if r[1] < nights[3]])
    kept = spark.read.parquet(f"{base}/before/epoch=2")  # what the fold and the new state both read
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in early.collect()}
