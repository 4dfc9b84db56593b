import json

import pytest
from pyspark.sql import functions as F

from recordlens import sinks
from recordlens.plans import scan_plans
from recordlens.plans.tables import spread
from recordlens.sources import feeds, records
from tests.helpers import as_list

BODY = "run_date string, snapshot string, doc int, body string"


def bodies(spark, *docs):
    return spark.createDataFrame([("2026-08-22", "s", n, d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(docs)], BODY)


@pytest.mark.parametrize(
    "code,want",
    [
        ("/O.NEW.KILX.FL.W.0039.260822T1511Z-260823T0600Z/", "nws-kilx-flw-0039-26"),
        ("/O.EXT.KILX.FL.W.0039.000000T0000Z-260824T0600Z/", "nws-kilx-flw-0039-26"),
        (" /O.CON.KILX.FL.W.0039.260822T1511Z-260823T0600Z/ ", "nws-kilx-flw-0039-26"),
        ("/O.EXP.KILX.FL.W.0039.260822T1511Z-260823T0600Z/", None), ("/O.CAN.KILX.FL.W.0039.260822T1511Z-260823T0600Z/", None),
        ("/O.NEW.KILX.FL.A.0039.260822T1511Z-260823T0600Z/", None), ("nonsense", None),
    ],
)
def test_tracking_numbers(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(feeds.vtec_id(F.col("c"))).collect()[0][0] == want


def test_alert_codes_and_documents_stay_in_compiled_code(spark, sf_dir):
    codes = [["C2", "", None, "C1", "C2"], None, [], [None, ""]]
    own = [" C1 ", "C9", None, " "]
    feature = lambda c, o: {"properties": {"eventid": "1", "eventtype": "EQ", "iso3": o, "affectedcountries": c and [None if x is None else {"iso3": x} for x in c]}}
    bodies = [("2024-01-01", "s", i, json.dumps({"features": [feature(c, o)]})) for i, (c, o) in enumerate(zip(codes, own, strict=True))]
    out = feeds.alert_observations(spark.createDataFrame(bodies, "run_date string, snapshot string, doc long, body string"))
    assert [r.iso3 for r in out.orderBy("pos").collect()] == [["C1", "C2"], ["C9"], [], []]
    documents = scan_plans.alert_bodies(spark, sf_dir)
    plan = feeds.alert_observations(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "substring" not in plan
    for r in documents.limit(50).collect():
        assert [len(json.loads(r.body)["features"]), json.loads(r.body)["features"][1]] == [2, {"properties": {"eventid": "1", "eventtype": "XX"}}]


def test_alert_feed(spark):
    doc = {"features": [
        {"properties": {"eventid": 1001297, "eventtype": "TC", "alertlevel": "Orange", "name": "Cyclone X", "country": "Japan", "iso3": "MHL",
                        "affectedcountries": [{"iso3": "JPN"}, {}], "fromdate": "2026-07-27T00:00:00", "todate": "soon", "url": {"report": "https://r"}}},
        {"properties": {"eventid": 1027450, "eventtype": "DR", "name": "", "eventname": "Drought", "url": "https://plain"}},
        {"properties": {"eventtype": "FL"}}, {"properties": {"eventid": 7, "eventtype": "VO"}},
    ]}
    got = feeds.alert_observations(bodies(spark, doc)).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["gdacs-tc-1001297", "gdacs-dr-1027450"]
    a, b = got
    assert (a["iso3"], a["source_ref"], a["hazard"]) == (["JPN", "MHL"], "https://r", "tropical cyclone")
    assert (a["window"]["from"], a["window"]["to"]) == ("2026-07-27T00:00:00", None)
    assert (b["what"], b["iso3"], b["source_ref"], b["severity"]) == ("Drought", [], "https://plain", "")


def test_storm_feed(spark):
    doc = {"activeStorms": [{"id": "AL052026", "binNumber": "B1", "name": "DOLPHIN", "classification": "TS", "intensity": "45", "lastUpdate": "2026-08-08T03:00:00Z"},
                            {"id": "", "binNumber": "B2", "name": "X"}, {"name": "none"}]}
    got = feeds.storm_observations(bodies(spark, doc, {"activeStorms": []})).orderBy("pos").collect()
    assert [(r["id"], r["what"]) for r in got] == [("nhc-al052026", "DOLPHIN (TS)"), ("nhc-b2", "X (storm)")]


def test_first_warning_message_wins(spark):
    def feature(name, *codes):
        return {"properties": {"@id": name, "event": "Flood Warning", "severity": "Severe", "effective": "2026-08-22T10:00:00-05:00", "expires": "2026-08-23T06:00:00-05:00",
                               "areaDesc": "Lake", "parameters": {"VTEC": list(codes)}}}

    new, ext = "/O.NEW.KILX.FL.W.0039.260822T1511Z-260823T0600Z/", "/O.EXT.KILX.FL.W.0039.000000T0000Z-260824T0600Z/"
    other = "/O.NEW.KILX.FL.W.0040.260822T1511Z-260823T0600Z/"
    doc = {"features": [feature("m1", new), feature("m2", ext, other), {"properties": {"event": "x"}}]}
    got = feeds.warning_observations(bodies(spark, doc))
    assert as_list(got, "id", "source_ref", "hazard") == [("nws-kilx-flw-0039-26", "m1", "flood"), ("nws-kilx-flw-0040-26", "m2", "flood")]
    both = feeds.all_observations({"NWS": bodies(spark, doc), "NHC": bodies(spark, {"activeStorms": []})})
    assert both.count() == 2


def test_answered_modes(spark):
    rows = [("A", "n1", 200, "{}"), ("A", "n2", 200, "{cut"), ("A", "n3", 503, "{}")]
    f = spark.createDataFrame(rows, "source string, run_date string, http_status int, body string")
    assert as_list(feeds.answered_nights(f), "run_date") == [("n1",)]
    assert as_list(feeds.answered_nights(f, "preserved"), "run_date") == [("n1",), ("n2",)]


def test_append_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *d: spark.createDataFrame([(x, 1) for x in d], "date string, n int")
    sinks.append_once(rows("2026-08-08"), path)
    sinks.append_once(rows("2026-08-09"), path)
    with pytest.raises(sinks.AlreadyRecorded):
        sinks.append_once(rows("2026-08-09", "2026-08-10"), path)
    assert records.read_committed(spark, path).count() == 2
    assert records.read_committed(spark, path, "2026-08-09").count() == 1


def test_a_day_holds_the_rows_of_one_run(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda n: spark.createDataFrame([("2026-08-08", n, k) for k in range(5)], "date string, n int, k int")
    sinks.append_once(rows(1), path, run="a")
    sinks.append_once(rows(2), path, run="a")  # the same run again replaces its own rows
    assert as_list(records.read_committed(spark, path), "n", "k") == [(2, k) for k in range(5)]
    with pytest.raises(sinks.AlreadyRecorded):
        sinks.append_once(rows(3), path, run="b")
    # a writer that passed the look before another one wrote: one of them stays, whole
    sinks._replace(rows(4).withColumn(sinks.RUN, F.lit("c")), path, "date")
    assert as_list(records.read_committed(spark, path), "n", "k") == [(4, k) for k in range(5)]


def test_two_writers_of_a_day(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    sinks.append_once(spark.createDataFrame([("2026-08-07", 0, 0)], "date string, n int, k int"), path)

    def write(n):
        try:
            sinks.append_once(spark.createDataFrame([("2026-08-08", n, k) for k in range(50)], "date string, n int, k int").repartition(4), path, run=f"w{n}")
        except sinks.AlreadyRecorded:
            return "refused"
        return "written"

    with ThreadPoolExecutor(2) as pool:
        told = sorted(pool.map(write, (1, 2)))
    day = records.read_committed(spark, path, "2026-08-08").collect()
    assert told == ["refused", "written"] and len(day) == 50 and len({r["n"] for r in day}) == 1


def test_a_claim_that_was_refused_or_left_is_no_bar(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *d: spark.createDataFrame([(x, 1) for x in d], "date string, n int")
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "day string")
    sinks._claim(days("2026-08-08"), f"{path}/_claims", "broken", 6.0)  # a run that claimed a day and broke off
    with pytest.raises(sinks.AlreadyRecorded):
        sinks.append_once(rows("2026-08-08", "2026-08-09"), path, run="other")
    sinks.append_once(rows("2026-08-09"), path, run="third")  # the refused run gave its claim back
    sinks.append_once(rows("2026-08-08"), path, run="broken")  # the broken one is run again
    assert as_list(records.read_committed(spark, path).selectExpr("string(date) AS d"), "d") == [("2026-08-08",), ("2026-08-09",)]
    sinks._claim(days("2026-08-10"), f"{path}/_claims", "gone", 6.0)
    sinks.append_once(rows("2026-08-10"), path, run="later", lease_hours=0.0)


def test_a_run_that_is_repeated_replaces_its_new_keys(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, verdict string")
    sinks.append_new(rows((1, "a")), path, "id", run="n1")
    for word in ("half", "whole"):
        sinks.append_new(rows((1, "late"), (2, word)), path, "id", run="n2")
    # a run that did not see n2's key: both rows lie there, the earlier run's counts
    sinks._replace(rows((2, "raced")).withColumn(sinks.RUN, F.lit("n3")), path, sinks.RUN)
    assert as_list(sinks.held_rows(spark, path, "id"), "id", "verdict") == [(1, "a"), (2, "whole")]
    assert as_list(sinks.held_rows(spark, path, "id", before="n2"), "id") == [(1,)]


def test_manifest_and_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"x":\n 1}')
    import hashlib

    got = sinks.manifest_of(spark, str(tmp_path / "d")).collect()
    assert [(r["bytes"], r["sha256"]) for r in got] == [(9, hashlib.sha256(b'{"x":\n 1}').hexdigest())]
    assert feeds.read_documents(spark, str(tmp_path / "d")).collect()[0]["body"] == '{"x":\n 1}'
    assert feeds.read_documents(spark, str(tmp_path / "d"), per="line").count() == 2


def test_log_lines_are_numbered(spark, tmp_path):
    lines = [json.dumps({"step": "run", "detail": {"date": f"d{n}"}}) if n % 3 else "{cut" for n in range(20)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    got = records.log_entries(records.numbered_lines(spark.read.text(str(tmp_path / "log.jsonl"))))
    assert as_list(got.filter("unparseable"), "line_no") == [(n + 1,) for n in range(20) if n % 3 == 0]
    assert as_list(got.filter("NOT unparseable"), "line_no", "run_date") == [(n + 1, f"d{n}") for n in range(20) if n % 3]


def test_line_numbers_belong_to_their_file(spark, tmp_path):
    for name, n in (("a.jsonl", 3), ("b.jsonl", 5000)):
        (tmp_path / name).write_text("".join(f"{name}{i + 1}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = records.numbered_lines(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5003 and all(r["file"].endswith(r["value"].rstrip("0123456789")) for r in got)
    assert all(r["value"] == f"{r['file'].rsplit('/', 1)[1]}{r['line_no']}" for r in got)


def test_a_batch_holds_a_key_once(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, verdict string")
    sinks.append_new(rows((1, "b"), (1, "a"), (2, "c")), path, "id")
    sinks.append_new(rows((1, "z"), (3, None), (3, "d")), path, "id")
    assert as_list(spark.read.parquet(path), "id")[:3] == [(1,), (2,), (3,)] and spark.read.parquet(path).filter("id = 1").first()["verdict"] == "a"
    files = spark.createDataFrame([("f", "s", "u2"), ("f", "s", "u1"), ("g", "s", "u3")], "file string, sha256 string, url string")
    held = spark.createDataFrame([("g", "s")], "file string, sha256 string")
    assert as_list(sinks.preserve_once(files, held), "file", "url") == [("f", "u1")]


def test_manifest_files_and_entries(spark, tmp_path):
    for night in ("2024-01-01", "2024-01-02"):
        folder = tmp_path / night / "snapshots"
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(json.dumps({"run_date": night, "entries": [{"file": "a.json", "url": "u", "http_status": 200, "sha256": "s", "bytes": 3}]}))
    got = records.manifest_files(spark, f"{tmp_path}/*/snapshots/manifest.json").orderBy("run_date").collect()
    assert [(r["run_date"], r["file"], r["url"]) for r in got] == [("2024-01-01", "a.json", "u"), ("2024-01-02", "a.json", "u")]
    assert all(r["origin"].endswith(f"{r['run_date']}/snapshots/manifest.json") for r in got)
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "x.bin").write_bytes(b"abc")
    fetched = spark.createDataFrame([("x.bin", "https://x.test", "2024-01-01T00:00:00Z", 200)], "file string, url string, retrieved_at string, http_status int")
    row = sinks.manifest_of(spark, str(tmp_path / "kept"), fetched).first()
    assert (row["file"], row["url"], row["http_status"], row["bytes"]) == ("x.bin", "https://x.test", 200, 3)


def test_pieces_outnumber_the_cores(spark):
    pieces = 4 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(2), "id").rdd.getNumPartitions() == pieces
    assert spread(spark.range(100).repartition(pieces + 1), "id").rdd.getNumPartitions() == pieces + 1
