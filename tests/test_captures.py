import hashlib

from pyspark.sql import functions as F

from recordlens.functions.rates import wilson
from recordlens.operators import captures as cp
from recordlens.operators import reports as rp
from recordlens.sources import records
from tests.helpers import as_list

CAP = "page string, timestamp string, pos int, original string, statuscode string, digest string"


def caps(spark, rows):
    return spark.createDataFrame([(p, t, n, "u", s, d) for n, (p, t, s, d) in enumerate(rows)], CAP)


def test_history_classes(spark):
    rows = [
        ("same", "20260801120000", "200", "D1"), ("new", "20260801120000", "200", "D1"), ("new", "20260814090000", "200", "D2"),
        ("late", "20260801120000", "200", "D1"), ("late", "20260815100000", "404", "D3"),
        ("gone", "20260801120000", "200", "D1"), ("gone", "20260814120000", "403", "D2"),
        ("moved", "20260801120000", "200", "D1"), ("moved", "20260814120000", "301", "D2"),
        ("first", "20260801120000", "404", "D1"), ("first", "20260814120000", "200", "D2"), ("dash", "20260814120000", "-", "D2"),
    ]
    pages = spark.createDataFrame([(p,) for p in {r[0] for r in rows} | {"none"}], "page string")
    got = {r["page"]: r for r in cp.history_class(caps(spark, rows), "2026-08-14", pages=pages).collect()}
    assert {p: (r["kind"], r["reason"]) for p, r in got.items()} == {
        "same": ("unchanged", "no_new_digest_on_day"), "new": ("changed_candidate", "new_digest"),
        "late": ("unchanged", "no_new_digest_on_day"), "gone": ("deletion_candidate", "archive_status_403"),
        "moved": ("unverifiable", "archive_status_301"), "first": ("unverifiable", "no_earlier_capture"),
        "dash": ("unverifiable", "archive_status_-"), "none": ("unverifiable", "no_capture_in_archive"),
    }
    assert (got["new"]["before"]["digest"], got["new"]["after"]["digest"]) == ("D1", "D2")


def test_collapse(spark):
    rows = [("p", "20260801", "200", "A"), ("p", "20260802", "200", "A"), ("p", "20260803", "200", "B"), ("p", "20260804", "200", "A"), ("q", "20260801", "200", "A")]
    assert as_list(cp.collapse_digests(caps(spark, rows)), "page", "timestamp") == [("p", "20260801"), ("p", "20260803"), ("p", "20260804"), ("q", "20260801")]


def test_live_looks_and_rates(spark):
    codes = [404, 200, 403, 451, 500, None, 302, 410, 299]
    df = spark.createDataFrame([(c,) for c in codes], "c int").select(cp.live_class(F.col("c")).alias("live_class"))
    assert [r[0] for r in df.collect()] == ["gone_404", "ok", "botwall", "legal_451", "server_error", "unreachable", "other", "gone_410", "ok"]
    few = spark.createDataFrame([("gone_404",), ("ok",), ("botwall",), ("legal_451",), ("server_error",)], "live_class string")
    r = cp.gone_rate(few).collect()[0]
    assert (r["decided"], r["excluded"], r["gone"]) == (3, 2, 1) and r["gone_low"] < r["gone_rate"] < r["gone_high"]
    empty = cp.gone_rate(few.filter("live_class = 'botwall'")).collect()[0]
    assert empty["gone_rate"] is None and empty["gone_low"] is None


def test_wilson(spark):
    df = spark.createDataFrame([(1, 10), (0, 0), (10, 10)], "k int, n int")
    got = [(round(r[0]["low"], 4), round(r[0]["high"], 4)) for r in df.select(wilson(F.col("k"), F.col("n"))).collect()]
    assert got[:2] == [(0.0179, 0.4042), (0.0, 0.0)] and got[2][1] == 1.0


def test_sample_does_not_depend_on_the_order(spark):
    urls = [("h", f"https://x.test/{n}") for n in range(50)]
    want = sorted(sorted((u for _, u in urls), key=lambda u: hashlib.sha256(f"2026-08-14|{u}".encode()).hexdigest())[:5])
    for rows in (urls, urls[::-1]):
        got = cp.hash_sample(spark.createDataFrame(rows, "g string, url string"), "2026-08-14", group="g")
        assert [r[0] for r in as_list(got, "url")] == want


def test_cap_marks_and_keeps_every_row(spark):
    rows = [("n1", p) for p in range(50)] + [("n2", p) for p in range(3)]
    table = spark.createDataFrame(rows, "night string, pos int")
    assert cp.mark_over_cap(table, night="night", order=["pos"]).filter("over_cap").count() == 0
    got = cp.mark_over_cap(table, night="night", order=["pos"], cap=40)
    assert got.count() == 53 and as_list(got.filter("over_cap"), "night", "pos") == [("n1", p) for p in range(40, 50)]


def test_night_counts(spark):
    kinds = [("unchanged", 15), ("changed", 1), ("unverifiable", 2), ("gone", 1)]
    df = spark.createDataFrame([(k,) for k, n in kinds for _ in range(n)], "class string")
    r = cp.class_rates(df).collect()[0]
    assert (r["examined"], r["decided"], r["changed_rate"]) == (19, 16, 0.0625)


def test_archive_answers(spark):
    bodies = ['[["timestamp","original","statuscode","digest"],["2","u","200","D"],["x"]]', "", "[]", "{broken", '[["h"]]']
    df = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "doc int, body string")
    assert as_list(records.capture_rows(df), "doc", "timestamp", "digest") == [(0, "2", "D")]


def test_answers_are_never_repaired(spark):
    answers = [
        '{"type": "date_shifted", "confidence": "low", "reason": "' + "x" * 200 + '"}', ' {"type": "none"} ', '{"type": "invented"}', "no json", "[1]", "{}", None,
    ]
    got = rp.read_answers(spark.createDataFrame([(n, a) for n, a in enumerate(answers)], "n int, answer string")).orderBy("n").collect()
    assert [r["type"] for r in got] == ["date_shifted", "none", None, None, None, None, None]
    assert [r["error"] for r in got] == [None, None, "out_of_vocabulary", "unparsed", "unparsed", "out_of_vocabulary", "unparsed"]
    assert got[0]["reason"] == "x" * 200 and all(r["estimated"] for r in got)
