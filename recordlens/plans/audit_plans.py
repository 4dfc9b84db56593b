"""Audit queries: committed tables with known defects, each of which must be found.

The defects follow from the data (a country, a level, a value range), so they spread over
the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.operators import audit as au
from recordlens.operators import captures as cp
from recordlens.operators import coverage as cov
from recordlens.operators import drift as dr
from recordlens.operators import reaction as rx
from recordlens.operators import register as reg
from recordlens.operators import verdicts as ver
from recordlens.operators import wording as wd
from recordlens.plans import capture_plans as cpp
from recordlens.plans import coverage_plans as cvp
from recordlens.plans import reaction_plans as rxp
from recordlens.plans import register_plans as rgp
from recordlens.plans import scan_plans as scp
from recordlens.plans import sqltext as q
from recordlens.plans import wording_plans as wdp
from recordlens.plans.tables import day_text, table
from recordlens.session import written


def _text(col: str):
    return F.col(col).cast("string")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as preserved files: some were lost, some overwritten, some never listed."""
    o = table(spark, sf_dir, "orders").withColumn("file", _text("o_orderkey")).withColumn("day", day_text("o_orderdate"))
    entries = o.filter("o_totalprice >= 5000").select(
        "file", F.col("day").alias("run_date"), F.sha2("file", 256).alias("sha256"),
        F.when(F.col("o_orderpriority") != "5-LOW", "u").alias("url"),
    )
    found = F.when(F.col("o_totalprice") > 450000, F.sha2(F.concat("file", F.lit("!")), 256)).otherwise(F.sha2("file", 256))
    files = o.filter("o_orderstatus <> 'P'").select("file", found.alias("sha256"))
    runs = o.filter("o_orderstatus = 'F'").select(F.col("day").alias("run_date")).distinct()
    return au.audit_manifest(entries, files, runs)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rgp.committed(spark, sf_dir)
    cur = reg.register_current(ev, carried=rgp.CARRIED)
    cur = cur.withColumns(
        {
            "status": F.when(F.col("severity") == "Red", "LOST").otherwise(F.col("status")),
            "announced_at": F.when(F.col("hazard") == "flood", "2023-12-31").when(F.col("where") == "zone-0", "").otherwise(F.col("announced_at")),
        }
    )
    lost = ev.withColumn("event", F.when(F.col("event") == "REAPPEARED", "BACK").otherwise(F.col("event")))
    lost = lost.filter(~((F.col("event") == "NOTARIZED") & (F.col("held")["severity"] == "Orange")))
    files = ev.filter("snapshot IS NOT NULL").select(F.col("snapshot").alias("file")).distinct()
    return au.audit_register(cur, lost, files.filter("file NOT LIKE 'click/%'"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rgp.committed(spark, sf_dir)
    cur = reg.register_current(ev, carried=rgp.CARRIED)
    out = ver.verdicts(cur, ev).withColumns(
        {
            "verdict": F.when(F.col("escalated"), "CAME_TRUE").otherwise(F.col("verdict")),
            "resolved_at": F.when(F.col("revisions") == 0, "").otherwise(F.col("resolved_at")),
        }
    )
    known = cur.filter("hazard <> 'flood'").withColumn(
        "status", F.when(F.col("severity") == "Orange", "OPEN").otherwise(F.col("status"))
    )
    files = ev.filter("snapshot IS NOT NULL").select(F.col("snapshot").alias("file")).distinct()
    return au.audit_verdicts(out, known, files.filter("file NOT LIKE 'view/2024-01-1%'"))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers mapped to the code of their balance; suppliers are the issuer's list."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("iso3"), F.floor("c_acctbal").cast("string").alias("fips")
    )
    s = table(spark, sf_dir, "supplier").select(F.floor("s_acctbal").cast("string").alias("code"))
    s = s.unionByName(c.filter("iso3 LIKE '%7'").select(F.col("fips").alias("code")))
    return au.audit_crosswalk(c, s)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = rxp.daily_volume(spark, sf_dir)
    off = F.col("country") == "F7"
    vol = vol.withColumn("articles", F.when(off & (F.col("events") > 12), F.col("articles") + 1).otherwise(F.col("articles")))
    vol = vol.withColumn("events", F.when(F.col("country") == "F9", F.lit(0).cast("bigint")).otherwise(F.col("events")))
    sources = table(spark, sf_dir, "events").groupBy(day_text("ts").alias("day")).agg(
        F.max("props").alias("url"), F.lit("h").alias("sha256"),
        F.count_if(F.col("value") > 300).alias("bytes"),
        F.max(F.when(F.col("value") > 400, "2024-02-01")).alias("retrieved_at"),
    )
    return au.audit_volume(vol, sources)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money on record, with wrong sums and lost rows, against the same derived again from the tables."""
    rec = rxp.order_records(spark, sf_dir)
    again = rx.plan_totals(rec, rxp.plans(spark, sf_dir), rxp.funding(spark, sf_dir)).select(
        "id", "kind", "status", "has_plan_match", "plan_requirements_usd", "plan_funded_usd"
    )
    held = written(again, "readings")
    off = F.col("kind") == "FORECAST"
    committed = held.filter("NOT (status = 'OPEN' AND kind = 'FORECAST' AND has_plan_match)").withColumn(
        "plan_funded_usd", F.when(off, F.col("plan_funded_usd") + 1).otherwise(F.col("plan_funded_usd"))
    )
    recomputed = again.filter("NOT (status <> 'OPEN' AND NOT has_plan_match)")
    return au.compare(committed.drop("kind", "status"), recomputed.drop("kind", "status"), ["id"], "readings")


def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A night's reading with a wrong sum, wrong codes, a wrong median, lost records and a wrong coverage count."""
    rec = written(rxp.order_records(spark, sf_dir), "order-records")
    vol = written(rxp.daily_volume(spark, sf_dir), "volume")
    inputs = (rec, rxp.plans(spark, sf_dir), rxp.funding(spark, sf_dir), rxp.crosswalk(spark, sf_dir), vol)
    days = {"run_date": rxp.READING_DAY, "attention_day": rxp.READING_DAY}
    held = rx.nightly_reading(*inputs, **days)
    late = F.array_contains("iso3", "N4") & (F.col("id") % 5 == 0)
    wrong = held.filter("id % 97 <> 0").withColumns(
        {
            "plan_funded_usd": F.col("plan_funded_usd") + F.when(F.col("kind") == "FORECAST", 1).otherwise(0),
            "fips": F.when(late, F.transform("fips", lambda c: F.regexp_replace(c, "^H", "G"))).otherwise(F.col("fips")),
            "baseline_median": F.col("baseline_median") + F.when(F.col("id") % 7 == 0, 0.5).otherwise(0.0),
        }
    )
    covered = rx.coverage(held).withColumn("with_plan_match", F.col("with_plan_match") - 1)
    return au.audit_reading(wrong, covered, au.reading_again(*inputs, **days))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = written(rxp.user_readings(spark, sf_dir), "user-readings")
    nights = r.filter("articles <> 40").withColumn("pos", F.col("run_date")).withColumn(
        "plan_funded_usd", F.when(F.col("articles") > 250, F.lit(1).cast("bigint")).otherwise(F.col("plan_funded_usd"))
    )
    extra = r.filter("articles > 300").withColumns(
        {"run_date": F.concat(F.lit("2024-02-"), F.substring("run_date", 9, 2)), "pos": F.concat(F.lit("2023-12-"), F.substring("run_date", 9, 2))}
    )
    listed = nights.unionByName(extra)
    measured = rx.reaction_series(r).select(
        "id", F.lit("2024-01-25T03:00:00").alias("resolved_at"), "nights_watched", "peak_date", "money_funded_delta_usd",
        F.when(F.col("money_plan_match"), F.array(F.lit("annual totals"))).otherwise(F.array().cast("array<string>")).alias("limits"),
    )
    return au.audit_series(listed, measured, r)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on record, some lost or changed, against the same derived again from the positions."""
    cells = cvp.grid_counts(spark, sf_dir)
    committed = written(cells, "cells").filter("cell NOT LIKE 'E15%'").withColumn(
        "observed_passes", F.when(F.col("cell").like("E20%"), F.col("observed_passes") + 1).otherwise(F.col("observed_passes"))
    )
    return au.compare(committed, cells.filter("cell NOT LIKE 'E22.5%'"), ["night", "cell"], "coverage")


def coverage_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, figures and the window's row on record, each with a defect, against footprints and positions."""
    sc, acq, cells = cvp._axes(spark, sf_dir)
    cells = written(cells, "cells")
    figures = cov.coverage_figures(cells, sc, acq)
    figures = figures.withColumn("cells_both", F.col("cells_both") + F.when(F.col("night") == "2024-01-03", 1).otherwise(0))
    window = cov.window_figures(cells).withColumns({"discrepancy_median": F.col("discrepancy_median") + 0.01, "declared_sd": F.col("declared_sd") * 2 + 1})
    wrong = cells.filter("cell NOT LIKE 'E15%'").withColumn(
        "observed_passes", F.when(F.col("cell").like("E20%"), F.col("observed_passes") + 1).otherwise(F.col("observed_passes"))
    )
    return au.audit_coverage_night(wrong, figures, window, sc, cvp._places(spark, sf_dir))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived documents of the positions; some kept the vessel's number."""
    p = cov.point_cells(cvp._places(spark, sf_dir))
    body = F.to_json(F.struct("cell", F.when(F.col("cell").isNull(), F.col("vec_id")).alias("MMSI")))
    return au.audit_identities(p.select("vec_id", body.alias("body")), "vec_id", "body")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, current, asked = cvp._drift_inputs(spark, sf_dir)
    held = written(held, "held")
    found = dr.drift(held, current, asked)
    committed = written(found, "findings").filter("NOT (kind = 'changed' AND field = 'online' AND current = 'false')").withColumn(
        "preserved",
        F.when((F.col("kind") == "changed") & (F.col("field") == "modification_date"), F.col("current")).otherwise(F.col("preserved")),
    )
    recomputed = found.filter("NOT (kind = 'gone_from_catalog' AND first_seen > '2024-01-03')")
    return au.audit_drift(committed, recomputed, held)


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded sample that swapped the french pages, against the redrawn one."""
    drawn = cpp.hash_sample(spark, sf_dir).select("host", "url")
    recorded = drawn.withColumn("url", F.when(F.col("url").contains("/fr/"), F.concat("url", F.lit("?x"))).otherwise(F.col("url")))
    return au.compare(recorded, drawn, ["host", "url"], "sample")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = cp.settle_candidates(cpp._classes(spark, sf_dir), cpp.live(spark, sf_dir))
    wrong = (
        F.when(F.col("reason") == "no_earlier_capture", "changed")
        .when(F.col("live_class") == "botwall", "gone")
        .when(F.col("live_class") == "ok", "unchanged")
        .when((F.col("kind") == "unchanged") & F.startswith(_text("page"), F.lit("1")), "gone")
        .when((F.col("kind") == "unchanged") & F.startswith(_text("page"), F.lit("2")), "changed")
        .when((F.col("kind") == "changed_candidate") & F.startswith(_text("page"), F.lit("3")), "unchanged")
        .when(F.col("reason") == "archive_status_500", "odd")
    )
    return au.audit_classes(entries.withColumn("class", F.coalesce(wrong, F.col("class"))))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded gate verdicts that call every challenge page fine."""
    again = wdp.page_gate(spark, sf_dir).select("page_id", "valid", "reason")
    short = F.col("reason").isin("too_short", "consent_boilerplate")
    recorded = written(again, "gates").withColumns(
        {"valid": F.col("valid") | short, "reason": F.when(short, "ok").otherwise(F.col("reason"))}
    )
    return au.compare(recorded, again, ["page_id"], "gate")


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events published with their whole passages."""
    diff = wdp._diff(spark, sf_dir)
    shown = wd.judged(diff).filter(F.size("verdicts") > 0).select("page", "before", "after")
    return au.audit_redaction(shown)


def wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and typed events on record, some wrong, lost or made up, against the texts themselves."""
    pairs = wdp.edited(spark, sf_dir)
    diff = written(wd.sentence_diff(pairs), "diff")
    counts = wd.diff_counts(diff).withColumns(
        {
            "removed_tokens": F.col("removed_tokens") + F.when(F.col("page") % 11 == 0, 1).when(F.col("page") % 101 == 1, 1_000_000).otherwise(0),
            "added_sentences": F.col("added_sentences") + F.when(F.col("page") % 13 == 0, 1).otherwise(0),
        }
    ).filter("page % 17 <> 0")
    made_up = F.when((F.col("type") == "date_shifted") & (F.col("page") % 3 == 0), F.sha2(F.lit("x"), 256)).otherwise(F.col("before_sha256"))
    events = wd.type_events(diff).filter("type <> 'negation_flipped'").withColumn("before_sha256", made_up)
    return au.audit_wording(pairs, counts, events)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by category with a class recounted, a rate and bounds that do not follow."""
    entries = cp.settle_candidates(cpp._classes(spark, sf_dir), cpp.live(spark, sf_dir))
    entries = written(entries.withColumn("category", (F.col("page") % 23).cast("string")), "entries")
    at = lambda n: F.col("category") == str(n)
    recorded = cp.class_rates(entries, ["category"]).withColumns(
        {
            "changed": F.when(at(3), F.col("changed") + 1).otherwise(F.col("changed")),
            "unverifiable_rate": F.when(at(5), F.col("unverifiable_rate") + 0.002).otherwise(F.col("unverifiable_rate")),
            "unverifiable_high": F.when(at(7), F.col("unverifiable_high") + 0.002).otherwise(F.col("unverifiable_high")),
            "unverifiable_low": F.when(at(9), F.col("unverifiable_low") - 0.002).otherwise(F.col("unverifiable_low")),
        }
    )
    return au.audit_rates(entries, recorded, ["category"])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events as answer files, their events as answers."""
    e = table(spark, sf_dir, "events").withColumn("date", day_text("ts"))
    files = e.groupBy("date").agg(
        F.max(F.when(F.col("value") > 350, "m1")).alias("model"),
        (F.count_if(F.col("value") < 60)).cast("int").alias("cap"),
        (F.count_if(F.col("value") > 250) > 0).alias("estimated"),
        F.min(F.when(F.col("value") > 200, F.col("date"))).alias("file_date"),
    )
    kind = F.when(F.col("event_type") == "view", "none_of_these").when(F.col("event_type") == "click", "guess").otherwise("date_shifted")
    items = e.select(
        "date", F.col("event_id").alias("pos"), kind.alias("type"), (F.col("value") > 2).alias("estimated"),
        F.sha2("props", 256).alias("before_sha256"),
    )
    abstained = e.filter("event_type <> 'error'").select("date", F.sha2("props", 256).alias("before_sha256"))
    with_reading = e.filter("value > 180").select("date")
    return au.audit_answers(files, items, abstained, with_reading)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifests, customers' orders as ledger lines and proofs."""
    o = table(spark, sf_dir, "orders").withColumn("manifest", _text("o_orderkey"))
    digest = F.sha2("manifest", 256)
    manifests = o.filter("o_totalprice < 480000").select("manifest", digest.alias("sha256"))
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("unstamped")
    lines = o.filter("o_totalprice > 20000").select(
        "manifest", F.when(F.col("o_orderpriority") == "1-URGENT", F.sha2("o_orderpriority", 256)).otherwise(digest).alias("sha256"),
        state.alias("state"), F.concat("manifest", F.lit(".ots")).alias("proof"),
        F.concat(F.lit("block(s) "), F.floor("o_totalprice").cast("string")).alias("evidence"),
    )
    proofs = o.filter("o_orderpriority <> '2-HIGH'").select(F.concat("manifest", F.lit(".ots")).alias("proof"), "manifest")
    proofs = proofs.union(o.filter("o_orderkey % 50 = 0").select(F.concat("manifest", F.lit(".ots.bak")), "manifest"))
    return au.audit_ledger(lines, manifests, proofs, {"complete": 1, "pending": 2})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = written(scp.log_scan(spark, sf_dir).withColumnRenamed("day", "file"), "log-entries")
    runs = table(spark, sf_dir, "orders").select(day_text("o_orderdate").alias("run_date")).unionByName(
        table(spark, sf_dir, "events").select(day_text("ts").alias("run_date"))
    )
    return au.audit_log(lines, runs, "purchase")


# --- the same in SQL ---------------------------------------------------------


def _rows(check: str, parts: list[tuple[str, str, str]]) -> str:
    """UNION of (subject expression, problem, FROM ... WHERE ...)."""
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", CAST({s} AS VARCHAR) AS subject, '{p}' AS problem {f}" for s, p, f in parts
    )


QUERIES = {
    "audit_manifest": manifest,
    "audit_register": register,
    "audit_verdicts": verdicts,
    "audit_crosswalk": crosswalk,
    "audit_volume": volume,
    "audit_readings": readings,
    "audit_reading": reading,
    "audit_series": series,
    "audit_coverage": coverage,
    "audit_coverage_night": coverage_night,
    "audit_identities": identities,
    "audit_drift": drift,
    "audit_sample": sample,
    "audit_classes": classes,
    "audit_gates": gates,
    "audit_redaction": redaction,
    "audit_wording": wording,
    "audit_rates": rates,
    "audit_answers": answers,
    "audit_ledger": ledger,
    "audit_log": log,
}

_BASE = rgp.BASE

ORACLES = {
    "audit_manifest": """
      WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS f, strftime(o_orderdate, '%Y-%m-%d') AS day, * FROM orders) """
    + _rows("manifest", [
        ("f", "file is missing", "FROM o WHERE o_totalprice >= 5000 AND o_orderstatus = 'P'"),
        ("f", "bytes do not match the manifest", "FROM o WHERE o_totalprice > 450000 AND o_orderstatus <> 'P'"),
        ("f", "file is not in any manifest", "FROM o WHERE o_totalprice < 5000 AND o_orderstatus <> 'P'"),
        ("f", "entry without url", "FROM o WHERE o_totalprice >= 5000 AND o_orderpriority = '5-LOW'"),
        ("day", "night without a run record",
         "FROM (SELECT DISTINCT day FROM o WHERE o_totalprice >= 5000) WHERE day NOT IN (SELECT day FROM o WHERE o_orderstatus = 'F')"),
    ]),
    "audit_register": _BASE + """
      , t AS (SELECT *, CASE WHEN severity = 'Red' THEN 'LOST' ELSE status END AS st,
        CASE WHEN hazard = 'flood' THEN '2023-12-31' WHEN "where" = 'zone-0' THEN '' ELSE announced_at END AS ann FROM reg),
      l AS (SELECT id, CASE WHEN event = 'REAPPEARED' THEN 'BACK' ELSE event END AS event, run_date, phase, step, snapshot FROM ev
            WHERE NOT (event = 'NOTARIZED' AND severity = 'Orange')),
      f AS (SELECT id, arg_min(event, run_date || phase || step) AS fe, min(run_date) AS fa FROM l GROUP BY id),
      j AS (SELECT t.*, f.fe, f.fa FROM t LEFT JOIN f ON f.id = t.id) """
    + _rows("register", [
        ("id", "illegal status", "FROM j WHERE st = 'LOST'"),
        ("id", "empty history", "FROM j WHERE fe IS NULL"),
        ("id", "history does not begin with NOTARIZED", "FROM j WHERE fe <> 'NOTARIZED'"),
        ("id", "missing announced_at", "FROM j WHERE ann = ''"),
        ("id", "announced_at diverges from the first event", "FROM j WHERE ann <> '' AND ann <> fa"),
        ("id", "unknown event", "FROM l WHERE event = 'BACK'"),
        ("id", "anchor is not in a manifest", "FROM (SELECT DISTINCT id, snapshot FROM l WHERE snapshot LIKE 'click/%')"),
    ]),
    "audit_verdicts": _BASE + rgp._VERDICT_SQL + """
      , k AS (SELECT v.*, r.severity, r.hazard FROM verd v JOIN reg r ON r.id = v.id) """
    + _rows("verdicts", [
        ("id", "unknown record", "FROM k WHERE hazard = 'flood'"),
        ("id", "record is still open", "FROM k WHERE hazard <> 'flood' AND severity = 'Orange'"),
        ("id", "illegal verdict", "FROM k WHERE escalated"),
        ("id", "missing resolved_at", "FROM k WHERE revisions = 0"),
        ("id", "evidence is not in a manifest", "FROM k WHERE evidence LIKE '%view/2024-01-1%'"),
    ]),
    "audit_crosswalk": """
      WITH c AS (SELECT DISTINCT c_name AS iso3, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS fips FROM customer),
      s AS (SELECT CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS code FROM supplier
            UNION SELECT fips FROM c WHERE iso3 LIKE '%7') """
    + _rows("crosswalk", [
        ("iso3", "code is not on the issuer''s list", "FROM c WHERE fips NOT IN (SELECT code FROM s)"),
        ("fips", "code is mapped from several countries", "FROM c GROUP BY fips HAVING count(*) > 1"),
    ]),
    "audit_volume": "WITH " + rxp._VOLUME + """
      , t AS (SELECT day, scope, country, CASE WHEN country = 'F9' THEN 0 ELSE events END AS events, mentions,
          CASE WHEN country = 'F7' AND events > 12 THEN articles + 1 ELSE articles END AS articles FROM vol),
      s AS (SELECT day, sum(events) FILTER (scope = 'world') AS we, sum(events) FILTER (scope <> 'world') AS se,
        sum(articles) FILTER (scope = 'world') AS wa, sum(articles) FILTER (scope <> 'world') AS sa,
        sum(mentions) FILTER (scope = 'world') AS wm, sum(mentions) FILTER (scope <> 'world') AS sm FROM t GROUP BY day),
      r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (value > 300) AS b, count(*) FILTER (value > 400) AS g FROM events GROUP BY 1) """
    + _rows("volume", [
        ("day", "world events is not the sum over countries", "FROM s WHERE we <> se"),
        ("day", "world articles is not the sum over countries", "FROM s WHERE wa <> sa"),
        ("day", "world mentions is not the sum over countries", "FROM s WHERE wm <> sm"),
        ("day", "source reference without bytes", "FROM r WHERE b = 0"),
        ("day", "source reference without retrieved_at", "FROM r WHERE g = 0"),
    ]),
    "audit_readings": rxp._RECORDS + _rows("readings", [
        ("id", "missing from the record", "FROM money WHERE status = 'OPEN' AND kind = 'FORECAST' AND has_plan_match"),
        ("id", "not in the recomputation", "FROM money WHERE status <> 'OPEN' AND NOT has_plan_match"),
        ("id", "plan_funded_usd differs", "FROM money WHERE kind = 'FORECAST' AND NOT (status = 'OPEN' AND has_plan_match) AND NOT (status <> 'OPEN' AND NOT has_plan_match)"),
    ]),
    "audit_reading": "WITH due AS (" + rxp.ORACLES["nightly_reading"] + """),
      r AS (SELECT due.*, o.o_orderpriority = '5-LOW' AS forecast, ',' || iso3 || ',' LIKE '%,N4,%' AND id % 5 = 0
              AND ',' || fips LIKE '%,H%' AS late FROM due JOIN orders o ON o.o_orderkey = due.id) """
    + _rows("reading", [
        ("id", "missing from the record", "FROM r WHERE id % 97 = 0"),
        ("id", "plan_funded_usd differs", "FROM r WHERE id % 97 <> 0 AND forecast"),
        ("id", "fips differs", "FROM r WHERE id % 97 <> 0 AND late"),
        ("id", "baseline_median differs", "FROM r WHERE id % 97 <> 0 AND id % 7 = 0 AND baseline_median IS NOT NULL"),
        ("'coverage'", "plan matches miscounted", "FROM r HAVING count(*) > 0"),
    ]),
    "audit_series": rxp._READINGS + """
      , listed AS (SELECT id, run_date, run_date AS pos, articles, ratio_to_baseline, has_plan_match, plan_requirements_usd,
          CASE WHEN articles > 250 THEN 1 ELSE plan_funded_usd END AS plan_funded_usd FROM readings WHERE articles <> 40
        UNION ALL SELECT id, '2024-02-' || right(run_date, 2), '2023-12-' || right(run_date, 2), articles, ratio_to_baseline, has_plan_match, plan_requirements_usd, plan_funded_usd
          FROM readings WHERE articles > 300),
      summary AS (SELECT id, count(*) AS n, arg_max(run_date, (ratio_to_baseline, run_date)) FILTER (ratio_to_baseline IS NOT NULL) AS peak,
          arg_max(plan_funded_usd, run_date) FILTER (has_plan_match AND plan_funded_usd IS NOT NULL)
          - arg_min(plan_funded_usd, run_date) FILTER (has_plan_match AND plan_funded_usd IS NOT NULL) AS delta,
          coalesce(bool_or(has_plan_match AND plan_funded_usd IS NOT NULL), false) AS matched FROM readings GROUP BY id),
      again AS (SELECT id, count(*) AS n, arg_max(run_date, (ratio_to_baseline, run_date)) FILTER (ratio_to_baseline IS NOT NULL) AS peak,
          arg_max(plan_funded_usd, run_date) FILTER (has_plan_match AND plan_funded_usd IS NOT NULL)
          - arg_min(plan_funded_usd, run_date) FILTER (has_plan_match AND plan_funded_usd IS NOT NULL) AS delta FROM listed GROUP BY id),
      m AS (SELECT s.*, a.n AS an, a.peak AS apeak, a.delta AS adelta FROM summary s LEFT JOIN again a ON a.id = s.id),
      turned AS (SELECT id, run_date < lag(run_date) OVER (PARTITION BY id ORDER BY pos) AS bad FROM listed) """
    + _rows("series", [
        ("id || '/' || run_date", "a watched night is missing", "FROM readings WHERE articles = 40 AND run_date < '2024-01-25'"),
        ("id || '/' || run_date", "night is in no reading", "FROM listed WHERE run_date LIKE '2024-02-%'"),
        ("id || '/' || run_date", "plan_funded_usd is not what the reading says",
         "FROM readings WHERE articles > 250 AND plan_funded_usd IS DISTINCT FROM 1"),
        ("id", "nights are out of order", "FROM (SELECT DISTINCT id FROM turned WHERE bad)"),
        ("id", "no nights", "FROM m WHERE an IS NULL"),
        ("id", "nights_watched is wrong", "FROM m WHERE n <> an"),
        ("id", "peak is not the loudest night", "FROM m WHERE apeak IS NOT NULL AND peak IS DISTINCT FROM apeak"),
        ("id", "money delta does not follow", "FROM m WHERE an IS NOT NULL AND delta IS DISTINCT FROM adelta"),
        ("id", "series without its limits", "FROM m WHERE NOT matched"),
    ]),
    "audit_coverage": cvp._PLACES + _rows("coverage", [
        ("night || '/' || cell", "missing from the record", "FROM both_axes WHERE cell LIKE 'E15%'"),
        ("night || '/' || cell", "not in the recomputation", "FROM both_axes WHERE cell LIKE 'E22.5%'"),
        ("night || '/' || cell", "observed_passes differs", "FROM both_axes WHERE cell LIKE 'E20%'"),
    ]),
    "audit_coverage_night": cvp._PLACES + _rows("coverage", [
        ("night || '/' || cell", "missing from the record", "FROM both_axes WHERE cell LIKE 'E15%'"),
        ("night || '/' || cell", "observed_passes differs", "FROM both_axes WHERE cell LIKE 'E20%'"),
    ]) + " UNION ALL SELECT 'figures', '2024-01-03', 'cells_both differs' UNION ALL SELECT 'window', 'discrepancy', 'median differs' UNION ALL SELECT 'window', 'declared', 'sd differs'",
    "audit_identities": cvp._PLACES + _rows("identities", [
        ("vec_id", "an identity leaked into a derived record", "FROM pc WHERE cell IS NULL"),
    ]),
    "audit_drift": cvp._PRODUCTS + _rows("drift", [
        ("id || '/changed/online'", "missing from the record", "FROM found WHERE kind = 'changed' AND field = 'online' AND current = 'false'"),
        ("id || '/gone_from_catalog/'", "not in the recomputation", "FROM found WHERE kind = 'gone_from_catalog' AND first_seen > '2024-01-03'"),
        ("id || '/' || field", "preserved value is not the one held", "FROM found WHERE kind = 'changed' AND field = 'modification_date'"),
    ]),
    "audit_sample": "WITH drawn AS (" + cpp.ORACLES["hash_sample"] + ") " + _rows("sample", [
        ("host || '/' || url", "missing from the record", "FROM drawn WHERE url LIKE '%/fr/%'"),
        ("host || '/' || url || '?x'", "not in the recomputation", "FROM drawn WHERE url LIKE '%/fr/%'"),
    ]),
    "audit_classes": cpp._CLASSES + """
      , w AS (SELECT page, kind, live_class, CASE WHEN reason = 'no_earlier_capture' THEN 'changed' WHEN live_class = 'botwall' THEN 'gone'
          WHEN live_class = 'ok' THEN 'unchanged' WHEN kind = 'unchanged' AND CAST(page AS VARCHAR) LIKE '1%' THEN 'gone'
          WHEN kind = 'unchanged' AND CAST(page AS VARCHAR) LIKE '2%' THEN 'changed'
          WHEN kind = 'changed_candidate' AND CAST(page AS VARCHAR) LIKE '3%' THEN 'unchanged'
          WHEN reason = 'archive_status_500' THEN 'odd' ELSE class END AS c FROM settled) """
    + _rows("classes", [
        ("page", "called gone without a live look saying so", "FROM w WHERE kind = 'deletion_candidate' AND c = 'gone' AND live_class NOT IN ('gone_404', 'gone_410')"),
        ("page", "a candidate ended neither gone nor unverifiable", "FROM w WHERE kind = 'deletion_candidate' AND c NOT IN ('gone', 'unverifiable')"),
        ("page", "gone without a candidate in the history", "FROM w WHERE kind <> 'deletion_candidate' AND c = 'gone'"),
        ("page", "no new digest that day, yet not unchanged", "FROM w WHERE kind = 'unchanged' AND c NOT IN ('unchanged', 'gone')"),
        ("page", "a new digest that day, yet unchanged", "FROM w WHERE kind = 'changed_candidate' AND c = 'unchanged'"),
        ("page", "changed on an unverifiable history", "FROM w WHERE kind = 'unverifiable' AND c = 'changed'"),
        ("page", "unknown class", "FROM w WHERE c = 'odd'"),
    ]),
    "audit_gates": "WITH g AS (" + wdp.ORACLES["page_gate"] + ") " + _rows("gate", [
        ("page_id", "valid differs", "FROM g WHERE reason IN ('too_short', 'consent_boilerplate')"),
        ("page_id", "reason differs", "FROM g WHERE reason IN ('too_short', 'consent_boilerplate')"),
    ]),
    "audit_redaction": wdp._JUDGED + _rows("redaction", [
        ("page", "a passage with an ascription is published as text", "FROM scored WHERE len(verdicts) > 0 AND redact"),
    ]),
    "audit_wording": wdp._JUDGED + f"""
      , per AS (SELECT page, s, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS a, min(idx) FILTER (side = 0) AS bi, min(idx) FILTER (side = 1) AS ai
        FROM sent GROUP BY page, s),
      turn AS (SELECT page, b > 1 OR a > 1 OR coalesce(ai < lag(ai) OVER (PARTITION BY page ORDER BY bi), false) AS odd FROM per WHERE a > 0 AND b > 0),
      plain AS (SELECT page FROM lists WHERE page NOT IN (SELECT page FROM turn WHERE odd) AND len(bs) + len(as_) > 0),
      k AS (SELECT page, CAST(coalesce(sum({q.token_count('before')}) FILTER (op = 'removed'), 0) AS BIGINT) AS removed,
        count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'rewritten') AS pairs FROM diff GROUP BY page),
      r AS (SELECT page, removed, added, pairs, removed + CASE WHEN page % 11 = 0 THEN 1 WHEN page % 101 = 1 THEN 1000000 ELSE 0 END AS rt,
        added + CASE WHEN page % 13 = 0 THEN 1 ELSE 0 END AS ra FROM k),
      h AS (SELECT page, coalesce(list_sum(list_transform(bs, lambda x: {q.token_count('x')})), 0) AS tokens, len(bs) AS old, len(as_) AS new FROM lists),
      e AS (SELECT page, unnest(verdicts).type AS type, sha256(before) AS sha FROM scored),
      m AS (SELECT page, type, CASE WHEN type = 'date_shifted' AND page % 3 = 0 THEN sha256('x') ELSE sha END AS sha FROM e WHERE type <> 'negation_flipped'),
      de AS (SELECT page, type, sha, count(*) AS n FROM e GROUP BY ALL), dm AS (SELECT page, type, sha, count(*) AS n FROM m GROUP BY ALL),
      j AS (SELECT coalesce(dm.page, de.page) AS page, coalesce(dm.type, de.type) AS type, coalesce(dm.sha, de.sha) AS sha, dm.n AS mn, de.n AS en
        FROM dm FULL JOIN de ON dm.page = de.page AND dm.type = de.type AND dm.sha = de.sha) """
    + _rows("wording", [
        ("page", "missing from the record", "FROM k WHERE page IN (SELECT page FROM plain) AND page % 17 = 0"),
        ("page", "removed_tokens differs", "FROM r WHERE page IN (SELECT page FROM plain) AND page % 17 <> 0 AND rt <> removed"),
        ("page", "added_sentences differs", "FROM r WHERE page IN (SELECT page FROM plain) AND page % 17 <> 0 AND ra <> added"),
        ("r.page", "more tokens removed than there were", "FROM r JOIN h ON h.page = r.page WHERE r.page NOT IN (SELECT page FROM plain) AND r.page % 17 <> 0 AND rt > tokens"),
        ("r.page", "more sentences added than there are", "FROM r JOIN h ON h.page = r.page WHERE r.page NOT IN (SELECT page FROM plain) AND r.page % 17 <> 0 AND ra + pairs > new"),
        ("page || '/' || type || '/' || sha", "missing from the record", "FROM j WHERE page IN (SELECT page FROM plain) AND mn IS NULL"),
        ("page || '/' || type || '/' || sha", "not in the recomputation", "FROM j WHERE page IN (SELECT page FROM plain) AND en IS NULL"),
        ("page || '/' || type || '/' || sha", "times differs", "FROM j WHERE page IN (SELECT page FROM plain) AND mn <> en"),
        ("page", "an event on a sentence the page did not hold", "FROM (SELECT DISTINCT page FROM m WHERE sha = sha256('x'))"),
    ]),
    "audit_rates": cpp._CLASSES + """
      , c AS (SELECT page % 23 AS cat, class, count(*) AS n FROM settled GROUP BY ALL) """
    + _rows("rates", [
        ("cat", "changed differs", "FROM c WHERE cat = 3 GROUP BY cat"),
        ("cat", "decided is not unchanged and changed", "FROM c WHERE cat = 3 GROUP BY cat"),
        ("cat", "changed rate does not follow", "FROM c WHERE cat = 3 GROUP BY cat HAVING sum(n) FILTER (class IN ('unchanged', 'changed')) > 0"),
        ("cat", "changed low is no bound of the interval", "FROM c WHERE cat = 3 GROUP BY cat HAVING sum(n) FILTER (class IN ('unchanged', 'changed')) > 0"),
        ("cat", "changed high is no bound of the interval", "FROM c WHERE cat = 3 GROUP BY cat HAVING sum(n) FILTER (class IN ('unchanged', 'changed')) > 0"),
        ("cat", "unverifiable rate does not follow", "FROM c WHERE cat = 5 GROUP BY cat"),
        ("cat", "unverifiable high is no bound of the interval", "FROM c WHERE cat = 7 GROUP BY cat"),
        ("cat", "unverifiable low is no bound of the interval", "FROM c WHERE cat = 9 GROUP BY cat"),
    ]),
    "audit_answers": """
      WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date FROM events),
      f AS (SELECT date, count(*) AS n, count(*) FILTER (value > 350) AS m, count(*) FILTER (value < 60) AS cap,
        count(*) FILTER (value > 250) AS est, count(*) FILTER (value > 200) AS named, count(*) FILTER (value > 180) AS r FROM e GROUP BY date),
      i AS (SELECT * FROM e WHERE date IN (SELECT date FROM f WHERE r > 0)) """
    + _rows("answers", [
        ("date", "date disagrees with the file name", "FROM f WHERE named = 0"),
        ("date", "no reading to annotate", "FROM f WHERE r = 0"),
        ("date", "not labelled estimated", "FROM f WHERE est = 0"),
        ("date", "no model named", "FROM f WHERE m = 0"),
        ("date", "more answers than the cap", "FROM f WHERE n > cap"),
        ("date || '/' || event_id", "answer not labelled estimated", "FROM i WHERE value <= 2"),
        ("date || '/' || event_id", "unknown type", "FROM i WHERE event_type = 'click'"),
        ("date || '/' || event_id", "no matching abstention",
         "FROM i WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.date = i.date AND x.props = i.props AND x.event_type <> 'error')"),
    ]),
    "audit_ledger": """
      WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS f, *, o_totalprice > 20000 AS listed, o_totalprice < 480000 AS here FROM orders) """
    + _rows("ledger", [
        ("f", "ledger omits this manifest", "FROM o WHERE here AND NOT listed"),
        ("f", "manifest is gone", "FROM o WHERE listed AND NOT here"),
        ("f", "digest diverges from the bytes", "FROM o WHERE listed AND here AND o_orderpriority = '1-URGENT'"),
        ("f", "proof is missing", "FROM o WHERE listed AND o_orderstatus IN ('F', 'O') AND o_orderpriority = '2-HIGH'"),
        ("f", "complete without a named block", "FROM o WHERE listed AND o_orderstatus = 'F' AND o_totalprice < 100000"),
        ("f || '.ots'", "orphan proof", "FROM o WHERE NOT here AND o_orderpriority <> '2-HIGH'"),
        ("f || '.ots.bak'", "backup left among the proofs", "FROM o WHERE o_orderkey % 50 = 0"),
        ("'ledger'", "count of complete is wrong", "FROM o WHERE listed AND o_orderstatus = 'F' HAVING count(*) <> 1"),
        ("'ledger'", "count of pending is wrong", "FROM o WHERE listed AND o_orderstatus = 'O' HAVING count(*) <> 2"),
    ]),
    "audit_log": "WITH l AS (" + scp.ORACLES["log_scan"] + ") " + _rows("log", [
        ("day || ':' || line_no", "unparseable line", "FROM l WHERE unparseable"),
        ("d", "run without a log entry",
         "FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders UNION SELECT strftime(ts, '%Y-%m-%d') FROM events) "
         "WHERE d NOT IN (SELECT run_date FROM l WHERE step = 'purchase')"),
    ]),
}
