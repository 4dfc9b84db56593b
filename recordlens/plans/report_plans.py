"""Reports over the register of `register_plans` and over readings derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import sinks
from recordlens.functions.rates import share
from recordlens.operators import register as reg
from recordlens.operators import reports as rp
from recordlens.operators import verdicts as ver
from recordlens.plans import register_plans as rgp
from recordlens.plans.register_plans import BASE, LAST_NIGHT
from recordlens.plans.reaction_plans import funding, order_records, plans
from recordlens.plans.reaction_plans import _RECORDS as RECORDS_SQL
from recordlens.operators.reaction import plan_totals
from recordlens.plans.tables import day_text, table

FIRST_NIGHT = "2024-01-01"


def _parts(spark, sf_dir):
    """Events, current table with first window end and public state, verdicts."""
    ev = rgp.committed(spark, sf_dir)
    cur = reg.register_current(ev, carried=rgp.CARRIED).join(reg.window_at_first_sight(ev), "id")
    state = reg.public_state(
        F.col("status"), F.col("window")["to"], F.col("first_to"), F.col("announced_at"), F.lit(LAST_NIGHT)
    )
    cur = cur.withColumn("state", state)
    return ev, cur, ver.verdicts(cur, ev)


def _moments(spark, sf_dir) -> DataFrame:
    ev, cur, verdicts = _parts(spark, sf_dir)
    return rp.moments(ev, cur, verdicts, first_night=FIRST_NIGHT)


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir)


def moments_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.moment_feed(_moments(spark, sf_dir)).select("id", "occurred_at", "mode")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve newest register events."""
    ev = rgp.fold(spark, sf_dir)
    return rp.newest(ev.select("id", "run_date", "event"), ["run_date", "id", "event"], 12)


def newest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen newest days with their volume."""
    days = table(spark, sf_dir, "events").groupBy(day_text("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return rp.newest(days, ["day"], 14)


def register_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cur, verdicts = _parts(spark, sf_dir)
    e = table(spark, sf_dir, "events").withColumn("night", day_text("ts"))
    probes = e.groupBy("night").agg(F.count(F.lit(1)).alias("answered"), F.count_if(F.col("value") > 300).alias("catches"))
    own = e.select("night", F.lit(None).cast("string").alias("register"))
    others = table(spark, sf_dir, "orders").select(day_text("o_orderdate").alias("night"), F.when(F.col("o_orderstatus") == "F", "coverage").otherwise("wording").alias("register"))
    return rp.register_figures(cur, verdicts, own.union(others), probes, as_of=LAST_NIGHT)


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.composition(rgp.current(spark, sf_dir))


def severity_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.severity_splits(rgp.current(spark, sf_dir))


def severity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.severity_cube(rgp.current(spark, sf_dir))


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of nights on which a user was quiet or busy."""
    e = table(spark, sf_dir, "events").groupBy("user_id", day_text("ts").alias("night")).agg(F.count(F.lit(1)).alias("n"))
    nights = e.select("user_id", "night", F.when(F.col("n") > 2, "busy").otherwise("quiet").alias("state"))
    return rp.state_runs(nights, key="user_id", night="night", state="state")


def idle_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, verdicts = _parts(spark, sf_dir)
    return rp.idle_sensor(verdicts, needed=10)


def plan_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that ask for more than a fifteenth of what their nations hold: the gap is what the others leave."""
    rec, money = order_records(spark, sf_dir), funding(spark, sf_dir)
    asking = plans(spark, sf_dir).join(money, "plan_id", "left").filter(
        F.coalesce("requirements_usd", F.lit(0)) * 15 > F.coalesce("funded_usd", F.lit(0))
    )
    return rp.plan_gap(plan_totals(rec, asking.drop("funded_usd"), money))


def night_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the match rate of the nights that have a reading: those with an even number of events."""
    ev, _, verdicts = _parts(spark, sf_dir)
    e = table(spark, sf_dir, "events").groupBy(day_text("ts").alias("run_date")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 35).alias("m"))
    return rp.night_table(ev, verdicts, e.filter("n % 2 = 0").select("run_date", share(F.col("m"), F.col("n"), 4).alias("match_rate")))


def hazard_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.hazard_listing(rgp.current(spark, sf_dir)).select("id", "hazard", "group_size")


def featured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cur, _ = _parts(spark, sf_dir)
    return rp.featured(cur, LAST_NIGHT).select("id", F.col("rank").cast("bigint").alias("rank"), "window_to")


def unverifiable_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lost = F.when(F.col("value") < 30, "unverifiable").otherwise("changed")
    return rp.unverifiable_by_category(e.select(F.col("event_type").alias("category"), lost.alias("class")))


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    digest = F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("/"), k), 256)
    typed = e.select(
        day_text("ts").alias("night"), F.col("user_id").alias("page"), F.col("event_type").alias("type"),
        F.when(F.col("value") > 100, "E").otherwise("A").alias("category"), digest.alias("before_sha256"),
    )
    entries = e.select(F.when(F.col("value") < 30, "unverifiable").otherwise("changed").alias("class"))
    answers = e.select(digest.alias("before_sha256"), F.when(F.col("value") > 5, F.col("event_type")).alias("type"))
    return rp.acceptance(typed, entries, answers)


# --- the same in SQL ---------------------------------------------------------

_STATE = f"""
, st AS (SELECT *, CASE WHEN status = 'OPEN' THEN CASE WHEN left(window_to, 10) >= '{LAST_NIGHT}' THEN 'window_open'
    WHEN left(first_to, 19) < left(announced_at, 19) THEN 'cold_start' ELSE 'drift' END END AS state FROM reg)
"""

_MOMENTS = BASE + rgp._VERDICT_SQL + f"""
, m AS (
  SELECT e.id, e.run_date AS occurred_at, CASE event WHEN 'REVISED' THEN 'revision' WHEN 'CLOSED_BY_SOURCE' THEN 'closure'
      WHEN 'DISSIPATED' THEN 'dissipation' WHEN 'REAPPEARED' THEN 'reappearance' ELSE 'notarization' END AS mode,
    CASE WHEN event = 'REVISED' THEN CASE date_diff('day', CAST(r.announced_at AS DATE), CAST(e.run_date AS DATE)) WHEN 1 THEN '24 hours'
      ELSE date_diff('day', CAST(r.announced_at AS DATE), CAST(e.run_date AS DATE)) || ' days' END END AS span,
    coalesce(e.snapshot, 'register') AS evidence, r.what AS subject
  FROM ev e JOIN reg r ON r.id = e.id
  WHERE NOT (event = 'NOTARIZED' AND (e.run_date <= '{FIRST_NIGHT}' OR (r.status = 'OPEN' AND left(r.window_to, 19) < e.run_date)))
  UNION ALL
  SELECT v.id, r.last_event_at, 'resolution', NULL, 'verdicts/' || v.id, r.what FROM verd v JOIN reg r ON r.id = v.id)
"""

QUERIES = {
    "moments": moments,
    "moments_top100": moments_top100,
    "latest_events": latest_events,
    "newest_days": newest_days,
    "register_figures": register_figures,
    "composition": composition,
    "severity_splits": severity_splits,
    "severity_cube": severity_cube,
    "state_runs": state_runs,
    "idle_sensor": idle_sensor,
    "plan_gap": plan_gap,
    "night_table": night_table,
    "hazard_listing": hazard_listing,
    "featured_records": featured_records,
    "acceptance": acceptance,
    "unverifiable_by_category": unverifiable_by_category,
}

ORACLES = {
    "unverifiable_by_category": """SELECT event_type AS category, count(*) AS entries, count(*) FILTER (value < 30) AS unverifiable,
      round_even((count(*) FILTER (value < 30) / count(*)) * 10000, 0) / 10000 AS unverifiable_share FROM events GROUP BY 1""",
    "moments": _MOMENTS + "SELECT * FROM m",
    "moments_top100": _MOMENTS + "SELECT id, occurred_at, mode FROM m ORDER BY occurred_at DESC, id DESC, mode DESC LIMIT 100",
    "latest_events": BASE + "SELECT id, run_date, event FROM ev ORDER BY run_date DESC, id DESC, event DESC LIMIT 12",
    "newest_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14",
    "register_figures": BASE + _STATE + rgp._VERDICT_SQL + f"""
      , p AS (SELECT count(*) AS answered, count(*) FILTER (value > 300) AS catches, count(DISTINCT CAST(ts AS DATE)) AS nights FROM events),
      f AS (
        SELECT CASE o_orderstatus = 'F' WHEN true THEN 'coverage' ELSE 'wording' END || '_nights_on_record' AS key, count(DISTINCT o_orderdate) AS value FROM orders GROUP BY 1
        UNION ALL SELECT 'futures_under_watch', count(*) FILTER (status = 'OPEN') AS value FROM st
        UNION ALL SELECT 'futures_window_open', count(*) FILTER (state = 'window_open') FROM st
        UNION ALL SELECT 'futures_cold_start', count(*) FILTER (state = 'cold_start') FROM st
        UNION ALL SELECT 'futures_drift', count(*) FILTER (state = 'drift') FROM st
        UNION ALL SELECT 'futures_notarized_total', count(*) FROM st
        UNION ALL SELECT 'sources_in_register', count(DISTINCT source) FROM st
        UNION ALL SELECT 'futures_resolved', count(*) FROM verd
        UNION ALL SELECT 'futures_resolved_under_watch', count(*) FILTER (NOT cold_start) FROM verd
        UNION ALL SELECT 'materialized', count(*) FILTER (verdict = 'MATERIALIZED_AS_ALERT') FROM verd
        UNION ALL SELECT 'nights_on_record', nights FROM p
        UNION ALL SELECT 'continuity_rechecks', answered FROM p
        UNION ALL SELECT 'continuity_divergences', catches FROM p
        UNION ALL SELECT 'futures_notarized_' || source, count(*) FROM st GROUP BY source)
      SELECT *, '{LAST_NIGHT}' AS as_of FROM f""",
    "composition": BASE + """SELECT 'source' AS dimension, source AS name, count(*) AS n FROM reg GROUP BY source
      UNION ALL SELECT 'hazard', hazard, count(*) FROM reg GROUP BY hazard""",
    "severity_splits": BASE + """, c AS (SELECT hazard, count(*) AS n, count(*) FILTER (severity IN ('Red', 'Extreme')) AS top,
        count(*) FILTER (w_from = window_to) AS instant FROM reg GROUP BY hazard)
      SELECT *, round_even(top / n * 10000, 0) / 10000 AS top_rate, round_even(instant / n * 10000, 0) / 10000 AS instant_rate FROM c""",
    "severity_cube": BASE + "SELECT hazard, severity, count(*) AS n FROM reg GROUP BY CUBE (hazard, severity)",
    "state_runs": """
      WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS night, CASE WHEN count(*) > 2 THEN 'busy' ELSE 'quiet' END AS state FROM events GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY night) - row_number() OVER (PARTITION BY user_id, state ORDER BY night) AS g FROM e)
      SELECT user_id, state, min(night) AS first_night, max(night) AS last_night, count(*) AS nights FROM r GROUP BY user_id, state, g""",
    "idle_sensor": BASE + rgp._VERDICT_SQL + """SELECT count(*) AS verdicts, count(*) FILTER (verdict = 'MATERIALIZED_AS_ALERT') AS materialized,
      count(*) >= 10 AND count(*) FILTER (verdict = 'MATERIALIZED_AS_ALERT') = 0 AS fired FROM verd""",
    "plan_gap": RECORDS_SQL.replace("JOIN plan p ON", "JOIN plan p ON p.req * 15 > p.fund AND") + """SELECT has_plan_match, count(DISTINCT code) AS countries
      FROM (SELECT has_plan_match, unnest(iso3) AS code FROM money) GROUP BY has_plan_match""",
    "night_table": BASE + rgp._VERDICT_SQL + """
      , n AS (SELECT run_date, count(*) FILTER (event = 'NOTARIZED') AS notarized, count(*) FILTER (event = 'REVISED') AS revised,
        count(*) FILTER (event IN ('CLOSED_BY_SOURCE', 'DISSIPATED')) AS closed, count(*) FILTER (event = 'REAPPEARED') AS reopened FROM ev GROUP BY run_date),
      v AS (SELECT r.last_event_at AS night, count(*) AS k FROM verd JOIN reg r ON r.id = verd.id GROUP BY 1)
      SELECT n.*, coalesce(v.k, 0) AS resolved, q.match_rate FROM n LEFT JOIN v ON v.night = n.run_date
      LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d') AS d, round_even(count(*) FILTER (value > 35) / count(*) * 10000, 0) / 10000 AS match_rate
        FROM events GROUP BY 1 HAVING count(*) % 2 = 0) q ON q.d = n.run_date""",
    "hazard_listing": BASE + """SELECT id, hazard, count(*) OVER (PARTITION BY hazard) AS group_size FROM reg WHERE status = 'OPEN'""",
    "featured_records": BASE + _STATE + f"""SELECT id, CAST(CASE WHEN left(window_to, 10) >= '{LAST_NIGHT}' THEN 0 ELSE 1 END AS BIGINT) AS rank, window_to
      FROM st WHERE state = 'window_open' ORDER BY 2, window_to, id LIMIT 7""",
    "acceptance": """
      WITH e AS (SELECT *, sha256(user_id || '/' || regexp_extract(props, '(\\d+)', 1)) AS d FROM events),
      t AS (SELECT d, list(DISTINCT event_type) AS types FROM e GROUP BY d),
      b AS (SELECT count(*) AS answered_and_typed, count(*) FILTER (list_contains(types, event_type)) AS agreeing
            FROM e JOIN t ON t.d = e.d WHERE value > 5)
      SELECT (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS nights_with_events, (SELECT count(*) FROM events WHERE value > 100) AS events_on_controls,
        answered_and_typed, agreeing, (SELECT round_even(count(*) FILTER (value < 30) / count(*) * 10000, 0) / 10000 FROM events) AS unverifiable_share FROM b""",
}
