"""Register queries: every (event type, user) of `events` is a record watched nightly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.operators import register as reg
from recordlens.operators import verdicts as ver
from recordlens.plans.tables import day_text, spread, table
from recordlens.session import written

LAST_NIGHT = "2024-01-30"
NIGHT_BEFORE = "2024-01-29"
CARRIED = ("hazard", "source_ref")


def _roles(src: DataFrame) -> DataFrame:
    """Columns of an observation from (event_type, user_id, run_date, event_id, value, props)."""
    day = F.col("run_date")
    sev = F.when(F.col("value") >= 60, "Red").when(F.col("value") >= 25, "Orange").otherwise("Green")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    own_end = F.date_add(F.to_date(day), F.floor(F.col("value") / 10).cast("int"))
    to = (
        F.when(F.col("user_id") % 7 == 0, F.lit("2023-12-20"))
        .when(F.col("user_id") % 3 == 0, F.lit("2024-01-25"))
        .when(F.col("user_id") % 3 == 1, day_text(F.date_add(F.to_date(day), 5)))
        .otherwise(day_text(own_end))
    )
    letters = F.translate(F.col("user_id").cast("string"), "0123456789", "ABCDEFGHIJ")
    return src.select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id"),
        "run_date",
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_type").isin("view", "click"), "FORECAST")
        .otherwise("ALERT_EPISODE")
        .alias("kind"),
        F.when(F.col("event_type") == "error", "drought")
        .when(F.col("event_type") == "signup", "flood")
        .otherwise("tropical cyclone")
        .alias("hazard"),
        F.concat(F.lit("Tropical Storm ST"), letters, F.when(sev == "Red", " (storm)").otherwise("")).alias("what"),
        F.concat(F.lit("zone-"), (k % 2).cast("string")).alias("where"),
        sev.alias("severity"),
        F.struct(
            F.concat(day, F.lit("T00:00:00")).alias("from"),
            F.concat(to, F.lit("T12:00:00")).alias("to"),
        ).alias("window"),
        F.concat(F.lit("ref-"), F.col("event_id").cast("string")).alias("source_ref"),
        F.concat("event_type", F.lit("/"), "run_date").alias("snapshot"),
    )


def nightly_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's last event per record; reduced before the shuffle by a partial max."""
    ev = spread(table(spark, sf_dir, "events"), "event_id").withColumn("run_date", day_text("ts"))
    last = ev.groupBy("event_type", "user_id", "run_date").agg(
        F.max(F.struct("ts", "event_id", "value", "props")).alias("e")
    )
    return _roles(last.select("event_type", "user_id", "run_date", "e.event_id", "e.value", "e.props"))


def feed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an observation in feed order, several per record and night."""
    return _roles(table(spark, sf_dir, "events").withColumn("run_date", day_text("ts")))


def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.register_fold(nightly_observations(spark, sf_dir), carried=CARRIED, one_per_night=True)


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded events as a written table, for queries that read them more than once."""
    return written(fold(spark, sf_dir), "register-events")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.register_current(fold(spark, sf_dir), carried=CARRIED)


def _event_view(ev: DataFrame) -> DataFrame:
    ch = F.col("changes")
    return ev.select(
        "id",
        "run_date",
        F.col("phase").cast("bigint").alias("phase"),
        F.col("pos").alias("pos"),
        F.col("step").cast("bigint").alias("step"),
        "event",
        "snapshot",
        ch["severity"]["from"].alias("severity_from"),
        ch["severity"]["to"].alias("severity_to"),
        ch["window"]["from"]["to"].alias("window_to_from"),
        ch["window"]["to"]["to"].alias("window_to_to"),
        ch["what"]["to"].alias("what_to"),
        ch["where"]["to"].alias("where_to"),
    )


def register_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_view(fold(spark, sf_dir))


def register_fold_feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several observations a night, folded one after the other in feed order."""
    obs = feed_observations(spark, sf_dir)
    return _event_view(reg.register_fold(obs, carried=CARRIED))


def register_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select(
        "id", "source", "kind", "hazard", "severity", "what", "where",
        F.col("window")["to"].alias("window_to"),
        "announced_at", "status", "last_event_at", "n_events", "revisions", "source_ref",
    )


def _with_first_end(spark, sf_dir) -> DataFrame:
    ev = committed(spark, sf_dir)
    cur = reg.register_current(ev, carried=CARRIED)
    return cur.join(reg.window_at_first_sight(ev), "id")


def overdue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = _with_first_end(spark, sf_dir)
    to, now = F.col("window")["to"], F.lit(LAST_NIGHT + "T04:00:00")
    args = (F.col("status"), to, F.col("first_to"), F.col("announced_at"))
    return cur.select(
        "id",
        "status",
        "first_to",
        reg.is_overdue(F.col("status"), to, now).alias("overdue"),
        reg.overdue_kind(*args, now).alias("overdue_kind"),
        reg.public_state(*args, F.lit(LAST_NIGHT)).alias("public_state"),
    )


def trajectory_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window-end path of every open record up to the last night."""
    ev = committed(spark, sf_dir)
    open_ids = reg.register_current(ev, carried=CARRIED).filter(F.col("status") == v.OPEN).select("id")
    t = reg.trajectory_class(ev.join(open_ids, "id", "left_semi"), LAST_NIGHT)
    return t.select(
        "id", "class", F.col("nights_observed").cast("bigint").alias("nights_observed"), "since",
        F.col("day_delta").cast("bigint").alias("day_delta"),
        F.col("todate_delta").cast("bigint").alias("todate_delta"), "window_to",
    )


def trajectory_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = committed(spark, sf_dir)
    open_ids = reg.register_current(ev, carried=CARRIED).filter(F.col("status") == v.OPEN).select("id")
    return reg.class_crossings(ev.join(open_ids, "id", "left_semi"), LAST_NIGHT, NIGHT_BEFORE)


def severity_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ver.severity_paths(fold(spark, sf_dir))
    return p.select("id", F.array_join("severity_path", ">").alias("severity_path"), "escalated", "revisions")


def register_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = committed(spark, sf_dir)
    out = ver.verdicts(reg.register_current(ev, carried=CARRIED), ev)
    return out.select(
        "id", "verdict", "cold_start", F.array_join("severity_path", ">").alias("severity_path"),
        "escalated", "revisions", "episode_days", "matched", "lead_time_hours",
        F.size("evidence").cast("bigint").alias("n_evidence"),
        F.array_join("evidence", ",").alias("evidence"),
    )


def register_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records holding their nation; the orders feed names a primary code."""
    cust = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    text = lambda c: F.lit(c).cast("string")
    cur = cust.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("iso3"),
        F.when(F.col("c_acctbal") >= 0, v.OPEN).otherwise(v.CLOSED_BY_SOURCE).alias("status"),
        F.col("c_mktsegment").alias("source"), text("ALERT_EPISODE").alias("kind"), text("flood").alias("hazard"), text(None).alias("source_ref"),
        text("Orange").alias("severity"), F.struct(text("2024-01-01").alias("from"), text(None).alias("to")).alias("window"),
        F.col("c_name").alias("what"), text(None).alias("where"),
    )
    feed = orders.select(
        F.col("o_custkey").cast("string").alias("id"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.concat(F.lit("N"), (F.floor("o_totalprice") % 25).cast("string")),
        ).alias("primary_iso3"),
    )
    corrected, found = reg.correct_register(cur, feed, cause="code left out at first", at=LAST_NIGHT, snapshot="orders")
    # The same register from its events: first sights, closures of the closed, corrections.
    first = found.columns[:-3]
    status = F.when(F.col("status") == v.OPEN, F.array(F.lit("NOTARIZED"))).otherwise(F.array(F.lit("NOTARIZED"), F.lit(v.CLOSED_BY_SOURCE)))
    rows = cur.select("*", F.posexplode(status).alias("phase", "event")).select(
        "id", "source", "kind", F.lit(NIGHT_BEFORE).alias("run_date"), "phase", F.lit(None).cast("long").alias("pos"), F.lit(0).alias("step"),
        "event", F.lit("customer").alias("snapshot"), F.lit(None).cast(found.schema["changes"].dataType).alias("changes"),
        F.struct("severity", "window", "what", "where").alias("held"), "hazard", "iso3", "source_ref",
    )
    again = reg.register_current(rows.select(first).unionByName(found.select(first)), with_history=True)
    derived = again.select("id", F.array_join("iso3", ",").alias("derived_iso3"), F.size(F.filter("history", lambda e: e["event"] == "CORRECTED")).cast("long").alias("corrections"))
    return corrected.select("id", "status", F.array_join("iso3", ",").alias("iso3")).join(derived, "id")


def primary_code_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("iso3"),
    )
    feed = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"),
        F.concat(F.lit(" N"), (F.floor("o_totalprice") % 25).cast("string")).alias("primary_iso3"),
    )
    return reg.field_guard(cust, feed)


# --- the same in SQL ---------------------------------------------------------

_ROLE_SQL = """
  SELECT event_type || '-' || user_id AS id, run_date, event_id AS pos, event_type AS source,
    CASE WHEN event_type IN ('view','click') THEN 'FORECAST' ELSE 'ALERT_EPISODE' END AS kind,
    CASE event_type WHEN 'error' THEN 'drought' WHEN 'signup' THEN 'flood' ELSE 'tropical cyclone' END AS hazard,
    'Tropical Storm ST' || translate(CAST(user_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ')
      || CASE WHEN value >= 60 THEN ' (storm)' ELSE '' END AS what,
    'zone-' || (CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 2) AS place,
    CASE WHEN value >= 60 THEN 'Red' WHEN value >= 25 THEN 'Orange' ELSE 'Green' END AS severity,
    run_date || 'T00:00:00' AS w_from,
    CASE WHEN user_id % 7 = 0 THEN '2023-12-20' WHEN user_id % 3 = 0 THEN '2024-01-25'
         WHEN user_id % 3 = 1 THEN strftime(CAST(run_date AS DATE) + 5, '%Y-%m-%d')
         ELSE strftime(CAST(run_date AS DATE) + CAST(floor(value / 10) AS INT), '%Y-%m-%d') END || 'T12:00:00' AS w_to,
    'ref-' || event_id AS source_ref, event_type || '/' || run_date AS snapshot
"""

_NIGHTLY_SQL = f"""
WITH last_ev AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS run_date FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id, strftime(ts, '%Y-%m-%d')
                             ORDER BY ts DESC, event_id DESC) = 1),
obs AS ({_ROLE_SQL} FROM last_ev),
"""

_FEED_SQL = f"""
WITH all_ev AS (SELECT *, strftime(ts, '%Y-%m-%d') AS run_date FROM events),
obs AS ({_ROLE_SQL} FROM all_ev),
"""

_EVENTS_SQL = """
cal AS (SELECT source, run_date AS night, lead(run_date) OVER (PARTITION BY source ORDER BY run_date) AS nxt
        FROM (SELECT DISTINCT source, run_date FROM obs)),
chain AS (
  SELECT o.*, c.nxt,
    lag(run_date) OVER w AS p_night, lag(nxt) OVER w AS p_nxt, lag(severity) OVER w AS p_sev,
    lag(w_from) OVER w AS p_from, lag(w_to) OVER w AS p_to, lag(what) OVER w AS p_what,
    lag(place) OVER w AS p_place, lead(run_date) OVER w AS n_night
  FROM obs o JOIN cal c ON c.source = o.source AND c.night = o.run_date
  WINDOW w AS (PARTITION BY id ORDER BY run_date, pos)),
flagged AS (
  SELECT *, p_night IS NOT NULL AND severity IS DISTINCT FROM p_sev AS d_sev,
    p_night IS NOT NULL AND (w_from IS DISTINCT FROM p_from OR w_to IS DISTINCT FROM p_to) AS d_win,
    p_night IS NOT NULL AND what IS DISTINCT FROM p_what AS d_what,
    p_night IS NOT NULL AND place IS DISTINCT FROM p_place AS d_place FROM chain),
ev AS (
  SELECT id, source, kind, hazard, run_date, 0 AS phase, pos, 0 AS step, 'NOTARIZED' AS event, snapshot,
    NULL AS severity_from, NULL AS severity_to, NULL AS window_to_from, NULL AS window_to_to,
    NULL AS what_to, NULL AS where_to, false AS d_win, severity, what, place, w_from, w_to, source_ref
  FROM flagged WHERE p_night IS NULL
  UNION ALL
  SELECT id, source, kind, hazard, run_date, 0, pos, 1, 'REAPPEARED', snapshot,
    NULL, NULL, NULL, NULL, NULL, NULL, false, severity, what, place, w_from, w_to, source_ref
  FROM flagged WHERE p_nxt < run_date
  UNION ALL
  SELECT id, source, kind, hazard, run_date, 0, pos, 2, 'REVISED', snapshot,
    CASE WHEN d_sev THEN p_sev END, CASE WHEN d_sev THEN severity END,
    CASE WHEN d_win THEN p_to END, CASE WHEN d_win THEN w_to END,
    CASE WHEN d_what THEN what END, CASE WHEN d_place THEN place END, d_win,
    severity, what, place, w_from, w_to, source_ref
  FROM flagged WHERE d_sev OR d_win OR d_what OR d_place
  UNION ALL
  SELECT id, source, kind, hazard, nxt, 1, NULL, 0,
    CASE WHEN kind = 'FORECAST' THEN 'DISSIPATED' ELSE 'CLOSED_BY_SOURCE' END, NULL,
    NULL, NULL, NULL, NULL, NULL, NULL, false, severity, what, place, w_from, w_to, source_ref
  FROM flagged WHERE nxt IS NOT NULL AND (n_night IS NULL OR n_night > nxt)),
"""

_CURRENT_SQL = """
cur AS (
  SELECT id, min(source) AS source, min(kind) AS kind, min(hazard) AS hazard,
    arg_max(severity, run_date || phase) AS severity, arg_max(what, run_date || phase) AS what,
    arg_max(place, run_date || phase) AS "where", arg_max(w_from, run_date || phase) AS w_from,
    arg_max(w_to, run_date || phase) AS window_to,
    min(run_date) AS announced_at, max(run_date) AS last_event_at, count(*) AS n_events,
    count(*) FILTER (event = 'REVISED') AS revisions,
    arg_max(event, run_date || phase || step) AS last_event,
    arg_min(source_ref, run_date || phase || step) AS source_ref,
    arg_min(w_to, run_date || phase || step) AS first_to
  FROM ev GROUP BY id),
reg AS (SELECT *, CASE WHEN last_event IN ('DISSIPATED','CLOSED_BY_SOURCE') THEN last_event ELSE 'OPEN' END AS status FROM cur)
"""

BASE = _NIGHTLY_SQL + _EVENTS_SQL + _CURRENT_SQL

_EVENT_COLS = """SELECT id, run_date, CAST(phase AS BIGINT) AS phase, pos, CAST(step AS BIGINT) AS step, event, snapshot,
  severity_from, severity_to, window_to_from, window_to_to, what_to, where_to FROM ev"""

_SERIES_SQL = """
, open_ids AS (SELECT id FROM reg WHERE status = 'OPEN'),
series AS (SELECT id, run_date AS day, w_to AS too FROM ev
           WHERE id IN (SELECT id FROM open_ids) AND phase = 0 AND (event = 'NOTARIZED' OR d_win) {extra})
"""


def _class_sql(name: str, series: str, as_of: str) -> str:
    return f"""
, {name}_full AS (
  SELECT * FROM {series} UNION ALL
  SELECT id, '{as_of}', arg_max(too, day) FROM {series} GROUP BY id HAVING max(day) <> '{as_of}'),
{name}_steps AS (
  SELECT *, lag(day) OVER w AS pday, lag(too) OVER w AS ptoo FROM {name}_full
  WINDOW w AS (PARTITION BY id ORDER BY day)),
{name}_d AS (
  SELECT *, date_diff('day', CAST(pday AS DATE), CAST(day AS DATE)) AS dd,
    date_diff('day', CAST(left(ptoo, 10) AS DATE), CAST(left(too, 10) AS DATE)) AS td FROM {name}_steps),
{name}_g AS (
  SELECT id, date_diff('day', CAST(min(day) AS DATE), DATE '{as_of}') + 1 AS nights_observed,
    count(DISTINCT too) AS kinds, min(day) FILTER (dd <> td) AS since,
    arg_min(dd, day) FILTER (dd <> td) AS day_delta, arg_min(td, day) FILTER (dd <> td) AS todate_delta,
    arg_max(too, day) AS last_too FROM {name}_d GROUP BY id),
{name} AS (
  SELECT id, CASE WHEN kinds = 1 THEN 'frozen' WHEN since IS NULL THEN 'rolling' ELSE 'irregular' END AS class, *
  EXCLUDE (id) FROM {name}_g WHERE nights_observed >= 2)
"""


_PATH_SQL = """
, sev AS (SELECT id, list(severity_from ORDER BY run_date) AS f, list(severity_to ORDER BY run_date) AS t
          FROM ev WHERE severity_to IS NOT NULL GROUP BY id),
paths AS (SELECT r.id, r.revisions,
    CASE WHEN s.id IS NULL THEN [r.severity] ELSE list_prepend(s.f[1], s.t) END AS path
  FROM reg r LEFT JOIN sev s ON s.id = r.id),
esc AS (SELECT *, len(list_filter(path[2:], lambda x: x IN ('Red','Extreme'))) > 0 AND path[1] NOT IN ('Red','Extreme') AS escalated
        FROM paths)
"""

_VERDICT_SQL = _PATH_SQL + """
, evid AS (SELECT id, list(DISTINCT snapshot) AS files FROM ev WHERE snapshot IS NOT NULL GROUP BY id),
tok AS (SELECT *, list_filter(regexp_extract_all(upper(what), '[A-Z]{3,}'), lambda x: x NOT IN
   ('TROPICAL','CYCLONE','HURRICANE','STORM','TYPHOON','DEPRESSION','POTENTIAL','SUBTROPICAL','SUPER'))[1] AS token FROM reg),
alerts AS (SELECT token, min(id) AS mid FROM tok
           WHERE kind = 'ALERT_EPISODE' AND hazard = 'tropical cyclone' AND token IS NOT NULL GROUP BY token),
ver AS (
  SELECT t.id, t.announced_at, t.announced_at = (SELECT min(announced_at) FROM reg) AS cold_start,
    e.path, e.escalated, e.revisions, CASE WHEN t.kind <> 'ALERT_EPISODE' THEN a.mid END AS matched, t.kind,
    t.w_from, t.window_to, m.w_from AS m_from, ef.files, mf.files AS mfiles
  FROM tok t JOIN esc e ON e.id = t.id
  LEFT JOIN alerts a ON a.token = t.token LEFT JOIN reg m ON m.id = a.mid
  LEFT JOIN evid ef ON ef.id = t.id LEFT JOIN evid mf ON mf.id = a.mid
  WHERE t.status <> 'OPEN'),
verd AS (
  SELECT id, CASE WHEN kind = 'ALERT_EPISODE' THEN 'EPISODE_ENDED' WHEN matched IS NOT NULL THEN 'MATERIALIZED_AS_ALERT'
    ELSE 'NO_ALERT_MATCH' END AS verdict, cold_start, array_to_string(path, '>') AS severity_path, escalated, revisions,
  CASE WHEN kind = 'ALERT_EPISODE' THEN round_even((date_diff('second', CAST(w_from AS TIMESTAMP), CAST(window_to AS TIMESTAMP)) / 86400.0) * 10, 0) / 10 END AS episode_days,
  matched, CASE WHEN matched IS NOT NULL THEN round_even((date_diff('second', CAST(announced_at AS TIMESTAMP), CAST(m_from AS TIMESTAMP)) / 3600.0) * 10, 0) / 10 END AS lead_time_hours,
  len(CASE WHEN matched IS NOT NULL THEN list_distinct(files || mfiles) ELSE files END) AS n_evidence,
  array_to_string(list_sort(CASE WHEN matched IS NOT NULL THEN list_distinct(files || mfiles) ELSE files END), ',') AS evidence
FROM ver)
"""

_GUARD_SQL = """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, 'N' || (CAST(floor(o_totalprice) AS BIGINT) % 25) AS dropped
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE 'N' || (CAST(floor(o_totalprice) AS BIGINT) % 25) <> 'N' || c_nationkey
"""

QUERIES = {
    "register_fold": register_fold,
    "register_fold_feed_order": register_fold_feed_order,
    "register_current": register_current,
    "overdue_kinds": overdue_kinds,
    "trajectory_classes": trajectory_classes,
    "trajectory_crossings": trajectory_crossings,
    "severity_paths": severity_paths,
    "register_verdicts": register_verdicts,
    "register_corrections": register_corrections,
    "primary_code_guard": primary_code_guard,
}

ORACLES = {
    "register_fold": BASE + _EVENT_COLS,
    "register_fold_feed_order": _FEED_SQL + _EVENTS_SQL.rstrip().rstrip(",") + _EVENT_COLS,
    "register_current": BASE + """SELECT id, source, kind, hazard, severity, what, "where", window_to, announced_at,
      status, last_event_at, n_events, revisions, source_ref FROM reg""",
    "overdue_kinds": BASE + f"""SELECT id, status, first_to,
      status = 'OPEN' AND window_to < '{LAST_NIGHT}T04:00:00' AS overdue,
      CASE WHEN status = 'OPEN' AND window_to < '{LAST_NIGHT}T04:00:00' THEN
        CASE WHEN first_to < announced_at || 'T00:00:00' THEN 'cold_start_overdue' ELSE 'drift_overdue' END END AS overdue_kind,
      CASE WHEN status = 'OPEN' THEN CASE WHEN left(window_to, 10) >= '{LAST_NIGHT}' THEN 'window_open'
        WHEN left(first_to, 19) < left(announced_at, 19) THEN 'cold_start' ELSE 'drift' END END AS public_state FROM reg""",
    "trajectory_classes": BASE + _SERIES_SQL.format(extra="") + _class_sql("t", "series", LAST_NIGHT) + """
      SELECT id, class, nights_observed, CASE WHEN class = 'irregular' THEN since END AS since,
        CASE WHEN class = 'irregular' THEN day_delta END AS day_delta,
        CASE WHEN class = 'irregular' THEN todate_delta END AS todate_delta,
        CASE WHEN class <> 'irregular' THEN last_too END AS window_to FROM t""",
    "trajectory_crossings": BASE + _SERIES_SQL.format(extra="") + f""",
      earlier AS (SELECT * FROM series WHERE day <> '{LAST_NIGHT}')"""
    + _class_sql("t", "series", LAST_NIGHT) + _class_sql("y", "earlier", NIGHT_BEFORE)
    + f"""SELECT t.id, y.class AS from_class, t.class AS to_class, '{LAST_NIGHT}' AS run_date
      FROM t JOIN y ON y.id = t.id WHERE t.class <> y.class""",
    "severity_paths": BASE + _PATH_SQL
    + "SELECT id, array_to_string(path, '>') AS severity_path, escalated, revisions FROM esc",
    "register_verdicts": BASE + _VERDICT_SQL + "SELECT * FROM verd",
    "register_corrections": """
      WITH named AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, 'N' || (CAST(floor(o_totalprice) AS BIGINT) % 25) AS code
                     FROM orders WHERE o_orderstatus <> 'P'),
      codes AS (SELECT id, list(code) AS codes FROM named GROUP BY id)
      SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal >= 0 THEN 'OPEN' ELSE 'CLOSED_BY_SOURCE' END AS status,
        CASE WHEN c_acctbal >= 0 AND codes IS NOT NULL
             THEN array_to_string(list_sort(list_distinct(list_append(codes, 'N' || c_nationkey))), ',')
             ELSE 'N' || c_nationkey END AS iso3,
        iso3 AS derived_iso3,
        CASE WHEN c_acctbal >= 0 AND len(list_filter(coalesce(codes, []), lambda x: x <> 'N' || c_nationkey)) > 0 THEN 1 ELSE 0 END AS corrections
      FROM customer LEFT JOIN codes ON codes.id = CAST(c_custkey AS VARCHAR)""",
    "primary_code_guard": _GUARD_SQL,
}
