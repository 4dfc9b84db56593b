"""Reaction queries: orders as records naming countries, nations as plans, events as volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.functions.rates import rounded, share
from recordlens.operators import reaction as rx
from recordlens.plans.tables import day_text, table
from recordlens.session import written

READING_DAY = "2024-01-30"


def _nation_code(col):
    return F.concat(F.lit("N"), F.col(col).cast("string"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nations of their suppliers as country codes."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", _nation_code("s_nationkey").alias("code"))
    codes = (
        li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("code")).alias("iso3"))
    )
    o = table(spark, sf_dir, "orders")
    return o.join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "FORECAST").otherwise("ALERT_EPISODE").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED_BY_SOURCE").otherwise("OPEN").alias("status"),
        F.coalesce("iso3", F.array().cast("array<string>")).alias("iso3"),
        day_text("o_orderdate").alias("day"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan per nation, listing itself and two others."""
    need = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.sum(F.floor("s_acctbal")).cast("bigint").alias("requirements_usd")
    )
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    other = lambda e: F.concat(F.lit("N"), e.cast("string"))
    return n.join(need, k == F.col("s_nationkey"), "left").select(
        k.cast("bigint").alias("plan_id"),
        F.array(other(k), other((k * 7 + 3) % 25), other((k * 11 + 5) % 25)).alias("iso3"),
        "requirements_usd",
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").cast("bigint").alias("plan_id")).agg(
        F.sum(F.floor("c_acctbal")).cast("bigint").alias("funded_usd")
    )


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation code to field code; region 4 mapped by later revisions."""
    n = table(spark, sf_dir, "nation")
    row = lambda prefix, day: F.struct(
        F.concat(F.lit(prefix), F.col("n_nationkey").cast("string")).alias("fips"), F.lit(day).alias("valid_from")
    )
    entries = F.when(
        F.col("n_regionkey") == 4, F.array(row("G", "1998-06-01"), row("H", "2000-01-01"))
    ).otherwise(F.array(row("F", "1995-03-01")))
    return n.select(_nation_code("n_nationkey").alias("iso3"), F.explode(entries).alias("e")).select("iso3", "e.*")


def volume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        day_text("ts").alias("day"),
        F.when(F.col("value") >= 2, F.concat(F.lit("F"), (F.col("user_id") % 25).cast("string")))
        .otherwise("")
        .alias("country"),
        F.floor("value").cast("bigint").alias("articles"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("mentions"),
    )


def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rx.daily_volume(volume_rows(spark, sf_dir))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to plan pairs that share a nation."""
    return rx.overlap_pairs(
        order_records(spark, sf_dir), plans(spark, sf_dir),
        left_key="id", right_key="plan_id", left_codes="iso3", right_codes="iso3",
    )


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rx.plan_totals(order_records(spark, sf_dir), plans(spark, sf_dir), funding(spark, sf_dir))
    return out.select(
        "id", "has_plan_match", F.array_join(F.col("plans").cast("array<string>"), ",").alias("plans"),
        "plan_requirements_usd", "plan_funded_usd",
    )


def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_rows = order_records(spark, sf_dir).filter("status = 'OPEN'")
    return rx.coverage(rx.plan_totals(open_rows, plans(spark, sf_dir), funding(spark, sf_dir)))


def crosswalk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's customer nation, mapped as of the order date."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", _nation_code("c_nationkey").alias("iso3"))
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), "iso3", day_text("o_orderdate").alias("day")
    )
    return rx.asof_lookup(facts, crosswalk(spark, sf_dir))


def unmapped_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nations have no field code: such gaps are what is listed."""
    known = crosswalk(spark, sf_dir).filter("iso3 NOT IN ('N23', 'N24')")
    out = rx.mapped_codes(order_records(spark, sf_dir), known)
    return out.select(
        "id", F.array_join("fips", ",").alias("fips"), F.array_join("unmapped_iso3", ",").alias("unmapped_iso3")
    )


def trailing_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28-day exact median of each user's daily articles, zero on silent days."""
    ev = table(spark, sf_dir, "events")
    daily = ev.groupBy("user_id", day_text("ts").alias("day")).agg(
        F.sum(F.floor("value")).cast("bigint").alias("articles")
    )
    out = rx.trailing_baseline(daily, daily.select("day"), key="user_id")
    return out.select(
        "user_id", "day", "articles", F.col("baseline_days").cast("bigint").alias("baseline_days"),
        "baseline_median", share(F.col("articles"), F.col("baseline_median"), 2).alias("ratio"),
    )


def nightly_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = written(order_records(spark, sf_dir), "order-records")
    out = rx.nightly_reading(
        cur, plans(spark, sf_dir), funding(spark, sf_dir), crosswalk(spark, sf_dir),
        written(daily_volume(spark, sf_dir), "volume"), run_date=READING_DAY, attention_day=READING_DAY,
    )
    return out.select(
        "id", F.array_join("iso3", ",").alias("iso3"), F.array_join("fips", ",").alias("fips"),
        F.array_join("unmapped_iso3", ",").alias("unmapped_iso3"), "has_plan_match", "plan_requirements_usd",
        "plan_funded_usd", "articles", "share_per_10k", "baseline_median", "ratio_to_baseline",
    )


def _type_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("register"), day_text("ts").alias("run_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 35).alias("m")
    )


def match_rate_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nights = _type_nights(spark, sf_dir).select("register", "run_date", rounded(F.col("m") / F.col("n"), 4).alias("match_rate"))
    out = rx.match_rate_sensor(nights)
    return out.withColumn("nights_recorded", F.col("nights_recorded").cast("bigint"))


def latency_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    gap = (
        F.when(F.col("register") == "click", F.lit(2))
        .when(F.col("register") == "view", F.when(n % 5 > 0, F.lit(1)))
        .when(F.col("register") == "error", n % 2 + 1)
        .otherwise(F.lit(1))
    )
    nights = _type_nights(spark, sf_dir).select(
        "register", "run_date", gap.cast("bigint").alias("gap_days"),
        ((F.col("register") != "signup") | (n % 4 > 0)).alias("newest_day_failed"),
    )
    out = rx.latency_sensor(nights)
    return out.withColumn("nights_recorded", F.col("nights_recorded").cast("bigint"))


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's nights as committed readings of one record."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("bigint"))
    per = ev.groupBy(F.col("user_id").alias("id"), day_text("ts").alias("run_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("bigint").alias("articles"), F.sum("k").alias("k")
    )
    return per.select(
        "id", "run_date", "articles",
        F.when(F.col("n") > 1, rounded(F.col("articles") / F.col("n"), 2)).alias("ratio_to_baseline"),
        (F.col("n") > 2).alias("has_plan_match"),
        (F.col("k") * 1000).alias("plan_requirements_usd"),
        F.when(F.col("k") % 3 > 0, F.col("k") * 100).alias("plan_funded_usd"),
    )


def reaction_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rx.reaction_series(user_readings(spark, sf_dir))


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    seen = ev.select(F.col("user_id").alias("register"), day_text("ts").alias("day")).distinct()
    return rx.missing_days(seen, "2024-02-03", backfill=7)


# --- the same in SQL ---------------------------------------------------------

_RECORDS = """
WITH codes AS (SELECT l_orderkey, list_sort(list(DISTINCT 'N' || s_nationkey)) AS iso3
               FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey),
rec AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'FORECAST' ELSE 'ALERT_EPISODE' END AS kind,
          CASE WHEN o_orderstatus = 'F' THEN 'CLOSED_BY_SOURCE' ELSE 'OPEN' END AS status,
          coalesce(iso3, []) AS iso3, strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders LEFT JOIN codes ON l_orderkey = o_orderkey),
plan AS (SELECT CAST(n_nationkey AS BIGINT) AS plan_id,
           ['N' || n_nationkey, 'N' || ((n_nationkey * 7 + 3) % 25), 'N' || ((n_nationkey * 11 + 5) % 25)] AS iso3,
           coalesce((SELECT CAST(sum(floor(s_acctbal)) AS BIGINT) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS req,
           coalesce((SELECT CAST(sum(floor(c_acctbal)) AS BIGINT) FROM customer
                     WHERE c_nationkey = n_nationkey), 0) AS fund
         FROM nation),
pairs AS (SELECT r.id, p.* EXCLUDE (iso3) FROM rec r JOIN plan p ON list_has_any(r.iso3, p.iso3)),
tot AS (SELECT id, list(plan_id ORDER BY plan_id) AS plans, CAST(sum(req) AS BIGINT) AS req,
          CAST(sum(fund) AS BIGINT) AS fund FROM pairs GROUP BY id),
money AS (SELECT rec.*, tot.id IS NOT NULL AS has_plan_match, coalesce(array_to_string(plans, ','), '') AS plans,
            coalesce(req, 0) AS plan_requirements_usd, coalesce(fund, 0) AS plan_funded_usd
          FROM rec LEFT JOIN tot ON tot.id = rec.id),
xw AS (SELECT 'N' || n_nationkey AS iso3, 'F' || n_nationkey AS fips, '1995-03-01' AS valid_from FROM nation
       WHERE n_regionkey <> 4
       UNION ALL SELECT 'N' || n_nationkey, 'G' || n_nationkey, '1998-06-01' FROM nation WHERE n_regionkey = 4
       UNION ALL SELECT 'N' || n_nationkey, 'H' || n_nationkey, '2000-01-01' FROM nation WHERE n_regionkey = 4)
"""

_VOLUME = """
vrows AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value >= 2 THEN 'F' || (user_id % 25) ELSE '' END AS country,
            CAST(floor(value) AS BIGINT) AS articles, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS mentions FROM events),
vol AS (
  SELECT day, 'world' AS scope, NULL AS country, count(*) AS events, CAST(sum(articles) AS BIGINT) AS articles,
    CAST(sum(mentions) AS BIGINT) AS mentions FROM vrows GROUP BY day
  UNION ALL
  SELECT day, CASE WHEN country = '' THEN 'unlocated' ELSE 'country' END, CASE WHEN country <> '' THEN country END,
    count(*), CAST(sum(articles) AS BIGINT), CAST(sum(mentions) AS BIGINT) FROM vrows GROUP BY day, country)
"""

_NIGHTS = """WITH nights AS (SELECT event_type AS register, strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS n,
  count(*) FILTER (value > 35) AS m FROM events GROUP BY 1, 2)"""

_READINGS = """WITH per AS (SELECT user_id AS id, strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS n,
    CAST(sum(floor(value)) AS BIGINT) AS articles, CAST(sum(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)) AS BIGINT) AS k
  FROM events GROUP BY 1, 2),
readings AS (SELECT id, run_date, articles, CASE WHEN n > 1 THEN round_even((articles / n) * 100, 0) / 100 END AS ratio_to_baseline,
  n > 2 AS has_plan_match, k * 1000 AS plan_requirements_usd, CASE WHEN k % 3 > 0 THEN k * 100 END AS plan_funded_usd FROM per)
"""

_ASOF = """(SELECT x.fips FROM xw x WHERE x.iso3 = {code} AND x.valid_from <= {day} ORDER BY x.valid_from DESC LIMIT 1)"""

_MAPPED = """
, ex AS (SELECT id, unnest(iso3) AS code, {day} AS day FROM money {where}),
looked AS (SELECT e.id, e.code, max(x.fips) AS fips FROM ex e
   LEFT JOIN (SELECT *, coalesce(lead(valid_from) OVER (PARTITION BY iso3 ORDER BY valid_from), '9999') AS valid_to FROM xw) x
     ON x.iso3 = e.code AND x.valid_from <= e.day AND e.day < x.valid_to GROUP BY e.id, e.code),
mapped AS (SELECT id, list_sort(list(DISTINCT fips) FILTER (fips IS NOT NULL)) AS fips,
     list(code ORDER BY code) FILTER (fips IS NULL) AS missing FROM looked GROUP BY id)
"""

QUERIES = {
    "daily_volume": daily_volume,
    "overlap_join": overlap_join,
    "plan_totals": plan_totals,
    "plan_coverage": plan_coverage,
    "crosswalk_asof": crosswalk_asof,
    "unmapped_codes": unmapped_codes,
    "trailing_baseline": trailing_baseline,
    "nightly_reading": nightly_reading,
    "match_rate_sensor": match_rate_sensor,
    "latency_sensor": latency_sensor,
    "reaction_series": reaction_series,
    "missing_days": missing_days,
}

ORACLES = {
    "daily_volume": "WITH " + _VOLUME + "SELECT * FROM vol",
    "overlap_join": _RECORDS + "SELECT id, plan_id FROM pairs",
    "plan_totals": _RECORDS
    + "SELECT id, has_plan_match, plans, plan_requirements_usd, plan_funded_usd FROM money",
    "plan_coverage": _RECORDS + """SELECT count(*) FILTER (kind = 'ALERT_EPISODE') AS open_alert_episodes,
      count(*) FILTER (kind = 'ALERT_EPISODE' AND has_plan_match) AS with_plan_match,
      round_even((count(*) FILTER (kind = 'ALERT_EPISODE' AND has_plan_match) / count(*) FILTER (kind = 'ALERT_EPISODE')) * 10000, 0) / 10000 AS match_rate
      FROM money WHERE status = 'OPEN'""",
    "crosswalk_asof": _RECORDS + f"""SELECT o_orderkey AS id, 'N' || c_nationkey AS iso3, strftime(o_orderdate, '%Y-%m-%d') AS day,
      {_ASOF.format(code="'N' || c_nationkey", day="strftime(o_orderdate, '%Y-%m-%d')")} AS fips
      FROM orders JOIN customer ON c_custkey = o_custkey""",
    "unmapped_codes": _RECORDS + _MAPPED.format(day="day", where="").replace("FROM xw)", "FROM xw WHERE iso3 NOT IN ('N23', 'N24'))") + """
      SELECT money.id, coalesce(array_to_string(fips, ','), '') AS fips, coalesce(array_to_string(missing, ','), '') AS unmapped_iso3
      FROM money LEFT JOIN mapped ON mapped.id = money.id""",
    "trailing_baseline": """
      WITH daily AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) AS articles
                     FROM events GROUP BY 1, 2),
      days AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM daily)),
      f AS (SELECT d.*, days.i FROM daily d JOIN days ON days.day = d.day),
      b AS (SELECT f.user_id, f.day, count(w.i) AS baseline_days, median(coalesce(h.articles, 0)) FILTER (w.i IS NOT NULL) AS baseline_median
            FROM f LEFT JOIN days w ON w.i BETWEEN f.i - 28 AND f.i - 1
            LEFT JOIN daily h ON h.user_id = f.user_id AND h.day = w.day GROUP BY f.user_id, f.day)
      SELECT f.user_id, f.day, f.articles, baseline_days, baseline_median,
        CASE WHEN baseline_median <> 0 THEN round_even((f.articles / baseline_median) * 100, 0) / 100 END AS ratio
      FROM f JOIN b ON b.user_id = f.user_id AND b.day = f.day""",
    "nightly_reading": _RECORDS + "," + _VOLUME + _MAPPED.format(day=f"'{READING_DAY}'", where="WHERE status = 'OPEN'") + f"""
      , days AS (SELECT DISTINCT day FROM vol WHERE day < '{READING_DAY}' ORDER BY day DESC LIMIT 28),
      sets AS (SELECT DISTINCT fips FROM mapped WHERE len(fips) > 0),
      grid AS (SELECT s.fips, d.day, (SELECT coalesce(sum(articles), 0) FROM vol
                 WHERE vol.day = d.day AND scope = 'country' AND list_contains(s.fips, vol.country)) AS a
               FROM sets s CROSS JOIN (SELECT day FROM days UNION ALL SELECT '{READING_DAY}') d),
      ent AS (SELECT fips, CAST(max(a) FILTER (day = '{READING_DAY}') AS BIGINT) AS articles,
                CAST(median(a) FILTER (day <> '{READING_DAY}') AS DOUBLE) AS base FROM grid GROUP BY fips),
      world AS (SELECT articles AS w FROM vol WHERE scope = 'world' AND day = '{READING_DAY}')
      SELECT m.id, array_to_string(iso3, ',') AS iso3, coalesce(array_to_string(p.fips, ','), '') AS fips,
        coalesce(array_to_string(missing, ','), '') AS unmapped_iso3, has_plan_match, plan_requirements_usd, plan_funded_usd,
        articles, round_even((articles * 10000 / (SELECT w FROM world)) * 10, 0) / 10 AS share_per_10k, base AS baseline_median,
        CASE WHEN base <> 0 THEN round_even((articles / base) * 100, 0) / 100 END AS ratio_to_baseline
      FROM money m LEFT JOIN mapped p ON p.id = m.id LEFT JOIN ent ON ent.fips = p.fips WHERE status = 'OPEN'""",
    "match_rate_sensor": _NIGHTS + """,
      r AS (SELECT register, run_date, round_even((m / n) * 10000, 0) / 10000 AS match_rate FROM nights),
      s AS (SELECT *, row_number() OVER w AS nights_recorded, abs(match_rate - lag(match_rate) OVER w) AS jump FROM r
            WINDOW w AS (PARTITION BY register ORDER BY run_date)),
      t AS (SELECT *, list_filter([
          CASE WHEN match_rate < 0.25 THEN 'match rate ' || CAST(round_even(match_rate * 100, 0) AS INT) || '% below 25%' END,
          CASE WHEN match_rate > 0.5 THEN 'match rate ' || CAST(round_even(match_rate * 100, 0) AS INT) || '% above 50%' END,
          CASE WHEN jump > 0.1 THEN 'match rate moved ' || CAST(round_even(jump * 100, 0) AS INT) || '% from the previous reading' END],
          lambda x: x IS NOT NULL) AS reasons FROM s)
      SELECT register, run_date, match_rate, nights_recorded, CASE WHEN nights_recorded >= 3 THEN 'ARMED' ELSE 'DEFERRED' END AS firing,
        nights_recorded >= 3 AND len(reasons) > 0 AS fired,
        CASE WHEN nights_recorded >= 3 THEN array_to_string(reasons, '; ') END AS why FROM t""",
    "latency_sensor": _NIGHTS + """,
      r AS (SELECT register, run_date, CASE register WHEN 'click' THEN 2 WHEN 'view' THEN CASE WHEN n % 5 > 0 THEN 1 END
              WHEN 'error' THEN n % 2 + 1 ELSE 1 END AS gap, register <> 'signup' OR n % 4 > 0 AS failed FROM nights),
      s AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY run_date) AS nights_recorded,
              list(coalesce(gap, -1)) OVER w AS gaps, bool_and(failed) OVER w AS all_failed FROM r
            WINDOW w AS (PARTITION BY register ORDER BY run_date ROWS 4 PRECEDING)),
      t AS (SELECT *, nights_recorded >= 5 AND len(list_distinct(gaps)) = 1 AND gaps[1] <> -1 AND all_failed AS fired FROM s)
      SELECT register, run_date, nights_recorded, CASE WHEN nights_recorded >= 5 THEN 'ARMED' ELSE 'DEFERRED' END AS firing,
        fired, CASE WHEN fired THEN gap END AS gap_days FROM t""",
    "reaction_series": _READINGS + """
      , pk AS (SELECT * FROM readings WHERE ratio_to_baseline IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY id ORDER BY ratio_to_baseline DESC, run_date DESC) = 1),
      fd AS (SELECT id, arg_min(plan_funded_usd, run_date) AS a, arg_max(plan_funded_usd, run_date) AS b,
               arg_max(plan_requirements_usd, run_date) AS r FROM readings
             WHERE has_plan_match AND plan_funded_usd IS NOT NULL GROUP BY id)
      SELECT x.id, x.nights_watched, pk.run_date AS peak_date, pk.articles AS peak_articles, pk.ratio_to_baseline AS peak_ratio,
        a AS money_funded_first_usd, b AS money_funded_last_usd, b - a AS money_funded_delta_usd,
        r AS money_requirements_last_usd, fd.id IS NOT NULL AS money_plan_match
      FROM (SELECT id, count(*) AS nights_watched FROM readings GROUP BY id) x
      LEFT JOIN pk ON pk.id = x.id LEFT JOIN fd ON fd.id = x.id""",
    "missing_days": """
      WITH seen AS (SELECT DISTINCT user_id AS register, CAST(ts AS DATE) AS d FROM events),
      reach AS (SELECT register, greatest(7, least(date_diff('day', max(d), DATE '2024-02-03') - 1, 30)) AS n FROM seen GROUP BY register),
      owed AS (SELECT register, unnest(generate_series(DATE '2024-02-03' - CAST(n AS INT), DATE '2024-02-02', INTERVAL 1 DAY)) AS d FROM reach)
      SELECT register, strftime(d, '%Y-%m-%d') AS day FROM owed o
      WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.register = o.register AND s.d = CAST(o.d AS DATE))""",
}
