"""Capture queries: events as captures of pages, pages and documents as sampled addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.operators import captures as cp
from recordlens.operators import reports as rp
from recordlens.plans.tables import table

DAY = "2024-01-28"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a capture of its user's page; status and digest follow from the event."""
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    status = (
        F.when(m == 0, "404").when(m == 1, "301").when(m == 2, "403").when(m == 3, "-").when(m == 4, "500").otherwise("200")
    )
    return ev.select(
        F.col("user_id").alias("page"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("https://u.test/"), F.col("user_id").cast("string")).alias("original"),
        status.alias("statuscode"),
        F.concat(F.lit("D"), F.floor(F.col("value") / 40).cast("string")).alias("digest"),
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live answer per page, by page number; every ninth does not answer."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("page")).distinct()
    m = F.col("page") % 9
    code = F.lit(None).cast("int")
    for n, value in enumerate((404, 410, 200, 403, 500, 451, None, 302, 429)):
        code = F.when(m == n, F.lit(value).cast("int")).otherwise(code)
    return u.select("page", code.alias("http_code"))


def collapsed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.collapse_digests(captures(spark, sf_dir)).select("page", "timestamp", "pos", "digest")


def _classes(spark, sf_dir) -> DataFrame:
    cap = captures(spark, sf_dir)
    return cp.history_class(cap, DAY, pages=cap.select("page"))


def history_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _classes(spark, sf_dir)
    return out.select(
        "page", "kind", "reason", F.col("before.timestamp").alias("before_ts"), F.col("before.digest").alias("before_digest"),
        F.col("after.timestamp").alias("after_ts"), F.col("after.statuscode").alias("after_status"),
    )


def live_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select("page", cp.live_class(F.col("http_code")).alias("live_class"))


def settled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.settle_candidates(_classes(spark, sf_dir), live(spark, sf_dir))


def gone_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.gone_rate(live_classes(spark, sf_dir))


def class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = cp.settle_candidates(_classes(spark, sf_dir), live(spark, sf_dir))
    return cp.class_rates(settled.withColumn("category", F.col("page") % 4), by=["category"])


def unverifiable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.unverifiable_reasons(cp.settle_candidates(_classes(spark, sf_dir), live(spark, sf_dir)))


def _hosts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "url", "page_id")


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages per host; some addresses are excluded, some are controls."""
    p = _hosts(spark, sf_dir)
    return cp.hash_sample(
        p.select("host", "url"), DAY, group="host",
        excluded=p.filter("url LIKE '%ref=%'").select("url"), controls=p.filter("url LIKE '%#top'").select("url"),
    )


def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents per source."""
    d = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"))
    return cp.hash_sample(d, DAY, group="source")


def over_cap_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of each night in page order; the ones after the first forty are marked."""
    cap = captures(spark, sf_dir).withColumn("night", F.substring("timestamp", 1, 8))
    return cp.mark_over_cap(cap, night="night", order=["page", "pos"], cap=40).select("night", "page", "pos", "over_cap")


def answer_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON turned into answers, good ones and broken ones."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kinds = ("number_revised", "date_shifted", "negation_flipped", "commitment_removed", "attribution_removed", "none", "other")
    kind = F.lit("")
    for n, name in enumerate(kinds):
        kind = F.when(k % len(kinds) == n, name).otherwise(kind)
    reason = F.repeat(F.concat(F.col("event_type"), F.lit(" ")), 20)
    good = F.concat(
        F.lit('{"type": "'), kind, F.lit('", "confidence": "high", "reason": "'), reason, F.lit('"}')
    )
    answer = F.when(k % 10 == 0, F.col("event_type")).when(k % 10 == 1, F.col("props")).otherwise(good)
    rows = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return rp.read_answers(rows).drop("answer")


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations as tokens, in for users and out for assistants."""
    c = table(spark, sf_dir, "conversations")
    words = F.regexp_count("text", F.lit(r"[^\s\p{Z}]+"))
    usage = c.select(
        "conv_id", F.when(F.col("role") == "assistant", 0).otherwise(words).cast("bigint").alias("input_tokens"),
        F.when(F.col("role") == "assistant", words).otherwise(0).cast("bigint").alias("output_tokens"),
    )
    return rp.token_costs(usage, price_in=1.0, price_out=5.0, discount=0.5, by=["conv_id"])


def watchlist_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as institutions, customers as controls, some pages excluded."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    url = lambda n: F.concat(F.lit("u"), n.cast("string"))
    category = F.when(k % 5 == 4, "E").otherwise(F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1)))
    strategy = F.when(k % 3 == 0, "domain").when(k % 3 == 1, "single_url").when(k % 6 == 2, "prefix").otherwise("scan")
    inst = s.select(
        F.concat(F.lit("inst"), F.floor(k / 2 * F.when(k % 7 == 0, 1).otherwise(2)).cast("string")).alias("slug"),
        category.alias("category"), strategy.alias("strategy"), F.when(k % 4 > 0, "q").alias("query"),
        F.when(k % 2 == 0, F.array(url(k), url(k + 1))).otherwise(F.array().cast("array<string>")).alias("urls"),
        F.when(
            k % 9 > 0,
            F.struct(F.when(k % 8 > 0, "2024-01-01").alias("at"), F.when(k % 5 > 0, 200).alias("http_status")),
        ).alias("probe"),
    )
    c = table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    controls = c.select(
        url(F.when(ck % 50 == 0, ck + 1).otherwise(ck)).alias("url"), F.when(ck % 6 > 0, "E").otherwise("A").alias("category"),
        F.when(ck % 10 > 0, F.struct(F.when(ck % 7 > 0, 200).alias("http_status"))).alias("probe"),
    )
    excluded = table(spark, sf_dir, "part").filter("p_size = 1").select(url(F.col("p_partkey")).alias("url")).distinct()
    return rp.watchlist_problems(inst, controls, excluded, None)


# --- the same in SQL ---------------------------------------------------------

_CAPS = """
WITH cap AS (SELECT user_id AS page, strftime(ts, '%Y%m%d%H%M%S') AS stamp, event_id AS pos,
    CASE event_id % 10 WHEN 0 THEN '404' WHEN 1 THEN '301' WHEN 2 THEN '403' WHEN 3 THEN '-' WHEN 4 THEN '500' ELSE '200' END AS status,
    'D' || CAST(floor(value / 40) AS BIGINT) AS digest FROM events),
live AS (SELECT DISTINCT page, CASE page % 9 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 200 WHEN 3 THEN 403 WHEN 4 THEN 500
    WHEN 5 THEN 451 WHEN 7 THEN 302 WHEN 8 THEN 429 END AS code FROM cap),
lc AS (SELECT page, CASE WHEN code IS NULL THEN 'unreachable' WHEN code BETWEEN 200 AND 299 THEN 'ok' WHEN code = 404 THEN 'gone_404'
    WHEN code = 410 THEN 'gone_410' WHEN code = 451 THEN 'legal_451' WHEN code IN (401, 403, 429) THEN 'botwall'
    WHEN code BETWEEN 500 AND 599 THEN 'server_error' ELSE 'other' END AS live_class, code FROM live)
"""

_CLASSES = _CAPS + f"""
, seen AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY stamp DESC, pos DESC) AS rn FROM cap
           WHERE stamp <= '{DAY.replace("-", "")}235959'),
newest AS (SELECT * FROM seen WHERE rn = 1),
prior AS (SELECT * FROM seen WHERE rn > 1 AND status = '200' QUALIFY row_number() OVER (PARTITION BY page ORDER BY rn) = 1),
cls AS (SELECT p.page,
    CASE WHEN n.page IS NULL THEN 'unverifiable' WHEN left(n.stamp, 8) <> '{DAY.replace("-", "")}' THEN 'unchanged'
      WHEN n.status = '200' THEN CASE WHEN b.page IS NULL THEN 'unverifiable' ELSE 'changed_candidate' END
      WHEN left(n.status, 1) = '4' THEN 'deletion_candidate' ELSE 'unverifiable' END AS kind,
    CASE WHEN n.page IS NULL THEN 'no_capture_in_archive' WHEN left(n.stamp, 8) <> '{DAY.replace("-", "")}' THEN 'no_new_digest_on_day'
      WHEN n.status = '200' THEN CASE WHEN b.page IS NULL THEN 'no_earlier_capture' ELSE 'new_digest' END
      ELSE 'archive_status_' || n.status END AS reason,
    CASE WHEN left(n.stamp, 8) = '{DAY.replace("-", "")}' AND (n.status = '200' OR left(n.status, 1) = '4') THEN b.stamp END AS before_ts,
    CASE WHEN left(n.stamp, 8) = '{DAY.replace("-", "")}' AND (n.status = '200' OR left(n.status, 1) = '4') THEN b.digest END AS before_digest,
    n.stamp AS after_ts, n.status AS after_status
  FROM (SELECT DISTINCT page FROM cap) p LEFT JOIN newest n ON n.page = p.page LEFT JOIN prior b ON b.page = p.page),
settled AS (SELECT c.page, kind, CASE WHEN kind = 'deletion_candidate' THEN CASE WHEN live_class IN ('gone_404', 'gone_410') THEN 'gone' ELSE 'unverifiable' END
      WHEN kind = 'changed_candidate' THEN 'changed' ELSE kind END AS class,
    CASE WHEN kind = 'deletion_candidate' THEN CASE WHEN live_class IN ('gone_404', 'gone_410') THEN 'live ' || code
      ELSE 'deletion_candidate_survived_recheck_' || live_class END ELSE reason END AS reason,
    CASE WHEN kind = 'deletion_candidate' THEN live_class END AS live_class FROM cls c JOIN lc ON lc.page = c.page)
"""


def wilson_sql(k: str, n: str, low: str, high: str) -> str:
    z = "1.96::DOUBLE"
    p = f"({k}::DOUBLE / {n})"
    d = f"(1 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / {d})"
    half = f"(({z} / {d}) * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    return (
        f"CASE WHEN {n} > 0 THEN round_even(greatest(0.0::DOUBLE, {centre} - {half}) * 10000, 0) / 10000 END AS {low}, "
        f"CASE WHEN {n} > 0 THEN round_even(least(1.0::DOUBLE, {centre} + {half}) * 10000, 0) / 10000 END AS {high}"
    )


_LIVE_NAMES = ("ok", "gone_404", "gone_410", "legal_451", "botwall", "server_error", "unreachable", "other")

_WATCH = """
WITH s AS (SELECT s_suppkey AS k, 'inst' || CAST(floor(s_suppkey / 2 * CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS slug,
    CASE WHEN s_suppkey % 5 = 4 THEN 'E' ELSE substr('ABCD', s_suppkey % 4 + 1, 1) END AS category,
    CASE WHEN s_suppkey % 3 = 0 THEN 'domain' WHEN s_suppkey % 3 = 1 THEN 'single_url' WHEN s_suppkey % 6 = 2 THEN 'prefix' ELSE 'scan' END AS strategy,
    s_suppkey % 4 > 0 AS has_query, s_suppkey % 2 = 0 AS has_urls, s_suppkey % 9 > 0 AND s_suppkey % 8 > 0 AS probed,
    s_suppkey % 5 > 0 AS has_status FROM supplier),
c AS (SELECT 'u' || (CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1 ELSE c_custkey END) AS url, c_custkey % 6 > 0 AS is_e,
    c_custkey % 10 > 0 AND c_custkey % 7 > 0 AS probed FROM customer),
x AS (SELECT DISTINCT 'u' || p_partkey AS url FROM part WHERE p_size = 1)
SELECT slug AS subject, 'category is not one of A-D' AS problem FROM s WHERE category NOT IN ('A','B','C','D')
UNION ALL SELECT slug, 'unknown strategy' FROM s WHERE strategy = 'scan'
UNION ALL SELECT slug, 'single_url strategy without urls' FROM s WHERE strategy = 'single_url' AND NOT has_urls
UNION ALL SELECT slug, 'no query target' FROM s WHERE strategy <> 'single_url' AND NOT has_query
UNION ALL SELECT slug, 'no live probe recorded' FROM s WHERE NOT probed
UNION ALL SELECT slug, 'probe without a status' FROM s WHERE probed AND NOT has_status
UNION ALL SELECT url, 'control category must be E' FROM c WHERE NOT is_e
UNION ALL SELECT url, 'control without a live probe' FROM c WHERE NOT probed
UNION ALL SELECT slug, 'duplicate slug' FROM s GROUP BY slug HAVING count(*) > 1
UNION ALL SELECT url, 'duplicate control' FROM c GROUP BY url HAVING count(*) > 1
UNION ALL SELECT slug, 'url is excluded' FROM (SELECT slug, unnest(['u' || k, 'u' || (k + 1)]) AS url FROM s WHERE has_urls) WHERE url IN (SELECT url FROM x)
UNION ALL SELECT url, 'control is excluded' FROM c WHERE url IN (SELECT url FROM x)
UNION ALL SELECT 'watchlist', 'no exclusions named' FROM x HAVING count(*) = 0
UNION ALL SELECT 'watchlist', 'no institutions' FROM s HAVING count(*) = 0
UNION ALL SELECT 'watchlist', 'too few control pages' FROM c HAVING count(*) < 15
UNION ALL SELECT 'watchlist', 'missing version'
"""

QUERIES = {
    "collapsed_captures": collapsed_captures,
    "history_classes": history_classes,
    "live_classes": live_classes,
    "settled_candidates": settled_candidates,
    "gone_rate": gone_rate,
    "class_rates": class_rates,
    "unverifiable_reasons": unverifiable_reasons,
    "hash_sample": hash_sample,
    "sample_per_source": sample_per_source,
    "over_cap_marks": over_cap_marks,
    "answer_intake": answer_intake,
    "token_costs": token_costs,
    "watchlist_rules": watchlist_rules,
}

ORACLES = {
    "collapsed_captures": _CAPS + """, l AS (SELECT *, lag(digest) OVER (PARTITION BY page ORDER BY stamp, pos) AS p FROM cap)
      SELECT page, stamp AS "timestamp", pos, digest FROM l WHERE p IS NULL OR p <> digest""",
    "history_classes": _CLASSES + "SELECT * FROM cls",
    "live_classes": _CAPS + "SELECT page, live_class FROM lc",
    "settled_candidates": _CLASSES + "SELECT * FROM settled",
    "gone_rate": _CAPS + f""", n AS (SELECT count(*) AS candidates,
        {', '.join(f"count(*) FILTER (live_class = '{c}') AS {c}" for c in _LIVE_NAMES)} FROM lc),
      d AS (SELECT *, gone_404 + gone_410 AS gone, ok + gone_404 + gone_410 + legal_451 + other AS decided,
        botwall + server_error + unreachable AS excluded FROM n)
      SELECT *, CASE WHEN decided > 0 THEN round_even(gone / decided * 10000, 0) / 10000 END AS gone_rate,
        {wilson_sql('gone', 'decided', 'gone_low', 'gone_high')} FROM d""",
    "class_rates": _CLASSES + f""", n AS (SELECT page % 4 AS category, count(*) AS examined,
        {', '.join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ('unchanged', 'changed', 'unverifiable', 'gone'))} FROM settled GROUP BY 1),
      d AS (SELECT *, unchanged + changed AS decided FROM n)
      SELECT *, CASE WHEN decided > 0 THEN round_even(changed / decided * 10000, 0) / 10000 END AS changed_rate,
        {wilson_sql('changed', 'decided', 'changed_low', 'changed_high')},
        round_even(unverifiable / examined * 10000, 0) / 10000 AS unverifiable_rate,
        {wilson_sql('unverifiable', 'examined', 'unverifiable_low', 'unverifiable_high')} FROM d""",
    "unverifiable_reasons": _CLASSES + "SELECT reason, count(*) AS n FROM settled WHERE class = 'unverifiable' GROUP BY reason",
    "hash_sample": f"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, page_id FROM pages),
      pool AS (SELECT DISTINCT host, url FROM p WHERE url NOT IN (SELECT url FROM p WHERE url LIKE '%ref=%')),
      r AS (SELECT *, sha256('{DAY}|' || url) AS rank FROM pool
            QUALIFY row_number() OVER (PARTITION BY host ORDER BY sha256('{DAY}|' || url), url) <= 5)
      SELECT host, url, rank FROM r WHERE url NOT IN (SELECT url FROM p WHERE url LIKE '%#top')""",
    "sample_per_source": f"""SELECT source, 'doc/' || doc_id AS url, sha256('{DAY}|doc/' || doc_id) AS rank FROM documents
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('{DAY}|doc/' || doc_id)) <= 5""",
    "over_cap_marks": _CAPS + """SELECT left(stamp, 8) AS night, page, pos,
      row_number() OVER (PARTITION BY left(stamp, 8) ORDER BY page, pos) > 40 AS over_cap FROM cap""",
    "answer_intake": """WITH a AS (SELECT event_id, event_type, props, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events),
      t AS (SELECT *, ['number_revised','date_shifted','negation_flipped','commitment_removed','attribution_removed','none','other'][k % 7 + 1] AS kind FROM a)
      SELECT event_id, CASE WHEN k % 10 > 1 AND kind <> 'other' THEN kind END AS type,
        CASE WHEN k % 10 > 1 AND kind <> 'other' THEN 'high' END AS confidence,
        CASE WHEN k % 10 > 1 AND kind <> 'other' THEN repeat(event_type || ' ', 20) END AS reason,
        CASE WHEN k % 10 = 0 THEN 'unparsed' WHEN k % 10 = 1 OR kind = 'other' THEN 'out_of_vocabulary' END AS error, true AS estimated FROM t""",
    "token_costs": """WITH w AS (SELECT conv_id, role, len(regexp_extract_all(text, '[^\\s\\p{Z}]+')) AS n FROM conversations),
      s AS (SELECT conv_id, CAST(coalesce(sum(n) FILTER (role <> 'assistant'), 0) AS BIGINT) AS input_tokens,
        CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens FROM w GROUP BY conv_id)
      SELECT *, round_even((input_tokens / 1000000 * 1.0::DOUBLE + output_tokens / 1000000 * 5.0::DOUBLE) * 0.5::DOUBLE * 1000000, 0) / 1000000 AS cost_usd FROM s""",
    "watchlist_rules": _WATCH,
}
