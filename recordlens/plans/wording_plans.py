"""Wording queries: documents and pages as captures before and after an edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions import text as tx
from recordlens.operators import wording as wd
from recordlens.plans import sqltext as q
from recordlens.plans.tables import spread, table

# The tables hold invented words, so each document gets one sentence that an edit rewrites.
EDITS = (
    (
        "The programme will reduce the emissions of the sector by 65 percent before 2030.",
        "The programme will reduce the emissions of the sector by 55 percent before 2030.",
    ),
    (
        "The federal government commits to the neutrality of the country by 2045.",
        "The federal government commits to the neutrality of the country by 2050.",
    ),
    (
        "The authority will not extend the deadline for the reporting duty.",
        "The authority will extend the deadline for the reporting duty.",
    ),
    ("The company will reach the target by the middle of the century.", ""),
    (
        "According to director Maria Schmidt the target remains in force for all of the divisions.",
        "The target remains in force for all of the divisions.",
    ),
    (
        "The office publishes the annual figures for the reporting period 2024.",
        "The office publishes the annual figures for the whole reporting period 2024.",
    ),
    ("The rules of the office apply from March on to all of the sites.", "The rules of the office apply from now on to all of the sites."),
)


def _pick(i: int):
    out = F.lit("")
    for n, edit in enumerate(EDITS):
        out = F.when(F.col("doc_id") % len(EDITS) == n, F.lit(edit[i])).otherwise(out)
    return out


def _status(col, shift):
    return F.when((col + shift) % 37 == 0, "403").when((col + shift) % 41 == 0, "-").otherwise("200")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, source, before, after): whole texts; the edit drops the first sentence and every ' of '."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    base = F.replace(F.regexp_replace(F.col("text"), r"^[^.!?]*[.!?][\s\p{Z}]+", ""), F.lit(" of "), F.lit(" "))
    return d.select(
        F.col("doc_id").alias("page"), "source", "lang",
        F.concat("text", F.lit(" "), _pick(0)).alias("before"),
        F.concat(base, F.lit(" "), _pick(1)).alias("after"),
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a third each as it is, inside nested menus, and before a form that never ends."""
    p = spread(table(spark, sf_dir, "pages"), "page_id")
    third = F.col("page_id") % 3
    html = F.when(third == 0, F.col("html")).when(
        third == 1, F.concat(F.lit("<nav>one<nav>two</nav>three</nav>Caf&eacute &mdash; "), F.col("html"), F.lit("</nav>end"))
    ).otherwise(F.concat(F.col("html"), F.lit("<p>last &amp; least<form><p>never shown")))
    return p.select("page_id", wd.page_text(html).alias("main_text"))


def validity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    judged = wd.with_gate(d.select("doc_id", "text", _status(F.col("doc_id"), 0).alias("status")), "text", "status", "g")
    return judged.select("doc_id", "g.valid", "g.reason")


def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate over extracted pages, with what it counted."""
    p = spread(table(spark, sf_dir, "pages"), "page_id")
    text = p.select("page_id", wd.page_text(F.col("html")).alias("t"), F.lit("200").alias("status"))
    judged = wd.with_gate(text, "t", "status", "g")
    return judged.select(
        "page_id", "g.valid", "g.reason", F.col("g.tokens").cast("bigint").alias("tokens"),
        F.array_join("g.markers", ",").alias("markers"),
    )


def prose_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and prose sentences per document."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        "doc_id", F.size(tx.sentences(F.col("text"))).cast("bigint").alias("sentences"),
        tx.prose_count(tx.sentences(F.col("text"))).cast("bigint").alias("prose"),
    )


def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = edited(spark, sf_dir).select("page", tx.salience(F.col("before")).alias("s"))
    return s.select("page", F.col("s.score").cast("bigint").alias("score"), F.array_join("s.signals", ",").alias("signals"))


def _diff(spark, sf_dir) -> DataFrame:
    return wd.sentence_diff(edited(spark, sf_dir))


def sentence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diff(spark, sf_dir)
    return d.withColumn("before_idx", F.col("before_idx").cast("bigint")).withColumn(
        "after_idx", F.col("after_idx").cast("bigint")
    )


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.diff_counts(_diff(spark, sf_dir))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = wd.type_events(_diff(spark, sf_dir))
    return e.select(
        "page", "type", "rule", "before_sha256", "after_sha256", "before", "after",
        F.col("salience").cast("bigint").alias("salience"), F.array_join("signals", ",").alias("signals"),
    )


def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = wd.abstentions(_diff(spark, sf_dir))
    return a.select(
        "page", "before_sha256", "before", "after", F.col("salience").cast("bigint").alias("salience"),
        F.array_join("signals", ",").alias("signals"),
    )


def top_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct passages by weight, ties by digest, each with its rank."""
    a = wd.abstentions(_diff(spark, sf_dir)).select("before_sha256", "salience").distinct()
    return wd.ranked_abstentions(a).select("before_sha256", F.col("salience").cast("bigint").alias("salience"), "rank")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited(spark, sf_dir).select(
        "page", F.lit(False).alias("over_cap"), "before", _status(F.col("page"), 0).alias("before_status"),
        "after", _status(F.col("page"), 5).alias("after_status"),
    )
    return wd.read_pages(pairs).select("page", "class", "reason")


def simultaneous_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as urls, their source as institution; the last source is the control group."""
    docs = edited(spark, sf_dir)
    removed = _diff(spark, sf_dir).filter("op = 'removed'").select("page", F.col("before").alias("passage"))
    rows = removed.join(docs.select("page", "source"), "page").select(
        F.col("page").alias("url"), F.col("source").alias("institution"),
        F.when(F.col("source") == "src19", "E").otherwise("A").alias("category"), "passage",
    )
    return wd.simultaneous_loss(rows)


def simultaneous_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages lost within fourteen nights; a document's night follows from its number and source."""
    docs = edited(spark, sf_dir)
    night = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page") * 7 + F.length("source")) % 60).cast("int"))
    where = docs.select(
        "page", F.col("source").alias("institution"), F.when(F.col("source") == "src19", "E").otherwise("A").alias("category"), night.alias("night")
    )
    rows = wd.losses(_diff(spark, sf_dir)).join(where, "page").withColumnRenamed("page", "url")
    out = wd.simultaneous_windows(rows)
    day = lambda c: F.col(c).cast("string").alias(c)
    return out.select("passage_sha256", day("first_night"), day("last_night"), "urls", "institutions")


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened texts, redacted addresses, permalinks, page ids and amounts in words."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", tx.without_query(F.col("url")).alias("redacted_url"), tx.page_id(F.col("url")).alias("url_id"),
        tx.capture_link(F.lit("20240130120000"), F.col("url"), "https://archive.test/web").alias("permalink"),
        tx.capture_link(F.lit("20240130120000"), F.col("url"), "https://archive.test/web", raw=True).alias("raw_link"),
        tx.short(F.col("url"), 30).alias("short_url"),
    )
    return p


def usd_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer totals in words, from plain dollars up to billions."""
    o = table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).cast("bigint").alias("total"))
    scaled = F.when(F.col("o_custkey") % 3 == 0, F.col("total") * 1000).when(
        F.col("o_custkey") % 3 == 1, F.floor(F.col("total") / 100)
    ).otherwise(F.col("total")).cast("bigint")
    return per.select("o_custkey", scaled.alias("value")).select("o_custkey", "value", tx.usd_words(F.col("value")).alias("words"))


# --- the same in SQL ---------------------------------------------------------


def _sql_pick(i: int) -> str:
    return "CASE " + " ".join(f"WHEN doc_id % {len(EDITS)} = {n} THEN '{e[i]}'" for n, e in enumerate(EDITS)) + " END"


def _sql_status(col: str) -> str:
    return f"CASE WHEN ({col}) % 37 = 0 THEN '403' WHEN ({col}) % 41 = 0 THEN '-' ELSE '200' END"


_EDITED = f"""
WITH RECURSIVE edited AS (SELECT doc_id AS page, source, lang, text || ' ' || {_sql_pick(0)} AS before,
    replace(regexp_replace(text, '^[^.!?]*[.!?]{q.WS}+', ''), ' of ', ' ') || ' ' || {_sql_pick(1)} AS after FROM documents)
"""

_DIFF = _EDITED + f"""
, lists AS (SELECT page, {q.sentences('before')} AS bs, {q.sentences('after')} AS as_ FROM edited WHERE before <> after),
sent AS (SELECT page, 0 AS side, unnest(bs) AS s, generate_subscripts(bs, 1) - 1 AS idx FROM lists
  UNION ALL SELECT page, 1, unnest(as_), generate_subscripts(as_, 1) - 1 FROM lists),
eq AS MATERIALIZED (SELECT b.page, b.idx AS i, a.idx AS j FROM sent b JOIN sent a ON a.page = b.page AND a.s = b.s AND b.side = 0 AND a.side = 1),
rng(page, i1, i2, j1, j2, fi, fj, fn) AS (
  SELECT page, CAST(0 AS BIGINT), CAST(len(bs) AS BIGINT), CAST(0 AS BIGINT), CAST(len(as_) AS BIGINT),
    CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM lists
  UNION ALL
  SELECT page, unnest([i1, bi + n]), unnest([bi, i2]), unnest([j1, bj + n]), unnest([bj, j2]), unnest([bi, NULL]), unnest([bj, NULL]), unnest([n, NULL])
  FROM (SELECT *, row_number() OVER (PARTITION BY page, i1, i2, j1, j2 ORDER BY n DESC, bi, bj) AS pos FROM (
    SELECT page, i1, i2, j1, j2, min(i) AS bi, min(j) AS bj, count(*) AS n FROM (
      SELECT r.page, r.i1, r.i2, r.j1, r.j2, e.i, e.j,
        e.i - row_number() OVER (PARTITION BY r.page, r.i1, r.i2, r.j1, r.j2, e.i - e.j ORDER BY e.i) AS run
      FROM rng r JOIN eq e ON e.page = r.page AND e.i >= r.i1 AND e.i < r.i2 AND e.j >= r.j1 AND e.j < r.j2)
    GROUP BY page, i1, i2, j1, j2, i - j, run)) WHERE pos = 1),
kept AS (SELECT page, fi AS i, fj AS j, fn AS n FROM rng WHERE fn IS NOT NULL
  UNION ALL SELECT page, len(bs), len(as_), 0 FROM lists),
gap AS (SELECT page, row_number() OVER w AS g, coalesce(lag(i + n) OVER w, 0) AS i1, i AS i2, coalesce(lag(j + n) OVER w, 0) AS j1, j AS j2
  FROM kept WINDOW w AS (PARTITION BY page ORDER BY i, j)),
rest AS MATERIALIZED (SELECT s.page, s.side, s.idx, s.s, g.g FROM sent s JOIN gap g ON g.page = s.page
  AND ((s.side = 0 AND s.idx >= g.i1 AND s.idx < g.i2) OR (s.side = 1 AND s.idx >= g.j1 AND s.idx < g.j2))),
tok AS MATERIALIZED (SELECT page, side, idx, g, unnest(list_distinct(regexp_extract_all(replace(lower(s), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'))) AS t FROM rest),
sz AS (SELECT page, side, idx, count(*) AS n FROM tok GROUP BY ALL),
common AS (SELECT b.page, b.idx AS bi, a.idx AS ai, count(*) AS c FROM tok b JOIN tok a
   ON a.page = b.page AND a.g = b.g AND a.t = b.t AND b.side = 0 AND a.side = 1 GROUP BY ALL),
cand AS MATERIALIZED (SELECT c.page, bi, ai, c / (x.n + y.n - c) AS score,
    row_number() OVER (PARTITION BY c.page ORDER BY bi, c / (x.n + y.n - c) DESC, ai) AS r
  FROM common c JOIN sz x ON x.page = c.page AND x.side = 0 AND x.idx = bi
  JOIN sz y ON y.page = c.page AND y.side = 1 AND y.idx = ai WHERE c / (x.n + y.n - c) > 0.5),
walk AS (
  SELECT page, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS tb, CAST([] AS BIGINT[]) AS ta, false AS ok,
    CAST(NULL AS BIGINT) AS bi, CAST(NULL AS BIGINT) AS ai FROM (SELECT DISTINCT page FROM cand)
  UNION ALL
  SELECT w.page, c.r,
    CASE WHEN list_contains(w.tb, c.bi) OR list_contains(w.ta, c.ai) THEN w.tb ELSE list_append(w.tb, c.bi) END,
    CASE WHEN list_contains(w.tb, c.bi) OR list_contains(w.ta, c.ai) THEN w.ta ELSE list_append(w.ta, c.ai) END,
    NOT (list_contains(w.tb, c.bi) OR list_contains(w.ta, c.ai)), c.bi, c.ai
  FROM walk w JOIN cand c ON c.page = w.page AND c.r = w.r + 1),
matched AS (SELECT page, bi, ai FROM walk WHERE ok),
diff AS (
  SELECT b.page, CASE WHEN m.page IS NULL THEN 'removed' ELSE 'rewritten' END AS op, b.idx AS before_idx, m.ai AS after_idx,
    b.s AS before, a.s AS after
  FROM rest b LEFT JOIN matched m ON m.page = b.page AND m.bi = b.idx
  LEFT JOIN rest a ON a.page = m.page AND a.side = 1 AND a.idx = m.ai WHERE b.side = 0
  UNION ALL
  SELECT a.page, 'added', NULL, a.idx, NULL, a.s FROM rest a LEFT JOIN matched m ON m.page = a.page AND m.ai = a.idx
  WHERE a.side = 1 AND m.page IS NULL)
"""


def _sql_rule(when: str, kind: str, rule: str) -> str:
    return f"CASE WHEN {when} THEN {{'type': '{kind}', 'rule': '{rule}'}} END"


def _sql_pair_types(b: str, a: str) -> str:
    same = f"({q.numeric(b, True)} = {q.numeric(a, True)} AND {q.numeric(b, False)} = {q.numeric(a, False)})"
    rules = [
        _sql_rule(f"{q.numeric(b, True)} <> {q.numeric(a, True)}", "date_shifted", "year rewritten in place"),
        _sql_rule(f"{q.numeric(b, False)} <> {q.numeric(a, False)}", "number_revised", "figure rewritten in place"),
        _sql_rule(
            f"{same} AND {q.has_word(b, v.MONTHS)} AND NOT {q.has_word(a, v.MONTHS)}",
            "date_shifted", "month name dropped from the sentence",
        ),
        _sql_rule(
            f"{q.word_count(b, v.NEGATIONS)} <> {q.word_count(a, v.NEGATIONS)}", "negation_flipped", "negation count changed"
        ),
        _sql_rule(
            f"{q.word_count(b, v.COMMITMENTS)} > 0 AND {q.word_count(a, v.COMMITMENTS)} = 0",
            "commitment_removed", "commitment verb dropped in rewrite",
        ),
        _sql_rule(
            f"{q.has_attribution(b)} AND NOT {q.has_attribution(a)}", "attribution_removed", "ascription dropped in rewrite"
        ),
    ]
    return f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"


def _sql_removal_types(b: str) -> str:
    rules = [
        _sql_rule(f"{q.word_count(b, v.COMMITMENTS)} > 0", "commitment_removed", "sentence with commitment verb removed"),
        _sql_rule(q.has_attribution(b), "attribution_removed", "sentence with an ascription removed"),
    ]
    return f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"


_JUDGED = _DIFF + f"""
, prose AS (SELECT * FROM diff WHERE op <> 'added' AND ({q.is_prose('before')} OR (op = 'rewritten' AND {q.is_prose('after')}))),
judged AS (SELECT *, CASE WHEN op = 'rewritten' THEN {_sql_pair_types('before', 'after')} ELSE {_sql_removal_types('before')} END AS verdicts,
    {q.has_attribution('before')} OR coalesce({q.has_attribution('after')}, false) AS redact, {q.signal_columns('before')} FROM prose),
scored AS (SELECT *, {q.SCORE} AS salience, {q.SIGNALS} AS signals FROM judged),
abst AS (SELECT page, sha256(before) AS before_sha256, CASE WHEN NOT redact THEN before END AS before,
    CASE WHEN NOT redact THEN after END AS after, salience, signals FROM scored WHERE len(verdicts) = 0 AND salience > 0)
"""

QUERIES = {
    "page_text": page_text,
    "validity_gate": validity_gate,
    "page_gate": page_gate,
    "prose_shares": prose_shares,
    "salience": salience,
    "sentence_diff": sentence_diff,
    "diff_counts": diff_counts,
    "typed_events": typed_events,
    "abstentions": abstentions,
    "top_abstentions": top_abstentions,
    "read_pages": read_pages,
    "simultaneous_loss": simultaneous_loss,
    "simultaneous_windows": simultaneous_windows,
    "text_words": text_words,
    "usd_words": usd_words,
}

ORACLES = {
    "page_text": q.page_text("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN html
        WHEN 1 THEN '<nav>one<nav>two</nav>three</nav>Caf&eacute &mdash; ' || html || '</nav>end'
        ELSE html || '<p>last &amp; least<form><p>never shown' END AS html FROM pages""")
      + "SELECT page_id, main_text FROM page_texts",
    "validity_gate": f"""WITH r AS (SELECT doc_id, {q.gate_reason('text', _sql_status('doc_id'))} AS reason FROM documents)
      SELECT doc_id, reason = 'ok' AS valid, reason FROM r""",
    "page_gate": q.page_text("SELECT page_id, html FROM pages") + f""", t AS (SELECT page_id, main_text AS t FROM page_texts),
      r AS (SELECT *, {q.gate_reason('t', "'200'")} AS reason FROM t)
      SELECT page_id, reason = 'ok' AS valid, reason, {q.token_count('t')} AS tokens,
        CASE reason WHEN 'challenge_fingerprint' THEN array_to_string({q.markers('t', v.CHALLENGE_MARKERS)}, ',')
          WHEN 'consent_boilerplate' THEN array_to_string({q.markers('t', v.CONSENT_MARKERS)}, ',') ELSE '' END AS markers FROM r""",
    "prose_shares": f"""SELECT doc_id, len({q.sentences('text')}) AS sentences,
      len(list_filter({q.sentences('text')}, lambda q: {q.is_prose('q')})) AS prose FROM documents""",
    "salience": _EDITED + f", s AS (SELECT page, {q.signal_columns('before')} FROM edited) SELECT page, {q.SCORE} AS score, {q.SIGNALS} AS signals FROM s",
    "sentence_diff": _DIFF + "SELECT * FROM diff",
    "diff_counts": _DIFF + f"""SELECT page, CAST(coalesce(sum({q.token_count('before')}) FILTER (op = 'removed'), 0) AS BIGINT) AS removed_tokens,
      count(*) FILTER (op = 'added') AS added_sentences, count(*) FILTER (op = 'rewritten') AS rewritten_pairs FROM diff GROUP BY page""",
    "typed_events": _JUDGED + """, e AS (SELECT *, unnest(verdicts) AS v FROM scored)
      SELECT page, v.type AS type, v.rule AS rule, sha256(before) AS before_sha256, sha256(after) AS after_sha256,
        CASE WHEN NOT redact AND v.type <> 'attribution_removed' THEN before END AS before,
        CASE WHEN NOT redact AND v.type <> 'attribution_removed' THEN after END AS after, salience, signals FROM e""",
    "abstentions": _JUDGED + "SELECT * FROM abst",
    "top_abstentions": _JUDGED + """SELECT *, rank() OVER (ORDER BY salience DESC, before_sha256) AS rank FROM (SELECT DISTINCT before_sha256, salience FROM abst)""",
    "read_pages": _EDITED + f""", g AS (SELECT page, false AS over_cap, {q.gate_reason('before', _sql_status('page'))} AS gb,
        {q.gate_reason('after', _sql_status('page + 5'))} AS ga FROM edited)
      SELECT page, CASE WHEN NOT over_cap AND gb = 'ok' AND ga = 'ok' THEN 'changed' ELSE 'unverifiable' END AS class,
        CASE WHEN over_cap THEN 'over_nightly_fetch_cap' WHEN gb <> 'ok' THEN 'gate_before_' || gb WHEN ga <> 'ok' THEN 'gate_after_' || ga
          ELSE 'new digest, both captures passed the gate' END AS reason FROM g""",
    "simultaneous_loss": _DIFF + f""", n AS (SELECT d.page, e.source, {q.collapse(f"regexp_replace(lower(d.before), '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}]+', '', 'g')")} AS norm
        FROM diff d JOIN edited e ON e.page = d.page WHERE d.op = 'removed' AND e.source <> 'src19')
      SELECT sha256(norm) AS passage_sha256, count(DISTINCT page) AS urls, count(DISTINCT source) AS institutions FROM n
      WHERE {q.token_count('norm')} >= 8 GROUP BY norm HAVING count(DISTINCT page) >= 3 AND count(DISTINCT source) >= 2""",
    "simultaneous_windows": _JUDGED + f""", l AS (SELECT page, before FROM diff WHERE op = 'removed'
        UNION ALL SELECT page, before FROM scored WHERE op = 'rewritten'
          AND list_has_any(list_transform(verdicts, lambda x: x.type), ['commitment_removed', 'attribution_removed', 'negation_flipped'])),
      n AS (SELECT DISTINCT l.page, e.source, DATE '2024-01-01' + CAST((l.page * 7 + length(e.source)) % 60 AS INT) AS night,
          {q.collapse(f"regexp_replace(lower(l.before), '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}]+', '', 'g')")} AS norm
        FROM l JOIN edited e ON e.page = l.page WHERE e.source <> 'src19'),
      k AS (SELECT sha256(norm) AS p, page, source, night FROM n WHERE {q.token_count('norm')} >= 8),
      w AS (SELECT DISTINCT p, night AS f FROM k)
      SELECT w.p AS passage_sha256, CAST(w.f AS VARCHAR) AS first_night, CAST(w.f + 13 AS VARCHAR) AS last_night, count(DISTINCT page) AS urls,
        count(DISTINCT source) AS institutions FROM w JOIN k ON k.p = w.p AND k.night BETWEEN w.f AND w.f + 13
      GROUP BY w.p, w.f HAVING count(DISTINCT page) >= 3 AND count(DISTINCT source) >= 2""",
    "text_words": """SELECT page_id, regexp_replace(url, '(?s)\\?.*', '') AS redacted_url, left(sha256(url), 16) AS url_id,
      'https://archive.test/web/20240130120000/' || url AS permalink, 'https://archive.test/web/20240130120000id_/' || url AS raw_link,
      CASE WHEN length(url) <= 30 THEN url ELSE left(url, 29) || '…' END AS short_url FROM pages""",
    "usd_words": """WITH per AS (SELECT o_custkey, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1),
      s AS (SELECT o_custkey, CAST(CASE o_custkey % 3 WHEN 0 THEN total * 1000 WHEN 1 THEN floor(total / 100) ELSE total END AS BIGINT) AS value FROM per)
      SELECT o_custkey, value, CASE WHEN value >= 1000000000 THEN '$' || printf('%.1f', value / 1000000000) || 'bn'
        WHEN value >= 1000000 THEN '$' || printf('%.0f', value / 1000000) || 'm' ELSE '$' || format('{:,}', value) END AS words FROM s""",
}
