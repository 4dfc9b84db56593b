"""SQL fragments that restate the text expressions for the SQL twins."""

from __future__ import annotations

from recordlens import vocab as v

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
WS = r"[\s\p{Z}]"


def doubled(col: str) -> str:
    """Every separator twice, so that neighbouring whole-word matches do not overlap."""
    return f"(' ' || regexp_replace({col}, '({NW})', '\\1\\1', 'g') || ' ')"


def _alt(words) -> str:
    return "|".join(w.replace(" ", "  ") for w in words)


def word_count(col: str, words) -> str:
    return f"len(regexp_extract_all({doubled(col)}, '(?i){NW}(?:{_alt(words)}){NW}'))"


def has_word(col: str, words) -> str:
    return f"regexp_matches({doubled(col)}, '(?i){NW}(?:{_alt(words)}){NW}')"


def has_attribution(col: str) -> str:
    titles = "|".join(v.ATTRIBUTION_TITLES)
    return (
        f"regexp_matches({doubled(col)}, '(?i){NW}(?:(?:{_alt(v.ATTRIBUTIONS)}){NW}"
        f"|(?:{titles})\\.\\.{W})')"
    )


def token_count(col: str) -> str:
    return f"len(regexp_extract_all({col}, '[^\\s\\p{{Z}}]+'))"


def sentences(col: str) -> str:
    cut = f"string_split(regexp_replace({col}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    trimmed = f"list_transform({cut}, lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def collapse(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WS}+', ' ', 'g'))"


def is_prose(col: str) -> str:
    stops = ",".join(f"'{w}'" for w in v.STOPWORDS)
    words = f"regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')"
    share = f"len(list_filter({words}, lambda w: w IN ({stops}))) / len({words})"
    return (
        f"coalesce({token_count(col)} BETWEEN {v.PROSE_MIN_TOKENS} AND {v.PROSE_MAX_TOKENS} "
        f"AND len({words}) > 0 AND {share} >= {v.PROSE_MIN_STOP_SHARE}, false)"
    )


def numbers(col: str) -> str:
    return f"len(regexp_extract_all(' ' || {col}, '{NW}\\p{{Nd}}[\\p{{Nd}}.,]*'))"


def dates(col: str) -> str:
    gap = f"(?:{WS}{WS})?"
    dotted = rf"\p{{Nd}}{{1,2}}\.\.{gap}\p{{Nd}}{{1,2}}\.\.{gap}(?:19|20)\p{{Nd}}{{2}}"
    months = "|".join(v.DATE_MONTHS)
    return f"len(regexp_extract_all({doubled(col)}, '(?i){NW}(?:(?:19|20)\\p{{Nd}}{{2}}|{dotted}|{months}){NW}'))"


def entities(col: str) -> str:
    words = f"list_filter(string_split(regexp_replace(s, '{WS}+', ' ', 'g'), ' '), lambda x: x <> '')[2:]"
    return (
        f"coalesce(list_sum(list_transform({sentences(col)}, lambda s: "
        f"len(list_filter({words}, lambda w: regexp_matches(w, '^[A-ZÄÖÜ]{W}'))))), 0)"
    )


def signal_columns(col: str) -> str:
    return (
        f"{numbers(col)} AS c_number, {dates(col)} AS c_date, {entities(col)} AS c_entity, "
        f"{word_count(col, v.NEGATIONS)} AS c_negation, {word_count(col, v.COMMITMENTS)} AS c_commit"
    )


SCORE = (
    "CAST(2 * least(c_number, 5) + 2 * least(c_date, 5) + least(c_entity, 5) + 2 * least(c_negation, 5) "
    "+ 3 * least(c_commit, 5) AS BIGINT)"
)
SIGNALS = (
    "array_to_string(list_filter([CASE WHEN c_commit > 0 THEN 'commitment_verb' END, CASE WHEN c_date > 0 THEN 'date' END, "
    "CASE WHEN c_entity > 0 THEN 'named_entity' END, CASE WHEN c_negation > 0 THEN 'negation' END, "
    "CASE WHEN c_number > 0 THEN 'number' END], lambda x: x IS NOT NULL), ',')"
)


def numeric(col: str, years: bool) -> str:
    tokens = f"regexp_extract_all({col}, '[\\p{{L}}\\p{{N}}]+')"
    test = "" if years else "NOT "
    return (
        f"list_sort(list_filter({tokens}, lambda t: regexp_full_match(t, '\\p{{Nd}}+') "
        f"AND {test}regexp_full_match(t, '(?:19|20)\\p{{Nd}}{{2}}')))"
    )


def markers(col: str, words) -> str:
    items = ", ".join(f"CASE WHEN contains(lower({col}), '{w}') THEN '{w}' END" for w in words)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def gate_reason(text: str, status: str) -> str:
    prose = f"len(list_filter({sentences(text)}, lambda q: {is_prose('q')}))"
    return (
        f"CASE WHEN {status} <> '200' THEN 'status_' || {status} "
        f"WHEN len({markers(text, v.CHALLENGE_MARKERS)}) > 0 THEN 'challenge_fingerprint' "
        f"WHEN {token_count(text)} < 60 THEN 'too_short' "
        f"WHEN len({markers(text, v.CONSENT_MARKERS)}) >= 2 AND {token_count(text)} < 400 THEN 'consent_boilerplate' "
        f"WHEN {prose} < 3 THEN 'not_prose' ELSE 'ok' END"
    )


def page_text(source: str) -> str:
    """WITH clauses up to page_texts (page_id, main_text) from a query of (page_id, html).

    Pages are cut at every opening sign; a running sum of skipped starts and ends, held at
    zero from below, tells what is shown.
    """
    skipped = ", ".join(f"'{t}'" for t in v.SKIPPED_TAGS)
    text = "string_agg(shown, ' ' ORDER BY k)"
    for entity, char in (("&nbsp;", "' '"), ("&eacute;", "'é'"), ("&eacute", "'é'"), ("&mdash;", "'—'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {char})"
    return f"""WITH src AS ({source}),
      live AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
          '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g') AS h FROM src),
      cut AS (SELECT page_id, unnest(string_split(h, '<')) AS c, generate_subscripts(string_split(h, '<'), 1) AS k FROM live),
      tag AS (SELECT *, k > 1 AS is_tag, lower(regexp_extract(c, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM cut),
      step AS (SELECT *, CASE WHEN NOT is_tag OR name NOT IN ({skipped}) THEN 0 WHEN starts_with(c, '/') THEN -1 ELSE 1 END AS d FROM tag),
      run AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY k) AS total FROM step),
      deep AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY k)) AS depth FROM run),
      page_texts AS (SELECT s.page_id, coalesce({collapse(text)}, '') AS main_text FROM src s LEFT JOIN (
          SELECT page_id, k, CASE WHEN is_tag THEN substr(c, strpos(c, '>') + 1) ELSE c END AS shown FROM deep WHERE depth = 0) t
        ON t.page_id = s.page_id GROUP BY s.page_id)
      """
