"""Column expressions over text: sentences, words, prose, weight, markers.

Everything here is built from native expressions, so a scan over whole texts stays on
the JVM. Patterns spell out Unicode classes because Java's short classes are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlens import vocab as v

WORD_CHAR = r"[\p{L}\p{N}_]"
_BEFORE = rf"(?<!{WORD_CHAR})"
_AFTER = rf"(?!{WORD_CHAR})"


def _starts(words, more: str = "") -> str:
    """Looks at one letter before anything else: most places of a text start none of the words."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}{more}])"


def _any_word(words) -> str:
    return rf"(?iu){_starts(words)}{_BEFORE}(?:{'|'.join(words)}){_AFTER}"


NUMBER = rf"(?iu)(?=\p{{Nd}}){_BEFORE}\p{{Nd}}[\p{{Nd}}.,]*[\s\p{{Z}}]?(?:{'|'.join(v.NUMBER_UNITS)})?"
DATE = (
    rf"(?iu){_starts(v.DATE_MONTHS, r'\p{Nd}')}(?:{_BEFORE}(?:19|20)\p{{Nd}}{{2}}{_AFTER}"
    rf"|{_BEFORE}\p{{Nd}}{{1,2}}\.[\s\p{{Z}}]?\p{{Nd}}{{1,2}}\.[\s\p{{Z}}]?(?:19|20)\p{{Nd}}{{2}}{_AFTER}"
    rf"|{_BEFORE}(?:{'|'.join(v.DATE_MONTHS)}){_AFTER})"
)
NEGATION = _any_word(v.NEGATIONS)
COMMITMENT = _any_word(v.COMMITMENTS)
MONTH = _any_word(v.MONTHS)
ATTRIBUTION = (
    rf"(?iu){_starts(v.ATTRIBUTIONS + v.ATTRIBUTION_TITLES)}{_BEFORE}(?:(?:{'|'.join(v.ATTRIBUTIONS)}){_AFTER}"
    rf"|(?:{'|'.join(v.ATTRIBUTION_TITLES)})\.(?={WORD_CHAR}))"
)
ENTITY = rf"(?=[A-ZÄÖÜ])(?<=[^.!?\s\p{{Z}}] )[A-ZÄÖÜ]{WORD_CHAR}"


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def token_count(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(text, F.lit(r"[^\s\p{Z}]+"))


def once(value: Column, use) -> Column:
    """Apply ``use`` to a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentence_pieces(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; an empty text gives one blank.

    The separator takes all white space, so only the ends of the text need trimming.
    """
    # Two characters tell whether there is anything to trim; a last next-line sign ends a line for $.
    bare = ~(F.left(text, F.lit(1)).rlike(r"[\s\p{Z}]") | F.right(text, F.lit(1)).rlike(r"[\s\p{Z}\x{85}]"))
    trimmed = F.when(bare, text).otherwise(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.split(trimmed, r"(?<=[.!?])[\s\p{Z}]+")


def sentences(text: Column) -> Column:
    """The sentences of a text, without blanks."""
    return F.filter(sentence_pieces(text), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def folded(text: Column) -> Column:
    """Case folded: lower case, sharp s as its pair of letters, one form of sigma."""
    return F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def token_set(text: Column) -> Column:
    return F.array_distinct(word_tokens(folded(text)))


def _prose_parts(text: Column) -> Column:
    return F.struct(
        token_count(text).alias("n"),
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0)).alias("words"),
    )


def _prose_test(parts: Column) -> Column:
    stops = F.size(F.filter(parts["words"], lambda w: w.isin(*v.STOPWORDS)))
    return (
        parts["n"].between(v.PROSE_MIN_TOKENS, v.PROSE_MAX_TOKENS)
        & (F.size(parts["words"]) > 0)
        & (stops / F.size(parts["words"]) >= v.PROSE_MIN_STOP_SHARE)
    )


def is_prose(text: Column) -> Column:
    """5 to 60 tokens, and function words make up at least 18 % of the letter words."""
    return F.coalesce(once(_prose_parts(text), _prose_test), F.lit(False))


def prose_count(passages: Column) -> Column:
    """How many passages of an array are prose."""
    return F.size(F.filter(F.transform(passages, _prose_parts), _prose_test))


def markers_found(lowered: Column, markers) -> Column:
    """The listed markers contained in a lower-case text, in list order."""
    hits = [F.when(F.contains(lowered, F.lit(m)), F.lit(m)) for m in markers]
    return F.array_compact(F.array(*hits))


def signal_counts(text: Column) -> dict[str, Column]:
    return {
        "number": F.regexp_count(text, F.lit(NUMBER)),
        "date": F.regexp_count(text, F.lit(DATE)),
        "negation": F.regexp_count(text, F.lit(NEGATION)),
        "commitment_verb": F.regexp_count(text, F.lit(COMMITMENT)),
        "named_entity": F.regexp_count(collapse(text), F.lit(ENTITY)),
    }


def salience(text: Column) -> Column:
    """struct(score, signals): weighted signals, each counted at most five times."""

    def weigh(counts):
        score = sum(
            (F.least(counts[k], F.lit(v.SIGNAL_CAP)) * w for k, w in v.SIGNAL_WEIGHTS.items()),
            F.lit(0),
        )
        found = F.array_compact(
            F.array(*[F.when(counts[k] > 0, F.lit(k)) for k in sorted(v.SIGNAL_WEIGHTS)])
        )
        return F.struct(score.cast("int").alias("score"), found.alias("signals"))

    return once(F.struct(*[c.alias(k) for k, c in signal_counts(text).items()]), weigh)


def has_attribution(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(ATTRIBUTION)), F.lit(False))


def negations(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NEGATION))


def commitments(text: Column) -> Column:
    return F.regexp_count(text, F.lit(COMMITMENT))


def has_month(text: Column) -> Column:
    return F.regexp_like(text, F.lit(MONTH))


def numeric_tokens(text: Column) -> Column:
    """Pure digit tokens, sorted: equal arrays mean equal multisets."""
    return F.array_sort(F.filter(word_tokens(text), lambda t: t.rlike(r"^\p{Nd}+$")))


def storm_token(text: Column) -> Column:
    """First ASCII word of three letters or more that is no storm category, upper case."""
    words = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("[A-Z]{3,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*v.STORM_STOPWORDS))
    return F.get(kept, F.lit(0))


def sha_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def short(text: Column, limit: int = 64) -> Column:
    """Cut to ``limit`` characters, the last one an ellipsis."""
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    )


def usd_words(value: Column) -> Column:
    """Dollar amounts for reading: billions, millions, or the plain figure.

    The binary quotient is rounded, ties to even; ``format_string`` would round the shortest
    decimal half up.
    """
    rounded = lambda x, places: F.replace(F.format_number(x, places), F.lit(","), F.lit(""))
    return (
        F.when(value >= 1_000_000_000, F.concat(F.lit("$"), rounded(value / 1_000_000_000, 1), F.lit("bn")))
        .when(value >= 1_000_000, F.concat(F.lit("$"), rounded(value / 1_000_000, 0), F.lit("m")))
        .otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
    )


def without_query(url: Column) -> Column:
    """Drop everything from the first question mark on."""
    return F.regexp_replace(url, r"(?s)\?.*", "")


def capture_link(stamp: Column, original: Column, base: str, raw: bool = False) -> Column:
    """Address of one archived capture; ``raw`` asks for the bytes without a wrapper."""
    return F.concat(F.lit(base + "/"), stamp, F.lit("id_/" if raw else "/"), original)


def page_id(url: Column) -> Column:
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 16)


def sample_rank(day: Column, url: Column) -> Column:
    return F.sha2(F.concat(day, F.lit("|"), url).cast("binary"), 256)
