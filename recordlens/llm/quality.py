"""Quality rules as a ledger of bits, in DataFrame expressions only.

``ledger`` evaluates every rule once per document and stores the measurements beside one
long whose bit r says that rule r failed. Policies are versioned masks over those bits:
``judged`` applies one, ``ablations`` counts what each rule of each policy decides alone,
from the counts per distinct bit pattern. New policies never touch the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import table

#: Fixed value: what separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule names in bit order; a rule keeps its bit for good, new rules take the next one.
RULES = ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "word_length", "long_repeat_run")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy"),
    "v2": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "word_length"),
}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covered(positions: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words that start at the sorted positions."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(positions) - 1),
        F.lit(0),
        lambda acc, i: acc + F.coalesce(F.least(F.lit(width), F.get(positions, i + 1) - F.get(positions, i)), F.lit(width)),
    )


def _recurring(pairs: Column) -> Column:
    """The sorted i of structs (v, i), sorted, whose v a neighbour has too."""
    same = lambda i, j: F.coalesce(F.get(pairs, i)["v"] == F.get(pairs, j)["v"], F.lit(False))
    marked = F.transform(pairs, lambda p, k: F.when(same(k, k - 1) | same(k, k + 1), p["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _repeat_words(words: Column) -> Column:
    """Words in windows met twice or more.

    Windows are found by a 64-bit hash; only those whose hash recurs are compared as
    words, so the count is exact.
    """
    window = lambda i: F.slice(words, i + 1, F.lit(WINDOW))
    starts = F.when(F.size(words) > WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))

    def spelt(likely: Column) -> Column:
        texts = F.sort_array(F.transform(likely, lambda i: F.struct(F.array_join(window(i), " ").alias("v"), i.alias("i"))))
        return _let(_let(texts, _recurring), lambda found: F.when(F.size(found) > 0, _covered(found, WINDOW)).otherwise(0))

    def likely(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("v"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(pairs, _recurring), spelt)).otherwise(0)

    return _let(F.transform(starts, lambda i: F.xxhash64(window(i))), likely)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    A null text has no words, lines or symbols (all zero). Everything happens in the
    document's own row: no shuffle, whatever the copies. The measurements come from one
    generated row, so a filter on them is never copied below their computation.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeat")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    symbols = F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))
    found = _let(
        F.struct(by_word.alias("w"), by_line.alias("x")),
        lambda v: F.struct(
            v["w"]["n"].cast("long").alias("n_words"), v["w"]["chars"].cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            v["x"]["dup"].cast("long").alias("n_dup_lines"), v["w"]["repeat"].cast("long").alias("n_repeat_words"), v["x"]["n"].cast("long").alias("n_lines"),
        ),
    )
    return docs.select("*", F.inline(F.array(found)))


def _conditions() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "symbol_heavy": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "long_repeat_run": 100 * F.col("n_repeat_words") > 60 * n,
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that a document breaks.

    Every column of ``docs`` stays; columns named like a measurement are replaced.
    """
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failed"}
    docs = docs.drop(*(names & set(docs.columns) - {text}))
    rules = _conditions()
    bits = [F.when(rules[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, text).withColumn("failed", total.cast("long"))


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """(policy, rule, n_documents, n_failed, n_only): what each rule of each policy decides.

    n_failed counts documents that fail the rule, n_only those that no other rule of the
    policy rejects: they would be kept without it. One aggregate over the bit patterns
    (at most two to the number of rules), then bit arithmetic on that small table.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask")) for p in POLICIES for r in POLICIES[p]))
    x = patterns.select("failed", "n", F.explode(pairs).alias("x")).select("failed", "n", "x.*")
    return x.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_documents"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op2_quality(spark: SparkSession, sf_dir: str, policy: str = "v2") -> DataFrame:
    """Every document with its measurements, the base rules' verdict and the policy's."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return judged(rows, policy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed"
    )


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, policy: str = "v2") -> DataFrame:
    """Pipeline stage: documents that the policy keeps, with their own columns."""
    del spark, sf_dir
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), "text")
    return judged(ledger(whole), policy).filter("kept").select("doc.*")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), rep AS (
  SELECT doc_id, i FROM win
  WHERE (doc_id, s) IN (SELECT (doc_id, s) FROM win GROUP BY doc_id, s HAVING count(*) > 1)
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
), f AS (
  SELECT *, (n_words < 20) AS r0, (100 * n_repeat_words > 30 * n_words) AS r1, (10 * n_symbols > 3 * n_words) AS r2,
         (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) AS r3,
         (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS r4, (100 * n_repeat_words > 60 * n_words) AS r5
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r0 OR r1) AS base_failed,
       NOT (r0 OR r1 OR r2 OR r3 OR r4) AS kept,
       CAST(r0 AS BIGINT) + 2 * CAST(r1 AS BIGINT) + 4 * CAST(r2 AS BIGINT) + 8 * CAST(r3 AS BIGINT) + 16 * CAST(r4 AS BIGINT) + 32 * CAST(r5 AS BIGINT) AS failed
FROM f
"""
