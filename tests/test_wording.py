import difflib
import random
import re

from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions import text as tx
from recordlens.operators import wording as wd
from tests.helpers import as_list

CHALLENGE = "Verifying your browser before proceeding... Incident ID: e4841cb0"
CONSENT = (
    "Diese Website verwendet Cookies. Wir nutzen Matomo für die Analyse der Zugriffe und setzen nur essenzielle Cookies ohne Ihre "
    "Einwilligung. Sie können Ihre Einwilligung jederzeit widerrufen. Weitere Hinweise finden Sie in unserer Datenschutzerklärung. "
    "Notwendige Cookies ermöglichen grundlegende Funktionen und sind für die einwandfreie Funktion der Website erforderlich. Mit Ihrer "
    "Einwilligung erlauben Sie uns die Verwendung von Cookies zur Reichweitenmessung durch einen Dritten."
)
PAGE = (
    "The strategy commits the federal government to climate neutrality by 2045. It will reduce emissions by 65 percent before the end "
    "of the decade. The measures are financed from the climate and transformation fund, and the ministry reports on their progress "
    "every year. Further steps are planned for the coming period, and the responsible department publishes an annual account of what "
    "has been achieved so far."
)
NAV = " ".join(["Presse Publikationen Termine Kontakt Impressum Barrierefreiheit Leichte Sprache"] * 12)


def test_gate_reasons(spark):
    rows = [(1, PAGE, "200"), (2, CHALLENGE, "200"), (3, CONSENT, "200"), (4, "Zu kurz.", "200"), (5, PAGE, "403"), (6, NAV, "200"), (7, None, "200"), (8, PAGE, None)]
    got = wd.with_gate(spark.createDataFrame(rows, "id int, t string, s string"), "t", "s")
    assert as_list(got.select("id", "gate.reason"), "id", "reason") == [
        (1, "ok"), (2, "challenge_fingerprint"), (3, "consent_boilerplate"), (4, "too_short"), (5, "status_403"), (6, "not_prose"), (7, "too_short"), (8, "status_")
    ]
    markers = got.filter("id = 2").select("gate.markers").collect()[0][0]
    assert markers == ["verifying your browser", "incident id"]


MARKUP = [
    ("<p>open", "open"), ("", ""), (None, ""),
    ("<head><title>Hidden</title></head><h1>Seen</h1><p>a<b>c</b>&amp;d&nbsp;e<!-- gone --><script>if (a<b) '</p>'</script>f", "Seen a c &d e f"),
    ("<nav>a<nav>b</nav>c</nav>d", "d"),
    ("x<form>hidden to the end <p>y", "x"),
    ("</nav>a<svg/>b", "a b"),
    ("caf&eacute &mdash; &eacute; &notit; &#8212; &#x20;&#150; &unknown; a&b &amp;lt;", "café — é ¬it; — – &unknown; a&b &lt;"),
    ("<a title='x>y'>t</a> 1 < 2 <3", "t 1 < 2 <3"),
    ("<SCRIPT>x</SCRIPT >z<style>p{}</style>k<navx>v</navx>", "z k v"),
]


def test_markup(spark):
    rows = spark.createDataFrame([(h,) for h, _ in MARKUP], "h string")
    assert [r[0] for r in rows.select(wd.page_text(F.col("h"))).collect()] == [t for _, t in MARKUP]


def test_bytes(spark):
    rows = spark.createDataFrame([("ä€".encode(),), ("ä".encode("cp1252"),), (b"\x81\xc3",)], "b binary")
    assert [r[0] for r in rows.select(wd.decode_bytes(F.col("b"))).collect()] == ["ä€", "ä", "��"]


PAIRS = [
    ("The harbour will handle 40 percent of the cargo of the coast.", "The harbour will handle 35 percent of the cargo of the coast.", ["number_revised"]),
    ("The council pledges to the opening of the bridge in 2031.", "The council pledges to the opening of the bridge in 2034.", ["date_shifted"]),
    ("The museum will never sell the maps of the old town.", "The museum will sell the maps of the old town.", ["negation_flipped"]),
    ("The railway shall renew the track on each of the lines of the valley.", "The railway discusses the track on each of the lines of the valley.", ["commitment_removed"]),
    ("The library will open on each of the Sundays of the year. The garden is part of the tour.", "The garden is part of the tour.", ["commitment_removed"]),
    ("As the minister said the dam is safe for the whole of the valley.", "As it stands the dam is safe for the whole of the valley.", ["attribution_removed"]),
    ("Home Search Contact Login", "Home Contact Login", []),
    ("The fee is due from June on for all of the boats.", "The fee is due from now on for all of the boats.", ["date_shifted"]),
]


def test_typed_events(spark):
    rows = spark.createDataFrame([(n, b, a) for n, (b, a, _) in enumerate(PAIRS)], "page int, before string, after string")
    diff = wd.sentence_diff(rows)
    got = {}
    for r in wd.type_events(diff).collect():
        got.setdefault(r["page"], []).append(r["type"])
        if r["type"] == "attribution_removed":
            assert r["before"] is None and r["before_sha256"]
    assert {n: sorted(got.get(n, [])) for n in range(len(PAIRS))} == {n: t for n, (_, _, t) in enumerate(PAIRS)}
    assert wd.abstentions(diff).count() == 0


def test_untyped_change_is_an_abstention(spark):
    rows = [(1, "The office publishes the annual figures for the reporting period 2024.", "The office publishes the annual figures for the whole reporting period 2024.")]
    diff = wd.sentence_diff(spark.createDataFrame(rows, "page int, before string, after string"))
    a = wd.abstentions(diff).collect()
    assert wd.type_events(diff).count() == 0 and len(a) == 1 and a[0]["salience"] > 0


MEASURED = [
    # text, number, date, named_entity, negation, commitment_verb, sentences, tokens
    ("", 0, 0, 0, 0, 0, [], 0),
    ("In 2045 the Office will not pay 3,5 mio.", 2, 1, 1, 1, 1, ["In 2045 the Office will not pay 3,5 mio."], 9),
    ("Yes. Berlin must. No Ärzte!", 0, 0, 1, 1, 1, ["Yes.", "Berlin must.", "No Ärzte!"], 5),
    ("On 12.03.2021 in März  x_2 19999", 2, 2, 1, 0, 0, ["On 12.03.2021 in März  x_2 19999"], 6),
    ("keine Zahl, nicht eine;  und SOLL MUSS", 0, 0, 3, 2, 2, ["keine Zahl, nicht eine;  und SOLL MUSS"], 7),
    ("nothing a1 notable", 0, 0, 0, 0, 0, ["nothing a1 notable"], 3),
]


def test_measures(spark):
    df = spark.createDataFrame([(m[0],) for m in MEASURED], "t string")
    t = F.col("t")
    cols = [F.struct(*[c.alias(k) for k, c in tx.signal_counts(t).items()]).alias("s"), tx.salience(t).alias("w"), tx.sentences(t).alias("sent"), tx.token_count(t).alias("n")]
    for r, m in zip(df.select("t", *cols).collect(), MEASURED, strict=True):
        want = dict(zip(("number", "date", "named_entity", "negation", "commitment_verb"), m[1:6], strict=True))
        assert r["s"].asDict() == want, m[0]
        assert (r["sent"], r["n"]) == m[6:], m[0]
        assert r["w"]["score"] == sum(v.SIGNAL_WEIGHTS[k] * n for k, n in want.items()) and r["w"]["signals"] == sorted(k for k, n in want.items() if n)


def test_prose_and_words(spark):
    texts = ["the cat of the house is here", "Home Search Contact Login Help", "the of", "one two three four five", "a-b c_d Straße"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.is_prose(F.col("t")), tx.word_tokens(F.col("t")), tx.token_set(F.col("t"))).collect()
    assert [r[0] for r in rows] == [True, False, False, False, False]
    assert rows[4][1] == ["a", "b", "c", "d", "Straße"] and rows[4][2] == ["a", "b", "c", "d", "strasse"]


def cut(text):
    return [s.strip() for s in re.split(r"(?<=[.!?]) ", (text or "").strip()) if s.strip()]


def test_diff_follows_the_order_of_blocks(spark):
    """Kept runs are those of the standard library's matcher; within a gap the best partner wins."""
    rng = random.Random(11)
    vocab = "alpha beta gamma delta straße STRASSE".split()
    doc = lambda: " ".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) + "." for _ in range(rng.randint(0, 12)))
    docs = [(n, doc(), doc()) for n in range(120)] + [(900, None, "a b. c d."), (901, "x y.", "x y."), (902, "one two. three four. five six.", "five six. one two. three four.")]
    kinds = lambda n: " ".join(f"{rng.choice(vocab)}." for _ in range(n))
    docs += [(910 + n, kinds(90), kinds(80)) for n in range(4)] + [(920, "same. " * 300, "same. " * 250 + "other. " + "same. " * 40)]
    long = [f"line {n} holds {rng.random()}." for n in range(800)]
    docs += [(930, " ".join(long), " ".join(x if n % 2 else x.replace("holds", "has got") for n, x in enumerate(long))), (931, " ".join(long[:200]), " ".join(rng.sample(long[:200], 200)))]
    got = {}
    for r in wd.sentence_diff(spark.createDataFrame(docs, "page int, before string, after string")).collect():
        got.setdefault(r["page"], []).append(r)
    words = lambda s: set(re.findall(r"[^\W_]+", s.casefold()))
    near = lambda x, y: len(words(x) & words(y)) / len(words(x) | words(y))
    for n, b, a in docs:
        old, new = cut(b), cut(a)
        rows = got.get(n, [])
        blocks = [m for m in difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks() if m.size]
        kept_old, kept_new = ({getattr(m, side) + k for m in blocks for k in range(m.size)} for side in "ab")
        assert {r["before_idx"] for r in rows if r["op"] != "added"} == set(range(len(old))) - kept_old, n
        assert {r["after_idx"] for r in rows if r["op"] != "removed"} == set(range(len(new))) - kept_new, n
        gap_of = lambda i, side: sum(getattr(m, side) <= i for m in blocks)
        free = {r["after_idx"] for r in rows if r["op"] != "removed"}
        for r in sorted((r for r in rows if r["op"] != "added"), key=lambda r: r["before_idx"]):
            assert r["before"] == old[r["before_idx"]]
            here = [j for j in sorted(free) if gap_of(j, "b") == gap_of(r["before_idx"], "a")]
            best = max(here, key=lambda j: (near(r["before"], new[j]), -j), default=None)
            if best is not None and near(r["before"], new[best]) > v.ALIGN_FLOOR:
                assert (r["op"], r["after_idx"], r["after"]) == ("rewritten", best, new[best])
                free.discard(best)
            else:
                assert (r["op"], r["after_idx"]) == ("removed", None)
    assert sorted((r["op"], r["before_idx"], r["after_idx"]) for r in got[902]) == [("added", None, 0), ("removed", 2, None)]


def test_simultaneous_loss(spark):
    p = "The ministry will publish the results of all of the audits"
    rows = [("u1", "i1", "A", p + "."), ("u2", "i1", "A", p.upper() + "!"), ("u3", "i2", "B", p), ("u4", "i3", "E", p), ("u5", "i1", "A", "Too short")]
    got = wd.simultaneous_loss(spark.createDataFrame(rows, "url string, institution string, category string, passage string"))
    assert as_list(got, "urls", "institutions") == [(3, 2)]


def test_losses_within_a_window_of_nights(spark):
    p, q = "The ministry will publish the results of all of the audits", "The agency commits to the repair of the bridge over the river"
    rows = [("u1", "i1", "A", "2026-08-01", p), ("u2", "i1", "A", "2026-08-03", p + "."), ("u3", "i2", "B", "2026-08-14", p), ("u4", "i2", "B", "2026-08-15", p), ("u5", "i3", "E", "2026-08-02", p)]
    rows += [("u1", "i1", "A", "2026-08-01", q), ("u2", "i2", "A", "2026-08-02", q), ("u3", "i2", "A", "2026-08-15", q)]
    lost = spark.createDataFrame(rows, "url string, institution string, category string, night string, passage string")
    got = wd.simultaneous_windows(lost).selectExpr("string(first_night) AS first_night", "urls", "institutions")
    # p: from the first and the third; from the fourteenth on only one institution. q never has three urls in fourteen nights
    assert as_list(got, "first_night", "urls", "institutions") == [("2026-08-01", 3, 2), ("2026-08-03", 3, 2)]
    assert wd.simultaneous_windows(lost, nights=15).count() == 3


def test_typed_losses_count_as_losses(spark):
    rows = spark.createDataFrame([(n, b, a) for n, (b, a, _) in enumerate(PAIRS)], "page int, before string, after string")
    got = {(r["page"], r["cause"]) for r in wd.losses(wd.sentence_diff(rows)).collect()}
    assert got == {(2, "negation_flipped"), (3, "commitment_removed"), (4, "removed"), (5, "attribution_removed")}


def test_dollars_round_the_binary_quotient_ties_to_even(spark):
    amounts = [2_500_000, 3_500_000, 1_150_000_000, 1_250_000_000, 1_350_000_000, 59_686_350_000_000, 999_999, 999_950_000_000]
    plain = lambda n: f"${n / 10**9:.1f}bn" if n >= 10**9 else f"${n / 10**6:.0f}m" if n >= 10**6 else f"${n:,}"
    rows = spark.createDataFrame([(n,) for n in amounts], "n bigint").select(tx.usd_words(F.col("n"))).collect()
    assert [r[0] for r in rows] == [plain(n) for n in amounts]


def test_the_diff_is_derived_once(spark):
    # A plan that names its source twice derives the diff twice.
    source = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    passage = "The board will keep the rules of the house on each of the floors."
    diff = spark.range(6).selectExpr(
        "id AS page", "if(id % 2 = 0, 'removed', 'rewritten') AS op", f"'{passage}' AS before", "if(id % 2 = 0, NULL, 'The board keeps the rules.') AS after"
    )
    lost = wd.losses(diff)
    assert source(lost) == 1
    assert as_list(lost, "page", "cause") == [(n, "removed" if n % 2 == 0 else "commitment_removed") for n in range(6)]
    where = lost.selectExpr("page AS url", "concat('i', page) AS institution", "'A' AS category", "date_add(DATE'2024-01-01', int(page)) AS night", "passage")
    windows = wd.simultaneous_windows(where)
    assert source(windows) == 0
    assert as_list(windows, "urls") == [(3,), (4,), (5,), (6,)]
    found = spark.range(5).selectExpr("sha2(string(id), 256) AS before_sha256", "int(id) AS salience")
    ranked = wd.ranked_abstentions(found)
    assert source(ranked) == 0
    assert as_list(ranked, "salience", "rank") == [(n, 5 - n) for n in range(5)]


def test_ends_of_a_text_are_trimmed(spark):
    texts = [" a. b ", "a.\u00a0b\u2003", "a b \u0085", "\n\n", "", "a.", "\u2028a! b?"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.sentences(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a.", "b"], ["a.", "b"], ["a b\u0085"], [], [], ["a."], ["a!", "b?"]]


def test_gaps_of_unrepeated_sentences_need_no_runs(spark):
    rng = random.Random(5)
    sides = []
    for _ in range(200):
        old = rng.sample("abcdefghij", rng.randint(0, 8))
        sides.append((old, [s if rng.random() < 0.6 else s.upper() for s in old if rng.random() < 0.8] + rng.sample("xyz", rng.randint(0, 2))))
    rows = spark.createDataFrame(sides, "old array<string>, new array<string>")
    old, new = F.col("old"), F.col("new")
    got = rows.select(wd._once_in_order(old, new), wd._open_gaps(old, new), wd._gaps_of_runs(old, new)).collect()
    assert all(once and quick == runs for once, quick, runs in got)
    other = spark.createDataFrame([(list("aab"), list("ab")), (list("ab"), list("ba"))], rows.schema)
    assert [r[0] for r in other.select(wd._once_in_order(old, new)).collect()] == [False, False]


def test_word_patterns_look_at_one_letter_first(spark):
    texts = ["ſaid", "he Said.", "unsaid", "KEIN", "Kein", "MÄRZ", "prof.x", "DR.x", "prof x", "5 %", "12.3.2024", "a12", "x İs"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (tx.NEGATION, tx.COMMITMENT, tx.MONTH, tx.ATTRIBUTION, tx.DATE, tx.NUMBER):
        assert re.match(r"(\(\?iu\))\(\?=", pattern)
        plain = re.sub(r"^(\(\?iu\))\(\?=(?:\[[^\]]*\]|\\p\{Nd\})\)", r"\1", pattern)
        assert rows.filter(F.regexp_count("t", F.lit(pattern)) != F.regexp_count("t", F.lit(plain))).count() == 0
