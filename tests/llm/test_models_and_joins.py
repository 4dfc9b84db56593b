"""Similarity join, components, language, segmentations and language-model scores against plain code."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlens.llm import base, catalog, components, jaccard, language, lattice, pieces, pseudo
from tests.llm import plain

WORDS = "sun moon star tree rock wind rain snow leaf bird fish frog ant bee owl fox elk cat dog hen".split()


def near_copies(rng, n):
    """Texts that share much: edits of a few bases, a passage in many, and short ones."""
    bases = [[rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(size)] for size in (8, 30, 60, 90)]
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        if rng.random() < 0.4:
            w += passage
        if rng.random() < 0.2:
            w = w[: rng.randrange(len(w))]
        rows.append((i, " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    return rows


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    missed = 0
    with np.errstate(over="ignore"):
        for trial in range(400):
            n = int(rng.integers(4, 300))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, len(a) // 5) + 1))
            extra = rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 5) + 1)), dtype=np.uint64)
            b = np.unique(np.concatenate([a[drop:], extra]))
            common = np.unique((a[: len(a) * trial // 400] & np.uint64(jaccard.COUNTERS - 1)).astype(np.int64))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                missed += not set(jaccard.signatures(a, common).tolist()) & set(jaccard.signatures(b, common).tolist())
    assert missed == 0


def test_join_against_all_pairs(spark):
    rows = near_copies(random.Random(7), 150)
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE\ttwo"), (205, "w " * 4000), (206, "W " * 50), (207, "x" * 9000), (203, "one two"), (None, "one two"), (None, None)]
    df = plain.documents(spark, rows).withColumns({c: F.lit(1) for c in ("key", "n", "sig", "component", "elements", "a", "b")})
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    sets = {i: plain.shingle_set(t) for i, t in rows if i is not None}
    want = plain.components(sets)
    assert sum(i != c for i, c in want.items()) > 40
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r.doc_id
    assert sorted((r.n_shingles, str(r.component_id)) for r in got if r.doc_id is None) == [(0, "None"), (1, "203")]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_rows_without_id_link_and_bridge(spark):
    """As a centre, as a bridge between two that are too far apart, and among themselves."""
    words = [f"w{n}" for n in range(240)]
    centre = " ".join(words)
    rows = [(1, " ".join(words[4:])), (None, centre), (2, " ".join(words[:-4]))]
    other = [f"v{n}" for n in range(100)]
    rows += [(11, " ".join(other)), (None, " ".join(other[11:] + ["x1"] * 1)), (12, " ".join(other[22:] + ["x1"]))]
    lone = [f"u{n}" for n in range(60)]
    rows += [(None, " ".join(lone)), (None, " ".join(lone[2:]))]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(plain.documents(spark, rows)).collect()}
    sets = {n: plain.shingle_set(t) for n, (_, t) in enumerate(rows)}
    component = plain.components(sets)
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in sets if component[m] == component[n] and rows[m][0] is not None]
        assert got[i, len(sets[n])] == min(ids, default=None), n
    assert got[1, 232] == got[2, 232] == 1 and component[4] == component[5] == 3


def test_one_of_each_group_stays(spark):
    rows = near_copies(random.Random(8), 60) + [(100, None), (101, None), (3, "again"), (5, "more text"), (5, "more text")]
    df = plain.documents(spark, rows).withColumn("component_id", F.lit("kept"))
    got = jaccard.keep_first_of_component(spark, df, "").collect()
    want = plain.components({i: plain.shingle_set(t) for i, t in rows[:60] if i not in (3, 5)})
    assert {r.doc_id for r in got if r.doc_id < 60 and r.doc_id not in (3, 5)} >= {i for i, c in want.items() if i == c and i not in (3, 5)} - {3, 5}
    assert {100, 101} <= {r.doc_id for r in got} and sum(r.doc_id == 5 and r.text == "more text" for r in got) <= 1
    assert got[0].asDict().keys() == set(df.columns)


def test_components_against_plain_search(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)] + [(7, 7), (None, 4), (1, 2), (2, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if None not in e}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_word_log(pieces_, p, word):
    """All segmentations of the whole word, into pieces of any length, in logarithms."""
    number = {x: i for i, x in enumerate(pieces_.pieces)}
    word, logs = lattice.MARK + word, np.log(p)
    alpha = [np.zeros(p.shape[1])]
    for t in range(1, len(word) + 1):
        x = np.full(p.shape[1], -np.inf)
        for k in range(1, t + 1) if t < 40 else range(1, 40):
            i = number.get(word[t - k : t], pieces_.unknown if k == 1 else None)
            if i is not None:
                x = np.logaddexp(x, alpha[t - k] + logs[i])
        alpha.append(x)
    return alpha[-1]


@pytest.fixture(scope="module")
def speech(spark):
    """Two invented languages, and rows that no language fits."""
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ber", "ich", "ein"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 30))), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "aa"), (903, "kalomi", None), (None, "kalomi tu", "aa"), (904, "ka" * 3000, "aa"), (905, "½ ²", None)]
    return plain.documents(spark, rows).withColumns({"lang_pred": F.lit("old"), "held_out": F.lit(1), "number": F.lit(2)})


def test_language_on_held_out_rows(speech):
    model = language.fit(speech)
    rows = language.predicted(speech, model, ["doc_id", "text", "lang"]).withColumn("held", language.held_out()).collect()
    known = [r for r in rows if r.held and r.lang and r.doc_id < 900]
    assert len(known) > 30 and np.mean([r.lang == r.lang_pred for r in known]) > 0.98
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902, 905))
    assert by_id[903].lang_pred == by_id[None].lang_pred == by_id[904].lang_pred == "aa"
    v = language.vocabulary(public_tokenizers.path(language.VOCABULARY))
    for r in rows[:20]:  # the posterior, summed the plain way
        logs = sum(plain_word_log(v, model.probabilities, w) for w in language._WORD.findall(r.text.lower()))
        best = int(np.argmax(logs))
        assert model.languages[best] == r.lang_pred and math.isclose(r.score, 1 / np.exp(logs - logs[best]).sum(), rel_tol=1e-6)


def test_words_of_any_length_are_summed_whole(speech):
    v = language.vocabulary(public_tokenizers.path(language.VOCABULARY))
    assert v.longest == max(map(len, v.pieces)) > 8
    rng = np.random.default_rng(8)
    p = rng.random((len(v.pieces) + 1, 3))
    p /= p.sum(axis=0)
    words = ["a", "international", "\u2581" * 16, "straße" * 60, "q" * 900, "communication" * 300] + ["".join(rng.choice(list("aeinstr"), int(n))) for n in rng.integers(1, 70, 40)]
    want = np.array([plain_word_log(v, p, w) for w in words])
    marked = [lattice.MARK + w for w in words]
    for cells, block in ((100_000, 4096), (50, 4096), (500, 16), (500, 33)):
        assert np.allclose(lattice.word_logs(v, marked, lattice.with_ends(p), cells, block), want, rtol=1e-9)


def test_language_learns_from_nothing_held_out(speech):
    free = language.fit(speech.filter(~language.held_out()))
    both = language.fit(speech.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang"))))
    assert free.languages == both.languages == ("aa", "bb") and np.allclose(free.probabilities, both.probabilities)
    none = language.fit(speech.limit(0))
    assert none.languages == () and {r.lang_pred for r in language.predicted(speech, none, ["doc_id"]).collect()} == {"und"}


def test_language_stage(spark, speech):
    kept = language.reject_unclear_language(spark, speech, "")
    assert kept.columns == speech.columns and {r.lang_pred for r in kept.collect()} == {"old"}
    assert {r.doc_id for r in speech.collect()} - {r.doc_id for r in kept.collect()} == {900, 901, 902, 905}


def test_samples_follow_the_lattice():
    v = pieces.vocabulary(public_tokenizers.path(pieces.VOCABULARY), 0.3)
    number = v.pieces.pieces
    assert len(number) > 30_000
    for text in ("cat", "a é\n"):
        every = all_segmentations_with(v, text, 0.3)
        n = 3000
        rows = pieces.sampled([text] * n, list(range(n)), v, 3)
        first, second, weight = Counter(), Counter(), Counter()
        best = max(every, key=every.get)
        for r in rows:
            ids = [tuple(int(i) for i in pieces._spelt(x[0], v)) for x in r]
            assert len(set(ids)) == len(ids) == min(3, len(every))
            assert all(abs(every[i] - x[1]) < 1e-3 for i, x in zip(ids, r, strict=True))
            assert all(x[2] >= y[2] for x, y in zip(r, r[1:], strict=False))
            first[ids[0]] += 1
            if ids[0] == best:
                second[ids[1]] += 1
            for i, x in zip(ids, r, strict=True):
                weight[i] += 1 / x[3] / n
        for i in sorted(every, key=every.get)[-4:]:
            p = math.exp(every[i])
            assert abs(first[i] / n - p) < 0.04 and (p < 0.05 or abs(weight[i] - 1) < 0.25)
            if i != best and len(every) > 3:
                assert abs(second[i] / max(1, sum(second.values())) - p / (1 - math.exp(every[best]))) < 0.08


def all_segmentations_with(v, text, sharpness):
    plain_logs = all_segmentations_raw(v, text, sharpness)
    total = math.log(sum(map(math.exp, plain_logs.values())))
    return {ids: log - total for ids, log in plain_logs.items()}


def all_segmentations_raw(v, text, sharpness):
    number = {p: int(i) for p, i in zip(v.pieces.pieces, v.ids, strict=False)}
    s, out = pieces.MARK + text.replace(" ", pieces.MARK), {}
    todo = [(0, (), 0.0)]
    while todo:
        i, ids, log = todo.pop()
        if i == len(s):
            out[ids] = log
        for k in range(1, min(v.pieces.longest, len(s) - i) + 1):
            p = s[i : i + k]
            if p in number:
                todo.append((i + k, ids + (number[p],), log - sharpness * math.log1p(number[p])))
            elif k == 1:
                todo.append((i + 1, ids + tuple(int(v.bytes[b]) for b in p.encode()), log + v.byte_log * len(p.encode())))
    return out


def test_samples_decode_to_their_text(spark):
    texts = ["", " ", "plain words", "  lead  and trail  ", "line\nfeeds\n\n", "日本 \U0001f600\U0001f600 é́", "y" * 500, "long " * 2000, "tab\there", "plain words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "plain words"), (50, None), (None, "nobody")]
    df = plain.documents(spark, rows).withColumns({"ids": F.lit(1), "sample": F.lit(2)})
    found = pieces.segmentations(df, k=2)
    got = pieces.decoded(found).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert 50 not in by and set(by) == {*range(len(texts)), None}
    for i, t in enumerate(texts):
        assert all(r.text == t for r in by[i]), i
        assert len({tuple(r.ids) for r in by[i]}) == min(2, len(by[i]) if i != 2 else 2)
    assert len(by[2]) == 4 and len({(r.sample, tuple(r.ids)) for r in by[2]}) == 2  # repeated rows are alike
    assert all(0 < r.inclusion <= 1 and r.n_pieces == len(r.ids) for r in got)
    again = {(r.doc_id, r.sample): r.ids for r in pieces.segmentations(df.repartition(3), k=2, batch_bytes=50).collect()}
    assert all(again[r.doc_id, r.sample] == r.ids for r in got)
    assert pieces.segmentations(df.limit(0)).count() == 0


def test_query_of_samples_returns_ids_and_decodes_them(spark, sf_dir):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text is not None}
    rows = pieces.op8_sampled_pieces(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and max(r.sample for r in rows) == 3
    model = pieces.speller(public_tokenizers.path(pieces.VOCABULARY)).model
    for r in rows:
        assert r.n_pieces == len(r.ids) and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.round_trip
    for r in rows[:200]:
        assert model.decode(r.ids) == texts[r.doc_id]


def test_decoding_is_the_librarys():
    one, rng = pieces.speller(public_tokenizers.path(pieces.VOCABULARY)), np.random.default_rng(3)
    for n in (0, 1, 2, 5, 40) * 60:
        ids = rng.integers(0, len(one.odd), n)
        assert one.text(ids) == one.model.decode(ids.tolist())
    for text in ("", " ", "  two  ", "é\n日本", "\u2581mark"):
        assert one.text(np.array(one.model.encode(text), dtype=np.int64)) == one.model.decode(one.model.encode(text))


def test_words_met_again_are_kept_when_others_are_forgotten():
    rng, path = random.Random(8), public_tokenizers.path(pieces.VOCABULARY)
    texts = [" ".join(["often", "seen", f"once{i}", f"rare{rng.randrange(10**6)}", "日x"]) for i in range(40)]
    small, large = (pieces.Vocabulary(path, 1.0) for _ in range(2))
    built, kept = [], small.lattices.add
    small.lattices.add = lambda words: (built.extend(words), kept(words))
    for at in range(0, 40, 4):
        args = texts[at : at + 4], list(range(at, at + 4))
        got, want = pieces.sampled(*args, small, 4), pieces.sampled(*args, large, 4)
        assert [[(x.tolist(), *r) for x, *r in t] for t in got] == [[(x.tolist(), *r) for x, *r in t] for t in want]
        if at % 8:
            small.lattices.forget(10_000)
            assert {"▁often", "▁seen", "▁日x"} == set(small.lattices.number)
    assert built.count("▁often") == 1 and len(small.lattices.id) < len(large.lattices.id)
    small.lattices.met += 2
    small.lattices.forget(1)
    assert not small.lattices.number and not len(small.lattices.id)


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = pseudo.Network.start(rng.integers(1, 100, pseudo.VOCABULARY).astype(float))
    net.weights += rng.normal(0, 0.1, len(net.weights)).astype(np.float32)
    batch = pseudo.Batch([rng.integers(0, pseudo.VOCABULARY, 30).tolist(), [], rng.integers(0, pseudo.VOCABULARY, 5).tolist()])
    g, w = net.gradient(batch.line, batch.at).weights, net.weights.astype(np.float64)
    loss = lambda x: -pseudo.Network(x).logs(batch.line, batch.at).mean()
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 20):
        up, down = w.copy(), w.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[i]) < 1e-4


def test_pseudo_likelihood(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(("red blue" if rng.random() < 0.5 else "dog cat") + " end" for _ in range(rng.randrange(5, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "unseen " * 400), (303, "Red BLUE"), (304, "red blue"), (None, "dog cat end"), (0, rows[0][1])]
    df = plain.documents(spark, rows).withColumn("n", F.lit("x"))
    counts = {bytes(r.word): r.n for r in pseudo.count_words(df).collect()}
    assert counts == Counter(w.lower().encode() for _, t in rows for w in plain.words(t))
    known, start = pseudo.fit(df, rounds=0)
    assert math.isclose(np.exp(pseudo.Network(start).kind_bias).sum(), 1, rel_tol=1e-5)
    known, weights = pseudo.fit(df, rounds=4)
    before, after = ({r.doc_id: r for r in pseudo.scored(df, known, w).collect()} for w in (start, weights))
    mean = lambda x: sum(r.log_likelihood for r in x.values()) / sum(r.n_tokens for r in x.values())
    assert mean(after) > mean(before) + 0.3
    assert (after[300].n_tokens, after[300].log_likelihood, after[300].mean_log_likelihood) == (0, 0.0, None) == (after[301].n_tokens, after[301].log_likelihood, after[301].mean_log_likelihood)
    assert after[303].log_likelihood == after[304].log_likelihood and after[302].n_tokens == 400
    # two tokens, each given the other, the plain way
    net = pseudo.Network(weights.copy())
    a, b = (known[w] for w in (b"red", b"blue"))
    blank, total = pseudo.VOCABULARY, 0.0
    for token, around in ((a, (blank, blank, b, blank)), (b, (blank, a, blank, blank))):
        h = np.tanh(net.bend + sum(net.side[k][t] for k, t in enumerate(around)))
        kind = token // pseudo.WITHIN
        x, y = h @ net.kind + net.kind_bias, h @ net.word[kind] + net.word_bias[kind]
        total += x[kind] - np.log(np.exp(x).sum()) + y[token % pseudo.WITHIN] - np.log(np.exp(y).sum())
    assert math.isclose(after[304].log_likelihood, total, rel_tol=1e-4)
    empty, w0 = pseudo.fit(df.limit(0))
    assert empty == {} and pseudo.scored(df.limit(0), empty, w0).count() == 0


def test_words_are_read_as_split_reads_them():
    texts = [None, "", " \t", "One two  THREE\n", "one", "Zoë \x00 x" + "y" * 40, "\x1fa\x0bb\r"]
    hashes, size, length, first = base.text_words(pa.array(texts)[1:])
    words = [[w.lower() for w in plain.words(t)] for t in texts[1:]]
    flat = [w.encode() for t in words for w in t]
    assert size.tolist() == list(map(len, words)) and length.tolist() == list(map(len, flat)) and first.tolist() == [w[0] for w in flat]
    assert hashes.tolist() == base.text_hashes(pa.array(flat))[0].tolist()
    known = {w: i for i, w in enumerate(flat[::2])}
    assert pseudo.Tokens(known).of(hashes, length, first).tolist() == [known.get(w, pseudo.shared_token(w)) for w in flat]
    assert pseudo.Tokens({}).of(hashes, length, first).tolist() == list(map(pseudo.shared_token, flat))


def test_many_places_a_step_learn_from_few_words():
    rng = np.random.default_rng(4)
    follow = rng.integers(0, 500, 500)
    docs = [[int(a), int(follow[a])] for a in rng.integers(0, 500, 20_000)]
    batch, net = pseudo.Batch(docs), pseudo.Network.start(np.ones(pseudo.VOCABULARY))
    first, seen = net.logs(batch.line, batch.at).mean(), np.full(pseudo.Network.SIZE, pseudo.SEEN, dtype=np.float32)
    for b in range(0, len(batch.at), pseudo.STEP):
        g = net.gradient(batch.line, batch.at[b : b + pseudo.STEP]).weights
        seen += g * g
        net.weights -= np.float32(pseudo.RATE) * g / np.sqrt(seen)
    assert net.logs(batch.line, batch.at).mean() > first + 1
    large = pseudo.Network(net.weights * 1000)  # beyond the range of the exponential
    assert net.small() and not large.small() and np.isfinite(large.logs(batch.line, batch.at)).all()


def test_every_place_is_trained_on_once():
    batch, keys = pseudo.Batch([[1] * 700, [], [2] * 90]), ["a", None, 7]
    for rounds in (1, pseudo.ROUNDS, 5):
        chosen = np.concatenate([pseudo._chosen(batch, keys, turn, rounds) for turn in range(rounds)])
        assert np.array_equal(np.sort(chosen), batch.at)


def test_words_that_share_a_token_have_their_own_probability(spark):
    common = [(i, f"c{i:04d} " * 9) for i in range(pseudo.VOCABULARY - pseudo.SHARED)]
    rows = common + [(5000, "zebra zebra"), (5001, "zabra"), (5002, "zebra"), (5002, "zebra"), (5003, "zabra zebra"), (5004, "z" * 20)]
    df = plain.documents(spark, rows)
    counts = pseudo.count_words(df)
    known, weights = pseudo.fit(df, rounds=0, counts=counts)
    assert len(known) == len(common) and not {b"zebra", b"zabra"} & set(known)
    other = plain.documents(spark, [(1, "zebra"), (2, "zabra"), (3, "zybra"), (4, "zebra zabra"), (None, None), (5, "z" * 20), (5, "z" * 20)])
    got = {}
    for r in pseudo.scored(other, known, weights, counts).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(map(len, got.values())) == [1, 1, 1, 1, 1, 2] and got[None][0].n_tokens == 0
    score = {i: x[0].log_likelihood for i, x in got.items()}
    n = {bytes(r.word): r.n for r in counts.collect()}
    assert math.isclose(score[1] - score[2], math.log(n[b"zebra"] / n[b"zabra"]), abs_tol=1e-5)
    assert math.isclose(score[3] - score[2], -40 * math.log(2) - math.log(n[b"zabra"]), abs_tol=1e-4)
    net = pseudo.Network(weights.copy())
    line = pseudo.Batch([[pseudo.shared_token(b"zebra")]])
    same = sum(k for w, k in n.items() if w not in known and pseudo.shared_token(w) == pseudo.shared_token(b"zebra"))
    assert math.isclose(score[1], net.logs(line.line, line.at)[0] + math.log(n[b"zebra"] / (same + 1)), rel_tol=1e-5)


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Rows of run() hold exactly the documents that the stages' plain forms keep, each id once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    model = language.fit(docs)
    v, memory, kept = language.vocabulary(public_tokenizers.path(language.VOCABULARY)), {}, []
    for r in rows:
        words = language._WORD.findall((r.text or "").lower())
        if not any(c.isalpha() for c in r.text or ""):
            continue
        logs = np.zeros(len(model.languages))
        for w in words:
            if w not in memory:
                memory[w] = plain_word_log(v, model.probabilities, w)
            logs = logs + memory[w]
        n, chars, symbols, dup, repeat, lines = plain.measures(r.text)
        bad = n < 20 or 100 * repeat > 30 * n or 10 * symbols > 3 * n or (dup >= 3 and 100 * dup > 30 * lines) or chars < 2 * n or chars > 15 * n
        if 1 / np.exp(logs - logs.max()).sum() >= 0.5 and not bad:
            kept.append(r)
    groups = plain.components({r.doc_id: plain.shingle_set(r.text) for r in kept})
    left = {r.doc_id: r for r in kept if groups[r.doc_id] == r.doc_id}
    assert 0 < len(left) < len(rows)
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(left)
    from recordlens.llm.bytebpe import tokenizer

    tok = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for i, found in got.items():
        found.sort(key=lambda r: r.start)
        assert [r.start for r in found] == list(np.cumsum([0, *[r.length for r in found]])[:-1])
        assert sum(r.length for r in found) == found[0].doc_tokens == len(tok.encode(left[i].text, add_special_tokens=False).ids) + 1


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and all(isinstance(x, str) for x in catalog.ORACLES.values())
