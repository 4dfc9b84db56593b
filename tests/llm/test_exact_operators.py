"""Archives, quality rules, token counts, URL verdicts, packing and embeddings against plain code."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from recordlens.llm import packing, quality, tokens, urls, vectors, warc
from recordlens.llm.bytebpe import safe_pieces, tokenizer, units
from recordlens.session import shared_folder
from tests.llm import plain

ODD_TEXTS = [
    None, "", " ", "\n", "a", "one two", " lead and trail ", "two  spaces\n\nand lines", "tab\tand\x0bfeed\x0c", "don't we'll",
    "na\u00efve \u2014 \u201cq\u201d \u65e5\u672c\u8a9e \u00a0 \U0001f600", "a<|endoftext|>b <|endoftext|>", "x " * 3000, "y" * 5000, "l one\nl one\nl one\nl two\n\n",
    "a b c d e f g h " * 4, "\x1cz y", "z\x85y", "\u01c5 \u0149 \u00d7y",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "\n"), (None, "no id here"), (4, "a")]
    return plain.documents(spark, rows).withColumns({c: F.lit("x") for c in ("n_words", "failed", "key", "ids", "length", "kept", "score")})


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark):
    rows = [(5, "http://a.org/x y\r\n", "<p>one</p>\r\n\r\nbody"), (2, None, "<p>one</p>\r\n\r\nbody"), (9, "u", None), (7, "u", ""), (8, "u", "\u00e9" * 9000), (2, None, "<p>one</p>\r\n\r\nbody"), (None, "n", "alone"), (None, "n", "")]
    folder = shared_folder(spark, "test-archives")
    df = pages(spark, rows).withColumns({c: F.lit(1) for c in ("payload", "file", "refers_to")})
    index = warc.write_archives(df, folder, max_file=500)
    got = warc.read_records(index, folder, gap=10, most=300, chunk=400).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), None if i == first.get(h or "") or (h or "") not in first or [x[2] or "" for x in rows].count(h or "") < 2 else first[h or ""]) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) and (r.record_type == "revisit") == (r.payload == b"" and r.payload_bytes > 0 or r.refers_to is not None) for r in got)
    assert {r.url for r in got if r.page_id == 5} == {"http://a.org/x%20y%0D%0A"}
    # the index tells where each record lies, and any selection can be read
    some = index.filter("page_id = 8")
    assert warc.read_records(some, folder).first().payload == ("\u00e9" * 9000).encode()
    row = some.first()
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{row.file}") as f:
        assert zlib.decompress(f.read_at(row.length, row.offset), 31).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_archive_of_no_pages_and_least_payload(spark):
    folder = shared_folder(spark, "test-archives")
    assert warc.read_records(warc.write_archives(pages(spark, []), folder), folder).count() == 0
    folder = shared_folder(spark, "test-archives")
    index = warc.write_archives(pages(spark, [(1, "a", ""), (2, "b", ""), (3, "c", "xyz"), (4, "d", "xyz")]), folder, min_bytes=1)
    assert {(r.page_id, r.record_type) for r in index.collect()} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_ledger_against_plain_rules(odd):
    rows = quality.judged(quality.ledger(odd.drop("kept")), "v2").collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    for r in rows:
        n, chars, symbols, dup, repeat, lines = plain.measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (n, chars, symbols, dup, repeat, lines), r.text
        failed = [n < 20, 100 * repeat > 30 * n, 10 * symbols > 3 * n, dup >= 3 and 100 * dup > 30 * lines, chars < 2 * n or chars > 15 * n, 100 * repeat > 60 * n]
        assert r.failed == sum(1 << i for i, x in enumerate(failed) if x)
        assert r.kept == (not any(failed[:5]))


def test_repeated_windows_on_random_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality.measured(plain.documents(spark, rows)).collect()}
    assert got == {i: plain.measures(t)[4] for i, t in rows}


def test_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (3,), (6,), (4,)], "failed long")
    got = {(r.policy, r.rule): (r.n_documents, r.n_failed, r.n_only) for r in quality.ablations(ledger).collect()}
    assert got["v1", "few_words"] == (6, 3, 2)
    assert got["base", "repeated_windows"] == (6, 2, 1)
    assert got["v1", "symbol_heavy"] == (6, 2, 1)
    assert quality.ablations(ledger.limit(0)).count() == 0


def test_quality_stage_keeps_rows_as_they_are(spark, odd):
    kept = quality.reject_low_quality(spark, odd, "")
    assert kept.columns == odd.columns
    assert all(r.n_words == "x" for r in kept.collect())


def test_token_counts_are_the_librarys(odd):
    import public_tokenizers

    tok = tokenizer(public_tokenizers.path(tokens.VOCABULARY))
    rows = tokens.token_counts(odd).collect()
    texts = [*ODD_TEXTS, "\n", "no id here", "a"]
    want = sorted((len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert tokens.token_counts(odd.limit(0)).count() == 0


def test_token_batches_hold_all_pieces_and_are_balanced():
    import public_tokenizers

    rng = random.Random(11)
    # a very long text, one without any safe place, odd white space, special strings, no text at all
    alphabet = ["word", "gap  ", "é", "日本", "\n", "\t", " ", "<|endoftext|>", "x" * 40, "1,234.5"]
    texts = [" ".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 3, 40, 6000, 0, 200)] + ["y" * 9000, "", " \n "]
    tok = tokenizer(public_tokenizers.path(tokens.VOCABULARY))
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for size in (64, 1024, 1 << 18):
        joined, found, sizes = [""] * len(texts), [0] * len(texts), []
        for owners, pieces in tokens.balanced(texts, size):
            sizes.append(sum(len(p.encode()) for p in pieces))
            assert sizes[-1] <= size or len(pieces) == 1
            for i, p in zip(owners, pieces, strict=True):
                joined[i] += p
                found[i] += len(tok.encode(p, add_special_tokens=False).ids)
        assert joined == texts and found == want
    assert list(tokens.balanced([], 64)) == []


def test_long_texts_are_cut_at_safe_places():
    text = "word  gap\n" * 50 + "plain words here " * 500
    assert "".join(safe_pieces(text, 100)) == text
    assert all(p[0] == " " and p[1] != " " for p in safe_pieces(text, 100)[1:])
    assert units("a b\nc") == ["a", "b", "\nc"] and units("a  b") is None and units(" a") is None


def test_packing_is_exact_and_full(spark, odd):
    import public_tokenizers

    tok = tokenizer(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(1)
    more = plain.documents(spark, [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randrange(1, 90)))) for i in range(60)])
    docs = odd.select("doc_id", "text").union(more.select("doc_id", "text"))
    rows = packing.pack(docs, window=64, shard=16).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,) for t in texts[d])
        if len(ids) == 1:
            joined = [i for p in sorted(pieces, key=lambda p: p.start) for i in p.ids]
            assert tuple(joined) == ids[0] and all(p.doc_tokens == len(ids[0]) for p in pieces)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, ids))
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == list(np.cumsum([0, *[r.length for r in w]])[:-1])
        sizes.append(sum(r.length for r in w))
    assert max(sizes) == 64 and sum(s < 64 for s in sizes) <= 4
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_stage_keeps_the_ids(spark):
    import public_tokenizers

    tok = tokenizer(public_tokenizers.path(packing.VOCABULARY))
    texts = {1: "alpha beta " * 900, 2: "a short one", 3: ""}
    found = {}
    for r in sorted(packing.pack_documents(spark, plain.documents(spark, list(texts.items())), "").collect(), key=lambda r: r.start):
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}


def test_windows_take_the_best_neighbours():
    a, b = np.arange(10, 30), np.arange(40, 60)
    units_ = [[0, 0, a, 20], [1, 0, b, 20], [2, 0, a.copy(), 20], [3, 0, b.copy(), 20]]
    done, rest = packing._Shard(units_, np.ones(100, dtype=np.float32), 20.0, 5).fill(40)
    assert [[p[0] for p in w] for w in done] == [[0, 2], [1, 3]] and rest == []


def test_url_parts_and_rules(spark):
    rows = [
        (1, "http://A.Net/x"), (2, "https://www.example.net/en/1?q#z"), (3, "https://example.com/de/"), (4, "ftp://b.org/fr/2#t"), (5, "http://example.net?en"), (6, None), (7, "no scheme/net/"),
        (8, "http://x.com/de/"), (9, "http://\u00c9XAMPLE.org/fr"), (10, "a://b://c.net/"), (11, "http://notnet/"), (1, "http://A.Net/x"), (None, ""), (12, "http://net/"), (13, "http://example.com/\nde"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit(1), "score": F.lit("x"), "host": F.lit("h")})
    labelled = spark.createDataFrame([*urls.labelled_urls(), (None, "block"), ("http://q", None)], "url string, verdict string")
    got = {r.page_id: r for r in urls.judged(df, urls.fit(labelled)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.net", "/x", "net/", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[3].rule, got[3].verdict) == ("example.com/de/", "block")
    assert (got[4].host, got[4].path, got[4].rule) == ("b.org", "/fr/2", "org/fr/")
    assert (got[5].host, got[5].path, got[5].rule) == ("example.net", "", None)
    assert (got[6].host, got[6].path, got[7].host, got[7].path) == ("", "", "", "")
    assert got[8].rule is None and got[9].rule is None and got[9].host == "\u00c9xample.org"
    assert (got[10].host, got[10].rule) == ("b:", None) and got[11].rule is None and got[12].rule == "net/"
    assert got[13].path == "/\nde"
    assert urls.judged(df.limit(0), urls.fit(labelled.limit(0))).count() == 0


def test_url_model_on_hosts_it_has_not_seen(spark):
    weights, bias = urls.fit(spark.createDataFrame(urls.labelled_urls(), "url string, verdict string"))

    def score(host):
        row, feature = urls.features([host], [b"/en/1"])
        return weights[feature].sum() / len(row) ** 0.5 + bias

    # words of the table in hosts of another form
    bad = [score(f"{a}{b}.example.com".encode()) > 0 for a in urls.UNWANTED[:12] for b in urls.UNWANTED[12:24]]
    good = [score(f"{a}{b}.example.com".encode()) <= 0 for a in urls.ORDINARY[:12] for b in urls.ORDINARY[12:24]]
    assert np.mean(bad) > 0.95 and np.mean(good) > 0.95


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows, n = [], 0
    for i in range(160):
        x = base[rng.integers(12)] + rng.normal(scale=rng.choice([0.0, 0.05, 0.3]), size=8)
        rows.append((n, [float(v) for v in x.astype(np.float32)], int(rng.integers(3))))
        n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [0.0] * 8, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [float("inf")] + [0.0] * 7, 1), (n + 5, rows[0][1], None), (n + 6, [], 1), (n + 7, [1.0, None], 2), (n + 8, rows[3][1][:4], rows[3][2])]
    rows += [(n + 9, [-0.0, 1.0], 5), (n + 10, [0.0, 1.0], 5), (n + 11, [0.0, 2.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit(1), "sign": F.lit(2), "id": F.lit(3), "component": F.lit(4)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, block=16).collect()}
    good = {i: np.array(e, dtype=np.float32).astype(float) for i, e, lab in rows if e and lab is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    label = {i: lab for i, _, lab in rows}
    near = {i: [j for j in good if j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / (np.sqrt(good[i] @ good[i]) * np.sqrt(good[j] @ good[j])) >= 0.98] for i in good}
    assert max(map(len, near.values())) > 3
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, [])), min(seen), i == min(seen)), i
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_without_id_link_and_bridge(spark):
    rows = [(1, [1.0, 0.0], 0), (None, [1.0, 0.15], 0), (3, [1.0, 0.32], 0), (None, [0.0, 1.0], 0), (None, [0.05, 1.0], 0), (9, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_vectors(df).collect()))
    assert got == [(0, 1, 0, True), (0, 1, 0, True), (0, 2, 1, False), (1, 1, 1, True), (3, 1, 1, False), (9, 0, 9, True)]
