"""Ranked lexical search by the Best Position Algorithm over impact lists.

``build_index`` turns documents into shards: one row holds some documents' ids and sizes and,
for every term in them, its postings. Nothing is shuffled. ``search`` ranks all documents for
each item:

1. Items are taken in blocks of bounded size. From every shard the lists of the block's terms
   are copied to a table of their own; the number of documents and terms, and each term's
   document frequency, are sums over it.
2. In a shard each term's postings are sorted by impact, best first. For an item, the lists
   are read from their best positions on: the best position of a list is the end of the run of
   positions, from the first, that have been seen. A document met in one list is looked up in
   all others at once (direct access), which marks its positions there too; so best positions
   run ahead of what was read. An unseen document stands behind every best position, so the
   impacts there add up to a bound on its score. A shard is done when that bound is strictly
   below the kth score, ties being ranked by document.
3. A task carries each item's best from shard to shard, so later shards stop sooner. The bests
   of all tasks meet in two steps, by item and part, then by item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.base import as_bytes, slices, table
from recordlens.session import shared_folder, written

#: ASCII letters in lower case, digits, and bytes of other characters stay; the rest become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Documents and bytes of text in one shard of the index.
SHARD_DOCS, SHARD_BYTES = 2048, 8 << 20
#: Cells of the tables that one search within a shard works on.
CELLS = 1 << 21
#: Items and bytes of their text that go to the tasks at once (a larger item goes alone).
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
PARTS = 64
INDEX = "doc_ids array<long>, sizes array<long>, terms array<string>, dfs array<int>, docs binary, tfs binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def _ragged(values: pa.Array) -> pa.Array:
    """One list of all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard of documents, written to the shared folder and read back.

    doc_ids and sizes (terms with repeats) tell the shard's documents; terms with their
    document frequencies dfs point, one after another, into docs and tfs, the documents'
    numbers within the shard (two bytes each) and the term's occurrences in them (four).
    """

    def shard(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        known: dict[bytes, int] = defaultdict(count().__next__)
        codes, sizes = [], []
        for text in texts:
            found = terms_of(text)
            sizes.append(len(found))
            codes.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        pair, tf = np.unique((np.concatenate(codes) << 16) + owner, return_counts=True)
        df = np.bincount(pair >> 16, minlength=len(known)).astype(np.int32)
        columns = [
            _ragged(pa.array(ids, pa.int64())), _ragged(pa.array(sizes, pa.int64())), _ragged(pa.array(list(known), pa.binary()).cast(pa.string())), _ragged(pa.array(df)),
            pa.array([(pair & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([tf.astype("<u4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "sizes", "terms", "dfs", "docs", "tfs"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                for i, t in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    if ids and (len(ids) == SHARD_DOCS or held + len(t or b"") > SHARD_BYTES):
                        yield shard(ids, texts)
                        ids, texts, held = [], [], 0
                    ids.append(i), texts.append(t)
                    held += len(t or b"")
        if ids:
            yield shard(ids, texts)

    path = shared_folder(docs.sparkSession, "lexical-index")
    docs.select("doc_id", "text").mapInArrow(index, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def term_lists(index: DataFrame, terms: list[bytes]) -> DataFrame:
    """The index with the lists of some terms only; the number of a term in ``terms`` stands for it."""
    sent = index.sparkSession.sparkContext.broadcast(pa.array(terms, pa.binary()).cast(pa.string()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                code = pc.fill_null(pc.index_in(row.column("terms").flatten(), sent.value), -1).to_numpy()
                df = row.column("dfs").flatten().to_numpy()
                keep = np.repeat(code >= 0, df)
                docs, tfs = (np.frombuffer(row.column(c)[0].as_py(), kind)[keep].tobytes() for c, kind in (("docs", "<u2"), ("tfs", "<u4")))
                columns = [row.column("doc_ids"), row.column("sizes"), _ragged(pa.array(code[code >= 0].astype(np.int64))), _ragged(pa.array(df[code >= 0])), pa.array([docs], pa.binary()), pa.array([tfs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_ids", "sizes", "terms", "dfs", "docs", "tfs"])

    return index.mapInArrow(pick, INDEX.replace("terms array<string>", "terms array<long>"))


class _Lists:
    """Impact lists of T terms over D documents.

    order[t, p] and impact[t, p] are the document and its impact at position p, best first;
    position[t, d] is where document d stands, D if it is not in the list (impact 0).
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, base: np.ndarray, n_terms: int, n_docs: int):
        key = np.sort((term << 40) + (((1 << 20) - base) << 16) + doc)
        term, doc, base = key >> 40, key & 0xFFFF, (1 << 20) - ((key >> 16) & 0xFFFFFF)
        at = np.arange(len(term)) - np.searchsorted(term, term, side="left")
        self.n_docs = n_docs
        self.order = np.full((n_terms, n_docs + 1), -1, dtype=np.int32)
        self.impact = np.zeros((n_terms, n_docs + 1), dtype=np.int32)
        self.position = np.full((n_terms, n_docs), n_docs, dtype=np.int32)
        self.order[term, at], self.impact[term, at], self.position[term, doc] = doc, base, at

    def best(self, rows: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) as they are met; ``send`` the kth score so far to go on (0: fewer than k)."""
        held = (self.impact[rows, 0] > 0) & (weight > 0)
        rows, weight = rows[held], weight[held]
        seen = np.zeros((len(rows), self.n_docs + 1), dtype=bool)
        met = np.zeros(self.n_docs + 1, dtype=bool)
        met[-1] = True  # what the end of a list points to
        each, at, step = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), 8
        while len(rows):
            bound = int((weight * self.impact[rows, at]).sum())
            if not bound or bound < least:
                return
            read = self.order[rows[:, None], np.minimum(at[:, None] + np.arange(step), self.n_docs)].ravel()
            new = np.unique(read[~met[read]])
            met[new] = True
            where = self.position[rows[:, None], new]
            seen[each[:, None], where] = True
            seen[:, -1] = False  # not a position
            least = yield new, (weight[:, None] * self.impact[rows[:, None], where]).sum(axis=0)
            at = seen.argmin(axis=1)  # the best position: all before it are seen
            step *= 2


def _groups(asked: list[tuple[int, Counter]]) -> list[dict]:
    """Items whose terms share one set of lists; numbers of terms stand for rows of it."""
    groups: list[dict] = []
    for item, counts in asked:
        if not groups or len(groups[-1]["rows"]) + len(counts) > 1024:
            groups.append({"rows": {}, "items": []})
        rows = groups[-1]["rows"]
        groups[-1]["items"].append((item, np.array([rows.setdefault(t, len(rows)) for t in counts]), np.array(list(counts.values()), dtype=np.int64)))
    return groups


def bests_by_task(lists: DataFrame, asked: list[tuple[int, Counter]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, part): every task's k best documents of each item."""
    sent = lists.sparkSession.sparkContext.broadcast((_groups(asked), weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, w = sent.value
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids = row.column("doc_ids").flatten().fill_null(np.iinfo(np.int64).max).to_numpy()
                m = 25 + 75 * row.column("sizes").flatten().to_numpy() * n_docs // n_terms
                code = np.repeat(row.column("terms").flatten().to_numpy(), row.column("dfs").flatten().to_numpy())
                doc, tf = (np.frombuffer(row.column(c)[0].as_py(), kind).astype(np.int64) for c, kind in (("docs", "<u2"), ("tfs", "<u4")))
                base = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                for group in groups:
                    number = np.full(len(w), -1)
                    number[list(group["rows"])] = np.arange(len(group["rows"]))
                    mine = number[code]
                    wide = max(CELLS // max(len(group["rows"]), 1), 16)
                    for lo in range(0, len(ids), wide):
                        some = np.flatnonzero((mine >= 0) & (doc >= lo) & (doc < lo + wide))
                        made = _Lists(mine[some], doc[some] - lo, base[some], len(group["rows"]), min(wide, len(ids) - lo))
                        of_row = w[list(group["rows"])]
                        for item, rows, repeats in group["items"]:
                            top[item] = _ranked(made, rows, of_row[rows] * repeats, ids[lo : lo + wide], top.get(item), k)
        part = TaskContext.get().partitionId() % PARTS
        found = [(i, d, s) for i, (docs, scores) in top.items() for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        items, docs, scores = zip(*found, strict=True) if found else ((), (), ())
        docs = pa.array([None if d == np.iinfo(np.int64).max else d for d in docs], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), docs, pa.array(scores, pa.int64()), pa.array([part] * len(items), pa.int64())], names=["item", "doc_id", "score", "part"])

    return lists.mapInArrow(rank, "item long, doc_id long, score long, part long")


def _ranked(lists: _Lists, rows: np.ndarray, weight: np.ndarray, ids: np.ndarray, best: tuple | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (documents, scores) of an item after one more set of lists."""
    docs, scores = best or (np.empty(0, np.int64), np.empty(0, np.int64))
    least = int(scores[-1]) if len(scores) == k else 0
    search = lists.best(rows, weight, least)
    try:
        new, score = next(search)
        while True:
            if len(good := np.flatnonzero((score >= least) & (score > 0))):
                docs, scores = np.concatenate([docs, ids[new[good]]]), np.concatenate([scores, score[good]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                least = int(scores[-1]) if len(scores) == k else 0
            new, score = search.send(least)
    except StopIteration:
        return docs, scores


def _first(rows: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Each distinct row of ``items`` (item_id, text) is ranked once. A null text, or one without
    terms, has no rows; so has an empty index. Null texts of documents hold no term; each row
    of a repeated doc_id ranks, and a null doc_id comes last among equal scores. Only the
    columns named here are read.
    """
    spark = index.sparkSession
    items = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(math.ceil(n_items / BLOCK_ITEMS), math.ceil(n_bytes / BLOCK_BYTES))
    n_docs, n_terms = index.select(F.explode("sizes").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in range(blocks if n_terms else 0):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a bounded block
        known: dict[bytes, int] = defaultdict(count().__next__)
        asked = [(i, Counter(known[t] for t in terms_of(r.text.encode()))) for i, r in enumerate(rows)]
        asked = [a for a in asked if a[1]]
        lists = written(term_lists(index, list(known)), "term-lists")
        df = np.zeros(len(known), dtype=np.int64)
        for r in lists.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect():  # one row per term of the block
            df[r.terms] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        found = bests_by_task(lists, asked, weights, n_docs, n_terms, k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        first = _first(_first(found, ["item", "part"], k), ["item"], k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = first if out is None else out.unionByName(first)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents; items without terms and scores of 0 have no rows."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), size AS (SELECT k, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, total GROUP BY term, docs
), q AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
), s AS (
  SELECT item_id, k, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN size USING (k), total
  GROUP BY item_id, k, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
