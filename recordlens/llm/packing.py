"""Lexical retrieval packing: windows filled with unused BM25 neighbours of a seed.

1. Every document becomes ids, closed by id 0. Its full windows are cut off as sequences
   of their own; the tail, shorter than a window, is the unit that is packed.
2. Document frequencies of all tails are counted over the whole corpus (a table no larger
   than the vocabulary, so it may be sent to every task).
3. Tails are ordered by a shared-bigram key and dealt out by range; a large group of
   copies is cut by the document id. Each run of ``shard`` tails gets an inverted index
   with BM25 weights from the corpus-wide counts. The next unused tail is the seed; its
   heaviest terms are looked up, and the best unused tails fill its window. The last one
   is cut where the window is full, and its rest stays for later windows.
4. What doesn't fill a window at a shard's end goes on to the next shard, so a task leaves
   one short sequence at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import MIX, give_back, slices, table
from recordlens.llm.bytebpe import id_bytes, tokenizer
from recordlens.session import shared_folder

VOCABULARY = "byte_bpe_50k.json"
CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lexical_key long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75


def _lexical_key(ids: np.ndarray) -> int:
    """The least hashed bigram: tails that share wording tend to share it."""
    if len(ids) < 2:
        return int(ids[0]) if len(ids) else 0
    with np.errstate(over="ignore"):
        pairs = (ids[:-1].astype(np.uint64) * np.uint64(65_599) + ids[1:]) * MIX[0]
        return int(((pairs ^ (pairs >> np.uint64(29))) * MIX[1]).min() >> np.uint64(1))


def cut_documents(docs: DataFrame, window: int, path: str, with_ids: bool) -> DataFrame:
    """Full windows and tails of every document; only tails (and, on request, windows) carry ids."""
    kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = id_bytes(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for doc, found in zip(part.column("doc_id").to_pylist(), memory.of([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    data = b"".join(found) + b"\0\0\0\0"
                    n = len(data) // 4
                    full = n - n % window
                    for at in range(0, full, window):
                        piece = data[4 * at : 4 * (at + window)]
                        rows.append((doc, at, window, zlib.crc32(piece), n, None, np.frombuffer(piece, "<u4").astype(kind).tobytes() if with_ids else None))
                    if n > full:
                        ids = np.frombuffer(data, "<u4", offset=4 * full)
                        rows.append((doc, full, n - full, 0, n, _lexical_key(ids), ids.astype(kind).tobytes()))
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lexical_key", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, CUT)


def document_frequencies(tails: DataFrame, kind: str) -> DataFrame:
    """(term, df): in how many tails an id occurs. Each task sends at most one row per id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                terms = np.unique(np.frombuffer(x, kind))
                if terms[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(terms[-1]) + 1, dtype=np.int64)])
                df[terms] += 1
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], names=["term", "df"])

    return tails.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Shard:
    """An inverted index over some tails, and the windows it fills."""

    def __init__(self, units: list[list], idf: np.ndarray, mean: float, query_terms: int):
        # a unit: [doc, start, ids (u4), doc_tokens]
        self.units = units
        terms, owner, tf = [], [], []
        for k, u in enumerate(units):
            t, c = np.unique(u[2], return_counts=True)
            terms.append(t), tf.append(c), owner.append(np.full(len(t), k))
        terms, owner, tf = np.concatenate(terms), np.concatenate(owner), np.concatenate(tf)
        size = np.array([len(u[2]) for u in units])
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))
        # the heaviest terms of each unit are its query
        by_unit = np.lexsort((-weight, owner))
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")  # owner ascends
        self.query = [[] for _ in units]
        top = by_unit[rank < query_terms]
        for k, t in zip(owner[top], terms[top], strict=True):
            self.query[k].append(t)
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        found, begin = np.unique(terms[order], return_index=True)
        self.span = dict(zip(found.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True), strict=True))

    def fill(self, window: int) -> tuple[list[list[tuple]], list[list]]:
        """Full windows as lists of (doc, start, ids, doc_tokens), and the units left over."""
        unused = np.ones(len(self.units), dtype=bool)
        done: list[list[tuple]] = []
        for seed in range(len(self.units)):
            while unused[seed]:
                # a rest that was cut keeps its place as seed
                spans = [self.span[t] for t in self.query[seed]]
                score = np.bincount(np.concatenate([self.owner[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), minlength=len(self.units))
                score[~unused] = -1
                score[seed] = -1
                parts, room, pick = [], window, seed
                while room:
                    doc, start, ids, n = self.units[pick]
                    take = min(room, len(ids))
                    parts.append((doc, start, ids[:take], n))
                    room -= take
                    if take < len(ids):
                        self.units[pick] = [doc, start + take, ids[take:], n]
                        break
                    unused[pick] = False
                    score[pick] = -1
                    if room:
                        pick = int(score.argmax())
                        if score[pick] < 0:
                            return done, [list(p) for p in parts]
                done.append(parts)
        return done, []


def fill_windows(tails: DataFrame, idf: np.ndarray, mean: float, window: int, kind: str, shard: int, query_terms: int, with_ids: bool) -> DataFrame:
    sent = tails.sparkSession.sparkContext.broadcast(idf)
    schema = PLACED + (", ids array<int>" if with_ids else "")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_bytes.cache_clear()  # all texts are cut: a worker's remembered words are of no more use
        give_back()
        # Odd ids, apart from the full windows' even ones; 31 bits of windows a task.
        next_id = [(TaskContext.get().partitionId() << 32) + 1]

        def rows(windows):
            out = []
            for parts in windows:
                offset = 0
                for doc, start, ids, n in parts:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, next_id[0], offset, *([ids.astype(np.int32)] * with_ids)))
                    offset += len(ids)
                next_id[0] += 2
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

        held: list[list] = []
        new = 0
        for batch in batches:
            for u in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                held.append([u[0], u[1], np.frombuffer(u[2], kind), u[3]])
                new += 1
                if new == shard:
                    done, held = _Shard(held, sent.value, mean, query_terms).fill(window)
                    new = 0
                    yield rows(done)
        if held:
            done, rest = _Shard(held, sent.value, mean, query_terms).fill(window)
            yield rows([*done, *([rest] if rest else [])])

    return tails.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(fill, schema)


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None, shard: int = 1024, query_terms: int = 12, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, on request, ids. A null or empty text is id 0 alone; each row of a repeated
    doc_id is packed; an empty table gives no rows; columns other than doc_id and text
    are not read. Sequences are full but for one at most per task.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    size = tokenizer(path).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    folder = shared_folder(spark, "cut-documents")
    cut_documents(docs, window, path, with_ids).write.option("compression", "zstd").parquet(folder)
    cut = spark.read.parquet(folder)
    tails = cut.filter(F.col("lexical_key").isNotNull())
    mean, n = tails.agg(F.coalesce(F.avg("length"), F.lit(1.0)), F.count("*")).first()
    found = document_frequencies(tails, kind).toPandas()  # no more rows than the vocabulary has ids
    df = np.zeros(size, dtype=np.float64)
    df[found["term"].to_numpy(dtype=np.int64)] = found["df"].to_numpy()
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    dealt = tails.repartitionByRange("lexical_key", "doc_id", "start").sortWithinPartitions("lexical_key", "doc_id", "start")
    placed = fill_windows(dealt, idf, mean, window, kind, shard, query_terms, with_ids)
    whole = cut.filter(F.col("lexical_key").isNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *([_unpacked(kind)] * with_ids)
    )
    return whole.unionByName(placed)


def _unpacked(kind: str):
    @F.pandas_udf("array<int>")
    def ids(data):
        return data.map(lambda x: np.frombuffer(x, kind).astype(np.int32))

    return ids("ids").alias("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the remaining documents, packed, with their ids."""
    del spark, sf_dir
    return pack(docs)
