"""Hard negatives through an inverted multi-index.

1. Each half of the vectors has a codebook; a pair of codewords is a cell. The codebooks are
   fitted on a bounded sample, but every row is in its cell, and each codeword's radius, the
   greatest distance of a row's half from it, is taken over all rows. So a row in cell (i, j)
   scores at most the sum of two half-score bounds: the product with the codeword plus the
   length of the query's half times the radius.
2. Cells are dealt to shards by their first codeword; a codeword of many rows is cut by row.
   An anchor first visits the shard of its greatest bound. What it finds there raises the
   score below which nothing is wanted, and it goes on only to shards whose bound reaches it.
   Anchors travel in blocks, and a shard's rows once per block that visits it.
3. Within a shard a heap walks the cells in descending order of their bounds (the
   multi-sequence walk over both sorted lists of half-score bounds). An anchor asks for the
   best k rows inside one or more windows of scores. A window is certified once the next
   bound is below its kth score, or below its lower end; when all are, the walk stops.

Positives are one window without ends over rows of the anchor's label; the negatives of each
positive are a window of scores relative to the positive's, over rows of other labels.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.base import table
from recordlens.session import written

#: Rows of a cell on average, codewords of a half at most, sampled rows per codeword, fitting rounds.
PER_CELL, CODEWORDS, SAMPLED, FITTING, SEED = 64, 1024, 16, 8, 13
#: Rows of a shard, anchors of a block, and rows scored in one product.
SHARD, BLOCK, STEP = 4096, 512, 256
LOW, HIGH = -(1 << 62), 1 << 62


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column as one matrix of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _codebook(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``words`` groups of the sampled halves."""
    centres = x[rng.choice(len(x), words, replace=len(x) < words)].astype(float)
    for _ in range(FITTING):
        near = (centres @ x.T * -2 + (centres * centres).sum(axis=1)[:, None]).argmin(axis=0)
        for w in np.unique(near):
            centres[w] = x[near == w].mean(axis=0)
    return centres


def codebooks(rows: DataFrame, n_rows: int, sampled: int = SAMPLED) -> tuple[np.ndarray, np.ndarray]:
    """Two codebooks from ``sampled`` rows per codeword (no more than 16,384 rows with the defaults)."""
    words = min(CODEWORDS, max(1, round(math.sqrt(n_rows / PER_CELL))))
    some = rows.select("x").orderBy(F.xxhash64("row"), "row").limit(words * sampled).toPandas()["x"]
    x, rng = np.array(some.tolist(), dtype=float), np.random.default_rng(SEED)
    half = x.shape[1] // 2
    return _codebook(x[:, :half], words, rng), _codebook(x[:, half:], words, rng)


def in_cells(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows with i, j (the nearest codewords) and far_i, far_j (the distances from them)."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), batch.num_rows).astype(float)
            half, codes, far = x.shape[1] // 2, [], []
            for part, book in zip((x[:, :half], x[:, half:]), sent.value, strict=True):
                near = (part @ book.T * -2 + (book * book).sum(axis=1)).argmin(axis=1)
                codes.append(pa.array(near))
                far.append(pa.array(np.sqrt(((part - book[near]) ** 2).sum(axis=1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *codes, *far], names=[*batch.schema.names, "i", "j", "far_i", "far_j"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(code, schema + ", i long, j long, far_i double, far_j double")


class Bounds:
    """Half-score bounds of a codebook pair, and the shards by first codeword (tables as long as a codebook)."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], counts: np.ndarray, shard: int):
        self.books, self.radii = books, radii  # a radius of -inf: no row has the codeword
        self.group, self.parts = np.zeros(len(counts), dtype=np.int64), []
        held = 0
        for i, n in enumerate(counts.tolist()):
            if not self.parts or held + n > shard:
                self.parts.append(1)
                held = 0
            held += n
            self.group[i] = len(self.parts) - 1
            self.parts[-1] = max(1, math.ceil(held / shard))

    def halves(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half the bounds (queries by codewords), a little above the true ones."""
        half = q.shape[1] // 2
        out = []
        for part, book, radius in zip((q[:, :half], q[:, half:]), self.books, self.radii, strict=True):
            size = np.sqrt((part * part).sum(axis=1))[:, None]
            with np.errstate(invalid="ignore"):
                reach = np.where(np.isfinite(radius), size * radius, -np.inf)
            out.append(part @ book.T + reach + 1e-9 * size * (np.abs(book).sum(axis=1) + np.where(np.isfinite(radius), radius, 0)) + 0.5)
        return out


def routed(anchors: DataFrame, bounds: Bounds, home: bool) -> DataFrame:
    """anchors with group and part: the shard of the greatest bound, or every other whose bound reaches a window."""
    sent = anchors.sparkSession.sparkContext.broadcast(bounds)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        parts = np.array(b.parts)
        for batch in batches:
            n = batch.num_rows
            u, v = b.halves(_matrix(batch.column("x"), n).astype(float))
            best = np.full((n, len(parts)), -np.inf)
            for g in range(len(parts)):
                best[:, g] = u[:, b.group == g].max(axis=1)
            best += v.max(axis=1)[:, None]
            first = best.argmax(axis=1)
            own = batch.column("row").to_numpy() % parts[first]
            if home:
                shards = [[{"group": g, "first": p, "parts": 1, "skip": -1}] for g, p in zip(first.tolist(), own.tolist(), strict=True)]
            else:
                least = [min(lo) for lo in batch.column("lo").to_pylist()]
                shards = []
                for k in range(n):
                    some = np.flatnonzero((best[k] >= least[k]) & np.isfinite(best[k])).tolist()
                    shards.append([{"group": g, "first": 0, "parts": b.parts[g], "skip": int(own[k]) if g == first[k] else -1} for g in some])
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("group", "first", "parts", "skip")]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, kind)], names=[*batch.schema.names, "shards"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    to = anchors.mapInArrow(route, schema + ", shards array<struct<group:long,first:long,parts:long,skip:long>>").withColumn("to", F.explode("shards")).drop("shards")
    to = to.select("*", F.col("to.group").alias("group"), F.explode(F.sequence(F.col("to.first"), F.col("to.first") + F.col("to.parts") - 1)).alias("part"))
    return to.filter(F.col("part") != F.col("to.skip")).drop("to")


def _cells(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs, in descending order of u[i] + v[j]."""
    by_u, by_v = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable").tolist()
    u, v = u.tolist(), v.tolist()
    heap = [(-(u[by_u[0]] + v[by_v[0]]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, by_u[a], by_v[b]
        if b + 1 < len(by_v):
            heapq.heappush(heap, (-(u[by_u[a]] + v[by_v[b + 1]]), a, b + 1))
        if b == 0 and a + 1 < len(by_u):
            heapq.heappush(heap, (-(u[by_u[a + 1]] + v[by_v[0]]), a + 1, 0))


class _Shard:
    """Rows of a shard by cell."""

    def __init__(self, rows: pa.Table):
        n = rows.num_rows
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        order = np.lexsort((j, i))
        self.i, inner = np.unique(i, return_inverse=True)
        self.j, outer = np.unique(j, return_inverse=True)
        cell = (inner * len(self.j) + outer)[order]
        self.ends = np.searchsorted(cell, np.arange(len(self.i) * len(self.j) + 1)).tolist()
        self.x = _matrix(rows.column("x"), n)[order]
        self.row, self.vec_id, self.label = (rows.column(c).to_numpy()[order] for c in ("row", "vec_id", "label"))
        self.float_x, self.most = self.x.astype(float), int(np.abs(self.x).max())

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whole-number products; by doubles where they hold them exactly."""
        if self.most * int(np.abs(q).max()) * len(q) < 1 << 53:
            return (self.float_x[at] @ q.astype(float)).astype(np.int64)
        return self.x[at] @ q

    def windows(self, q: np.ndarray, row: int, label: int, u: np.ndarray, v: np.ndarray, lo: list[int], hi: list[int], k: int, same: bool) -> list[tuple]:
        """(slot, row, vec_id, score): the k best inside each window, as far as this shard knows."""
        found: list[tuple] = [(np.empty(0, np.int64),) * 3 for _ in lo]  # row, vec_id, score
        need = list(lo)
        held: list[np.ndarray] = []
        size, walk = 0, _cells(u[self.i], v[self.j])
        while True:
            bound, a, b = next(walk, (-math.inf, 0, 0))
            done = bound < min(need)
            if not done:
                cell = a * len(self.j) + b
                if self.ends[cell] < self.ends[cell + 1]:
                    held.append(np.arange(self.ends[cell], self.ends[cell + 1]))
                    size += len(held[-1])
            if size and (done or size >= STEP):
                at = np.concatenate(held)
                at = at[(self.label[at] == label) & (self.row[at] != row) if same else self.label[at] != label]
                score = self.scores(at, q)
                for s, (low, high) in enumerate(zip(need, hi, strict=True)):
                    if len(good := np.flatnonzero((score >= low) & (score <= high))):
                        rows, ids, scores = (np.concatenate(c) for c in zip(found[s], (self.row[at[good]], self.vec_id[at[good]], score[good]), strict=True))
                        best = np.lexsort((rows, ids, -scores))[:k]
                        found[s] = rows[best], ids[best], scores[best]
                        if len(best) == k:
                            need[s] = max(low, int(found[s][2][-1]))
                held, size = [], 0
            if done:
                break
        return [(s, *r) for s, f in enumerate(found) for r in zip(*(c.tolist() for c in f), strict=True)]


def searched(cells: DataFrame, bounds: Bounds, to: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, slot, found_row, found_id, score) of anchors in their shards."""
    sent = cells.sparkSession.sparkContext.broadcast(bounds)
    keys = ["group", "part", "block"]
    names = ["row", "slot", "found_row", "found_id", "score"]

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            shard, q = _Shard(rows), _matrix(anchors.column("x"), anchors.num_rows)
            u, v = sent.value.halves(q.astype(float))
            asked = zip(*(anchors.column(c).to_pylist() for c in ("row", "label", "lo", "hi")), strict=True)
            for n, (row, label, lo, hi) in enumerate(asked):
                out += [(row, *f) for f in shard.windows(q[n], row, label, u[n], v[n], lo, hi, k, same)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=names)

    visits = to.select(*[F.col(c).alias(c) for c in keys]).distinct()
    dealt = cells.join(visits, ["group", "part"]).select(*keys, "row", "vec_id", "label", "x", "i", "j")
    left = to.select(*keys, "row", "label", "x", "lo", "hi").groupBy(*keys)
    return left.cogroup(dealt.groupBy(*keys)).applyInArrow(work, ", ".join(f"{c} long" for c in names))


def in_windows(cells: DataFrame, bounds: Bounds, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, slot, found_row, found_id, score, rank): the k best of each anchor's windows lo..hi, over all shards."""
    by = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "found_id", "found_row")
    first = written(searched(cells, bounds, routed(anchors, bounds, home=True), k, same), "home-shards")
    kth = first.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k)
    kth = kth.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "score"))).alias("kth"))  # a row per window of an anchor
    raised = F.transform("lo", lambda low, slot: F.greatest(low, F.coalesce(F.try_element_at("kth", slot), low)))
    rest = written(anchors.join(kth, "row", "left").withColumn("lo", raised).drop("kth"), "raised-anchors")
    found = first.unionByName(searched(cells, bounds, routed(rest, bounds, home=False), k, same))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _floor_div(a: Column, b: int) -> Column:
    """a / b rounded down, in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and x, an array of whole numbers; a score is the inner
    product with the anchor, higher first, ties by vec_id. A positive is one of an anchor's
    first ``positives`` other rows of its label; its negatives are the first ``negatives``
    rows of another label that score between ``low`` and ``high`` percent of the positive's
    score (none for a negative one). Rows with a null vec_id, label, vector or component take
    no part, nor do vectors that are empty or not of the commonest length (of several, the
    longest). Repeated rows are rows of their own; an empty table gives no rows; other
    columns are not read. The results are exact: no candidate is left out unseen unless its
    cell's bound rules it out.
    """
    spark = vectors.sparkSession
    whole = F.coalesce(F.forall("x", lambda c: c.isNotNull()) & (F.size("x") > 0), F.lit(False))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = written(good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "mined-vectors")
    length = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if length is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.filter(F.size("x") == length.dim)
    books = codebooks(rows, length.n)
    coded = written(in_cells(rows, books), "vectors-in-cells")
    words = len(books[0])
    radii, counts = [], None
    for code, far in (("i", "far_i"), ("j", "far_j")):
        by = coded.groupBy(code).agg(F.max(far).alias("far"), F.count("*").alias("n")).collect()  # one row per codeword
        radius, count = np.full(words, -np.inf), np.zeros(words, dtype=np.int64)
        for r in by:
            radius[r[0]], count[r[0]] = r.far, r.n
        radii.append(radius)
        counts = count if counts is None else counts
    bounds = Bounds(books, (radii[0], radii[1]), counts, shard)
    shards = spark.createDataFrame([(i, int(g), bounds.parts[g]) for i, g in enumerate(bounds.group)], "i long, group long, parts long")
    cells = coded.join(F.broadcast(shards), "i").withColumn("part", F.pmod(F.col("row"), F.col("parts"))).drop("parts", "far_i", "far_j")  # as long as a codebook
    anchors = rows.filter("is_anchor")
    blocks = max(1, math.ceil(anchors.count() / block))
    anchors = anchors.select("row", "vec_id", "label", "x", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))

    one = [F.array(F.lit(v).cast("long")).alias(c) for c, v in (("lo", LOW), ("hi", HIGH))]
    same = in_windows(cells, bounds, anchors.select("*", *one), positives, same=True)
    same = written(same.select("row", (F.col("rank") - 1).cast("long").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    ends = same.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))  # no longer than ``positives``
    lo = F.transform("p", lambda p: -_floor_div(p["positive_score"] * -low, 100))
    hi = F.transform("p", lambda p: _floor_div(p["positive_score"] * high, 100))
    asked = anchors.join(ends, "row").select("row", "vec_id", "label", "x", "block", lo.alias("lo"), hi.alias("hi"))
    other = in_windows(cells, bounds, asked, negatives, same=False)
    out = other.join(same, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x of ``embeddings``: finite vectors in steps of 1/256, every seventh label moved on by one."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256))
    return vectors.filter(F.coalesce(finite, F.lit(False))).select("vec_id", moved.alias("label"), x.alias("x"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negatives of every anchor's positives; rows without a usable label, vector or vec_id take no part."""
    return hard_negatives(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k AS ak, b.k AS bk, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.k <> b.k AND len(a.e) = len(b.e)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.ak, p.bk ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.ak = s.ak AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
