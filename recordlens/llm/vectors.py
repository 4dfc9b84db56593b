"""Near copies of embeddings: sign hashing in several tables, exact cosine, components.

Equal vectors of a label are joined once, with their number. Every table cuts the space by
random hyperplanes; vectors of a label with the same signs share a bucket. A bucket is
cut into blocks of bounded size, and each pair of blocks is one piece of work, so a large
bucket spreads over many tasks. Within a piece all cosines come from one matrix product
in double precision. A pair that meets in several tables counts in the first of them
only. A piece returns a count per vector and a spanning star per component, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import table
from recordlens.llm.components import connected_components
from recordlens.session import written

#: At a cosine of 0.98 a pair keeps its side of a plane with probability 0.936 and meets
#: in a table of 16 planes with 0.35, so 20 tables miss it with 0.0002.
PLANES, TABLES, SEED = 16, 20, 17
#: Vectors of a bucket that one block holds on average.
BLOCK = 256


def is_usable():
    """Whether a vector can link: labelled, of finite components, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def hashed(firsts: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """firsts with dim and signs: one number per table."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            values, dims = batch.column("embedding"), batch.column("dim").to_numpy()
            flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(dims)
            out = np.zeros((len(dims), tables), dtype=np.int64)
            for d in np.unique(dims):
                if d not in made:
                    made[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), planes * tables))
                mine = np.flatnonzero(dims == d)
                x = flat[(ends[mine] - d)[:, None] + np.arange(d)]
                out[mine] = ((x @ made[d]) >= 0).reshape(len(mine), tables, planes) @ powers
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables).cast(pa.list_(pa.int64()))], names=[*batch.schema.names, "signs"])

    rows = firsts.withColumn("dim", F.size("embedding").cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", signs array<long>"
    return rows.mapInArrow(sign, schema)


def _spanning(adjacent: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    label = np.arange(len(adjacent))
    near = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        low = np.where(near, label[None, :], len(label)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(piece: dict, least: float) -> tuple:
    """(id, links, a, b) of one piece: counts of the vectors on either side, and its stars."""
    side, at = piece["side"], piece["table"]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: on both sides
    x, signs, ids, copies = piece["x"], piece["signs"], piece["id"], piece["copies"]
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = unit[left] @ unit[right].T >= least - 1e-9
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if piece["diagonal"]:
        a, b = a[a < b], b[a < b]
    earlier = (signs[a, :at] == signs[b, :at]).any(axis=1) if at else np.zeros(len(a), dtype=bool)
    a, b = a[~earlier], b[~earlier]
    # the plain quotient decides; the product above only chooses
    dot = np.einsum("ij,ij->i", x[a], x[b])
    norm = np.sqrt((x * x).sum(axis=1))
    sure = dot / (norm[a] * norm[b]) >= least
    a, b = a[sure], b[sure]
    if not len(a):
        return ids[:0], copies[:0], ids[:0], ids[:0]
    n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    who = np.flatnonzero(n)
    adjacent = np.zeros((len(who), len(who)), dtype=bool)
    pa_, pb_ = np.searchsorted(who, a), np.searchsorted(who, b)
    adjacent[pa_, pb_] = adjacent[pb_, pa_] = True
    root = _spanning(adjacent)
    return ids[who], n[who].astype(np.int64), ids[who], ids[who[root]]


def compared(pieces: DataFrame, least: float) -> DataFrame:
    """(id, links, a, b) from rows sorted by piece: label, dim, table, sign, lo, hi."""
    keys = ["label", "dim", "table", "sign", "lo", "hi"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            mark = np.column_stack([held.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield from done(held.slice(0, cuts[-1]), mark[: cuts[-1]], cuts)
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            mark = np.column_stack([held.column(k).to_numpy() for k in keys])
            yield from done(held, mark, np.array([held.num_rows]))

    def done(rows: pa.RecordBatch, mark: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        signs = rows.column("signs").flatten().to_numpy().reshape(rows.num_rows, -1)
        dims = mark[:, 1]
        flat, side = rows.column("embedding").flatten().to_numpy(zero_copy_only=False), rows.column("side").to_numpy()
        reach = np.concatenate([[0], np.cumsum(dims)])
        out, begin = [], 0
        for end in ends:
            if end - begin > 1:
                s = slice(begin, end)
                x = flat[reach[begin] : reach[end]].reshape(end - begin, -1).astype(np.float64)
                piece = {"x": x, "signs": signs[s], "id": ids[s], "copies": copies[s], "side": side[s], "table": int(mark[begin, 2]), "diagonal": mark[begin, 4] == mark[begin, 5]}
                found = _compared(piece, least)
                if len(found[0]):
                    out.append(found)
            begin = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["id", "links", "a", "b"])

    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(work, "id long, links long, a long, b long")


def near_vectors(vectors: DataFrame, least: float = 0.98, planes: int = PLANES, tables: int = TABLES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label).

    Rows of the same label link at a cosine of ``least`` or more. A null label, a null or
    zero vector, and null or non-finite components link with nothing; so do vectors of
    different lengths. n_links counts other rows linked directly, equal vectors included;
    component_id is the smallest vec_id reachable; kept marks the row that bears it. A
    row without vec_id links and counts like any other, but names no component: it is kept
    only where nothing it reaches has a vec_id. Extra columns are not read; an empty table
    gives no rows.
    """
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).withColumn("usable", is_usable())
    good = rows.filter("usable")
    # One row per distinct vector of a label, with a number of its own; vec_id only names it.
    distinct = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    firsts = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    signs = written(hashed(firsts.drop("name"), planes, tables, seed), "signed-vectors")
    met = signs.select("label", "dim", "id", F.posexplode("signs").alias("table", "sign"))
    buckets = met.groupBy("label", "dim", "table", "sign").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "buckets")
    full = signs.select("label", "dim", "id", "copies", "embedding", "signs", F.posexplode("signs").alias("table", "sign"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cut = full.join(buckets, ["label", "dim", "table", "sign"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = cut.select(
        "label", "dim", F.col("table").cast("long").alias("table"), "sign",
        F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "id", "copies", "embedding", "signs",
    )
    found = written(compared(pieces, least), "vector-links")
    labels = connected_components(found.select("a", "b").filter("a <> b"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = firsts.join(links, "id", "left").join(labels.toDF("id", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    joined = written(joined.select("label", "embedding", "name", "group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-groups")
    names = joined.groupBy("group").agg(F.min("name").alias("component"))
    known = written(joined.join(names, "group").select("label", "embedding", "n_links", "component"), "vector-components")

    out = good.select("vec_id", "label", "embedding").join(known, ["label", "embedding"], "left").select("vec_id", "n_links", "component")
    out = out.unionByName(rows.filter(~F.col("usable")).select("vec_id"), allowMissingColumns=True)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op10_vector_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), r(vec_id, reach) AS (
  SELECT a, b FROM l
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON r.reach = l.a
), c AS (SELECT vec_id, min(reach) AS lo FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, coalesce(k.n, 0) AS n_links, coalesce(least(c.lo, x.vec_id), x.vec_id) AS component_id,
       coalesce(least(c.lo, x.vec_id), x.vec_id) = x.vec_id AS kept
FROM embeddings x LEFT JOIN c ON x.vec_id = c.vec_id LEFT JOIN k ON x.vec_id = k.vec_id
"""
