"""Similarity join of shingle sets by PartEnum signatures.

Two sets link when 100 * intersection >= 80 * union. A pair of sizes s and t then differs
in at most (s + t) / 9 elements. The feature domain is cut into parts by a hash; within
one band of sizes all sets use the same number of parts, more than any linked pair can
differ in, so a linked pair agrees on whole parts, and a signature is (band, part, hash
of the set's elements there).

Not every part has to be signed. If n parts are used and a set of size s may differ from
a partner in at most k elements, a linked pair agrees on n - k parts or more. Each set
signs only its k + 1 best parts, ordered by how many of their elements are not found in
very many documents and then by number. That order depends on a part's elements alone,
so both sets place the parts they agree on alike, and the best of these has n - k - 1
others below it in either set: it is among the k + 1 signed by both. Empty parts and
parts of boilerplate come last and are signed only where nothing else is left.

Sets enter the join once, whatever their copies. Sets that share a signature are compared
with the best-connected of them, their centre; the links found give components. Of sets
that share a signature and no component, a linked pair x, y with common centre c must
have enough in common: either x and y each have so much in common with c that this alone
could do, or they share elements outside c. The first are compared, if one of them lies
outside c's component; the others meet by the first elements of what they have outside c,
as many as must hold a shared one. So no link between components is missed, and no group
of near copies is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import MIX, give_back, mixed, shingles, slices, table
from recordlens.llm.components import connected_components
from recordlens.session import written

#: Least size of the first band; every further band starts at twice the size.
BAND = 4
#: Parts, in percent of the differences to survive.
PARTS = 115
#: Counters for common shingles, and how many of them are held to be common at most.
COUNTERS, COMMON = 1 << 20, 1 << 16
#: Copies of one set that a task signs once, while it remembers this many sets.
REMEMBERED = 200_000


def band(size: int) -> int:
    return (size // BAND).bit_length() - 1


def parts_of(i: int) -> int:
    """Parts in band i: more than a linked pair can differ in."""
    most = 2 * (BAND * 2 ** (i + 1) - 1) // 9
    return -(-PARTS * (most + 1) // 100) + 2


def instances(size: int) -> list[tuple[int, int]]:
    """(band, differences at most) for each band in which a set of this size has partners."""
    if size < BAND:
        return []  # only an equal set can be a partner
    i, reach = band(size), size * 100 // 80
    own = [(i, (size + min(reach, BAND * 2 ** (i + 1) - 1)) // 9)]
    return own + ([(i + 1, (size + reach) // 9)] if reach >= BAND * 2 ** (i + 1) else [])


def is_rare(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which elements are not counted by a common counter."""
    if not len(common):
        return np.ones(len(elements), dtype=bool)
    counter = (elements & np.uint64(COUNTERS - 1)).astype(np.int64)
    return common[np.minimum(np.searchsorted(common, counter), len(common) - 1)] != counter


def signatures(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The signatures of a sorted set of 64-bit elements; common: sorted numbers of counters."""
    out, rare = [], is_rare(elements, common)
    for i, k in instances(len(elements)):
        n = parts_of(i)
        part = ((mixed(elements ^ MIX[3]) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
        sums = np.zeros(n, dtype=np.uint64)
        np.add.at(sums, part, mixed(elements + MIX[1]))
        weight = np.bincount(part[rare], minlength=n)
        best = np.lexsort((np.arange(n), weight))[n - k - 1 :]
        out.append(mixed(sums[best] + mixed(best.astype(np.uint64) + (np.uint64(i + 1) << np.uint64(32)))))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _key(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mixed(elements).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mixed(elements + MIX[2])) * MIX[0]
        return int(mixed(np.array([total + np.uint64(len(elements))], dtype=np.uint64)).view(np.int64)[0])


def named_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, key) per document, and (counter, count) of shingles common in a task's documents."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, dtype=np.int64), 0
        names = ["doc_id", "n", "key", "counter", "count"]
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                sets = shingles(piece.column("text"), size)
                seen += len(sets)
                counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                n, none = np.array([len(x) for x in sets]), pa.nulls(len(sets), pa.int64())
                keys = pa.array([_key(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), keys, none, none], names=names)
        common = np.flatnonzero(counts >= max(16, 0.005 * seen, 4 * counts.mean()))
        none = pa.nulls(len(common), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(common, pa.int64()), pa.array(counts[common], pa.int64())], names=names)
        give_back()

    return docs.mapInArrow(name, "doc_id long, n long, key long, counter long, count long")


def signed(docs: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """(sig, key): the signatures of every set; a task signs copies once."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # COMMON numbers at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                sigs, keys = [], []
                with np.errstate(over="ignore"):
                    for x in shingles(piece.column("text"), size):
                        if len(x) >= BAND and (key := _key(x)) not in done:
                            if len(done) >= REMEMBERED:
                                done.clear()
                            done.add(key)
                            sigs.append(signatures(x, sent.value))
                            keys.append(np.full(len(sigs[-1]), key))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])
        del done
        give_back()

    return docs.mapInArrow(sign, "sig long, key long")


def shared(sigs: DataFrame) -> DataFrame:
    """(sig, key), once each, of signatures that two keys or more have.

    Rows are dealt by signature and sorted; a pass that holds one row tells shared
    signatures, so memory doesn't depend on how many keys share one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, key, sent = np.empty(0, np.int64), np.empty(0, np.int64), False
        for batch in batches:
            sig = np.concatenate([sig, batch.column("sig").to_numpy()])
            key = np.concatenate([key, batch.column("key").to_numpy()])
            if not len(sig):
                continue
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            sig, key = sig[new], key[new]
            keep = np.zeros(len(sig), dtype=bool)
            same = sig[1:] == sig[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            go = keep.copy()
            go[0] &= not sent
            last = bool(keep[-1]) or (len(sig) == 1 and sent)
            yield pa.RecordBatch.from_arrays([pa.array(sig[go]), pa.array(key[go])], names=["sig", "key"])
            sig, key, sent = sig[-1:], key[-1:], last

    return sigs.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(scan, "sig long, key long")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, elements) for the wanted (key, doc_id), from the documents' texts.

    A set that only rows without doc_id have is made from all of those rows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                sets = shingles(piece.column("text"), size)
                keys = [_key(x) if len(x) else None for x in sets]
                right = [i for i, (k, w) in enumerate(zip(keys, piece.column("key").to_pylist(), strict=True)) if k is not None and w in (None, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in right], pa.int64()), pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64()))], names=["key", "elements"]
                )

    texts = docs.join(wanted, "doc_id").select("key", "text")
    made = texts.mapInArrow(make, "key long, elements array<long>")
    nameless = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("key"), "text")
    others = nameless.mapInArrow(make, "key long, elements array<long>").join(wanted.filter(F.col("doc_id").isNull()).select("key"), "key", "left_semi")
    return made.unionByName(others).dropDuplicates(["key"])


def linked(pairs: DataFrame, sets: DataFrame, least: int = 80) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough."""
    x = sets.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.filter(100 * F.col("common") >= least * (F.col("total") - F.col("common"))).select("a", "b")


def stars(together: DataFrame) -> DataFrame:
    """(sig, key, centre): each signature's sets and the one among them that shares most."""
    counts = written(together.groupBy("sig").agg(F.count("*").alias("m")), "signature-counts")
    ties = written(together.join(counts, "sig").groupBy("key").agg(F.sum("m").alias("ties")), "ties")
    ranked = written(together.join(ties, "key"), "ranked-signatures")
    centres = written(ranked.groupBy("sig").agg(F.max_by("key", F.struct("ties", "key")).alias("centre")), "centres")
    return written(ranked.join(centres, "sig").filter(F.col("key") != F.col("centre")).select("sig", "key", "centre"), "stars")


def still_open(starred: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, centre, component, centre_component) of sets whose signature is in several components.

    A centre has been compared with every other set of its signatures, so only the others
    count.
    """
    to = labels.select(F.col("node").alias("key"), "component")
    placed = written(starred.join(to, "key", "left").select("sig", "key", "centre", F.coalesce("component", "key").alias("component")), "placed")
    several = written(placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig"), "open-signatures")
    rows = placed.join(several, "sig").select("key", "centre", "component").distinct()
    of_centre = labels.toDF("centre", "centre_component")
    return written(rows.join(of_centre, "centre", "left").select("key", "centre", "component", F.coalesce("centre_component", "centre").alias("centre_component")), "open-rows")


def around_centres(rows: DataFrame, sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(centre, element, key, component, centre_component, n, shared): what open sets have outside their centre.

    ``shared`` counts the elements of the n that the centre has too. A partner y of x has
    80 percent of x's size or more, so the pair needs 0.8 n elements in common or more; if
    x shares fewer with the centre, the rest lies outside it, and x's elements there, less
    as many as are needed but one, hold one of y's. Rare elements come first. A set that
    shares enough has a row without element too.
    """
    sent = sets.sparkSession.sparkContext.broadcast(common)
    x = sets.select("key", F.col("elements").alias("x"))
    c = sets.select(F.col("key").alias("centre"), F.col("elements").alias("c"))
    names = ["centre", "element", "key", "component", "centre_component", "n", "shared"]

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in names]
            ids = [batch.column(k).to_pylist() for k in ("centre", "key", "component", "centre_component")]
            for centre, key, component, of_centre, own, middle in zip(*ids, batch.column("x"), batch.column("c"), strict=True):
                own, middle = own.values.to_numpy().view(np.uint64), middle.values.to_numpy().view(np.uint64)
                outer = np.setdiff1d(own, middle, assume_unique=True)
                n, shared = len(own), len(own) - len(outer)
                needed = max(1, -(-n * 80 // 100) - shared)
                outer = outer[np.lexsort((outer, ~is_rare(outer, sent.value)))][: max(0, len(outer) - needed + 1)]
                elements = [*outer.view(np.int64).tolist(), *([None] if 100 * shared >= 80 * n else [])]
                for column, value in zip(found, (centre, None, key, component, of_centre, n, shared), strict=True):
                    column.extend([value] * len(elements))
                found[1][len(found[1]) - len(elements) :] = elements
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)

    both = rows.join(x, "key").join(c, "centre").select("centre", "key", "component", "centre_component", "x", "c")
    return both.mapInArrow(outside, ", ".join(f"{k} long" for k in names))


def pairs_around(outer: DataFrame) -> DataFrame:
    """(a, b): the pairs of open sets that could be linked, see ``around_centres``."""
    x, y = (outer.select("centre", "element", "centre_component", *(F.col(k).alias(f"{k}_{s}") for k in ("key", "component", "n", "shared"))) for s in "xy")
    apart = (F.col("key_x") < F.col("key_y")) & (F.col("component_x") != F.col("component_y"))
    fits = 100 * F.least("n_x", "n_y") >= 80 * F.greatest("n_x", "n_y")
    meet = x.filter("element is not null").join(y.filter("element is not null").drop("centre_component"), ["centre", "element"]).filter(apart & fits)
    close = x.filter("element is null and component_x <> centre_component").join(y.filter("element is null").drop("centre_component", "element"), "centre")
    enough = 9 * F.least("shared_x", "shared_y") >= 4 * (F.col("n_x") + F.col("n_y"))
    close = close.filter((F.col("component_x") != F.col("component_y")) & fits & enough)
    pair = F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")
    return meet.select(*pair).union(close.select(*pair)).distinct()


def _star_pairs(starred: DataFrame) -> DataFrame:
    return starred.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()


def _fitting(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link."""
    p = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return p.filter(100 * F.least("na", "nb") >= 80 * F.greatest("na", "nb")).select("a", "b")


def jaccard_components(documents: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of documents by similar shingle sets.

    Words are what stands between white space, A-Z in lower case; a set holds the distinct
    ``size``-word shingles, or the whole sequence if it is shorter. Texts without a word
    have an empty set and are components of their own. component_id is the smallest doc_id
    reachable. A row without doc_id keeps a row and links like any other, but names no
    component: its component_id is null where it reaches no row with one. Repeated rows each
    have a row; other columns are not read.
    """
    docs = documents.select("doc_id", "text")
    named = written(named_sets(docs, size), "named-sets")
    rows = named.filter(F.col("n").isNotNull()).select("doc_id", "n", "key")
    # The most common counters: a bounded table, and one that only orders parts.
    top = named.filter(F.col("counter").isNotNull()).groupBy("counter").agg(F.sum("count").alias("count")).orderBy(F.col("count").desc(), "counter").limit(COMMON)
    common = np.sort(np.array([r[0] for r in top.select("counter").collect()], dtype=np.int64))
    firsts = written(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "first-of-set")

    together = written(shared(signed(docs, size, common)), "shared-signatures")
    wanted = together.select("key").distinct()
    sets = written(sets_of(docs, firsts.join(wanted, "key", "left_semi").select("key", "doc_id"), size), "sets")
    sizes = firsts.select("key", "n")
    starred = stars(together)
    links = written(linked(_fitting(_star_pairs(starred), sizes), sets), "links")
    labels = connected_components(links)

    outer = written(around_centres(still_open(starred, labels), sets, common), "around-centres")
    again = written(linked(pairs_around(outer), sets), "links")
    if not again.isEmpty():
        labels = connected_components(links.union(again))

    heads = firsts.join(labels.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    heads = written(heads, "set-components")
    least = written(heads.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-names")
    named_heads = written(heads.join(least, "component").select("key", "component_id"), "set-component-names")
    return rows.join(named_heads, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the component it belongs to."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_first_of_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays.

    Rows that repeat its id and text stay once; rows without an id stay.
    """
    del spark, sf_dir
    firsts = written(jaccard_components(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "kept-documents")
    named = docs.filter(F.col("doc_id").isNotNull()).join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reach) AS (
  SELECT a, b FROM e
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m.lo, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, min(reach) AS lo FROM r GROUP BY doc_id) m ON w.doc_id = m.doc_id
"""
