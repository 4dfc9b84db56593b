"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration says how many rests of each length share one sequence. The program asks
for the least number of sequences whose configurations cover the histogram:

1. Every document becomes ids, closed by id 0. A longer one is cut into full pieces and a
   rest. Pieces are numbered by length within their task; the numbers of rests of each
   length are summed on Spark. That histogram has one row per length at most, however
   large the corpus, and is all that the driver sees.
2. The program is solved by multiplicative weights. A length is worth its share of a
   sequence, times a weight that falls exponentially with the part of it already covered.
   A knapsack table over the sequence's capacity prices configurations: one pass gives,
   for each length, the configuration of the greatest worth that holds it. Each is taken
   for a step of its length's need, and worths are computed again. Where a pass ends above
   the lower bound that the worths prove, the next starts from what each length cost.
3. Multiplicities are rounded down. What is then left over is filled best fit: the longest
   rest first, completed by the subset of rests that leaves the least room.
4. Each configuration owns a range of sequence ids, and the ranges of each length's
   numbers that go into it. The table of ranges depends on the window alone, so it is
   sent to every task, where a piece's number gives its place.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.base import slices, table
from recordlens.llm.bytebpe import tokenizer
from recordlens.llm.wordbpe import run_memory
from recordlens.session import shared_folder

VOCABULARY = "word_bpe_49k.json"
#: The part of a length's need taken in one step, the fall of its weight from nothing to
#: all of it covered, the most pricing rounds, and the part of all tokens left to best fit.
STEP, FALL, ROUNDS, LEFT = 0.5, 2.0, 80, 0.002
#: Passes at most, and the gap to the lower bound at which a pass is the last.
PASSES, GAP = 8, 0.001
#: A number within a length has fewer bits than this.
NUMBER_BITS = 48

Configuration = tuple[tuple[int, int], ...]  # (index of a length, how many)


def cut_documents(docs: DataFrame, window: int, path: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number[, ids]): pieces, numbered by length within a task."""
    kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, part = run_memory(path), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                rows = []
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    data = memory.of(text or "") + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(data), 4 * window)):
                        x = data[at : at + 4 * window]
                        n = len(x) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(x), part, seen[n], *[np.frombuffer(x, "<u4").astype(kind).tobytes()] * with_ids))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + ", ids binary" * with_ids)


def _prices(lengths: np.ndarray, worth: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w]: the greatest worth of lengths that fit in w; last[w]: one of them, -1 where w - 1 does as well."""
    best, last = np.zeros(window + 1), np.full(window + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(window + 1), side="right")
    for w in range(int(lengths[0]), window + 1):
        k = fitting[w]
        with_one = best[w - lengths[:k]] + worth[:k]
        i = int(with_one.argmax())
        best[w], last[w] = (with_one[i], i) if with_one[i] > best[w - 1] else (best[w - 1], -1)
    return best, last


def _traced(last: np.ndarray, lengths: np.ndarray, room: int) -> Iterator[int]:
    """The lengths behind best[room]."""
    while room > 0:
        if (i := int(last[room])) >= 0:
            yield i
            room -= int(lengths[i])
        else:
            room -= 1


def _one_pass(lengths: np.ndarray, need: np.ndarray, window: int, base: np.ndarray) -> tuple[dict[Configuration, float], np.ndarray, float]:
    """Configurations with their multiplicities, what they leave over, and a lower bound on the sequences.

    The bound is the dual value of the worths: need times worth over the greatest worth of
    a configuration, at its best over the rounds. A length that is used up is worth nothing,
    which keeps the bound valid.
    """
    left, taken, bound = need.astype(float), Counter(), 0.0
    for _ in range(ROUNDS):
        on = np.flatnonzero(left > 0)
        if left @ lengths <= LEFT * (need @ lengths):
            break
        some, worth = lengths[on], base[on] * np.exp(FALL * (left[on] / need[on] - 1))
        best, last = _prices(some, worth, window)
        bound = max(bound, (need[on] @ worth) / best[window])
        for i in np.argsort(-(worth + best[window - some]), kind="stable").tolist():
            config = Counter([i, *_traced(last, some, window - int(some[i]))])
            at, many = on[list(config)], np.array(list(config.values()))
            times = min(STEP * need[on[i]] / config[i], (left[at] / many).min())
            if times > 0:
                left[at] -= times * many
                left[left < 1e-9 * need] = 0
                taken[tuple(sorted(zip(at.tolist(), many.tolist(), strict=True)))] += times
    return taken, left, bound


def rounded(taken: dict[Configuration, float], lengths: np.ndarray, need: np.ndarray, least: int) -> tuple[list[tuple[Configuration, int]], np.ndarray]:
    """Whole multiplicities of the configurations of ``least`` tokens or more, and what they leave over."""
    left, out = need.copy(), []
    for config, times in sorted(taken.items(), key=lambda c: (-c[1], c[0])):
        at, many = [i for i, _ in config], np.array([n for _, n in config])
        if int(lengths[at] @ many) >= least and (k := min(int(times + 1e-6), int((left[at] // many).min()))) > 0:
            left[at] -= k * many
            out.append((config, k))
    return out, left


def best_fit(lengths: np.ndarray, need: np.ndarray, window: int) -> list[tuple[Configuration, int]]:
    """Configurations that use up ``need``: the longest first, with the subset that fits best.

    Sums that a subset can reach are the bits of one number. A configuration is used as
    often as what is left allows, so the work depends on the lengths, not on their counts.
    """
    left, out = need.copy(), []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        config, room = Counter([first]), window - int(lengths[first])
        left[first] -= 1
        tried, reached, before = [], 1, []
        for i in np.flatnonzero((left > 0) & (lengths <= room))[::-1].tolist():
            for _ in range(min(int(left[i]), room // int(lengths[i]))):
                if reached >> room:
                    break
                tried.append(i)
                before.append(reached)
                reached |= (reached << int(lengths[i])) & ((2 << room) - 1)
        left[first] += 1
        filled = reached.bit_length() - 1
        for i, sums in zip(reversed(tried), reversed(before), strict=True):
            if not sums >> filled & 1:
                config[i] += 1
                filled -= int(lengths[i])
        at, many = list(config), np.array(list(config.values()))
        times = int((left[at] // many).min())
        left[at] -= times * many
        out.append((tuple(sorted(config.items())), times))
    return out


def configurations(lengths: np.ndarray, need: np.ndarray, window: int) -> tuple[list[tuple[Configuration, int]], int]:
    """Configurations with whole multiplicities that hold every rest once, and a lower bound on their number.

    The best of several passes, each rounded twice: with full configurations only, and with
    all. A sequence costs 1, which its rests share by their worths. After a pass a length's
    worth goes halfway (as a power) to what it cost; a pass within ``GAP`` of the bound, or
    one sequence above it, is the last.
    """
    if not len(lengths):
        return [], 0
    base, bound, fewest, out = lengths / window, 0, math.inf, []
    for _ in range(PASSES):
        taken, left, low = _one_pass(lengths, need, window, base)
        bound = max(bound, math.ceil(low - 1e-6))
        for least in (window, 0):
            some, rest = rounded(taken, lengths, need, least)
            some += best_fit(lengths, rest, window)
            if (total := sum(times for _, times in some)) < fewest:
                fewest, out = total, some
        if fewest <= max(bound * (1 + GAP), bound + 1):
            break
        cost = np.zeros(len(lengths))
        for config, times in taken.items():
            at, many = [i for i, _ in config], np.array([n for _, n in config])
            cost[at] += times * many * base[at] / (base[at] @ many)
        covered = need - left
        base = np.where(covered > 0, np.sqrt(base * np.maximum(cost, 1e-12) / np.maximum(covered, 1e-12)), base)
    return out, bound


def ranges(found: list[tuple[Configuration, int]], lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Per length and configuration: the first number, the first sequence, how many in one, the offset of the first of them."""
    rows, next_number, sequence = [], [0] * len(lengths), 0
    for config, times in found:
        offset = 0
        for i, many in config:
            rows.append(((int(lengths[i]) << NUMBER_BITS) + next_number[i], next_number[i], sequence, many, offset))
            next_number[i] += times * many
            offset += many * int(lengths[i])
        sequence += times
    made = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "sequence", "many", "offset"), made.T, strict=True))


def placed(pieces: DataFrame, where: dict[str, np.ndarray], kind: str) -> DataFrame:
    """pieces (with ``number`` over the whole corpus) with sequence_id and offset, ids unpacked."""
    sent = pieces.sparkSession.sparkContext.broadcast(where)
    kept = [f for f in pieces.schema if f.name not in ("number", "ids")]
    with_ids = "ids" in pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = np.searchsorted(w["key"], (length << NUMBER_BITS) + number, side="right") - 1
            since = number - w["first"][row]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(w["sequence"][row] + since // w["many"][row]), pa.array(w["offset"][row] + since % w["many"][row] * length)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, kind).astype(np.int32) for x in batch.column("ids").to_pylist()], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["sequence_id", "offset"] + ["ids"] * with_ids)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return pieces.mapInArrow(place, schema + ", ids array<int>" * with_ids)


def pack_best_fit(docs: DataFrame, window: int = 2048, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in as few sequences of at most ``window`` ids as the method finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, on
    request, ids. Only documents of more than ``window`` ids are cut, into full pieces and a
    rest. A null or empty text is id 0 alone; each row of a repeated or null doc_id is packed;
    an empty table gives no rows; columns other than doc_id and text are not read. Sequence
    ids run from 0 without gaps; which of several rests of equal length goes where depends on
    how the rows were dealt to tasks.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
    folder = shared_folder(spark, "cut-to-length")
    cut_documents(docs, window, path, with_ids).write.option("compression", "zstd").parquet(folder)
    cut = spark.read.parquet(folder)
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toPandas()  # one row per length
    lengths, need = histogram["length"].to_numpy(dtype=np.int64), histogram["n"].to_numpy(dtype=np.int64)
    short = lengths < window
    found, _ = configurations(lengths[short], need[short], window)
    full = [(((len(lengths) - 1, 1),), int(need[-1]))] if not short.all() else []
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = cut.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    pieces = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"), *["ids"] * with_ids)
    return placed(pieces, ranges(found + full, lengths), kind)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place; a null or empty text is id 0 alone, repeated rows are each packed."""
    return pack_best_fit(table(spark, sf_dir, "documents"), with_ids=False)
