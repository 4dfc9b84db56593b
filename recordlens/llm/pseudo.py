"""Masked pseudo-likelihood: every token predicted from both sides by a window network.

1. Words of all documents are counted; the most frequent get tokens of their own, the
   others share a few tokens by length and first byte. A shared token is a class of words:
   the network predicts the class, and the word's share of it comes from the counts.
2. The network adds one vector for each of the neighbours at -2, -1, +1 and +2, bends the
   sum, and predicts the class of the hidden token and the token within its class. Every
   task trains on its positions from common weights (numpy, Adagrad), and the weights are
   averaged by the number of positions. The rounds deal all positions out between them.
   Words are told apart by 64-bit hashes there, as in the lookup of counts.
3. A document's score is the sum of the log probabilities of its words, each given its
   neighbours; nothing outside the document is a neighbour. The counts of words that share
   a token are met on Spark, by hash, as they grow with the corpus.

Counts, training positions and averaged weights all grow with the corpus; the network, and
with it what tasks receive, has a fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import LOWER, MIX, as_bytes, mixed, slices, table, text_hashes, text_words
from recordlens.session import written

#: Classes, tokens a class, and the width of the network.
CLASSES, WITHIN, WIDTH = 32, 64, 16
VOCABULARY = CLASSES * WITHIN
#: Tokens for words without one of their own: by length (sixteen) and first byte (four).
SHARED = 64
#: Rounds of training; every position is trained on in one of them.
ROUNDS = 2
#: Places a step of training, its rate, and the square of a slope that every weight is taken to have seen.
STEP, RATE, SEEN = 4096, 0.2, 1e-6
#: Values whose exponentials, and the sums of these, neither vanish nor overflow as single floats.
LARGEST = 80.0
#: Words counted in a task before it hands them on.
HELD = 400_000
#: Groups in which shared words meet their counts: so many at least, and of so many occurrences.
GROUPS, GROUP = 1024, 1_000_000
#: Weights in one piece when they are averaged.
PIECE = 8192
OFFSETS = (-2, -1, 1, 2)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                held.update(chain.from_iterable(t.translate(LOWER).split() for t in as_bytes(piece.column("text")) if t))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_token(word: bytes) -> int:
    return VOCABULARY - SHARED + min(len(word), 15) * 4 + word[0] % 4


class Tokens:
    """Words' tokens, by the words' 64-bit hashes."""

    def __init__(self, known: dict[bytes, int]):
        hashes, _ = text_hashes(pa.array(list(known), pa.large_binary()))
        order = np.argsort(hashes)
        # a last hash that is met by none keeps the search inside
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.numbers = np.append(np.fromiter(known.values(), dtype=np.int64, count=len(known))[order], -1)

    def of(self, hashes: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A word's own token, or that shared by its length in bytes and first byte."""
        at = self.hashes.searchsorted(hashes)
        return np.where(self.hashes[at] == hashes, self.numbers[at], VOCABULARY - SHARED + np.minimum(length, 15) * 4 + first % 4)


class Batch:
    """Tokens of several documents in one line, two blanks between them."""

    def __init__(self, docs: list[list[int]]):
        self._lay(np.fromiter(chain.from_iterable(docs), dtype=np.int64), np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)))

    @classmethod
    def of(cls, tokens: np.ndarray, size: np.ndarray) -> Batch:
        """From the tokens of all documents in order, and how many each has."""
        self = cls.__new__(cls)
        self._lay(tokens, size)
        return self

    def _lay(self, tokens: np.ndarray, size: np.ndarray) -> None:
        self.size = size
        self.at = np.arange(len(tokens)) + 2 * np.repeat(np.arange(1, len(size) + 1), size)
        self.line = np.full(len(tokens) + 2 * len(size) + 2, VOCABULARY)
        self.line[self.at] = tokens


class Network:
    """Weights in one vector, seen as parts."""

    SHAPES = (("side", (len(OFFSETS), VOCABULARY + 1, WIDTH)), ("bend", (WIDTH,)), ("kind", (WIDTH, CLASSES)), ("kind_bias", (CLASSES,)), ("word", (CLASSES, WIDTH, WITHIN)), ("word_bias", (CLASSES, WITHIN)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, weights: np.ndarray):
        self.weights, at = weights, 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, weights[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> Network:
        """Small random vectors; biases that give the tokens' own frequencies."""
        net = cls(np.zeros(cls.SIZE, dtype=np.float32))
        rng = np.random.default_rng(seed)
        net.side[:] = rng.normal(0, 0.1, net.side.shape)
        net.kind[:] = rng.normal(0, 0.1, net.kind.shape)
        net.word[:] = rng.normal(0, 0.1, net.word.shape)
        p = (counts + 0.5).reshape(CLASSES, WITHIN)
        net.kind_bias[:] = np.log(p.sum(axis=1) / p.sum())
        net.word_bias[:] = np.log(p / p.sum(axis=1, keepdims=True))
        return net

    def hidden(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = self.side[0].take(line[at + OFFSETS[0]], axis=0)
        for k, o in enumerate(OFFSETS[1:], 1):
            h += self.side[k].take(line[at + o], axis=0)
        h += self.bend
        return np.tanh(h, out=h)

    def inside(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Values of the tokens within each place's class; places come in order of class."""
        y = np.empty((len(h), WITHIN), dtype=h.dtype)
        for c, a, b in _runs(kind):
            np.matmul(h[a:b], self.word[c], out=y[a:b])
            y[a:b] += self.word_bias[c]
        return y

    def small(self) -> bool:
        """Whether no value can leave the range of the exponential: what is bent lies within 1."""
        kind = np.abs(self.kind).sum(axis=0) + np.abs(self.kind_bias)
        return max(kind.max(), (np.abs(self.word).sum(axis=1) + np.abs(self.word_bias)).max()) < LARGEST

    def logs(self, line: np.ndarray, at: np.ndarray, piece: int = 16_384) -> np.ndarray:
        """Log probability of the token at each place, given its neighbours."""
        out, small = np.zeros(len(at)), self.small()
        for b in range(0, len(at), piece):
            order, mine, token, kind = _by_class(line, at[b : b + piece])
            rows = np.arange(len(mine))
            h = self.hidden(line, mine)
            x = h @ self.kind + self.kind_bias
            log = x[rows, kind]
            log -= _logsum(x, small)
            y = self.inside(h, kind)
            log += y[rows, token % WITHIN]
            log -= _logsum(y, small)
            out[b + order] = log
        return out

    def gradient(self, line: np.ndarray, at: np.ndarray) -> Network:
        """Of the mean negative log probability over the places."""
        g, small = Network(np.zeros(self.SIZE, dtype=np.float32)), self.small()
        _, at, token, kind = _by_class(line, at)
        rows, n = np.arange(len(at)), np.float32(1 / len(at))
        h = self.hidden(line, at)
        x = _shares(h @ self.kind + self.kind_bias, small)
        x[rows, kind] -= 1
        x *= n
        g.kind[:], g.kind_bias[:] = h.T @ x, x.sum(axis=0)
        dh = x @ self.kind.T
        y = _shares(self.inside(h, kind), small)
        y[rows, token % WITHIN] -= 1
        y *= n
        for c, a, b in _runs(kind):
            np.matmul(h[a:b].T, y[a:b], out=g.word[c])
            np.sum(y[a:b], axis=0, out=g.word_bias[c])
            dh[a:b] += y[a:b] @ self.word[c].T
        dh *= 1 - h * h
        g.bend[:] = dh.sum(axis=0)
        # all sides at once: a neighbour's number goes on from side to side; 16 bits are sorted by radix
        near = np.concatenate([line[at + o] + k * (VOCABULARY + 1) for k, o in enumerate(OFFSETS)]).astype(np.uint16)
        order = np.argsort(near, kind="stable")
        near = near[order]
        begin = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
        g.side.reshape(-1, WIDTH)[near[begin]] = np.add.reduceat(dh.take(order % len(at), axis=0), begin)
        return g


def _by_class(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their tokens' classes: the order, and with it the places, tokens and classes."""
    token = line[at]
    order = np.argsort((token // WITHIN).astype(np.uint8), kind="stable")
    token = token[order]
    return order, at[order], token, token // WITHIN


def _runs(kind: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class, begin, end) of each class in a sorted array."""
    edge = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    return ((c, a, b) for c, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b)


def _logsum(x: np.ndarray, small: bool) -> np.ndarray:
    """Logarithm of the sum of a row's exponentials; x is used up."""
    top = 0.0 if small else x.max(axis=1)
    if not small:
        x -= top[:, None]
    return top + np.log(np.exp(x, out=x) @ np.ones(x.shape[1], dtype=x.dtype))


def _shares(x: np.ndarray, small: bool) -> np.ndarray:
    if not small:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]
    return x


def _chosen(batch: Batch, keys: list, turn: int, rounds: int) -> np.ndarray:
    """The training places of a round: its part of all, by the document's key and the place in it."""
    with np.errstate(over="ignore"):
        seeds = np.array([xxhash.xxh64_intdigest(str(k)) for k in keys], dtype=np.uint64)
        inside = np.arange(len(batch.at)) - np.repeat(np.cumsum(batch.size) - batch.size, batch.size)
        h = mixed(mixed(np.repeat(seeds, batch.size) + MIX[0]) + inside.astype(np.uint64) * MIX[1])
    return batch.at[h % np.uint64(rounds) == turn]


def trained_once(docs: DataFrame, known: dict[bytes, int], net: np.ndarray, turn: int, rounds: int, rate: float = RATE, step: int = STEP) -> np.ndarray:
    """Weights after one of ``rounds``: every task trains from ``net``, then weights are averaged by places.

    The averaged pieces, as many as the network has, are all that the driver receives.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, net))  # VOCABULARY words, Network.SIZE weights

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = sent.value
        mine, places = Network(weights.copy()), 0
        tokens, seen = Tokens(words), np.full(Network.SIZE, SEEN, dtype=np.float32)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                hashes, size, *form = text_words(piece.column("text"))
                line = Batch.of(tokens.of(hashes, *form), size)
                at = _chosen(line, piece.column("doc_id").to_pylist(), turn, rounds)
                for b in range(0, len(at), step):
                    g = mine.gradient(line.line, at[b : b + step]).weights
                    seen += g * g
                    mine.weights -= np.float32(rate) * g / np.sqrt(seen)
                places += len(at)
        if places:
            total = mine.weights.astype(np.float64) * places
            cuts = range(0, Network.SIZE, PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(cuts)), pa.int64()), pa.array([total[c : c + PIECE].astype(np.float32).tobytes() for c in cuts], pa.binary()), pa.array([places] * len(cuts), pa.int64())], names=["piece", "total", "places"]
            )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}  # no more than the network's pieces
        for batch in batches:
            for piece, total, places in zip(*(batch.column(c).to_pylist() for c in ("piece", "total", "places")), strict=True):
                x, n = sums.get(piece, (0.0, 0))
                sums[piece] = x + np.frombuffer(total, dtype=np.float32).astype(np.float64), n + places
        if sums:
            means = [(x / n).astype(np.float32).tobytes() for x, n in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(means, pa.binary())], names=["piece", "mean"])

    parts = docs.select("doc_id", "text").mapInArrow(train, "piece long, total binary, places long")
    found = {r["piece"]: r["mean"] for r in parts.repartition("piece").mapInArrow(average, "piece long, mean binary").collect()}
    return np.concatenate([np.frombuffer(found[i], dtype=np.float32) for i in range(len(found))]) if found else net


def shared_counts(counts: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """Occurrences of the words of each shared token, from (word, n) and the words that have their own."""
    n = np.zeros(SHARED)
    sizes = counts.groupBy(F.least(F.octet_length("word"), F.lit(15)).alias("size"), F.expr("conv(hex(substring(word, 1, 1)), 16, 10) % 4").cast("int").alias("first")).agg(F.sum("n").alias("n"))
    for r in sizes.collect():  # SHARED rows
        n[r["size"] * 4 + r["first"]] = r["n"]
    if known:
        own = counts.sparkSession.createDataFrame([(bytearray(w),) for w in known], "word binary")
        for r in counts.join(own, "word").collect():  # no more rows than known words
            n[shared_token(bytes(r["word"])) - VOCABULARY + SHARED] -= r["n"]
    return n


def fit(docs: DataFrame, rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary and the network's weights from all documents of (doc_id, text) and their counted words."""
    counts = written(count_words(docs), "word-counts") if counts is None else counts
    own = VOCABULARY - SHARED
    top = counts.orderBy(F.col("n").desc(), "word").limit(own).collect()
    known = {bytes(r["word"]): i for i, r in enumerate(top)}
    n = np.zeros(VOCABULARY)
    n[: len(top)] = [r["n"] for r in top]
    n[own:] = shared_counts(counts, known)
    weights = Network.start(n).weights
    for turn in range(rounds):
        weights = trained_once(docs, known, weights, turn, rounds)
    return known, weights


def _spelt(size: np.ndarray) -> np.ndarray:
    """Log probability of a word of so many bytes that was never counted: any byte, and any length from 15."""
    return -np.log(2.0) * (8 * size + np.maximum(size - 14, 0))


def _dealt(hashes: np.ndarray, groups: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(group, hashes, columns) as bytes, for each group of hashes that has any."""
    group = (hashes >> np.uint64(32)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    found, begin = np.unique(group[order], return_index=True)
    edge = [*begin.tolist(), len(order)]
    parts = [x[order] for x in (hashes, *columns)]
    for g, a, b in zip(found.tolist(), edge, edge[1:], strict=False):
        yield (g, *(x[a:b].tobytes() for x in parts))


def _gains(counts: DataFrame, known: dict[bytes, int], groups: int) -> DataFrame:
    """By group, hashes of the words that share a token, and the log of each one's count over the chance of its spelling."""
    sent = counts.sparkSession.sparkContext.broadcast(known)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, n = sent.value, [], []

        def out():
            gain = np.log(np.array(n, dtype=np.float64)) - _spelt(np.array([len(w) for w in words]))
            rows = list(_dealt(text_hashes(pa.array(words, pa.large_binary()))[0], groups, gain))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["group", "hashes", "gains"])

        for batch in batches:
            for w, k in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if w not in own:
                    words.append(w), n.append(k)
            if len(words) > HELD:
                yield out()
                words.clear(), n.clear()
        if words:
            yield out()

    return counts.select("word", "n").mapInArrow(gains, "group long, hashes binary, gains binary")


def _looked_up(found: pa.Table, gains: pa.Table) -> pa.Table:
    """The scores that came along, and by row what the words' counts add to them."""

    def joined(table: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)

    rows, ids, sizes, logs = [], [], [], []
    scores = found.filter(found.column("hashes").is_null())
    for base, doc, n, total in zip(*(scores.column(c).to_pylist() for c in ("base", "doc_id", "n_tokens", "log_likelihood")), strict=True):
        rows += range(base, base + len(doc))
        ids += doc
        sizes += n
        logs += total
    words = found.filter(found.column("hashes").is_valid())
    key, gain, h = joined(gains, "hashes", np.uint64), joined(gains, "gains", np.float64), joined(words, "hashes", np.uint64)
    added, total = np.zeros(0, dtype=np.int64), np.zeros(0)
    if len(key) and len(h):
        order = np.argsort(key)
        key, gain = key[order], gain[order]
        base = np.repeat(words.column("base").to_numpy(), [len(x) // 8 for x in words.column("hashes").to_pylist()])
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        added, row = np.unique(base + joined(words, "rows", np.int32), return_inverse=True)
        total = np.bincount(row, np.where(key[at] == h, gain[at], 0.0))
    blank = [None] * len(added)
    return pa.table([pa.array(c, t) for c, t in ((rows + added.tolist(), pa.int64()), (ids + blank, pa.int64()), (sizes + blank, pa.int64()), (logs + total.tolist(), pa.float64()))], names=["row", "doc_id", "n_tokens", "log_likelihood"])


def scored(docs: DataFrame, known: dict[bytes, int], weights: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every whole text.

    Tokens are words between white space, A-Z in lower case. A word without a token of its
    own has the probability of its shared token times its share of that token's words in
    ``counts`` (word, n), by default those of docs; words not counted have one count in
    all, dealt out by their bytes. A text that is null or without a word has no tokens, a
    sum of 0 and no mean. Every row is scored by itself; other columns are not read.
    """
    counts = written(count_words(docs), "word-counts") if counts is None else counts
    shared = shared_counts(counts, known)
    groups = max(GROUPS, int(shared.sum()) // GROUP)
    sent = docs.sparkSession.sparkContext.broadcast((known, weights, np.log(shared + 1)))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
    names = ["group", "base", "hashes", "rows", "doc_id", "n_tokens", "log_likelihood"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, net, among = Tokens(sent.value[0]), Network(sent.value[1].copy()), sent.value[2]
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                hashes, size, length, first = text_words(piece.column("text"))
                line = Batch.of(tokens.of(hashes, length, first), size)
                logs = net.logs(line.line, line.at)
                owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
                kind = line.line[line.at] - (VOCABULARY - SHARED)
                bare = kind >= 0
                logs[bare] += _spelt(length[bare]) - among[kind[bare]]
                total = np.bincount(owner, logs, minlength=len(size))
                out = [(base % groups, base, None, None, piece.column("doc_id").to_pylist(), size, total)]
                out += [(g, base, h, r, None, None, None) for g, h, r in _dealt(hashes[bare], groups, owner[bare])]
                base += len(size)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    found = docs.select("doc_id", "text").mapInArrow(score, "group long, base long, hashes binary, rows binary, doc_id array<long>, n_tokens array<long>, log_likelihood array<double>")
    met = found.groupBy("group").cogroup(_gains(counts, known, groups).groupBy("group")).applyInArrow(_looked_up, "row long, doc_id long, n_tokens long, log_likelihood double")
    rows = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_likelihood").alias("log_likelihood")).drop("row")
    return rows.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    counts = written(count_words(docs), "word-counts")
    return scored(docs, *fit(docs, counts=counts), counts=counts)
