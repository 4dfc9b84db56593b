"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice has every cut into vocabulary pieces; a segmentation's probability is
proportional to the product of its pieces' weights. The k segmentations with the greatest
Gumbel-perturbed log probabilities are a sample of k without replacement. They are found
best first over the tree of prefixes: the text's own perturbed maximum is drawn, the best
segmentation under it by walking the lattice, and every place where another piece could
have followed gives one sealed group of siblings whose maximum is drawn below that of its
parent. The group with the greatest maximum is opened next. Its value after the k-th
segmentation is the threshold of the inclusion probabilities.

No piece of the vocabulary goes on from a letter into a space mark, and none holds a line
feed, so a text's lattice is the chain of its words' lattices: these are built once per
distinct word, with backward sums over all segmentations, remembered in bounded memory, and
walked for many occurrences and all samples at once. Draws are seeded by the row's key and text alone.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import MIX, mixed, slices, table
from recordlens.llm.lattice import Pieces

VOCABULARY = "piece_bpe_32k.model"
#: Segmentations per text, and the sharpness of piece weights (powers of one over the rank).
SAMPLES, SHARPNESS = 4, 1.0
#: Words up to this length are summed as products, longer ones as logarithms.
SHORT = 16
#: What a draw is a multiple of.
DRAW = 2.0**-24
#: Characters of words of one length whose lattices are built at once (or one word's).
CELLS = 1 << 15
#: Edges of lattices a worker remembers, about; beyond it only words met again stay for the next texts.
REMEMBERED = 4_000_000
#: Occurrences of words walked at once.
TOGETHER = 1 << 13
MARK = "▁"
_UNITS = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
SAMPLE = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long"


class Vocabulary:
    """Pieces with log weights: minus the sharpness times the log of the rank in the vocabulary."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        number = {m.id_to_piece(i): i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.pieces = Pieces(list(number), max(map(len, number)))
        self.ids = np.array([number[p] for p in self.pieces.pieces] + [-1])
        # by piece number; then the unknown piece, and none at number -1
        self.ids = np.append(self.ids, -1)
        self.byte_log = -sharpness * np.log(n)
        size = np.array([len(p.encode()) for p in self.pieces.pieces])
        self.logs = np.append(-sharpness * np.log1p(self.ids[:-2]), [0.0, -np.inf])
        self.scaled = np.append(np.exp(self.logs[:-2] - self.byte_log * size), [1.0, 0.0])
        self.lattices = Lattices(self)


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Speller:
    """The library's decoding, from a table of each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.odd = np.array([m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(m.get_piece_size())])
        spelt = [bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(len(self.odd))]
        self.marked = np.array([not m.is_byte(i) and m.id_to_piece(i)[:1] == MARK for i in range(len(self.odd))])
        self.spelt = np.array([None if odd else x for odd, x in zip(self.odd.tolist(), spelt, strict=True)], dtype=object)

    def text(self, ids: np.ndarray) -> str:
        """One text; ids that are not pieces or bytes, and bytes that are no UTF-8, go to the library."""
        if not len(ids):
            return ""
        if ids.min() >= 0 and ids.max() < len(self.spelt):
            try:
                return b"".join(self.spelt.take(ids).tolist())[int(self.marked[ids[0]]) :].decode()
            except (TypeError, UnicodeDecodeError):  # an id without bytes of its own, or bytes cut
                pass
        return self.model.decode(ids.tolist())


@lru_cache(maxsize=2)
def speller(path: str) -> Speller:
    return Speller(path)


def units(text: str) -> list[str]:
    """The words of a text as the model sees it: a mark first, marks for spaces."""
    if text[:1] != " " and "  " not in text and MARK not in text:
        return list(filter(None, (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")))
    return _UNITS.findall(MARK + text.replace(" ", MARK))


class Lattices:
    """Lattices of the words seen so far, as one run of edges ordered by the place they leave.

    Places are numbered word after word, a word's last place meeting the next word's first.
    An edge is kept with its place's number plus the chance of all edges up to it, so a
    draw at any place of any word is one search in one ascending array.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        #: in how many calls each word occurred
        self.met = np.zeros(0, dtype=np.int64)
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.places = 0
        #: of each edge: where a draw ends on it, id (a character without a piece below zero), characters, log chance
        self.reach, self.id = np.zeros(0), np.zeros(0, dtype=np.int32)
        self.step, self.log = np.zeros(0, dtype=np.uint8), np.zeros(0)
        #: the first edge of each place, and the end
        self.out = np.zeros(1, dtype=np.int64)

    def forget(self, most: int) -> None:
        """Keep the words that occurred in more than one call, unless they have more than ``most`` edges."""
        words = np.flatnonzero(self.met > 1)
        words = words[np.argsort(self.first[words])]
        old, size = self.first[words], self.size[words]
        low = self.out[old]
        edges = self.out[old + size] - low
        names, number = list(self.number), int(edges.sum())
        if number > most:
            return self.clear()
        at = np.arange(number) + np.repeat(low - np.cumsum(edges) + edges, edges)
        new = np.cumsum(size) - size
        steps = np.arange(int(size.sum())) + np.repeat(old - new, size)
        self.out = np.append(0, np.cumsum(self.out[steps + 1] - self.out[steps]))
        self.reach = self.reach[at] - np.repeat(old - new, edges)  # whole numbers: nothing is rounded
        self.id, self.step, self.log = self.id[at], self.step[at], self.log[at]
        self.number = {names[w]: i for i, w in enumerate(words.tolist())}
        self.first, self.size, self.places = new, size, int(size.sum())
        self.met = np.zeros(len(words), dtype=np.int64)

    def add(self, words: list[str]) -> None:
        """Build the lattices of words that are new."""
        if not words:
            return
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        first = np.zeros(len(words), dtype=np.int64)
        reach, ids, step, log = [self.reach], [self.id], [self.step], [self.log]
        begin = 0
        while begin < len(order):
            n = int(size[order[begin]])
            mine = order[begin : min(int(np.searchsorted(size[order], n, side="right")), begin + max(1, CELLS // n))]
            chance, found, code = self._chances([words[i] for i in mine])
            edge = np.flatnonzero(chance)
            place, j = np.divmod(edge, chance.shape[2])
            total = chance.cumsum(axis=2)
            total /= total[:, :, -1:]  # the last edge of a place ends at one
            # in steps of a draw, so that the place's number doesn't round it
            reach.append(self.places + place + np.ceil(total.ravel()[edge] / DRAW) * DRAW)
            known = self.v.ids[found.ravel()[edge]]
            ids.append(np.where(known < 0, code.ravel()[place], known).astype(np.int32))
            step.append((j + 1).astype(np.uint8))
            log.append(np.log(chance.ravel()[edge]))
            first[mine] = self.places + np.arange(len(mine)) * n
            self.places += len(mine) * n
            begin += len(mine)
        self.first, self.size = np.append(self.first, first), np.append(self.size, size)
        self.met = np.append(self.met, np.zeros(len(words), dtype=np.int64))
        self.reach, self.id, self.step, self.log = map(np.concatenate, (reach, ids, step, log))
        known = len(self.out) - 1
        self.out = np.append(self.out[:known], self.reach.searchsorted(np.arange(known, self.places + 1), side="right"))

    def _chances(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of one length: at each place the chance of each next piece, given what may follow, its number, and
        the id of a character that has no piece: its byte's, or minus its code point until the end."""
        v = self.v
        size, found = v.pieces.edges(words)
        n, k = int(size[0]), len(found)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(np.int64)
        # Weights are scaled by the byte, so that short words neither overflow nor vanish; long words go by logarithms.
        short = n <= SHORT
        table = v.scaled if short else v.logs
        weight = np.full((len(words), n, k), 0.0 if short else -np.inf)
        piece = np.full((len(words), n, k), -1, dtype=np.int32)
        for j, ids in enumerate(found):
            weight[:, : n - j, j] = table[ids]
            piece[:, : n - j, j] = ids
        alone = found[0] == v.pieces.unknown
        if alone.any():
            wide = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            weight[:, :, 0] = np.where(alone, 1.0 if short else v.byte_log * wide, weight[:, :, 0])
        beta = np.full((len(words), n + k), 0.0 if short else -np.inf)  # beyond the end nothing follows
        beta[:, n] = 1.0 if short else 0.0
        for t in range(n - 1, -1, -1):
            if short:
                x = weight[:, t] * beta[:, t + 1 : t + 1 + k]
                beta[:, t] = x.sum(axis=1)
                weight[:, t] = x / beta[:, t : t + 1]
            else:
                x = weight[:, t] + beta[:, t + 1 : t + 1 + k]
                top = x.max(axis=1)
                beta[:, t] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
                weight[:, t] = np.exp(x - beta[:, t : t + 1])
        return weight, piece, np.where(chars < 0x80, v.bytes[np.minimum(chars, 0x7F)], -chars)

    def walk(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """A segmentation of each given word: log probability, pieces, and (who, ids) by step.

        Words should come in the order of their places: only edges between the first and the last are searched.
        """
        node = self.first[word]
        end = node + self.size[word]
        low, high = self.out[[node.min(), end.max()]]
        reach, ids, steps, logs = (x[low:high] for x in (self.reach, self.id, self.step, self.log))
        log, count, trace, going = np.zeros(len(word)), np.zeros(len(word), dtype=np.int64), [], np.arange(len(word))
        while len(going):
            with np.errstate(over="ignore"):
                u = (mixed(seed + MIX[4] * np.uint64(len(trace) + 1)) >> np.uint64(40)) * DRAW
            edge = reach.searchsorted(node + u, side="right")
            log[going] += logs[edge]
            trace.append((going, ids[edge]))
            node = node + steps[edge]
            alive = node < end
            if not alive.all():
                count[going[~alive]] = len(trace)
                going, node, end, seed = going[alive], node[alive], end[alive], seed[alive]
        return log, count, trace

    def edges(self, node: int) -> list[tuple[int, int, float]]:
        """(id, characters, chance) of the edges that leave a place."""
        of = slice(self.out[node], self.out[node + 1])
        return list(zip(self.id[of].tolist(), self.step[of].tolist(), map(math.exp, self.log[of].tolist()), strict=True))

    def other(self, word: int, taken: list[tuple], rng: random.Random) -> tuple[float, list[int]]:
        """A segmentation of a word drawn from all but those taken (given as ids)."""
        node = int(self.first[word])
        end, known = node + int(self.size[word]), {}
        live = []  # of each taken one, by place: its next id, and the chance of going on as it does
        for way in taken:
            at, steps = node, []
            for x in way:
                if at not in known:
                    known[at] = self.edges(at)
                size, chance = next((n, c) for i, n, c in known[at] if i == x)
                steps.append((at, x, chance))
                at += size
            rest, follow = {}, 1.0
            for at, x, chance in reversed(steps):
                follow *= chance
                rest[at] = (x, follow)
            live.append(rest)
        total, ids = 0.0, []
        while node < end:
            if node not in known:
                known[node] = self.edges(node)
            less: dict[int, float] = {}
            for rest in live:
                x, chance = rest[node]
                less[x] = less.get(x, 0.0) + chance
            free = [c - less.get(i, 0.0) for i, _, c in known[node]]
            free = [c if c >= 1e-14 else 0.0 for c in free]
            left, j = rng.random() * sum(free), 0
            while j < len(free) - 1 and left >= free[j]:
                left -= free[j]
                j += 1
            i, size, chance = known[node][j]
            live = [rest for rest in live if rest[node][0] == i]
            total += math.log(chance)
            ids.append(i)
            node += size
        return total, ids


def _highest(mass: float, bound: float, rng: random.Random) -> float:
    """The maximum of Gumbel variables of this total mass, drawn below a bound."""
    x, y = -bound, math.log(rng.expovariate(1.0) or 1e-300) - math.log(mass)
    return -(max(x, y) + math.log1p(math.exp(-abs(x - y))))


def sampled(texts: list[str], seeds: list[int], v: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` (ids, log_prob, perturbed, inclusion), in order of perturbed."""
    lattices = v.lattices
    if len(lattices.id) > REMEMBERED:
        lattices.forget(REMEMBERED // 2)
    split = [units(t) for t in texts]
    number = lattices.number
    lattices.add(list(set(chain.from_iterable(split)).difference(number)))
    begin = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(begin[-1]))
    m = len(flat)
    lattices.met += np.bincount(flat, minlength=len(lattices.met)) > 0
    with np.errstate(over="ignore"):
        row = np.repeat(np.arange(len(texts)), np.diff(begin))
        seed = mixed(np.array(seeds, dtype=np.uint64)[row] + MIX[0] * (np.arange(m) - begin[row]).astype(np.uint64))
    # One draw of every occurrence per sample. Occurrences of a word are walked together, sample by
    # sample in a row, some thousands at a time, so that what is looked up lies close together.
    order = np.argsort(lattices.first[flat], kind="stable")
    log, count, traces = np.zeros(k * m), np.zeros(k * m, dtype=np.int64), []
    sample = np.arange(k)
    with np.errstate(over="ignore"):
        shift = MIX[sample % len(MIX)]
        for at in range(0, m, TOGETHER):
            mine = order[at : at + TOGETHER]
            where = (mine[:, None] + sample * m).ravel()
            drawn = (mixed(seed[mine][:, None] ^ shift) + sample.astype(np.uint64)).ravel()
            log[where], count[where], trace = lattices.walk(np.repeat(flat[mine], k), drawn)
            traces += [(where[who], step, ids) for step, (who, ids) in enumerate(trace)]
    start = np.concatenate([[0], np.cumsum(count)])
    ids = np.zeros(int(start[-1]), dtype=np.int32)
    for who, step, x in traces:
        ids[start[who] + step] = x
    draws = [(log[s * m : (s + 1) * m], start[s * m : (s + 1) * m + 1], ids) for s in range(k)]
    return [_best(draws, int(begin[i]), int(begin[i + 1]), lattices, flat, seeds[i], k) for i in range(len(texts))]


class _Path:
    """One segmentation of a text: log probabilities and ids by word."""

    def __init__(self, log: np.ndarray, start: np.ndarray, ids: np.ndarray):
        self.log, self.start, self.ids = log, start, ids
        #: log probability of the path up to the end of each word
        self.upto = log.cumsum()

    def before(self, word: int) -> float:
        """Probability of the path before a word."""
        return math.exp(self.upto[word - 1]) if word else 1.0

    def way(self, word: int) -> tuple:
        return tuple(self.ids[self.start[word] : self.start[word + 1]].tolist())

    def left_at(self, a: int, b: int, share: float) -> int:
        """The first word of a to b - 1 by whose end a share of what is lost between them is lost."""
        y = self.before(a) - share * (self.before(a) - self.before(b))
        if y <= 0:
            return b - 1
        return min(a + int((-self.upto[a:b]).searchsorted(-math.log(y))), b - 1)


def _best(draws, lo, hi, lattices, flat, seed, k):
    """The tree of prefixes of one text, opened best first.

    Sealed groups: segmentations that leave a path at one of its words a to b - 1 (mass
    before a less mass before b), or at one word by none of the ways taken there.
    """
    rng = random.Random(seed)
    n, done, sealed = hi - lo, [], []
    bound, old, at, taken = -math.log(rng.expovariate(1.0) or 1e-300), None, 0, {}

    def seal(path: _Path, a: int, b: int, ways: dict | None = None) -> None:
        whole = path.before(a)
        mass = whole - path.before(b) if ways is None else whole * (1.0 - math.fsum(map(math.exp, ways.values())))
        if whole > 0 and mass > 1e-12 * whole:
            sealed.append((_highest(mass, bound, rng), path, a, b, ways))

    for s in range(k):
        log, start, ids = draws[s]
        if old is None:
            path = _Path(log[lo:hi], start[lo : hi + 1] - start[lo], ids[start[lo] : start[hi]])
            seal(path, 0, n)
        else:
            lg, x = lattices.other(int(flat[lo + at]), list(taken), rng)
            head, next_ = old.start[at], start[lo + at + 1]
            path = _Path(
                np.concatenate([old.log[:at], [lg], log[lo + at + 1 : hi]]),
                np.concatenate([old.start[: at + 1], start[lo + at + 1 : hi + 1] + (head + len(x) - next_)]),
                np.concatenate([old.ids[:head], np.array(x, dtype=np.int32), ids[next_ : start[hi]]]),
            )
            seal(old, at, at + 1, {**taken, tuple(x): lg})
            seal(path, at + 1, n)
        done.append((path.ids, float(path.upto[-1]), bound))
        if not sealed:
            return [(x, lp, g, 1.0) for x, lp, g in done]
        pick = max(range(len(sealed)), key=lambda i: sealed[i][0])
        if s < k - 1:
            bound, old, a, b, ways = sealed.pop(pick)
            if ways is None:  # where the path is left, by mass; the rest of the group stays sealed
                at = old.left_at(a, b, 1.0 - rng.random())
                taken = {old.way(at): float(old.log[at])}
                seal(old, a, at)
                seal(old, at + 1, b)
            else:
                at, taken = a, ways
    limit = sealed[pick][0]  # the greatest value that was not taken
    return [(x, lp, g, -math.expm1(-math.exp(min(lp - limit, 50.0)))) for x, lp, g in done]


def _spelt(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """ids with characters that have no piece as their bytes."""
    if len(ids) and ids.min() < 0:
        return np.concatenate([v.bytes[list(chr(-x).encode())] if x < 0 else [x] for x in ids.tolist()])
    return ids


def segmentations(docs: DataFrame, k: int = SAMPLES, sharpness: float = SHARPNESS, path: str | None = None, with_ids: bool = True, batch_bytes: int = 1 << 20, with_decoding: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of every whole text of (doc_id, text).

    One row per sample: doc_id, sample (0 for the greatest perturbed value), n_pieces,
    log_prob, perturbed, inclusion (1 if the text has no more segmentations), ids_crc32
    and, on request, ids; and text_crc32 of the decoded ids, and round_trip: whether they
    decode to the text, as ``decoded`` does it. A null text gives no rows, an empty one the space mark alone.
    Repeated rows each have their samples, alike if key and text are. A space mark in a
    text is read as a space, as the library does. Other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, one = vocabulary(path, sharpness), speller(path)
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                texts, keys = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
                rows = []
                seeds = [xxhash.xxh64_intdigest(f"{key}\0{t}") for key, t in zip(keys, texts, strict=True)]
                for key, text, found in zip(keys, texts, sampled(texts, seeds, v, k), strict=True):
                    for s, (ids, log, value, inclusion) in enumerate(found):
                        ids = _spelt(ids, v).astype("<u4")
                        back = one.text(ids) if with_decoding else ""
                        rows.append((key, s, len(ids), log, value, inclusion, zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] * with_ids), *([zlib.crc32(back.encode()), back == text] * with_decoding)))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids + [pa.int64(), pa.bool_()] * with_decoding
                names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_crc32"] + ["ids"] * with_ids + ["text_crc32", "round_trip"] * with_decoding
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInArrow(sample, SAMPLE + ", ids array<int>" * with_ids + ", text_crc32 long, round_trip boolean" * with_decoding)


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with text: the library's decoding of ids (null for null ids)."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        one = speller(path)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        edge = np.concatenate([[0], np.cumsum(size)]).tolist()
        return pa.array([one.text(flat[a:b]) if valid else None for a, b, valid in zip(edge, edge[1:], column.is_valid().to_pylist(), strict=False)], pa.string())

    return rows.withColumn("text", decode(ids))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampled segmentations with their ids, the digest of their decoding, and whether it is the text."""
    return segmentations(table(spark, sf_dir, "documents"), with_decoding=True)
