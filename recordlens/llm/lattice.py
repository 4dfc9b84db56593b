"""Words as lattices over a fixed vocabulary of pieces, many words at a time.

``edges`` finds every vocabulary piece inside every word by rolling hashes; ``word_logs``
sums the products of piece probabilities over all segmentations of whole words, for several
models at once. A character without a piece is an unknown piece of its own, so each word
has at least one segmentation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters of the words (as many as the longest one's, for each) that are looked at together.
CELLS = 100_000
#: Characters of a word whose pieces are looked up at once; the sums go on across them.
BLOCK = 4096
#: What a word begins with.
MARK = "\u2581"


class Pieces:
    """A vocabulary of pieces, found by the hash of their characters."""

    def __init__(self, pieces: list[str], longest: int):
        pieces = sorted({p for p in pieces if 0 < len(p) <= longest})
        self.pieces, self.longest, self.unknown = pieces, longest, len(pieces)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(longest, _BASE))])
            hashes = np.zeros(len(pieces), dtype=np.uint64)
            for i, p in enumerate(pieces):
                h = np.uint64(0)
                for c in p:
                    h = h * _BASE + np.uint64(ord(c) + 1)
                hashes[i] = h
        # An open table, loaded to an eighth at most; a probe goes on until an empty place.
        self.bits = max(10, (8 * len(pieces) + 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        for i, (h, at) in enumerate(zip(hashes, self.places(hashes).tolist(), strict=True)):
            while self.values[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = h, i
        self.used = self.values >= 0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for none."""
        flat = hashes.ravel()
        at = self.places(flat)
        out = np.full(len(flat), -1, dtype=np.int32)
        going = np.flatnonzero(self.used[at])
        at = at[going]
        while len(going):
            hit = self.keys[at] == flat[going]
            out[going[hit]] = self.values[at[hit]]
            going, at = going[~hit], (at[~hit] + 1) & ((1 << self.bits) - 1)
            more = self.used[at]
            going, at = going[more], at[more]
        return out.reshape(hashes.shape)

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for each piece length k the piece number at (word, start), -1 for none."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(size.max(initial=0))
        even = bool(len(size)) and int(size.min()) == width
        flat = np.frombuffer("".join(words if even else [w.ljust(width, "\0") for w in words]).encode("utf-32-le"), dtype="<u4").reshape(len(words), width)
        found = []
        with np.errstate(over="ignore"):
            h = np.zeros((len(words), width + 1), dtype=np.uint64)
            for t in range(width):
                h[:, t + 1] = h[:, t] * _BASE + flat[:, t] + np.uint64(1)
            for k in range(1, min(self.longest, width) + 1):
                sub = h[:, k:] - h[:, :-k] * self.powers[k]
                ids = self.numbers(sub)
                if k == 1:
                    ids[ids < 0] = self.unknown
                if not even:
                    ids[np.arange(width - k + 1)[None, :] + k > size[:, None]] = -1
                found.append(ids)
        return size, found


def with_ends(p: np.ndarray) -> np.ndarray:
    """(pieces + unknown, models) probabilities with a closing row of zeros, met at number -1."""
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def forward(size: np.ndarray, found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """alpha[word, position]: the mass of all segmentations up to a position, under one model."""
    width = int(size.max(initial=0))
    alpha = np.zeros((len(size), width + 1))
    alpha[:, 0] = 1.0
    for t in range(1, width + 1):
        for k in range(1, min(len(found), t) + 1):
            alpha[:, t] += alpha[:, t - k] * p[found[k - 1][:, t - k], 0]
    return alpha


def together(words: list[str], cells: int = CELLS) -> Iterator[list[int]]:
    """Numbers of words by length, in batches of at most ``cells`` characters or one word."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    batch: list[int] = []
    for i in order:
        if batch and (len(batch) + 1) * len(words[i]) > cells:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def word_logs(pieces: Pieces, words: list[str], p: np.ndarray, cells: int = CELLS, block: int = BLOCK) -> np.ndarray:
    """Log probability of every word under every model, all segmentations summed.

    Words of any length are taken whole. The sums of the last positions, as many as the
    longest piece has characters, are all that is held; they are scaled as they get small.
    """
    out = np.zeros((len(words), p.shape[1]))
    reach = pieces.longest
    for mine in together(words, cells):
        size = np.array([len(words[i]) for i in mine])
        scale = np.zeros((len(mine), p.shape[1]))
        last = [np.ones_like(scale)]  # the sums at t - 1, t - 2, ...
        for begin in range(0, int(size[-1]), block):
            lead = max(0, begin - reach + 1)
            _, found = pieces.edges([words[i][lead : begin + block] for i in mine])
            for t in range(begin + 1, min(begin + block, int(size[-1])) + 1):
                now = np.zeros_like(scale)
                for k in range(1, min(len(found), len(last)) + 1):
                    ids = found[k - 1][:, t - lead - k] if t - lead - k < found[k - 1].shape[1] else None
                    if ids is None:
                        continue
                    if k < 3:
                        now += last[k - 1] * p[ids]
                    elif len(some := np.flatnonzero(ids >= 0)):
                        now[some] += last[k - 1][some] * p[ids[some]]
                ended = slice(*np.searchsorted(size, [t, t + 1]))
                out[mine[ended.start : ended.stop]] = np.log(np.maximum(now[ended], 1e-300)) + scale[ended]
                last = [now, *last[: reach - 1]]
                if t % reach == 0:
                    most = np.maximum.reduce(last)
                    most[most <= 0] = 1.0
                    last = [x / most for x in last]
                    scale += np.log(most)
    return out


def fitted(pieces: Pieces, words: list[str], weight: np.ndarray, rounds: int = 4, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities of one model by expectation-maximisation over counted words."""
    n = len(pieces.pieces) + 1
    p = np.full((n, 1), 1.0 / n)
    for _ in range(rounds):
        expected = np.zeros(n + 1)
        q = with_ends(p)
        for mine in together(words):
            size, found = pieces.edges([words[i] for i in mine])
            alpha = forward(size, found, q)
            width = alpha.shape[1] - 1
            beta = np.zeros_like(alpha)
            beta[np.arange(len(mine)), size] = 1.0
            for t in range(width - 1, -1, -1):
                for k in range(1, min(len(found), width - t) + 1):
                    beta[:, t] += q[found[k - 1][:, t], 0] * beta[:, t + k]
            share = weight[mine] / np.maximum(alpha[np.arange(len(mine)), size], 1e-300)
            for k, ids in enumerate(found, 1):
                mass = alpha[:, : width + 1 - k] * q[ids, 0] * beta[:, k:] * share[:, None]
                expected += np.bincount(np.where(ids < 0, n, ids).ravel(), mass.ravel(), minlength=n + 1)
        p = ((expected[:n] + smooth) / (expected[:n].sum() + smooth * n))[:, None]
    return p
