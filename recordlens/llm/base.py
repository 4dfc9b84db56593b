"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z over UTF-8 bytes; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers that mix 64-bit hashes.
MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what this worker has freed to the system, so that it holds little while another stage runs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``most`` bytes of text each, but one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


_LETTER = np.frombuffer(LOWER, dtype=np.uint8)
#: A fixed random 64-bit value for every byte of a word; white space has none.
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[[32, *range(9, 14)]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose words are hashed at once.
AT_ONCE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * MIX[1]
    h ^= h >> np.uint64(29)
    h *= MIX[4]
    return h ^ (h >> np.uint64(32))


def _some_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of some bytes; ``first`` marks bytes at which a text begins."""
    value = _VALUE[_LETTER[data]]
    inside = value != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at
    lead = int(at[0])  # bytes before the first word have no value
    place = np.zeros(len(data), dtype=np.int64)
    place[lead:] = np.arange(len(data) - lead) - np.repeat(at - lead, np.diff(at, append=len(data)))
    power = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    return mixed(np.add.reduceat(value * power[place], at)), at


def text_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts in order, A-Z in lower case, and the number of words of each text.

    Words are what stands between ASCII white space. A hash is the sum of a value per byte
    times a power of an odd base for its place in the word, so no word is looked up or kept.
    """
    return _found_words(texts)[:2]


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text_hashes``, and of each word its length in bytes and its first byte, A-Z in lower case."""
    hashes, counts, data, first, at = _found_words(texts)
    inside = _VALUE[data] != 0
    end = np.flatnonzero(inside & np.append(~inside[1:] | first[1:-1], True)[: len(inside)])
    return hashes, counts, end + 1 - at, _LETTER[data[at]].astype(np.int64)


def _found_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, words of each text, all bytes, at which of them a text begins, and where words begin."""
    none = np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.uint8), np.ones(1, dtype=bool), np.zeros(0, dtype=np.int64)
    if not len(texts):
        return none
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    low, high = int(ends[0]), int(ends[-1])
    if low == high:
        return none
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8, count=high)[low:]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[ends[:-1] - low] = True
    hashes, places, begin = [], [], 0
    with np.errstate(over="ignore"):
        while begin < len(data):
            end = min(begin + AT_ONCE, len(data))
            if end < len(data):  # go on to the next place where no word is cut
                step = 1 << 12
                while end < len(data):
                    gap = np.flatnonzero((_VALUE[data[end : end + step]] == 0) | first[end : end + step][: len(data) - end])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end = min(end + step, len(data))
            h, at = _some_words(data[begin:end], first[begin:end])
            hashes.append(h)
            places.append(at + begin)
            begin = end
    places = np.concatenate(places)
    return np.concatenate(hashes), np.diff(np.searchsorted(places, ends - low)), data, first, places


def shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles.

    With fewer words the whole sequence is one shingle; no words, or no text, give none.
    Word hashes are combined by distinct multipliers, so order counts.
    """
    h, counts = text_hashes(texts)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        windows = np.full(max(len(h) - size + 1, 0), size, dtype=np.uint64)
        for i in range(size):
            windows += mixed(h[i : i + len(windows)] + MIX[i % 5] * np.uint64(i + 1))
        windows = mixed(windows)
        begin = 0
        for n in counts.tolist():
            if n >= size:
                found = np.sort(windows[begin : begin + n - size + 1])
                new = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=new[1:])
                out.append(found[new])
            elif n:
                whole = np.uint64(n)
                for i in range(n):
                    whole += mixed(h[begin + i : begin + i + 1] + MIX[i % 5] * np.uint64(i + 1))[0]
                out.append(mixed(np.array([whole])))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            begin += n
    return out
