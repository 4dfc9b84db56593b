"""Byte-level BPE by the tokenizers library, with words remembered between calls.

The vocabulary's pre-tokenizer never joins across a single white-space character that has
a non-space on both sides: a space belongs to the word after it, a line feed stands alone.
So such places are safe to cut, and the ids of a text are those of its words in turn. A
text whose white space is irregular (runs, tabs, at an end, other code points) is encoded
by the library in pieces cut at safe places only.

A new word is merged by tiktoken where the vocabulary file says that ids follow the order
of merges, as its ranks are then the same; a word that might hold a special token, and any
word of another vocabulary, goes through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Words remembered by a worker; beyond it the memory starts again.
REMEMBERED = 800_000


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a printable code point: itself, or the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def ranked(path: str):
    """The vocabulary as a tiktoken encoding, or None if ranks can't stand for its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {t.content for t in tokenizer(path).get_added_tokens_decoder().values()}
    if model.get("dropout") or any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    back = {chr(c): b for b, c in byte_letters().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = 1 << 16) -> list[str]:
    """The text cut before single spaces between words, at the first such place after each ``size`` characters."""
    out, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def units(text: str) -> list[str] | None:
    """The words of a text, a line feed kept before the word it precedes; None if its white space is irregular."""
    if " ".join(text.split()) != text.replace("\n", " "):
        return None
    return text.replace("\n", " \n").split(" ")


class WordMemory:
    """Values of words (their id bytes, say) for whole texts, computed once per word."""

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        self.tok, self.value, self.ranked = tokenizer(path), value, ranked(path)
        self.special = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.inner: dict[str, object] = {}  # "word" stands for " word"; "\nword" for itself
        self.first: dict[str, object] = {}

    def ids(self, unit: str) -> list[int]:
        if self.ranked and not any(x in unit for x in self.special):
            return self.ranked.encode_ordinary(unit)
        return self.tok.encode_batch_fast([unit], add_special_tokens=False)[0].ids

    def of(self, texts: list[str]) -> list[list]:
        """For each text the values of its units, in order."""
        if len(self.inner) + len(self.first) > REMEMBERED:
            self.inner.clear()
            self.first.clear()
        inner, first, value, out = self.inner, self.first, self.value, []
        for t in texts:
            words = units(t) if t else []
            if words is None:
                out.append([value(e.ids) for e in self.tok.encode_batch_fast(safe_pieces(t), add_special_tokens=False)])
                continue
            if not words:
                out.append([])
                continue
            found = list(map(inner.get, words))
            found[0] = first.get(words[0])
            if None in found:
                for i, v in enumerate(found):
                    if v is None:
                        w = words[i]
                        if not i:
                            found[0] = first[w] = value(self.ids(w))
                        elif (v := inner.get(w)) is None:
                            found[i] = inner[w] = value(self.ids(w if w[0] == "\n" else " " + w))
                        else:
                            found[i] = v
            out.append(found)
        return out


@lru_cache(maxsize=2)
def id_bytes(path: str) -> WordMemory:
    return WordMemory(path, lambda ids: np.asarray(ids, dtype="<u4").tobytes())
