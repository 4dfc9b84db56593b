"""Ids of the word-end BPE vocabulary, with runs of letters remembered between texts.

The vocabulary's normaliser composes, turns white space to spaces and lower-cases; its
pre-tokenizer then drops the spaces and cuts a text into runs of letters, single digits
and runs of other signs, each merged on its own. For texts of plain Latin letters and
common signs those steps are done here by one pattern, and each distinct run is merged
once, by the library's own model. Every other text, every text that might hold a special
token, and every other vocabulary goes through the library whole, cut at white space only.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from recordlens.llm.bytebpe import byte_letters, safe_pieces, tokenizer

#: What the pattern below needs of the vocabulary file.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose composing and lower-casing depend on nothing beside them.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡§«°»¿-ÖØ-öø-ÿŒœ–—‘-„•…€]*")
_LETTERS = "a-zß-öø-ÿœ"
_RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: Runs a worker remembers, and the longest of them; beyond the number the memory starts again.
REMEMBERED, LONGEST = 300_000, 48


class RunMemory:
    """The ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = [s["type"] for s in (said.get("normalizer") or {}).get("normalizers", [])]
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known = steps == NORMALIZER and cuts[0].get("pattern") == {"Regex": SPLIT} and not said["model"].get("dropout")
        self.special = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.letters = {b: chr(c) for b, c in byte_letters().items()}
        self.runs: dict[str, bytes] = {}

    def run(self, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.tok.model.tokenize(shown)], dtype="<u4").tobytes()
        if len(run) <= LONGEST:
            self.runs[run] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.known or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            pieces = self.tok.encode_batch_fast(safe_pieces(text), add_special_tokens=False) if text else []
            return b"".join(np.asarray(e.ids, dtype="<u4").tobytes() for e in pieces)
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        out = []
        for piece in safe_pieces(text):
            found = _RUN.findall(piece.lower())
            got = list(map(self.runs.get, found))
            if None in got:
                got = [self.runs.get(f) or self.run(f) if g is None else g for f, g in zip(found, got, strict=True)]
            out += got
        return b"".join(out)


@lru_cache(maxsize=1)
def run_memory(path: str) -> RunMemory:
    return RunMemory(path)
