"""Plain forms of the text operators' rules, for tests."""

from __future__ import annotations

import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", None) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, size=5):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1)))


def components(sets):
    """Smallest reachable id per id of {id: set}, by all pairs."""
    ids = sorted(sets)
    best = {i: i for i in ids}

    def root(x):
        while best[x] != x:
            x = best[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                best[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)
