"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def kept_words(rows: list[tuple[int | None, str | None]], n: int = 13) -> list[tuple]:
    """(doc_id, words, removed, digest, kept text) of rows of the substring dedup; a null id is the largest."""
    rank = lambda d: (d is None, d)
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    low: dict[tuple, tuple] = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            low[k] = min(low.get(k, rank(d)), rank(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if low[tuple(w[i : i + n])] < rank(d):
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def classes(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[int, int]:
    """Smallest id of the class of each id: links are Jaccard similarities of five-word shingle sets."""
    sets = {}
    for d, t in rows:
        w = NORMAL.findall((t or "").lower())
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([("bare", t or "")])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common / len(sets[a] | sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def quality(text: str | None) -> tuple:
    """(words, word characters, symbols, repeated lines, repeated words, base failed)."""
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, lines = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def coverage_keeps(text: str | None) -> bool:
    """The method's verdict on a text that the base rules keep."""
    from tarn.llm import quality as q

    t = text or ""
    w = WORD.findall(t)
    chars = max(1, sum(map(len, w)))
    for n, limit in q.GRAM_LIMITS.items():
        seen, marked = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                marked |= set(range(i, i + n))
            seen.add(g)
        if sum(len(w[k]) for k in marked) / chars > limit:
            return False
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line in seen:
            dup += sum(map(len, WORD.findall(line)))
        seen.add(line)
    return dup / chars <= q.LINE_LIMIT and len(re.findall(r"[#*$%&|<>]", t)) / chars <= q.SYMBOL_LIMIT


def greedy_pieces(word: bytes, pieces: set[tuple[int, ...]], longest: int) -> int:
    symbols, at, n = (*word, 256), 0, 0
    while at < len(symbols):
        stop = next((j for j in range(min(len(symbols), at + longest), at, -1) if symbols[at:j] in pieces), None)
        if stop is None:
            return -1
        at, n = stop, n + 1
    return n


def distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, none of them twice at one place."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]
