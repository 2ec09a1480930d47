"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links, as in Aho-Corasick, but a link also says how many pieces greedy
longest-match has finished when it is taken. So a word is counted in one pass over its bytes and no piece is built.

Words are runs of `[^ \\t-\\r]`, lower-cased. A word is its UTF-8 bytes followed by an end mark; pieces are those of a vocabulary
whose entries may carry that mark. Bytes that no piece begins with make the word one unknown piece.
A null or empty text has 0 words and 0 pieces. Very long texts and words are counted whole. Equal texts get equal results, repeated rows a row each; of words with as many pieces
the longest's number is the same, so ties show nowhere. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import base

SCHEMA = "doc_id long, n_words long, n_pieces long, n_unknown long, longest_word_pieces long"
VOCABULARY = "word_bpe_49k.json"
END = 256
#: Words whose counts a worker remembers.
CACHE = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load(path: str) -> list[tuple[int, ...]]:
    """Pieces as symbol sequences, in order of their ids; END closes those that end a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of, out = byte_symbols(), []
    for piece in sorted(vocab, key=vocab.get):
        body, mark = (piece[:-4], (END,)) if piece.endswith("</w>") else (piece, ())
        if all(c in of for c in body):
            out.append((*(of[c] for c in body), *mark))
    return out


class Automaton:
    """next[v] maps a symbol to a child; link[v] is where the unmatched rest stands after popped[v] whole pieces; -1 if there is none."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            v = 0
            for s in piece:
                if s not in self.next[v]:
                    self.next[v][s] = len(self.next)
                    self.next.append({})
                    final.append(False)
                v = self.next[v][s]
            final[v] = bool(piece)
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for s, child in self.next[v].items():
                if final[child]:
                    self.link[child], self.popped[child] = 0, 1
                else:  # the rest of v's text goes on with s, from where v's own link leads
                    at, n = self.link[v], self.popped[v]
                    while at >= 0 and s not in self.next[at]:
                        at, n = self.link[at], n + self.popped[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.next[at][s], n
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match over the word and its end mark; -1 if it can't be split so."""
        nexts, link, popped = self.next, self.link, self.popped
        v = n = 0
        for s in (*word, END):
            while s not in nexts[v]:
                n += popped[v]
                v = link[v]
                if v < 0:
                    return -1
            v = nexts[v][s]
        while v:
            n += popped[v]
            v = link[v]
            if v < 0:
                return -1
        return n


_LOADED: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def count_texts(texts: pa.Array, path: str) -> dict[str, np.ndarray]:
    base.claim("wordpieces", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = (Automaton(load(path)), {})
    automaton, known = _LOADED[path]
    lowered = pa.array([(x or "").lower() for x in texts.to_pylist()], pa.large_string())
    words = base.Words(*base.text_bytes(lowered))
    strings = words.strings()
    if len(known) > CACHE:
        known.clear()
    for w in set(strings).difference(known):
        known[w] = automaton.count(w)
    each = np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
    unknown = each < 0
    each = np.where(unknown, 1, each)
    total = np.concatenate([[0], np.cumsum(each)])
    strange = np.concatenate([[0], np.cumsum(unknown)])
    most = np.zeros(len(texts), np.int64)
    if len(each):
        np.maximum.at(most, words.docs(), each)
    a, b = words.first[:-1], words.first[1:]
    return {"n_words": words.counts, "n_pieces": total[b] - total[a], "n_unknown": strange[b] - strange[a], "longest_word_pieces": most}


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Word and piece counts of every document; `path` is a vocabulary file that executors can read."""
    return base.map_texts(df, [doc_id, text], text, lambda b: base.record(SCHEMA, doc_id=b.column(doc_id), **count_texts(b.column(text), path)), SCHEMA)
