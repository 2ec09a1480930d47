"""Toxicity by a learned lexicon, misspellings included, in context.

Fitting: from a bounded sample of labelled rows, words that occur in far more toxic than other texts become the lexicon, each with its log-odds; texts that have a word between the
same neighbours count once, so that copies of a text make no lexicon of their own. A logistic regression then weighs a text's hits. Scoring: the Levenshtein automata of all unseen words of a batch (bit-parallel ones, a machine word of states for each number of
edits) walk a trie of the lexicon together; a word leaves the walk where its automaton has no state left. Two swapped letters are one edit. Words that a symbol
parts, as in "id!ot", are tried as one word too. A hit counts less if its context shows a quotation: quotation marks around it or a word of speech before it.

Only rows whose crc32(doc_id as text) modulo 3 is not 1 are learned from, at most SAMPLE ids of a class (those with the smallest hashes);
labels, language, source and doc_id are no inputs of a score. The lexicon has all words that pass its tests in the sample, so its size is bounded by the sample.

A null text counts as empty; an empty text has no hits and gets the score of one. Very long texts are read whole; words of over LONGEST letters are only
compared exactly. Equal texts get equal scores. Rows labelled twice are toxic if either label says so; of several texts under one labelled id the smallest is learned from. Without
labels of both classes there is no lexicon and every score is the share of toxic labels. A null doc_id is not held out. Of several terms as near the longest counts, then the first.
Other columns are not read, or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

SCHEMA = "doc_id long, score double, n_hits long, n_quoted long"
#: Labelled ids that a model is fitted on, at most, of the classes 0 and 1.
SAMPLE = (12_000, 4_000)
#: What a term needs: its texts among the toxic ones, and the log-likelihood ratio of its counts.
LEAST_TEXTS, LEAST_RATIO = 3, 20.0
#: Letters from which a term is found with one edit, and with two; letters of the longest word that an automaton is made of.
ONE_EDIT, TWO_EDITS, LONGEST = 4, 9, 60
THRESHOLD, CONTEXT, QUOTED = 0.7, 6, 0.35
CACHE, BATCH = 250_000, 20_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Symbols that stand for a letter.
_MASKS = np.zeros(256, bool)
_MASKS[list(b"!@$*#+-.|")] = True
SPEECH = frozenset(b"said says quote quoted quotes called wrote term word phrase sagte schrieb zitat dit citation dijo cita".split())
_QUOTE = re.compile("|".join('"“”«»„').encode())


def edits(letters: int) -> int:
    """How many edits a term of so many letters is found with."""
    return 0 if letters < ONE_EDIT or letters > LONGEST - 2 else 1 if letters < TWO_EDITS else 2


class Lexicon:
    """A trie of terms; near(words) walks it with the Levenshtein automata of the words."""

    def __init__(self, terms: list[str]):
        self.terms = {t: k for k, t in enumerate(terms)}
        self.next: list[dict[str, int]] = [{}]
        self.term, self.most = [-1], [0]  # the term that ends at a node, and the edits that any term below it allows
        for k, t in enumerate(terms):
            v, e = 0, edits(len(t))
            if not e:
                continue  # found by its spelling alone
            self.most[0] = max(self.most[0], e)
            for c in t:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.most.append(0)
                v = self.next[v][c]
                self.most[v] = max(self.most[v], e)
            self.term[v] = k

    def near(self, words: list[str]) -> list[tuple[int, int] | None]:
        """Of each word the term with the fewest edits, and their number; the longest of several, then the first."""
        out: list[tuple[int, int] | None] = [(self.terms[w], 0) if w in self.terms else None for w in words]
        rest = [k for k, w in enumerate(words) if out[k] is None and ONE_EDIT - 1 <= len(w) <= LONGEST]
        for at in range(0, len(rest), BATCH):
            some = rest[at : at + BATCH]
            for k, best in zip(some, self._walk([words[k] for k in some])):
                out[k] = best
        return out

    def _walk(self, words: list[str]) -> list[tuple[int, int] | None]:
        n, one = len(words), np.uint64(1)
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(n), size)
        bits = one << (np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size) + 1).astype(np.uint64)
        masks: dict[str, np.ndarray] = {}  # bit i: letter i, from 1, is this one
        for c in {c for children in self.next for c in children}:
            masks[c], here = np.zeros(n, np.uint64), points == ord(c)
            np.bitwise_or.at(masks[c], owner[here], bits[here])
        final = one << size.astype(np.uint64)
        inside = (final << one) - one
        best = np.full(n, 1 << 62, np.int64)  # edits, then letters from the longest, then the term
        # Bit i of rows[e]: the first i letters of the word are matched by the path so far with e edits.
        start = [np.uint64((1 << e + 1) - 1) & inside for e in range(self.most[0] + 1)]
        stack = [(0, np.arange(n), start, None, "", 0)]
        while stack:
            v, who, rows, before, last, depth = stack.pop()
            for c, child in self.next[v].items():
                m, bound = masks[c][who], inside[who]
                after = [(rows[0] << one) & m]
                for e in range(1, self.most[child] + 1):  # match, insertion, substitution, deletion, swap
                    now = ((rows[e] << one) & m) | rows[e - 1] | (rows[e - 1] << one) | (after[e - 1] << one)
                    if before is not None:
                        now |= (before[e - 1] << np.uint64(2)) & masks[last][who] & (m << one)
                    after.append(now & bound)
                alive = after[-1] != 0  # a state with fewer edits is one with more, too
                if not alive.any():
                    continue
                on, left = who[alive], [r[alive] for r in after]
                if (k := self.term[child]) >= 0:
                    for e in range(edits(depth + 1), -1, -1):
                        hit = on[left[e] & final[on] != 0]
                        best[hit] = np.minimum(best[hit], (e << 40) + (LONGEST - depth << 32) + k)
                if self.next[child]:
                    stack.append((child, on, left, [r[alive] for r in rows], c, depth + 1))
        return [None if b == 1 << 62 else (b & 0xFFFFFFFF, b >> 40) for b in best.tolist()]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    exact: list[float] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (N_FEATURES + 1))

    def lexicon(self) -> Lexicon:
        return _lexicon(tuple(self.terms))


N_FEATURES = 5
_LEXICONS: dict[tuple[str, ...], tuple[Lexicon, dict[bytes, tuple[int, int] | None]]] = {}


def _known(terms: tuple[str, ...]) -> tuple[Lexicon, dict[bytes, tuple[int, int] | None]]:
    base.claim("toxicity", _LEXICONS.clear)
    if terms not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[terms] = (Lexicon(list(terms)), {})
    return _LEXICONS[terms]


def _lexicon(terms: tuple[str, ...]) -> Lexicon:
    return _known(terms)[0]


def _text_words(texts: pa.Array) -> base.Words:
    return base.Words(*base.text_bytes(pa.array([(x or "").lower() for x in texts.to_pylist()], pa.large_string())), _WORD)


def _masked(words: base.Words, docs: np.ndarray, raw: bytes) -> dict[int, bytes]:
    """Of words that one symbol parts from the next: their number and both as one word."""
    gap = words.starts[1:] - words.ends[:-1] == 1
    at = np.flatnonzero(gap & _MASKS[words.data[words.ends[:-1]]] & (docs[1:] == docs[:-1])) if len(words) > 1 else np.zeros(0, np.int64)
    return {int(i): raw[words.starts[i] : words.ends[i + 1]] for i in at.tolist()}


def hits(words: base.Words, model: Model) -> list[tuple[int, int, int, bool]]:
    """(word, term, edits, quoted) of every hit of a batch."""
    lexicon, known = _known(tuple(model.terms))
    strings = words.strings()
    if len(known) > CACHE:
        known.clear()
    docs, raw = words.docs(), words.data.tobytes()
    joined = _masked(words, docs, raw)
    if unseen := list({*strings, *joined.values()}.difference(known)):
        known.update(zip(unseen, lexicon.near([w.decode() for w in unseen])))
    found = [(i, known[w]) for i, w in enumerate(strings) if known[w] is not None]
    found += [(i, known[w]) for i, w in joined.items() if known[w] is not None and known[strings[i]] is None and known[strings[i + 1]] is None]
    out = []
    for i, (term, edits) in found:
        a, b = int(words.first[docs[i]]), int(words.first[docs[i] + 1])
        low, high = max(a, i - CONTEXT), min(b, i + CONTEXT + 1)
        before, after = raw[words.starts[low] : words.starts[i]], raw[words.ends[i] : words.ends[high - 1]]
        marks = bool(_QUOTE.search(before)) and bool(_QUOTE.search(after))
        out.append((i, term, edits, marks or any(w in SPEECH for w in strings[low:i])))
    return out


def features(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: features, hits, and hits in quotations."""
    words = _text_words(texts)
    n = len(texts)
    x, count, quoted = np.zeros((n, N_FEATURES)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    found = hits(words, model)
    if found:
        place, term, edits, said = (np.array(v) for v in zip(*found))
        doc = words.docs()[place]
        weight = np.where(edits == 0, np.array(model.exact)[term], np.array(model.fuzzy)[term]) * np.where(said, QUOTED, 1.0)
        np.add.at(x[:, 0], doc, weight)
        np.maximum.at(x[:, 1], doc, weight)
        np.add.at(x[:, 2], doc[edits > 0], weight[edits > 0])
        np.add.at(count, doc, 1)
        np.add.at(quoted, doc[said], 1)
        x[:, 0], x[:, 2] = np.log1p(x[:, 0]), np.log1p(x[:, 2])
        x[:, 3] = np.log1p(quoted)
        x[:, 4] = count / np.maximum(words.counts, 1)
    return x, count, quoted


def _scores(x: np.ndarray, weights: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ np.array(weights[1:]), -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float]:
    """Logistic regression with a small ridge, by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 1.0)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve(z.T @ (z * (w * p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def training_labels(labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    return labels.where(F.col(toxic).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % 3 != 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic)).cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from at most SAMPLE texts of the classes."""
    spark = docs.sparkSession
    base.prepare(spark)
    scratch = base.Scratch(spark, "toxicity")
    rows = training_labels(labels)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = [sizes.get(0, 0), sizes.get(1, 0)]
    model = Model()
    if not all(total):
        share = total[1] / max(sum(total), 1)
        model.weights[0] = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model
    chosen = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    sample = chosen[0].union(chosen[1])  # at most sum(SAMPLE) narrow rows, so it may be broadcast
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(sample), "doc_id")
    texts = scratch.keep(texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "toxic"), "texts")  # a text for each id
    n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t_all, c_all = n.get(1, 0), n.get(0, 0)
    if not t_all or not c_all:
        model.weights[0] = math.log(total[1] / total[0])
        return model

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.passes(batches, "text"):
            words = _text_words(part.column("text"))
            strings, toxic, rows = words.strings(), part.column("toxic").to_pylist(), []
            for a, b, y in zip(words.first.tolist(), words.first[1:].tolist(), toxic):
                once = dict(zip(reversed(strings[a:b]), range(b - 1, a - 1, -1)))  # the first place of each word
                rows += [(w, y, zlib.crc32(b" ".join(strings[max(a, i - 1) : min(b, i + 2)]))) for w, i in once.items()]
            yield base.record("word string, toxic int, around long", **dict(zip("abc", zip(*rows)))) if rows else base.record("word string, toxic int, around long", a=[], b=[], c=[])

    # Of texts that have a word between the same neighbours, as copies have, only one counts.
    seen = texts.mapInArrow(distinct_words, "word string, toxic int, around long").distinct()
    counts = scratch.keep(seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).select("word", "t", (F.col("n") - F.col("t")).alias("c")), "counts")
    one = F.lit(1.0)
    t, c = F.col("t"), F.col("c")
    ratio = 2 * (t * F.log(F.greatest(t, one * 0.5) * (t_all + c_all) / (t_all * (t + c))) + c * F.log(F.greatest(c, one * 0.5) * (t_all + c_all) / (c_all * (t + c))))
    odds = F.log((t + 0.5) / (t_all + 1.0)) - F.log((c + 0.5) / (c_all + 1.0))
    best = counts.where((t >= LEAST_TEXTS) & (F.length("word") >= 3)).select("word", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 1))
    terms = best.orderBy(F.desc("ratio"), "word").collect()  # each is in LEAST_TEXTS toxic texts of the sample
    model.terms, model.exact = [r.word for r in terms], [r.odds for r in terms]

    # What words a few edits away have been worth, term by term: their texts in the sample.
    names = tuple(model.terms)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, t, c = (b.column(k).to_pylist() for k in ("word", "t", "c"))
            found = [(near[0], x, y) for near, x, y in zip(_lexicon(names).near(words), t, c) if near and near[1]]
            if found:
                yield base.record("term int, t long, c long", **dict(zip("abc", zip(*found))))

    fuzzy = {r.term: (r.t, r.c) for r in counts.mapInArrow(neighbours, "term int, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
    prior = math.log(c_all / t_all)
    model.fuzzy = [min(w, max(0.0, math.log((fuzzy[k][0] + 0.5) / (fuzzy[k][1] + 0.5)) + prior)) if k in fuzzy else 0.7 * w for k, w in enumerate(model.exact)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.passes(batches, "text"):
            x, *_ = features(part.column("text"), model)
            yield base.record("toxic int, x array<double>", toxic=part.column("toxic"), x=list(x))

    got = texts.mapInArrow(vectors, "toxic int, x array<double>").collect()  # at most sum(SAMPLE) short rows
    y = np.array([r.toxic for r in got], float)
    weight = np.where(y == 1, total[1] / t_all, total[0] / c_all)
    model.weights = _regression(np.array([r.x for r in got], float), y, weight * len(y) / weight.sum())
    scratch.drop(texts, counts)
    return model


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and hits of every row."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        x, count, quoted = features(b.column(text), model)
        return base.record(SCHEMA, doc_id=b.column(doc_id), score=_scores(x, model.weights), n_hits=count, n_quoted=quoted)

    return base.map_texts(df, [doc_id, text], text, work, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and predictions of all documents by a model fitted on the labelled ones."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "n_quoted")


def keep_civil(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score is under THRESHOLD, with all their columns."""
    return base.filter_texts(df, text, lambda b: _scores(features(b.column(text), model)[0], model.weights) < THRESHOLD)
