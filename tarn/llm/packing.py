"""Vector bin packing of tokenised documents into training sequences.

An item has a size in each of three dimensions: tokens, segments and loss-bearing tokens. A sequence has a capacity in each. Bins are filled one at a
time: of the items that fit, the one with the largest dot product of its size and what is left of the bin goes in, both relative to
the capacities (Panigrahy et al., 2011). Documents may be cut: whole sequences are cut from long ones first, and an item is cut to close a
gap that no item fits. What remains at the end of a partition goes into sequences whose lengths are powers of two, so that they need no padding.

Each task packs the rows of its own partition in a bounded pool, so nothing is exchanged; sequence ids carry the partition's number.
A loss-bearing token is one that is predicted from another of its piece and is no part of a prompt: all but the first of a piece, and none of the leading
characters that a prompt column counts. No sequence has more of them than `loss`, which is less than a sequence's tokens, so that a sequence of nothing but one long piece is
not full: it takes pieces of other documents, or prompts, to fill it.

A null or empty text is the end token alone; a null prompt is none, and one that is longer than its text is the whole text. Every token lies in exactly one piece, very long texts in many.
Repeated rows are packed one by one; of items as good as each other the first goes in. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import base

VOCABULARY = "word_bpe_49k.json"
END, LENGTH, MAX_SEGMENTS = 2, 4096, 512
#: Loss-bearing tokens of a sequence, at most.
MAX_LOSS = LENGTH - 8
#: Tokens that wait to be packed together, and the shortest part that is cut to close a gap.
POOL, MIN_CUT = 1 << 20, 16
#: Parts of texts that one generation of a worker's cache holds.
CACHE = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segments long, loss_tokens long"

# Letters, numbers and white space of lower-cased Latin-1, and the pieces that the tokenizer's own pattern takes from such a text.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
# ASCII white space; other texts are cut there, which changes no word's tokens.
_BLANKS = str.maketrans("\t\n\r\x0b\x0c", "     ")


class Tokens:
    """Ids of texts from ids of their parts, which are kept in a cache of two generations.

    Ids of a part don't depend on its neighbours. A Latin-1 text is cut into the tokenizer's own pieces, each of which ends with the only token of it that closes a
    word; so many unseen pieces are encoded as one text and told apart by those tokens. Other texts are cut into words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str], pieces: bool) -> None:
        unseen = []
        for w in parts.difference(self.young):
            if (ids := self.old.get(w)) is None:
                unseen.append(w)
            else:
                self.young[w] = ids
        for k in range(0, len(unseen), 2000):
            some = unseen[k : k + 2000]
            if pieces:
                ids = np.array(self._encode([" ".join(some)])[0], "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(some):
                    raw, stops = ids.tobytes(), (ends * 4).tolist()
                    self.young.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops)]))
                    continue
            self.young.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(some, self._encode(some)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, followed by END."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        parts, latin = [], []
        for t in texts:
            t = t or ""
            try:
                t.encode("latin-1")
                parts.append(_PIECES.findall(t.lower()))
                latin.append(True)
            except UnicodeEncodeError:
                parts.append(t.translate(_BLANKS).split(" "))
                latin.append(False)
        for kind in (True, False):
            self._learn(set().union(*(p for p, x in zip(parts, latin) if x is kind)), kind)
        get, end = self.young.__getitem__, END.to_bytes(4, "little")
        return [np.frombuffer(b"".join(map(get, p)) + end, "<u4") for p in parts]


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    base.claim("packing", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


class Packer:
    """Items (key, start, tokens) are added; full bins are taken out as lists of (key, start, tokens)."""

    def __init__(self, length: int = LENGTH, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS):
        self.caps = np.array([length, segments, max(loss, 1)], float)
        self.length, self.most, self.items, self.waiting = length, loss, [], 0
        self.prompts: dict[int, int] = {}  # key: tokens at its start that bear no loss, if any

    def loss(self, key: int, start: int, size: int) -> int:
        """Loss-bearing tokens of a piece."""
        return max(0, start + size - max(start + 1, self.prompts.get(key, 0)))

    def _part(self, key: int, start: int, tokens: float, loss: float) -> int:
        """The longest piece from a place on that has no more of both."""
        return int(min(tokens, max(start + 1, self.prompts.get(key, 0)) - start + loss))

    def add(self, key: int, start: int, size: int, prompt: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        """Takes an item; yields the whole bins that it fills alone."""
        if prompt > start:
            self.prompts[key] = prompt
        while size >= (whole := self._part(key, start, self.length, self.most)):
            yield [(key, start, whole)]
            start, size = start + whole, size - whole
        if size:
            self.items.append((key, start, size))
            self.waiting += size

    def bins(self, least: int) -> Iterator[list[tuple[int, int, int]]]:
        """Fills bins while more than `least` tokens wait."""
        if self.waiting <= least:
            return
        size = np.array([s for *_, s in self.items], float)
        demand = np.stack([size, np.ones(len(size)), [self.loss(*x) for x in self.items]], axis=1)
        alive = np.ones(len(size), bool)
        full = np.array([self.length, self.caps[1], self.most], float)
        while self.waiting > least:
            left, chosen = full.copy(), []
            while left[0] >= 1 and left[1] >= 1:
                fits = alive & (demand <= left).all(axis=1)
                if fits.any():
                    weight = (demand / self.caps) @ (left / self.caps)
                    k = int(np.argmax(np.where(fits, weight, -1)))
                    chosen.append(self.items[k])
                    left -= demand[k]
                    alive[k] = False
                    continue
                k = int(np.argmax(np.where(alive, size, -1)))
                if not alive[k]:
                    break
                key, start, n = self.items[k]
                part = self._part(key, start, left[0], left[2])
                if part < MIN_CUT or n <= part:
                    break
                chosen.append((key, start, part))
                left -= (part, 1, self.loss(key, start, part))
                self.items[k] = (key, start + part, n - part)
                size[k] -= part
                demand[k] = (size[k], 1, self.loss(*self.items[k]))
            self.waiting -= sum(n for *_, n in chosen)
            yield chosen
        self.items = [x for x, a in zip(self.items, alive) if a]

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """Everything that waits, the last of it in bins of 2**k tokens, that can't have more loss-bearing tokens than allowed."""
        yield from self.bins(self.length)
        most = max(1, min(self.length, self.most + 1))
        todo, self.items, self.waiting = self.items[::-1], [], 0
        while todo:
            total = sum(n for *_, n in todo)
            room, chosen = 1 << min(total, most).bit_length() - 1, []
            while room and len(chosen) < self.caps[1]:
                key, start, n = todo.pop()
                part = min(n, room)
                chosen.append((key, start, part))
                if part < n:
                    todo.append((key, start + part, n - part))
                room -= part
            yield chosen


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, prompt: str | None = None) -> DataFrame:
    """One row per piece (SCHEMA): where it lies in its document and in its sequence, and the CRC of its ids. `prompt` names a column with the leading characters
    of the text that bear no loss: instructions, of which only the answers are learned."""
    base.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer = tokens(path), Packer(length, segments, loss)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: dict[int, list] = {}  # key: doc_id, ids, tokens that aren't placed yet
        rows: list[tuple] = []

        def place(chosen: list[tuple[int, int, int]]) -> None:
            nonlocal number
            offset, lost = 0, sum(packer.loss(*piece) for piece in chosen)
            for key, start, n in chosen:
                doc, ids, left = held[key]
                rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), number, offset, len(chosen), lost))
                offset += n
                held[key][2] = left - n
                if left == n:
                    del held[key]
                    packer.prompts.pop(key, None)
            number += 1

        def out() -> pa.RecordBatch:
            batch = base.record(SCHEMA, **dict(zip("abcdefghi", zip(*rows))))
            rows.clear()
            return batch

        key = 0
        for part in base.passes(batches, text):
            texts = part.column(text).to_pylist()
            leads = [0] * len(texts)
            if prompt:
                heads = [(t or "")[: max(0, n or 0)] for t, n in zip(texts, part.column(prompt).to_pylist())]
                leads = [len(x) - 1 for x in coder.encode(heads)]
            for doc, ids, lead in zip(part.column(doc_id).to_pylist(), coder.encode(texts), leads):
                held[key] = [doc, ids, len(ids)]
                for full in packer.add(key, 0, len(ids), lead):
                    place(full)
                key += 1
            if packer.waiting > POOL:
                for chosen in packer.bins(POOL // 8):
                    place(chosen)
            if len(rows) > 5000:
                yield out()
        for chosen in packer.rest():
            place(chosen)
        if rows:
            yield out()

    return df.select(*[df[c].alias(c) for c in (doc_id, text, *([prompt] if prompt else []))]).mapInArrow(run, SCHEMA)
