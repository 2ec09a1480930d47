"""Substring dedup with difference-cover anchors.

Positions modulo PERIOD that lie in COVER are anchors: for any two positions there is a shift below PERIOD that takes both to anchors.
So if two documents share WINDOW words, they share an anchor window of WINDOW - PERIOD + 1 words that is aligned in both. Only
anchor windows are hashed for the search; where one occurs in two different texts, it is extended to the windows of WINDOW words around it,
and those decide, by 128-bit hashes of their words, which words go.

What moves: each text once, compressed (exchanged by document and read again by every later step); one narrow row per anchor;
then only what lies around shared anchors. What texts that are read together share is known to be shared without asking others: of such an anchor only the smallest and the
largest document, and of such a window only the smallest, are sent to the task that has it; the other rows are dealt out by document. So a passage of very many
documents, however hot, sends a few rows a batch to one place. Copies of whole texts are counted by partial aggregation and joined back with hot ones dealt out.

Words are `[^ \\t-\\r]+`. A null or empty text has none. Texts under WINDOW words keep everything. Among equal texts the smallest doc_id keeps its
words. Rows with the same doc_id, or with none, are no earlier documents for each other; a null doc_id counts as the largest. Very long texts are handled whole. Other
columns are not read, or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
EDIT_SCHEMA = "doc_id long, digest binary, kept_text string"
#: Numbers that stand for null doc_ids, from NULLS to LAST, so that rows without an id are not one key.
LAST, PARTS = (1 << 63) - 1, 64
NULLS = LAST - PARTS + 1
#: The last bits of an anchor's hash and of a window's second one are no part of them: 0, or by the document for rows that pass by.
PLAIN, SALT = np.uint64(base.MASK - PARTS + 1), PARTS - 1
HEAD = 16 + 8 + 32  # of a packed text: digest, number of words, SHA-256 of its joined words


def _pack(texts: pa.Array) -> list[bytes]:
    base.claim("passages", lambda: None)
    data, offs = base.text_bytes(texts)
    words = base.Words(data, offs)
    raw, strings, pack, out = data.tobytes(), words.strings(), zstandard.ZstdCompressor(level=1), []
    for k in range(len(texts)):
        text, i, j = raw[offs[k] : offs[k + 1]], words.first[k], words.first[k + 1]
        digest = hashlib.blake2b(text, digest_size=16).digest()
        out.append(digest + int(j - i).to_bytes(8, "little") + hashlib.sha256(b" ".join(strings[i:j])).digest() + pack.compress(text))
    return out


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob[HEAD:])


def rank(df: DataFrame, doc_id: str, text: str) -> Column:
    """The doc_id, or for none a number above all ids, by the text."""
    return F.coalesce(df[doc_id].cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(df[text]), F.lit(PARTS)))


def packed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts with digests, compressed, dealt out by document."""
    # No column is nullable, else the optimiser adds filters that differ between the readers of the exchange, and it runs once for each.
    schema, rows = "doc_id long not null, blob binary not null", df.select(rank(df, doc_id, text).alias("doc_id"), df[text].alias("text"))
    return base.map_texts(rows, ["doc_id", "text"], "text", lambda b: base.record(schema, doc_id=b.column("doc_id"), blob=_pack(b.column("text"))), schema).repartition("doc_id")


def _texts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ()) -> Iterator[tuple[list, list[bytes], base.Words, list[list]]]:
    """Ids, blobs, words and further columns of at most PASS_BYTES of compressed text at a time."""
    base.claim("passages", lambda: None)
    for part in base.passes(batches, "blob", base.PASS_BYTES // 2):
        blobs = part.column("blob").to_pylist()
        texts = [_unpack(x) for x in blobs]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        yield part.column("doc_id").to_pylist(), blobs, base.Words(np.frombuffer(b"".join(texts), np.uint8), offs), [part.column(c).to_pylist() for c in columns]


def anchors(words: base.Words, hashes: np.ndarray) -> np.ndarray:
    """Positions of the words at which anchor windows start."""
    at = base.within(words.first, ANCHOR)
    return at[np.isin((at - words.first[words.docs()[at]]) % PERIOD, COVER)]


def _grouped(docs: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows by keys, then documents, without repeats of both, and the smallest and the largest document of each row's key."""
    order = np.lexsort((docs, *keys))
    other = np.ones(len(order), bool)
    other[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    fresh = other.copy()
    fresh[1:] |= docs[order][1:] != docs[order][:-1]
    order, edges = order[fresh], np.flatnonzero(other[fresh])
    size = np.diff(np.append(edges, len(order)))
    return order, np.repeat(docs[order[edges]], size), np.repeat(docs[order[edges + size - 1]], size)


def _salt(docs: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known, 1 + docs % SALT, 0).astype(np.uint64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, words, _ in _texts(batches):
        hashes = words.hashes()
        at = anchors(words, hashes)
        if len(at):
            docs, keys = words.docs()[at], base.gram_hashes(hashes, ANCHOR)[at] & PLAIN
            docs = np.array(ids, np.int64)[docs]
            order, low, high = _grouped(docs, keys)  # a text's repeats of an anchor say nothing
            keys, docs = keys[order], docs[order]
            keys = keys | _salt(docs, (docs > low) & (docs < high))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs)], names=["anchor", "doc_id"])


def _windows(words: base.Words, marked: np.ndarray) -> np.ndarray:
    """Starts of the windows of WINDOW words that hold a marked anchor at one of their first PERIOD words."""
    n = len(words)
    change = np.zeros(n + PERIOD + 1, np.int64)
    np.add.at(change, np.maximum(marked - PERIOD + 1, 0), 1)
    np.add.at(change, marked + 1, -1)
    near = np.cumsum(change)[:n] > 0
    at = base.within(words.first, WINDOW)
    return at[near[at]]


def _window_keys(words: base.Words) -> tuple[np.ndarray, np.ndarray]:
    first, second = (base.gram_hashes(words.hashes(seed), WINDOW) for seed in (1, 3))
    return first, second & PLAIN


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, words, (shared,) in _texts(batches, ("anchors",)):
        hashes = words.hashes()
        at = anchors(words, hashes)
        keys, docs = base.gram_hashes(hashes, ANCHOR)[at] & PLAIN, words.docs()[at]
        edges = np.searchsorted(docs, np.arange(len(ids) + 1))
        hit = [at[a:b][np.isin(keys[a:b], np.array(s, np.int64).view(np.uint64) & PLAIN)] for a, b, s in zip(edges, edges[1:], shared)]
        at = _windows(words, np.concatenate(hit)) if hit else at[:0]
        if len(at):
            first, second = (k[at] for k in _window_keys(words))
            docs = np.array(ids, np.int64)[words.docs()[at]]
            order, low, _ = _grouped(docs, second, first)
            docs = docs[order]
            second = second[order] | _salt(docs, (docs > low) & (low < NULLS))  # a smaller document has it: it goes
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(first[order].view(np.int64)), pa.array(second.view(np.int64))], names=["doc_id", "w1", "w2"])


def covered_words(words: base.Words, gone: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each word of one document: is it in a window that is gone."""
    first, second = _window_keys(words)
    lost = gone[0].view(np.uint64), gone[1].view(np.uint64) & PLAIN
    at = np.flatnonzero(np.isin(first, lost[0]) & np.isin(first ^ base.mix(second), lost[0] ^ base.mix(lost[1])))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rest, rows = [], []
        for doc, blob, copies, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "blob", "copies")), _lost(batch)):
            n, doc = int.from_bytes(blob[16:24], "little"), None if doc >= NULLS else doc
            if n >= WINDOW and copies and blob[:16] in copies:
                rows.append((doc, n, n, nothing))
            elif gone and n >= WINDOW:
                rest.append((doc, blob, gone))
            else:
                rows.append((doc, n, 0, blob[24:HEAD].hex()))
        for doc, blob, gone in rest:
            kept, n, removed = _kept(blob, gone)
            rows.append((doc, n, removed, hashlib.sha256(kept).hexdigest()))
        if rows:
            yield base.record(SCHEMA, **dict(zip("abcd", zip(*rows))))


def _lost(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The windows that each row has to lose, without a Python object for each."""
    column = batch.column("gone")
    keys = [column.values.field(c).to_numpy(zero_copy_only=False) for c in ("w1", "w2")]
    offs = column.offsets.to_numpy()
    return [tuple(k[a:b] for k in keys) if a < b else None for a, b in zip(offs, offs[1:])]


def _kept(blob: bytes, gone: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, int, int]:
    data = np.frombuffer(_unpack(blob), np.uint8)
    words = base.Words(data, np.array([0, len(data)]))
    off = covered_words(words, gone)
    return b" ".join(w for w, x in zip(words.strings(), off) if not x), len(words), int(off.sum())


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []  # a null doc_id stays its number here
        for doc, blob, copies, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "blob", "copies")), _lost(batch)):
            if int.from_bytes(blob[16:24], "little") < WINDOW:
                continue
            if copies and blob[:16] in copies:
                rows.append((doc, blob[:16], ""))
            elif gone and (edit := _kept(blob, gone))[2]:
                rows.append((doc, blob[:16], edit[0].decode()))
        if rows:
            yield base.record(EDIT_SCHEMA, **dict(zip("abc", zip(*rows))))


def _judged(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every text, packed, with the digests it only copies and the windows it has to lose."""
    docs = packed(df, doc_id, text)
    digests = docs.select("doc_id", F.substring("blob", 1, 16).alias("digest"))
    earliest = digests.groupBy("digest").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count("*").alias("n")).where(f"earliest < latest and earliest < {NULLS}").drop("latest")
    copies = base.join_back(digests, earliest, ["digest"], "doc_id").where("doc_id > earliest").groupBy("doc_id").agg(F.collect_set("digest").alias("copies"))
    docs = docs.join(copies, "doc_id", "left")
    own = docs.where("copies is null or not array_contains(copies, substring(blob, 1, 16))").select("doc_id", "blob")

    # One exchange each for counting and joining. Rows with a salt are known to be shared, or to go; they only pass.
    salted = lambda c: F.col(c).bitwiseAND(SALT) != 0
    rows = own.mapInArrow(_anchor_rows, "anchor long not null, doc_id long not null").repartition("anchor")
    common = rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where((F.col("low") < F.col("high")) | salted("anchor")).select("anchor")
    shared = rows.join(common, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    windows = own.join(shared, "doc_id").mapInArrow(_window_rows, "doc_id long not null, w1 long not null, w2 long not null").repartition("w1", "w2")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where((F.col("low") < F.col("high")) | salted("w2")).drop("high")
    gone = windows.join(first, ["w1", "w2"]).where(salted("w2") | (F.col("doc_id") > F.col("low")) & (F.col("low") < NULLS)).groupBy("doc_id").agg(F.collect_set(F.struct("w1", "w2")).alias("gone"))
    return docs.join(gone, "doc_id", "left")


def dedup_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, words removed, and the SHA-256 of the kept words joined by spaces (SCHEMA)."""
    base.prepare(df.sparkSession)
    return _judged(df, doc_id, text).mapInArrow(_results, SCHEMA)


def without_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with repeated passages cut out of its texts; rows that lose nothing stay as they are."""
    base.prepare(df.sparkSession)
    edits = _judged(df, doc_id, text).mapInArrow(_edits, EDIT_SCHEMA).groupBy("doc_id").agg(F.collect_list(F.struct("digest", "kept_text")).alias("__tarn_edits"))
    marked = df.join(edits.withColumnRenamed("doc_id", "__tarn_doc"), F.col("__tarn_doc") == rank(df, doc_id, text), "left")

    names = df.columns
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.passes(batches, text, 4 * base.PASS_BYTES):
            texts, changes = part.column(text).to_pylist(), part.column("__tarn_edits").to_pylist()
            for k, (old, edits) in enumerate(zip(texts, changes)):
                if edits:
                    digest = hashlib.blake2b((old or "").encode(), digest_size=16).digest()
                    texts[k] = next((e["kept_text"] for e in edits if e["digest"] == digest), old)
            columns = [pa.array(texts, part.column(c).type) if c == text else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.select(*[df[c] for c in names], "__tarn_edits").mapInArrow(run, schema)
