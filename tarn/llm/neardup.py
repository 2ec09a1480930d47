"""Near-duplicate classes by ProbMinHash.

Every five-word shingle of a text is a Poisson process whose rate is its weight, 1 + ln(count) / 8. An arrival falls into one of SIZE registers,
which keeps its earliest one; a shingle stops once its next arrival is later than all registers. Two texts agree in a register with the
probability Jaccard similarity of their weights. Bands of ROWS registers give candidate pairs, and these are verified on the texts: a link
needs a Jaccard similarity of the shingle sets of THRESHOLD or more. Classes are the connected components of the links.

Words are runs of letters, digits and bytes above 127 after lower-casing; under five words the whole text is one shingle, without any word the
text itself. Texts with the same words are one text here, so copies are never paired. Within a band's bucket each text is compared
with the smallest one. Where that does not link them all, each is compared with the text that is most similar to the smallest too: the bucket's pivot. Then only texts
around a pivot that are still in different components are compared, and only if a link is possible by the triangle inequality of the Jaccard distance, by their
sizes, and by how many of their shingles the pivot or a text of another component has, and if they have a shingle in common that the pivot lacks; where
nearly all of both lies in the pivot, a bound by their overlaps with it takes the place of the last test. These tests fail for no pair that is similar enough,
so no group of similar texts is expanded into its pairs and no link is lost. Components are paired before their texts are, so texts of one component never meet.

A null text counts as empty; empty texts are one class. Ties cannot occur (64-bit arrivals, then the larger shingle hash). Classes are of texts, told apart
by a 128-bit key of their words: rows with one doc_id, or with none, and different texts are in one class only if these are linked. A null doc_id is above
all others. Very long texts are shingled whole. Other columns are not read, or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tarn.llm import base
from tarn.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 4
SIZE = BANDS * ROWS
#: How much repeats of a shingle add to its weight: little, so that texts whose sets are similar stay similar in their registers.
REPEATS = 1 / 8
PASS = 1 << 21
SEEN = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normal_words(texts: list[str | None]) -> base.Words:
    base.claim("neardup", lambda: None)
    return base.Words(*base.text_bytes(pa.array([(t or "").lower() for t in texts], pa.large_string())), _WORD)


def word_keys(texts: list[str | None], words: base.Words, h: np.ndarray) -> list[np.ndarray]:
    """Two hashes that tell texts with other words apart; a text without any word counts by its bytes."""
    n = words.counts
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - words.first[words.docs()]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
        keys = []
        for seed in (1, 3):
            total = np.concatenate([[np.uint64(0)], np.cumsum(base.mix((h if seed == 1 else words.hashes(seed)) + place * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
            keys.append(base.mix(total[words.first[1:]] - total[words.first[:-1]] ^ n.astype(np.uint64)))
    bare = np.flatnonzero(n == 0)
    if len(bare):
        data, offs = base.text_bytes(pa.array([texts[k] or "" for k in bare], pa.large_string()))
        for key, seed in zip(keys, (5, 6)):
            key[bare] = base.span_hashes(data, offs[:-1], offs[1:], seed)
    return keys


def packed_keys(texts: list[str | None]) -> list[bytes]:
    words = normal_words(texts)
    return [x.tobytes() for x in np.stack(word_keys(texts, words, words.hashes()), axis=1)]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of the distinct shingles, and two hashes that tell texts with other words apart."""
    words = normal_words(texts)
    h, n = words.hashes(), words.counts
    at = base.within(words.first, SHINGLE)
    doc, grams = words.docs()[at], base.gram_hashes(h, SHINGLE)[at]
    keys = word_keys(texts, words, h)
    short = np.flatnonzero(n < SHINGLE)
    doc, grams = np.concatenate([doc, short]), np.concatenate([grams, keys[0][short]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    edges = np.flatnonzero(new)
    counts = np.diff(np.append(edges, len(doc)))
    return doc[edges], grams[edges], 1 + REPEATS * np.log(counts), keys[0], keys[1]


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """Registers (n_docs, size): the element whose arrival is the earliest in each. Every document needs an element."""
    first = np.full(n_docs * size, np.inf)
    owner = np.zeros(n_docs * size, np.uint64)
    clock, k = np.zeros(len(doc)), 0
    row, elem, pace = doc * size, element, 1 / weight
    with np.errstate(over="ignore"):
        while len(row):
            k += 1
            u = base.mix(elem + np.uint64(k * 0x9E3779B97F4A7C15 & base.MASK))
            clock = clock - np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) * pace
            slot = row + (base.mix(u ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(size)).astype(np.int64)
            live = clock < first[slot]
            np.minimum.at(first, slot[live], clock[live])
            won = live & (clock == first[slot])
            owner[slot[won]] = elem[won]
            latest = first.reshape(n_docs, size).max(axis=1)
            on = clock < latest[row // size]  # the process ends for those that can no longer be earliest
            row, elem, pace, clock = row[on], elem[on], pace[on], clock[on]
    return owner.reshape(n_docs, size)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        grid = base.mix(registers).reshape(len(registers), BANDS, ROWS)
        odd = base.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        return base.mix((grid * odd).sum(axis=2, dtype=np.uint64) + base.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77)))


def _signed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Ids, keys of the words and packed bands of all rows."""
    schema = "doc_id long, key binary not null, bands binary not null"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.passes(batches, text, PASS):
            doc, element, weight, k1, k2 = shingles(part.column(text).to_pylist())
            bands = band_hashes(prob_minhash(doc, element, weight, part.num_rows))
            keys = np.stack([k1, k2], axis=1)
            yield base.record(schema, doc_id=part.column(doc_id), key=[x.tobytes() for x in keys], bands=[x.tobytes() for x in bands])

    return df.select(df[doc_id].alias(doc_id), df[text].alias(text)).mapInArrow(run, schema)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            hashes = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["bucket", "node"])


def _unseen(seen: set[tuple], *columns: list) -> np.ndarray:
    """Rows whose values a task has not had among its last ones. The set is bounded, so some repeats stay; hot ones shrink to a few rows a task."""
    new = np.zeros(len(columns[0]), bool)
    for k, row in enumerate(zip(*columns)):
        if row not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(row)
            new[k] = True
    return new


def _named(doc_id: Column) -> Column:
    """An id that joins: null is one too."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _blobs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts, compressed, with the names of their ids and their keys."""
    schema = "doc_id long, key binary not null, blob binary not null"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for part in base.passes(batches, text):
            texts, ids = part.column(text).to_pylist(), part.column(doc_id).to_pylist()
            keys = packed_keys(texts)
            at = np.flatnonzero(_unseen(seen, ids, keys)).tolist()
            yield base.record(schema, doc_id=[ids[k] for k in at], key=[keys[k] for k in at], blob=[pack.compress((texts[k] or "").encode()) for k in at])

    rows = df.select(df[doc_id].alias(doc_id), df[text].alias(text)).mapInArrow(run, schema)
    return rows.select(_named(F.col("doc_id")).alias("name"), "key", "blob")


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with the key of their words, without some repeats of an id with the same text."""
    schema = StructType([*df.schema, StructField("__tarn_key", BinaryType(), False)])
    base.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for part in base.passes(batches, text):
            texts = part.column(text).to_pylist()
            keys = packed_keys(texts)
            new = _unseen(seen, part.column(doc_id).to_pylist(), keys, [hash(t) for t in texts])
            columns = [*part.columns, pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "__tarn_key"]).filter(pa.array(new))

    return df.mapInArrow(run, schema)


_SIMS = "a long, b long, common long, size_a long, size_b long, similarity double"


def _sets(blobs: list[bytes]) -> list[np.ndarray]:
    """The shingles of packed texts, sorted."""
    unpack = zstandard.ZstdDecompressor()
    doc, element, *_ = shingles([unpack.decompress(x).decode() for x in blobs])
    edges = np.searchsorted(doc, np.arange(len(blobs) + 1))
    return [element[i:j] for i, j in zip(edges, edges[1:])]


def _paired(batches: Iterator[pa.RecordBatch], left: str, right: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Batches of pairs with the shingles of both sides; those of a text are kept while it comes again and again."""
    known: dict[int, np.ndarray] = {}
    for part in base.passes(batches, f"blob_{right}"):
        nodes: dict[int, bytes] = {}
        for side in (left, right):
            nodes |= dict(zip(part.column(side).to_pylist(), part.column(f"blob_{side}").to_pylist()))
        known = {k: v for k, v in known.items() if k in nodes}
        new = [k for k in nodes if k not in known]
        known |= zip(new, _sets([nodes[k] for k in new])) if new else ()
        yield part, *([known[k] for k in part.column(side).to_pylist()] for side in (left, right))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of pairs of texts."""
    for part, x, y in _paired(batches, "a", "b"):
        n, m = (np.array([len(v) for v in s], np.int64) for s in (x, y))
        common = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y)], np.int64)
        yield base.record(_SIMS, a=part.column("a"), b=part.column("b"), common=common, n=n, m=m, similarity=common / (n + m - common))


def _with_texts(pairs: DataFrame, blobs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs with the texts of both sides. A text with very many partners makes a skewed join, which Spark splits."""
    for side in (right, left):
        pairs = pairs.join(blobs.select(F.col("node").alias(side), F.col("blob").alias(f"blob_{side}")), side)
    return pairs


def _verified(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the shingles that they have in common, their sizes and their similarity."""
    return _with_texts(pairs, blobs, "a", "b").select("a", "b", "blob_a", "blob_b").mapInArrow(_similar, _SIMS)


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of texts that their pivot lacks."""
    for part, x, y in _paired(batches, "p", "node"):
        own = [v[np.isin(v, u, assume_unique=True, invert=True)] for u, v in zip(x, y)]
        size = [len(o) for o in own]
        if sum(size):
            columns = [pa.array(np.repeat(part.column(c).to_numpy(), size)) for c in ("p", "node", "component")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(own).view(np.int64))], names=["p", "node", "component", "shingle"])


#: Two texts around a pivot can be linked only if their distances from it differ by no more than this.
SLACK = 1 - THRESHOLD + 1e-9
#: A link's smallest intersection is its sizes' sum divided by this.
SHARE = (1 + THRESHOLD) / THRESHOLD


def _across(x: DataFrame, y: DataFrame, keys: list[str], once: bool) -> DataFrame:
    """Pairs of rows of x and y with equal keys and different components, as far as distances and sizes allow a link: first the components are paired by the
    bounds of their rows, then the rows. `once` if x and y are the same rows."""

    def cells(rows: DataFrame, name: str) -> DataFrame:
        bounds = F.min("far").alias("near"), F.max("far").alias("far"), F.min("size").alias("size"), F.max("reach").alias("reach")
        return rows.groupBy(*keys, F.col("component").alias(name)).agg(*bounds)

    def same(*names: str):
        return [F.col(f"{names[0]}.{k}") == F.col(f"{names[1]}.{k}") for k in keys]

    a, b = cells(x, "cx").alias("a"), cells(y, "cy").alias("b")
    far, size = F.greatest(F.col("a.near") - F.col("b.far"), F.col("b.near") - F.col("a.far")) <= SLACK, (F.col("a.size") <= F.col("b.reach")) & (F.col("b.size") <= F.col("a.reach"))
    apart = F.col("cx") < F.col("cy") if once else F.col("cx") != F.col("cy")
    pairs = a.join(b, [*same("a", "b"), apart, far, size]).select(*[F.col(f"a.{k}") for k in keys], "cx", "cy").alias("c")
    left = x.alias("x").join(pairs, [*same("x", "c"), F.col("x.component") == F.col("c.cx")]).select("x.*", "cy").alias("x")
    near = F.abs(F.col("x.far") - F.col("y.far")) <= SLACK
    return left.join(y.alias("y"), [*same("x", "y"), F.col("x.cy") == F.col("y.component"), near, F.col("y.size") <= F.col("x.reach"), F.col("x.size") <= F.col("y.reach")])


def _missed(around: DataFrame, found: DataFrame, blobs: DataFrame, scratch: base.Scratch) -> DataFrame | None:
    """Links (a, b) of texts around the same pivot that are in different components so far; None if all texts around each pivot are in one."""
    spots = around.select(F.col("a").alias("p"), F.col("b").alias("node"), "common", F.col("size_a").alias("p_size"), F.col("size_b").alias("size"), "similarity")
    spots = scratch.keep(spots.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "spots")
    parted = spots.groupBy("p").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").drop("low", "high")
    spots = scratch.keep(base.join_back(spots, parted, ["p"], "node"), "parted")
    if spots.isEmpty():
        return None

    rows = _with_texts(spots.select("p", "node", "component"), blobs, "p", "node").mapInArrow(_outer, "p long not null, node long not null, component long not null, shingle long not null")
    rows = scratch.keep(rows, "outer")
    lists = rows.groupBy("p", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").drop("low", "high")
    foreign = scratch.keep(base.join_back(rows, lists, ["p", "shingle"], "node"), "foreign")  # shingles that texts of two components or more have
    # What a text can have in common with one of another component: what the pivot has too, and these.
    others = foreign.groupBy("p", "node").agg(F.count("*").alias("others"))
    shared = F.col("common") + F.coalesce("others", F.lit(0))
    able = spots.join(others, ["p", "node"], "left").where(shared >= THRESHOLD * F.col("size") - 1e-6)
    able = able.withColumns({"far": 1 - F.col("similarity"), "reach": shared * SHARE - F.col("size") + 1e-6, "within": F.col("common") * SHARE - F.col("size") + 1e-6})
    able = scratch.keep(able.drop("others"), "able")

    # A pair whose common shingles are all the pivot's: each is at most `within` the other's size. So one is smaller than the pivot, or both are linked to it.
    inner = able.where(F.col("within") >= THRESHOLD * F.col("size") - 1e-5)
    inside = _across(inner.where("size < p_size"), inner.where(F.col("similarity") < THRESHOLD), ["p"], False).where((F.col("x.size") <= F.col("y.within")) & (F.col("y.size") <= F.col("x.within")))
    # Any other pair has a shingle in common that the pivot lacks.
    outer = scratch.keep(foreign.join(able.select("p", "node", "size", "far", "reach"), ["p", "node"]), "outer")
    outside = _across(outer, outer, ["p", "shingle"], True)
    wanted = [j.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")) for j in (inside, outside)]
    return scratch.keep(_verified(wanted[0].union(wanted[1]).distinct(), blobs).where(F.col("similarity") >= THRESHOLD).select("a", "b"), "missed")


def _texts(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The ids, keys and numbers of all rows, and one row per key: least (its smallest id), class_id and class_key (those of the first text of its class) and n (its rows)."""
    spark = df.sparkSession
    base.prepare(spark)
    scratch = base.Scratch(spark, "neardup")
    signed = scratch.keep(_signed(df, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "signed")  # narrow, and read twice
    # A text is a node, numbered in the order of its smallest id, then its key. The number is made once, in the written table, from which everything else reads it.
    order = [F.col("least").asc_nulls_last(), F.col("key").asc()]
    unique = signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("bands").alias("bands"), F.count("*").alias("n"))
    unique = scratch.keep(unique.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "unique")

    buckets = unique.select("node", "bands").mapInArrow(_bucket_rows, "bucket long not null, node long not null")
    full = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a < z").drop("z")
    members = scratch.keep(base.join_back(buckets, full, ["bucket"], "node"), "members")  # only texts that share a bucket
    wanted = unique.join(members.select("node").distinct(), "node", "left_semi").select("node", "key", _named(F.col("least")).alias("name"))
    blobs = scratch.keep(_blobs(df, doc_id, text).join(wanted, ["name", "key"]).groupBy("node").agg(F.min("blob").alias("blob")), "blobs")  # dealt out by id too: copies of a text have others
    sims = scratch.keep(_verified(members.where("node > a").select("a", F.col("node").alias("b")).distinct(), blobs), "stars")

    # The pivot of a bucket whose texts are not all linked to its smallest: the text that is most similar to that.
    best = F.struct("similarity", -F.col("node"))
    near = members.join(sims.select("a", F.col("b").alias("node"), "similarity"), ["a", "node"])
    pivots = scratch.keep(near.groupBy("bucket").agg(F.max_by("node", best).alias("p"), F.min("similarity").alias("least")).where(F.col("least") < THRESHOLD).drop("least"), "pivots")
    spots = members.join(pivots, "bucket").where("node <> p").select(F.col("p").alias("a"), F.col("node").alias("b")).distinct()
    around = scratch.keep(_verified(spots, blobs), "around")
    linked = F.col("similarity") >= THRESHOLD
    links = sims.where(linked).select("a", "b").union(around.where(linked).select("a", "b"))
    found = scratch.keep(components(links, scratch), "found")

    more = _missed(around, found, blobs, scratch)
    if more is not None and not more.isEmpty():  # links between components: these are the nodes of a smaller graph
        for side in "ab":
            more = more.join(found.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
        joined = scratch.keep(components(more, scratch), "joined")
        old = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        found = scratch.keep(old.union(joined.join(found, "node", "left_anti").select("node", "component")), "classes")

    heads = found.where("node <> component").join(unique.select(F.col("node").alias("component"), F.col("least").alias("class_id"), F.col("key").alias("class_key")), "component").drop("component")
    first = F.col("class_key").isNull()  # of its class, or alone
    texts = unique.join(heads, "node", "left").select("key", "least", F.when(first, F.col("least")).otherwise(F.col("class_id")).alias("class_id"), F.when(first, F.col("key")).otherwise(F.col("class_key")).alias("class_key"), "n")
    texts = scratch.keep(texts, "texts")
    scratch.drop_all_but(signed, texts)
    return signed.select("doc_id", "key", "row"), texts


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_id (the smallest id of the same words) and class_id (the smallest id of the class).

    As ids may be null or repeated, text_key and class_key (the key of the text that gives the class its id) tell texts and classes apart.
    """
    rows, texts = _texts(df, doc_id, text)
    out = base.join_back(rows, texts, ["key"], "row")
    return out.select("doc_id", F.col("least").alias("text_id"), "class_id", F.hex("key").alias("text_key"), F.hex("class_key").alias("class_key"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id, then the smallest key; of rows with both, the smallest text. All columns."""
    _, texts = _texts(df, doc_id, text)
    heads = texts.where("key = class_key").select(_named(F.col("least")).alias("__tarn_id"), F.col("key").alias("__tarn_key"))
    left = _keyed(df, doc_id, text).withColumn("__tarn_id", _named(F.col(doc_id))).join(heads, ["__tarn_id", "__tarn_key"], "left_semi")
    first = F.row_number().over(W.partitionBy("__tarn_id", "__tarn_key").orderBy(text))
    return left.withColumn("__tarn_n", first).where("__tarn_n = 1").select(*[left[c] for c in df.columns])
