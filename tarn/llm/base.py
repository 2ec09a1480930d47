"""What the text operators share: Arrow batches cut to a bounded size, and numpy views of words and their hashes.

A batch of texts is handled as one UTF-8 byte array with document offsets, so that no step loops over characters in Python.
"""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
#: Bytes that are hashed at once, whatever the length of the text.
HASH_BYTES = 1 << 18

MASK = (1 << 64) - 1
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small where texts are long."""
    if hasattr(spark, "sparkContext"):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
        if _ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_HOLDERS: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called in a worker by an operator that keeps caches: those of other operators, which ran in the same worker before, go."""
    others = [k for k in _HOLDERS if k != name]
    for other in others:
        _HOLDERS.pop(other)()
    _HOLDERS[name] = clear
    if others:
        release()


def release() -> None:
    """Give free memory of this worker back to the system: it waits for other tasks, and others share its machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one (tests) gets a folder of its own; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if not place:
            import tempfile

            place = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


class Scratch:
    """Tables of one run in the shared folder. A written table cuts lineage, survives lost executors, and is read with its size known, in as many parts as that
    needs. What is dropped goes at once, the rest when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        self._with(self.root, "deleteOnExit")

    def _with(self, place: str, action: str, *more) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        getattr(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), action)(path, *more)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written and read again."""
        schema, place = df.schema, f"{self.root}/{len(self.kept)}-{name}"
        df.write.option("compression", "zstd").parquet(place)
        self.kept[place] = out = self.spark.read.schema(schema).parquet(place)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for place, kept in self.kept.items():
            if any(kept is t for t in tables):
                self._with(place, "delete", True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[kept for kept in self.kept.values() if not any(kept is t for t in tables)])


def passes(batches: Iterator[pa.RecordBatch], text: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(size), 0
        while start < len(size):
            done = int(total[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def map_texts(df: DataFrame, columns: list[str], text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply `work` to bounded batches of the named columns. Other columns, whatever their names, are not read."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passes(batches, text):
            yield work(part)

    return df.select(*[df[c] for c in columns]).mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows for which `keep` returns true, with all their columns."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passes(batches, text):
            yield part.filter(pa.array(keep(part)))

    return df.mapInArrow(run, df.schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]


#: Keys that may be hot at most, and parts that the rows of a hot key are dealt into.
HOT_KEYS, PARTS = 1000, 64


def join_back(rows: DataFrame, summary: DataFrame, keys: list[str], spread: str, n: str = "n") -> DataFrame:
    """rows joined with a summary of them by keys (one row a key, with its count n), with rows of hot keys dealt out by `spread` too.

    A key is hot if it has over a HOT_KEYS-th of the rows counted in the summary. So there are fewer than HOT_KEYS of them, whatever the input, and they may be broadcast.
    """
    total = summary.agg(F.sum(n).alias("_total"))  # one row
    hot = F.broadcast(summary.crossJoin(F.broadcast(total)).where(F.col(n) * HOT_KEYS > F.col("_total")).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(hot, keys, "left").withColumn("_part", part).drop("_hot")
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(summary.join(hot, keys, "left").withColumn("_part", copies).drop("_hot", n), [*keys, "_part"]).drop("_part")


def record(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the columns that a schema ("a long, b array<int>") names, from arrays or lists in that order."""
    fields = [f.split()[:2] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, type=_arrow(k)) for (_, k), v in zip(fields, columns.values(), strict=True)], names=[n for n, _ in fields])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows in them. Null counts as empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of a batch of texts: maximal runs of bytes that `inside` marks, by default all but space and bytes 9 to 13."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray = ~_SPACE):
        self.data, self.offs = data, offs
        edge = offs[:-1][offs[:-1] < offs[1:]]
        on = inside[data]
        begin = on.copy()
        begin[1:] &= ~on[:-1]
        begin[edge] = on[edge]
        final = on
        final[:-1] &= begin[1:] | ~inside[data[1:]]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(final) + 1
        #: The words of document i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


_TABLES: dict[int, tuple[np.ndarray, int, int]] = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the 256 bytes, and the powers of an odd base and of its inverse modulo 2**64."""
    if seed not in _TABLES:
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 62, 1 << 63)) * 2 | 5
        _TABLES[seed] = (rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base & MASK, pow(base, -1, 1 << 64))
    table, base, inverse = _TABLES[seed]
    if seed not in _POWERS or len(_POWERS[seed][0]) <= n:  # n + 1 powers, so that a stretch of n bytes is never taken for a longer one
        size = max(n, 1 << 16)
        steps = np.empty((2, size + 1), np.uint64)
        steps[:, 0], steps[0, 1:], steps[1, 1:] = 1, base, inverse
        with np.errstate(over="ignore"):
            up, down = np.multiply.accumulate(steps, axis=1)
        _POWERS[seed] = (up, down)
    return table, *_POWERS[seed]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans in order of their starts: polynomial sums by prefix, moved to a common origin, then mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            k = max(i + 1, int(np.searchsorted(ends, low + HASH_BYTES, side="right")))
            high = int(ends[k - 1])
            table, up, down = _powers(seed, min(high - low, 4 * HASH_BYTES))
            if high - low >= len(up):  # one span that is longer than the powers kept, which grow to any stretch of several
                assert k == i + 1
                out[i] = _long_hash(data[low:high], table, up)
            else:
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:])
                a, b = starts[i:k] - low, ends[i:k] - low
                out[i:k] = mix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            i = k
    return out


def _long_hash(span: np.ndarray, table: np.ndarray, up: np.ndarray) -> np.uint64:
    """The same value as the prefix form, piece by piece."""
    total, scale, step = 0, 1, len(up) - 1
    for at in range(0, len(span), step):
        piece = span[at : at + step]
        total = (total + scale * int(np.sum(table[piece] * up[: len(piece)], dtype=np.uint64))) & MASK
        scale = scale * int(up[step]) & MASK
    return mix(np.array([total ^ (len(span) * 0x9E3779B97F4A7C15 & MASK)], np.uint64))[0]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values; the run that starts at i is at i, so there are len(h) - n + 1."""
    size = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size, np.uint64)
        for k in range(n):
            total *= np.uint64(0x9FB21C651E98DF25)
            total += h[k : k + size]
    return mix(total)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that lie in one document."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(total - n + 1)
    return at[at + n <= first[1:][owner[: total - n + 1]]]
