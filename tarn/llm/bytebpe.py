"""Byte-level BPE without a regex engine.

Token boundaries of the usual splitting pattern come from a small automaton over codepoint classes. Its transition
functions compose associatively, so whole batches are scanned in numpy: blocks of codepoints are composed side by side, the
compositions of blocks are scanned by doubling, and each block is then replayed from its known entry state. The slices between
boundaries are merged pair by pair by rank, with a cache; byte offsets of the pieces are kept, and decoding uses them.

The pattern, in order: 's 't 're 've 'm 'll 'd | ?letters | ?numbers | ?others | spaces not before a non-space | spaces.
A null or empty text has no ids; both digests are those of the empty string. Very long texts are encoded whole. Equal texts get equal results, repeated rows a row each; of
pairs of one rank the leftmost is merged first. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import base

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, ids array<int>, starts array<int>"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Slices that one generation of the cache holds; two generations are kept.
CACHE = 400_000
BLOCK = 128

# Classes of codepoints. LETTER1: s t m d, that complete a contraction; PAIR1: r v l that their next letter completes.
LETTER, LETTER1, PAIR1, NUMBER, OTHER, QUOTE, BLANK, SPACE_LAST, WHITE_LAST, WHITE, START = range(11)
# States after a codepoint: what the piece that it belongs to still takes. FRESH: nothing.
FRESH, LETTERS, NUMBERS, OTHERS, QUOTED, HALF, JOIN, SPACES = range(8)
N_STATES = 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """move[class, state] and begins[class, state]: the next state, and whether the codepoint begins a piece."""
    move, begins = np.zeros((11, N_STATES), np.uint8), np.zeros((11, N_STATES), bool)

    def rule(classes, state_after, goes_on, special=()):
        for c in classes:
            move[c, :], begins[c, :] = state_after, True
            begins[c, list(goes_on)] = False
            for state, after in special:
                move[c, state], begins[c, state] = after, False

    rule((LETTER, LETTER1, PAIR1), LETTERS, (LETTERS, JOIN), [(HALF, FRESH)])
    move[LETTER1, QUOTED], begins[LETTER1, QUOTED] = FRESH, False
    move[PAIR1, QUOTED], begins[PAIR1, QUOTED] = HALF, False
    rule((NUMBER,), NUMBERS, (NUMBERS, JOIN))
    rule((OTHER,), OTHERS, (OTHERS, JOIN, QUOTED))
    rule((QUOTE,), QUOTED, (), [(OTHERS, OTHERS), (JOIN, OTHERS), (QUOTED, OTHERS)])
    rule((SPACE_LAST,), JOIN, ())
    rule((WHITE_LAST,), FRESH, ())
    rule((WHITE,), SPACES, (SPACES,))
    rule((START,), FRESH, ())
    return move, begins


MOVE, BEGINS = _tables()
_CLASSES: list[np.ndarray] = []


def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for every codepoint, as the tiktoken library's Unicode tables have it; ASCII specials refined."""
    if not _CLASSES:
        import tiktoken

        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
        everything = points.astype("<u4").tobytes().decode("utf-32-le")
        bytes_only = {bytes([i]): i for i in range(256)}
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            probe = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
            found = bytes(probe.encode_ordinary(everything)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        table[ord("'")], table[ord(" ")] = QUOTE, BLANK
        table[[ord(c) for c in "stmd"]] = LETTER1
        _CLASSES.append(table)
    return _CLASSES[0]


def classify(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Classes of codepoints with one codepoint of lookahead; a virtual START stands before each text, at `begin`."""
    table = codepoint_classes()
    kinds = np.insert(table[points], begin, START)
    seen = np.insert(points, begin, 0)
    after, nextp = np.append(kinds[1:], START), np.append(seen[1:], 0)
    for first, second in (("r", "e"), ("v", "e"), ("l", "l")):
        kinds[(seen == ord(first)) & (nextp == ord(second))] = PAIR1
    white = (kinds == WHITE) | (kinds == BLANK)
    last = white & ~((after == WHITE) | (after == BLANK) | (after == START))
    kinds[last & (kinds == BLANK)] = SPACE_LAST
    kinds[last & (kinds == WHITE)] = WHITE_LAST
    kinds[kinds == BLANK] = WHITE
    return kinds


def scan(kinds: np.ndarray) -> np.ndarray:
    """Does a piece begin at each codepoint: a scan of transition functions, in blocks."""
    n = len(kinds)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, START, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat = MOVE.ravel()
    whole = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (blocks, N_STATES)).copy()
    for row in grid:  # the function of each block
        whole = flat[row[:, None].astype(np.int16) * N_STATES + whole]
    step = 1
    while step < blocks:  # functions of all blocks up to each: composition is associative
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.full(blocks, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((BLOCK, blocks), bool)
    starts = BEGINS.ravel()
    for k, row in enumerate(grid):
        at = row.astype(np.int16) * N_STATES + state
        out[k], state = starts[at], flat[at]
    return out.T.ravel()[:n]


def pieces(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, the byte offsets where pieces begin and end, and the first piece of each text (n + 1 of them)."""
    data, offs = base.text_bytes(texts)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)  # where each codepoint lies
    begin = np.searchsorted(at_byte, offs[:-1])
    kinds = classify(points, begin)
    starts = np.flatnonzero(scan(kinds)[kinds != START])
    starts = at_byte[starts]
    return raw, starts, np.append(starts[1:], len(raw)), np.searchsorted(starts, offs)


class Bpe:
    """Ranks, pair merging with a cache of two generations, and decoding tables."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.decimal = [b"%d" % k for k in range(len(self.bytes_of))]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of lowest rank, leftmost first, merges until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while costs and (low := min(costs)) < 1 << 30:
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap and links, for pieces where rescanning would be quadratic."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end, after, before = [*range(1, n + 1)], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:  # one of the two has merged otherwise
                continue
            end[i], after[i] = stop, after[j]
            end[j] = 0
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, slices: list[bytes]) -> list[bytes]:
        """For each slice its ids as 32-bit little-endian integers."""
        young, old = self.young, self.old
        if len(young) > CACHE:
            self.old, self.young = old, young = young, {}
        for s in set(slices).difference(young):
            young[s] = old.get(s) or np.array(self.merge(s), "<u4").tobytes()
        return list(map(young.__getitem__, slices))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    base.claim("bytebpe", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its ids, and the byte offset in the text at which each id begins."""
    coder = bpe(path)
    raw, starts, ends, first = pieces(texts)
    coded = coder.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    ids = np.frombuffer(b"".join(coded), "<u4")
    total = np.concatenate([[0], np.cumsum(lengths)])
    sizes = _sizes(path)[ids]
    at = np.cumsum(sizes) - sizes
    _, offs = base.text_bytes(texts)
    edges = total[first]
    return [ids[a:b] for a, b in zip(edges, edges[1:])], [at[a:b] - o for a, b, o in zip(edges, edges[1:], offs)]


_SIZES: dict[str, np.ndarray] = {}


def _sizes(path: str) -> np.ndarray:
    if path not in _SIZES:
        _SIZES[path] = np.array([len(x) for x in bpe(path).bytes_of], np.int64)
    return _SIZES[path]


def decode_ids(ids: np.ndarray, starts: np.ndarray, path: str) -> bytes:
    """The bytes of a text from its ids, each checked against the offset kept for it."""
    out = bpe(path).decode(ids)
    sizes = _sizes(path)[ids]
    if len(ids) and (not np.array_equal(np.cumsum(sizes) - sizes, starts) or int(starts[-1] + sizes[-1]) != len(out)):
        raise ValueError("ids and offsets do not belong together")
    return out


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text and the byte offsets at which they begin."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts = encode_texts(b.column(text), path)
        return base.record(IDS_SCHEMA, doc_id=b.column(doc_id), ids=ids, starts=starts)

    return base.map_texts(df, [doc_id, text], text, work, IDS_SCHEMA)


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and give digests of both (SCHEMA)."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        ids, starts = encode_texts(b.column(text), path)
        listed = [hashlib.sha256(b",".join(map(coder.decimal.__getitem__, x.tolist()))).hexdigest() for x in ids]
        decoded = [hashlib.sha256(decode_ids(x, at, path)).hexdigest() for x, at in zip(ids, starts)]
        return base.record(SCHEMA, doc_id=b.column(doc_id), n_tokens=[len(x) for x in ids], ids_sha256=listed, decoded_sha256=decoded)

    return base.map_texts(df, [doc_id, text], text, work, SCHEMA)
