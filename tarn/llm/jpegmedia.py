"""Baseline JPEG as a media column: markers, Huffman scans and DC-only luminance thumbnails in numpy.

Reading: markers are parsed, byte stuffing is removed, and all restart intervals of all images of a batch that share their tables are
decoded side by side, one Huffman symbol a step. Of each block only the DC coefficient is kept; times its quantiser, over eight,
plus 128, it is the block's mean, so the DCs of the luminance are a thumbnail at an eighth of the size. AC symbols are read and skipped.
An image whose components come in scans of their own is read from that of its luminance. `thumbnails` does this for a column of any media; an image that can't be read (no or
other JPEG, cut off, a code that no table has, too many or too few intervals) is a row with an error and without values, and stops nothing.

Writing: bytes are stored without loss as the means of flat grey blocks, 64 blocks a row and a restart interval each row, at most
ROWS rows an image; longer payloads are several images end to end.

A null or empty text is a payload of 64 zero bytes; very long ones are stored whole, in more images. A null or empty medium has no images, which is an error too. Equal texts or media
get equal values, repeated rows a row each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import base

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, images long"
MEDIA_SCHEMA = "doc_id long, media_bytes long, images int, width int, height int, thumbnail_sha256 string, feature string, error string"
COLUMNS, ROWS = 64, 8000

# The typical luminance DC table of the JPEG standard (counts of codes of 1 to 16 bits, then the categories).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
# The only AC symbol in stored payloads is the end of a block, as one zero bit.
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a Huffman table: codes of a length follow each other, a longer length doubles them."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """Symbol and length (symbol << 8 | bits) for each 16-bit prefix; 0 where no code is."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, bits in codes(counts, symbols):
        table[code << 16 - bits : code + 1 << 16 - bits] = symbol << 8 | bits
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255 to 255: the bits of the category, the difference and the end of the block, and their number."""
    of = {s: (c, n) for s, c, n in codes(DC_COUNTS, DC_SYMBOLS)}
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = of[size]
        value[d + 255] = ((code << size) + (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = bits + size + 1
    return value, length


VALUE, LENGTH = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    quant = bytes([8, *[1] * 63])
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\x00" + quant), _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLUMNS * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)), _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", COLUMNS)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """An image of each payload: COLUMNS blocks a row, at most ROWS rows."""
    rows = np.array([len(p) // COLUMNS for p in payloads])
    grid = np.concatenate(payloads).astype(np.int64).reshape(-1, COLUMNS)
    diff = np.diff(grid, axis=1, prepend=128) + 255
    value, length = VALUE[diff], LENGTH[diff]
    ends = np.cumsum(length, axis=1)
    size = -(-ends[:, -1] // 8)  # bytes of each row, filled up with ones
    base_bit = (np.cumsum(size) - size) * 8
    at = (ends - length + base_bit[:, None]).ravel()
    fill = size * 8 - ends[:, -1]
    at = np.concatenate([at, base_bit + ends[:, -1]])
    value = np.concatenate([value.ravel(), (1 << fill).astype(np.uint64) - np.uint64(1)])
    length = np.concatenate([length.ravel(), fill])
    word, shift = at >> 5, (64 - (at & 31) - length).astype(np.uint64)
    placed = value << (shift & np.uint64(63))
    bits = np.zeros(int(size.sum()) // 4 + 3, np.uint64)
    np.add.at(bits, word, placed >> np.uint64(32))
    np.add.at(bits, word + 1, placed & np.uint64(0xFFFFFFFF))
    plain = np.frombuffer(bits.astype(">u4").tobytes(), np.uint8)[: int(size.sum())]
    # Room for a zero after each 255, and for a restart marker after each row but an image's last.
    full = plain == 255
    last = np.cumsum(rows) - 1
    marked = np.ones(len(grid), bool)
    marked[last] = False
    within = np.arange(len(grid)) - np.repeat(np.cumsum(rows) - rows, rows)
    row_of = np.repeat(np.arange(len(grid)), size)
    before = np.cumsum(marked) - marked
    target = np.arange(len(plain)) + np.cumsum(full) - full + 2 * before[row_of]
    out = np.zeros(len(plain) + int(full.sum()) + 2 * int(marked.sum()), np.uint8)
    out[target] = plain
    stops = np.cumsum(size) - 1
    tail = target[stops] + full[stops] + 1  # where a row's bytes end
    out[tail[marked]] = 255
    out[tail[marked] + 1] = 0xD0 + within[marked] % 8
    raw, begins = out.tobytes(), np.concatenate([[0], tail[last[:-1]]])
    return [header(int(n)) + raw[a:b] + b"\xff\xd9" for n, a, b in zip(rows, begins.tolist(), tail[last].tolist())]


def _markers(data: bytes, at: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(marker, body, end of the segment, end of the coded bytes after it) of the segments from a place on."""
    while True:
        if at + 1 < len(data) and data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 2 > len(data):
            raise ValueError("the image has no end")
        marker = data[at + 1]
        if marker == 0xD9:
            yield marker, b"", at + 2, at + 2
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("a segment is cut off")
        begin, at = at + 4, at + 2 + size
        stop = at
        if marker == 0xDA:
            found = _SCAN_END.search(data, at)
            if not found:
                raise ValueError("the image has no end")
            stop = found.start()
        yield marker, data[begin:at], at, stop
        at = stop


_SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.DOTALL)


class Image:
    """What the markers of one image say, and the entropy-coded bytes of the scan that has its luminance, its first component."""

    def __init__(self, data: bytes, start: int = 0):
        quant, tables, interval, parts, self.scan = {}, {}, 0, None, None
        if data[start : start + 2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        for marker, body, begin, self.end in _markers(data, start + 2):
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    step = 2 if wide else 1
                    quant[body[0] & 15] = int.from_bytes(body[1 : 1 + step], "big")  # the DC's
                    body = body[1 + 64 * step :]
            elif marker == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    n = sum(counts)
                    if len(counts) < 16 or len(body) < 17 + n or sum(c << 16 - k for k, c in enumerate(counts, 1)) > 1 << 16:
                        raise ValueError("no Huffman table")
                    tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                if depth != 8 or not (self.height and self.width and parts) or not all(1 <= p[1] <= 4 and 1 <= p[2] <= 4 for p in parts):
                    raise ValueError("no frame of 8-bit samples")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline images are read")
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xDA and self.scan is None:
                if not parts:
                    raise ValueError("a scan before its frame")
                of = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if parts[0][0] in of:
                    scan = [(*p, tables.get(of[p[0]] >> 4), tables.get(16 + (of[p[0]] & 15))) for p in parts if p[0] in of]
                    if any(x is None for p in scan for x in p) or parts[0][3] not in quant:
                        raise ValueError("a table is missing")
                    self.scan, self.interval, self.quant, self.coded = scan, interval, quant[parts[0][3]], data[begin : self.end]
        if self.scan is None:
            raise ValueError("no scan of the luminance")
        single = len(self.scan) == 1
        wide, high = (max(p[k] for p in parts) for k in (1, 2))
        if single:  # blocks of the component, row by row
            columns, lines = (-(-size * parts[0][k] // most) for size, k, most in ((self.width, 1, wide), (self.height, 2, high)))
            self.across, self.down = -(-columns // 8), -(-lines // 8)
        else:
            columns, lines = self.width, self.height
            self.across, self.down = -(-columns // (8 * wide)), -(-lines // (8 * high))
        self.shape = -(-lines // 8), -(-columns // 8)
        self.layout = tuple((1 if single else p[1], 1 if single else p[2], p[4], p[5]) for p in self.scan)
        if self.across * self.down * sum(h * v for h, v, *_ in self.layout) > 4 * len(self.coded):  # a block takes two bits at least
            raise ValueError("the scan is cut off")

    def thumbnail(self, dc: np.ndarray) -> np.ndarray:
        """Means of the luminance blocks from the DCs (MCU, block of the MCU)."""
        h, v = self.layout[0][:2]
        grid = dc.reshape(self.down, self.across, v, h).transpose(0, 2, 1, 3).reshape(self.down * v, self.across * h)
        means = grid * self.quant / 8 + 128
        return np.clip(np.rint(means), 0, 255).astype(np.uint8)[: self.shape[0], : self.shape[1]]


def images(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        out.append(Image(data, at))
        at = out[-1].end
    return out


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _table(key: tuple) -> np.ndarray:
    if key not in _LOOKUPS:
        _LOOKUPS[key] = lookup(*key)
    return _LOOKUPS[key]


def decode(pictures: list[Image]) -> list[np.ndarray | None]:
    """Luminance thumbnails, None of images whose coded bytes are no scan of theirs; images that share layout and tables are decoded together."""
    out: list[np.ndarray | None] = [None] * len(pictures)
    alike: dict[tuple, list[int]] = {}
    for k, p in enumerate(pictures):
        alike.setdefault(p.layout, []).append(k)
    for layout, members in alike.items():
        for k, dc in zip(members, _decode_alike([pictures[k] for k in members], layout)):
            out[k] = None if dc is None else pictures[k].thumbnail(dc)
    return out


def _decode_alike(group: list[Image], layout: tuple) -> list[np.ndarray | None]:
    sizes = np.array([len(p.coded) for p in group])
    raw = np.frombuffer(b"".join(p.coded for p in group), np.uint8)
    begins = np.cumsum(sizes) - sizes
    after = np.append(raw[1:], 0)
    full = raw == 255
    marker = full & (after >= 0xD0) & (after <= 0xD7)
    gone = marker.copy()
    gone[1:] |= marker[:-1] | (full[:-1] & (raw[1:] == 0))
    place = np.cumsum(~gone) - ~gone  # of each byte among those kept
    plain = np.concatenate([raw[~gone], np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = plain[:-3] << 24 | plain[1:-2] << 16 | plain[2:-1] << 8 | plain[3:]
    place = np.append(place, len(plain) - 8)
    starts = np.sort(np.concatenate([begins, np.flatnonzero(marker) + 2]))
    owner = np.searchsorted(begins, starts, side="right") - 1
    rank = np.arange(len(starts)) - np.searchsorted(owner, owner)
    total = np.array([p.across * p.down for p in group])
    step = np.array([p.interval or p.across * p.down for p in group])
    count = np.minimum(step[owner], total[owner] - rank * step[owner])  # MCUs of each interval
    broken = (np.bincount(owner, minlength=len(group)) != -(-total // step)) | (np.bincount(owner, np.maximum(count, 0), len(group)) != total)
    count[broken[owner]] = 0
    bit = place[starts].astype(np.int64) * 8
    limit = np.append(place[starts[1:]], len(plain) - 8) * 8  # an interval's bits end where the next one's begin
    odd = np.zeros(len(starts), bool)  # intervals with a code that no table has
    first = np.cumsum(total) - total
    target = first[owner] + rank * step[owner]
    luma = layout[0][0] * layout[0][1]
    dcs = np.zeros((int(total.sum()), luma), np.int64)
    last = np.zeros((len(layout), len(starts)), np.int64)
    order = np.argsort(-count, kind="stable")
    bit, count, target, last, limit = bit[order], count[order], target[order], last[:, order], limit[order]
    tables = [(_table(x[2]), _table(x[3]), x[0] * x[1]) for x in layout]

    def peek(at: np.ndarray) -> np.ndarray:
        return window[np.minimum(at >> 3, len(window) - 1)] >> (16 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)

    for m in range(int(count.max(initial=0))):
        n = int(np.searchsorted(-count, -m, side="left"))  # intervals with an MCU number m
        for c, (dc_table, ac_table, blocks) in enumerate(tables):
            for block in range(blocks):
                now = bit[:n]
                found = dc_table[peek(now)]
                odd[:n] |= (found == 0) | (found >> 8 > 11)
                now = now + (found & 255)
                size = (found >> 8).astype(np.int64)
                extra = (peek(now) >> (16 - size).astype(np.uint32)).astype(np.int64)
                now += size
                low = extra < (1 << size >> 1)
                last[c, :n] += extra - np.where(low, (1 << size) - 1, 0)
                if not c:
                    dcs[target[:n] + m, block] = last[c, :n]
                found = ac_table[peek(now)]
                odd[:n] |= found == 0
                now += found & 255
                busy = np.flatnonzero(found >> 8)
                seen = np.zeros(len(busy), np.int64)  # AC coefficients so far
                found = found[busy]
                while len(busy):
                    symbol = (found >> 8).astype(np.int64)
                    now[busy] += symbol & 15
                    seen += (symbol >> 4) + 1
                    on = seen < 63
                    busy, seen = busy[on], seen[on]
                    found = ac_table[peek(now[busy])]
                    odd[busy[found == 0]] = True
                    now[busy] += found & 255
                    on = found >> 8 != 0
                    busy, seen, found = busy[on], seen[on], found[on]
                bit[:n] = now
    broken[owner[order[odd | (bit > limit)]]] = True
    return [None if bad else dcs[a : a + n] for a, n, bad in zip(first, total, broken)]


def fingerprint(grid: np.ndarray) -> str:
    """Dimensions, then average and gradient hashes of the thumbnail at 8 x 8."""
    h, w = grid.shape
    rows, cols = np.arange(9) * h // 8, np.arange(9) * w // 8
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)
    r0, c0 = np.minimum(rows[:-1], h - 1), np.minimum(cols[:-1], w - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    cells = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    average = np.packbits(cells > cells.mean()).tobytes().hex()
    gradient = np.packbits(np.diff(cells, axis=1, append=cells[:, :1]) > 0).tobytes().hex()
    return f"{w * 8}x{h * 8}:{average}:{gradient}"


def store(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Media of a batch of texts, the bytes of each text and of each payload."""
    data, offs = base.text_bytes(texts)
    size = np.diff(offs)
    padded = np.maximum(-(-size // COLUMNS), 1) * COLUMNS
    owner, cut = [], []
    for k, (a, n, p) in enumerate(zip(offs, size, padded)):
        for at in range(0, int(p), COLUMNS * ROWS):
            stop = min(int(p), at + COLUMNS * ROWS)
            piece = data[a + at : a + min(int(n), stop)]
            cut.append(piece if len(piece) == stop - at else np.concatenate([piece, np.zeros(stop - at - len(piece), np.uint8)]))
            owner.append(k)
    coded, todo = [], 0
    while todo < len(cut):
        stop, room = todo + 1, base.PASS_BYTES - len(cut[todo])
        while stop < len(cut) and len(cut[stop]) <= room:
            room -= len(cut[stop])
            stop += 1
        coded += encode(cut[todo:stop])
        todo = stop
    media: list[list[bytes]] = [[] for _ in size]
    for k, c in zip(owner, coded):
        media[k].append(c)
    return [b"".join(m) for m in media], size, padded


def parsed(medium: bytes | None) -> list[Image] | str:
    """The images of a medium, or why they can't be read."""
    try:
        return images(medium) if medium else "no image"
    except ValueError as e:
        return str(e)
    except (IndexError, struct.error):
        return "a segment is cut off"


def read(media: list[bytes | None]) -> list[list[np.ndarray] | str]:
    """Thumbnails of the images of each medium, or why they can't be read."""
    found = [parsed(m) for m in media]
    flat = [p for group in found if not isinstance(group, str) for p in group]
    grids: list[np.ndarray | None] = []
    at = 0
    while at < len(flat):
        stop, room = at + 1, base.PASS_BYTES
        while stop < len(flat) and (room := room - flat[stop].across * flat[stop].down) > 0:
            stop += 1
        grids += decode(flat[at:stop])
        at = stop
    left, out = iter(grids), []
    for group in found:
        own = group if isinstance(group, str) else [next(left) for _ in group]
        out.append("the scan can't be decoded" if any(g is None for g in own) else own)
    return out


def thumbnails(df: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """Dimensions and thumbnail hashes of the JPEGs in a binary column (MEDIA_SCHEMA): width and height of the first image, the digest of all thumbnails' samples, and
    their fingerprints. `error` says why a medium can't be read."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        data, rows = b.column(media).to_pylist(), []
        for doc, m, grids in zip(b.column(doc_id).to_pylist(), data, read(data)):
            if isinstance(grids, str):
                rows.append((doc, len(m or b""), None, None, None, None, None, grids))
            else:
                first = Image(m)
                rows.append((doc, len(m), len(grids), first.width, first.height, hashlib.sha256(b"".join(g.tobytes() for g in grids)).hexdigest(), "|".join(fingerprint(g) for g in grids), None))
        return base.record(MEDIA_SCHEMA, **dict(zip("abcdefgh", zip(*rows))))

    return base.map_texts(df, [doc_id, media], media, work, MEDIA_SCHEMA)


def media_features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as JPEG, read it back, and give digests, dimensions and thumbnail hashes (SCHEMA)."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        media, size, padded = store(b.column(text))
        rows = []
        for doc, n, p, m, grids in zip(b.column(doc_id).to_pylist(), size, padded, media, read(media)):
            payload = b"".join(g.tobytes() for g in grids)
            feature = "|".join(fingerprint(g) for g in grids)
            sums = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-COLUMNS:]), len(m), hashlib.sha256(m).hexdigest()
            rows.append((doc, n, len(payload), *sums, feature, grids[0].shape[1] * 8, sum(g.shape[0] for g in grids) * 8, len(grids)))
        return base.record(SCHEMA, **dict(zip("abcdefghijk", zip(*rows))))

    return base.map_texts(df, [doc_id, text], text, work, SCHEMA)
