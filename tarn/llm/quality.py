"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words of every n-gram that a text has had before; the rules look at
the share of characters that such n-grams and repeated lines cover. All counts are per document, so no data are exchanged.

A null or empty text has no words: its counts are 0, base_failed is true (under 50 words) and kept false. Repeated rows get
equal results. Very long texts are measured whole; of windows or lines that are alike the first is the original. Other columns are not read, or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import base

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "cover_5 double, cover_7 double, cover_10 double, cover_lines double, symbol_share double"
)
#: n-gram length -> largest share of word characters that repeated n-grams may cover.
GRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share of characters in repeated lines, and of symbols among word characters.
LINE_LIMIT, SYMBOL_LIMIT = 0.20, 0.10
MIN_WORDS, WINDOW = 50, 3

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offs[1:]] - total[offs[:-1]]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and has it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    before[order[1:]] = same
    return twice, before


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside the windows of n words that begin at `starts`."""
    change = np.bincount(starts, minlength=total + 1)[: total + 1] - np.bincount(starts + n, minlength=total + 1)[: total + 1]
    return np.cumsum(change)[:total] > 0


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts, coverages and verdicts of a batch of texts."""
    base.claim("quality", lambda: None)
    data, offs = base.text_bytes(texts)
    words = base.Words(data, offs)
    n, doc = words.counts, words.docs()
    point = np.concatenate([[0], np.cumsum(_POINT[data])])
    chars = point[words.ends] - point[words.starts]
    word_chars = _sums(chars, words.first)
    symbols = _sums(_SYMBOL[data], offs)
    hashes = words.hashes()
    salt = base.mix(np.arange(len(n), dtype=np.uint64) + np.uint64(11))

    def gram(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = base.within(words.first, size)
        return at, *_groups(base.gram_hashes(hashes, size)[at] ^ salt[doc[at]])

    at, twice, _ = gram(WINDOW)
    repeat = _sums(_covered(at[twice], WINDOW, len(words)).astype(np.int64), words.first)
    cover = {}
    for size in GRAM_LIMITS:
        at, _, before = gram(size)
        cover[size] = _sums(chars * _covered(at[before], size, len(words)), words.first) / np.maximum(word_chars, 1)

    # Lines: between line feeds, and at document edges. What a final line feed opens is empty and left out.
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, feeds, side="right") - 1
    inner = feeds + 1 < offs[owner + 1]
    opens = np.concatenate([offs[:-1], feeds[inner] + 1])
    order = np.argsort(opens, kind="stable")
    line_starts, line_doc = opens[order], np.concatenate([np.arange(len(n)), owner[inner]])[order]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends[:-1] -= line_doc[1:] == line_doc[:-1]
    closing = np.zeros(len(data) + 1, bool)  # a line's own final feed
    closing[feeds[~inner] + 1] = True
    line_ends -= closing[line_ends] & (line_ends > line_starts)
    a, b = np.searchsorted(words.starts, line_starts), np.searchsorted(words.starts, line_ends)
    worded = b > a
    line_starts, line_ends, line_doc, a, b = (x[worded] for x in (line_starts, line_ends, line_doc, a, b))
    _, seen = _groups(base.span_hashes(data, line_starts, line_ends, 2) ^ salt[line_doc])
    n_dup = np.bincount(line_doc[seen], minlength=len(n))
    prefix = np.concatenate([[0], np.cumsum(chars)])
    dup_chars = np.bincount(line_doc[seen], weights=(prefix[b] - prefix[a])[seen], minlength=len(n))
    lines = dup_chars / np.maximum(word_chars, 1)

    failed = (n < MIN_WORDS) | (100 * repeat > 50 * n)
    share = symbols / np.maximum(word_chars, 1)
    fine = (lines <= LINE_LIMIT) & (share <= SYMBOL_LIMIT)
    for size, limit in GRAM_LIMITS.items():
        fine &= cover[size] <= limit
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & fine,
        **{f"cover_{k}": v for k, v in cover.items()}, "cover_lines": lines, "symbol_share": share,
    }


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with the counts, the coverages and the verdict (SCHEMA)."""
    return base.map_texts(df, [doc_id, text], text, lambda b: base.record(SCHEMA, doc_id=b.column(doc_id), **measures(b.column(text))), SCHEMA)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return base.filter_texts(df, text, lambda b: measures(b.column(text))["kept"])
