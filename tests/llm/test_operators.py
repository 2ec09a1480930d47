"""The ten operators against brute force, exact libraries or round trips, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import base, bytebpe, components, jpegmedia, licenses, neardup, packing, passages, quality, toxicity, warc, wordpieces
from tarn.llm.queries import vocabulary
from tests.llm import brute

ALPHABET = "'stmdrevl  \n\t aB1٣é漢.!?́😀\r\x1c_#%|Σ"


def noise(seed: int, n: int, longest: int = 80) -> list[str | None]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, longest))) for _ in range(n)] + ["", None, "'" * 300, "x" * 3000, " " * 40, "\n"]


def prose(seed: int, n: int, words: int = 120, vocabulary_size: int = 400) -> list[str]:
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary_size)]
    return [" ".join(rnd.choice(names) for _ in range(rnd.randint(5, words))) for _ in range(n)]


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    """Texts with copies, near copies and shared passages; nulls and empty ones."""
    rnd = random.Random(seed)
    texts: list[str | None] = prose(seed, 60)
    shared = " ".join(prose(seed + 1, 1, 60)[0].split() * 2)
    for k in range(40):
        w = texts[rnd.randrange(60)].split()
        for _ in range(rnd.randint(0, max(1, len(w) // 40))):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(1000)}"
        if k % 4 == 0:
            at = rnd.randrange(len(w))
            w[at:at] = shared.split()
        texts.append(" ".join(w))
    return list(enumerate([*texts, "", None, "", "one two", "one two", "..", "word " * 400, texts[0].upper() if texts[0] else None]))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


TEXT_OPERATORS = {
    "packing": lambda df: packing.pack(df, vocabulary(packing.VOCABULARY)),
    "passages": passages.dedup_passages,
    "without_passages": passages.without_passages,
    "licenses": licenses.scan,
    "byte_bpe": lambda df: bytebpe.round_trip(df, vocabulary(bytebpe.VOCABULARY)),
    "byte_bpe_ids": lambda df: bytebpe.encode(df, vocabulary(bytebpe.VOCABULARY)),
    "jpeg": jpegmedia.media_features,
    "toxicity": lambda df: toxicity.score(df, toxicity.Model(["idiot"], [3.0], [1.0], [-3.0, 2.0, 0.5, 0.0, 0.0, 0.0])),
    "neardup": neardup.near_classes,
    "keep_one": neardup.keep_one,
    "wordpieces": lambda df: wordpieces.token_counts(df, vocabulary(wordpieces.VOCABULARY)),
    "quality": quality.quality,
    "keep_good": quality.keep_good,
}
DROPS = {"keep_good", "keep_one"}
LONG = "longer and longer texts come " * 40_000  # over a megabyte, one row


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_edges(spark, name):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with the names of results."""
    rows = [(1, None, 7, "s"), (2, "", 7, None), (3, "a b c", None, "s"), (3, "a b c", None, "s"), (None, "a b c", 1, "s"), (5, LONG, 1, "s"), (6, "x" * 70_000, 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, blob string").repartition(2)
    out = TEXT_OPERATORS[name](df).collect()
    if name == "packing":
        whole = {(r.doc_id, r.doc_tokens): r.doc_tokens for r in out}
        assert sum(r.length for r in out) == sum(whole.values()) + next(n for (d, _), n in whole.items() if d == 3)  # doc 3 comes twice
    elif name not in DROPS:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    if name == "keep_one":
        assert sorted(str(r.doc_id) for r in out) == ["1", "3", "5", "6"] and out[0].asDict().keys() == {"doc_id", "text", "n_words", "blob"}
    if name == "neardup":
        assert len({(r.doc_id, r.class_id) for r in out}) == len(rows) - 1


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_empty_table(spark, name):
    assert TEXT_OPERATORS[name](frame(spark, [])).collect() == []


def test_hashes_of_long_spans():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(50_000)), np.uint8)
    starts, ends = np.array([0, 10, 20_000]), np.array([10, 20_000, 50_000])
    whole = base.span_hashes(data, starts, ends)
    table, up, _ = base._powers(1, 100)
    assert base._long_hash(data[20_000:], table, up[:1000]) == whole[2]
    assert len(set(whole.tolist())) == 3
    assert base.span_hashes(np.tile(data[:10], 2), np.array([0, 10]), np.array([10, 20])).tolist() == [whole[0]] * 2


def test_hashes_do_not_depend_on_what_stands_before(monkeypatch):
    monkeypatch.setattr(base, "HASH_BYTES", 1000)
    base._POWERS.clear()
    rnd = random.Random(4)
    ends = np.cumsum([rnd.randint(1, 40) for _ in range(5000)] + [70_000, 5, 5])
    data = np.frombuffer(rnd.randbytes(int(ends[-1])), np.uint8)
    starts = np.concatenate([[0], ends[:-1]])
    got = base.span_hashes(data, starts, ends)
    alone = [base.span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts.tolist(), ends.tolist())]
    assert got.tolist() == alone
    for size in (999, 1000, 1001, 65_535, 65_536, 65_537):  # at and around the powers that are there
        base._POWERS.clear()
        base._powers(1, size - 1)
        cut = np.array([0, size // 2, size])
        assert base.span_hashes(data[:size], cut[:-1], cut[1:]).tolist() == [base.span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(cut[:-1], cut[1:])]


# 1: packing


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary(packing.VOCABULARY)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    latin = "'stmdrevlLSRE \n\t\x1c\x1f\x85\xa0µªº×÷ß²³¼éÉÀÿÞaB1.,!?_"
    rnd = random.Random(2)
    texts = noise(1, 1500) + ["".join(rnd.choice(latin) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> ΟΔΟΣ", "".join(map(chr, range(256)))]
    got = packing.tokens(path).encode(texts)
    want = plain.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [g.tolist() for g in got] == [[*w.ids, packing.END] for w in want]


@pytest.mark.parametrize(("segments", "loss", "prompts"), [(512, packing.MAX_LOSS, False), (3, 4096, False), (512, 1000, False), (512, packing.MAX_LOSS, True), (512, 2500, True), (9, 0, True)])
def test_packing(spark, segments, loss, prompts):
    rnd = random.Random(8)
    rows = [(k, t, rnd.choice([None, 0, 100, len(t) // 2, len(t), 10**6]) if prompts else 0) for k, t in enumerate(prose(3, 300, 900) + [" ".join(prose(4, 60, 900))])] + [(900 + k, "hi", 0) for k in range(50)]
    df = frame(spark, rows, "doc_id long, text string, prompt int").repartition(3)
    out = packing.pack(df, vocabulary(packing.VOCABULARY), segments=segments, loss=loss, prompt="prompt").toPandas()
    coder = packing.tokens(vocabulary(packing.VOCABULARY))
    ids = dict(zip([d for d, *_ in rows], coder.encode([t for _, t, _ in rows])))
    leads = dict(zip([d for d, *_ in rows], (len(x) - 1 for x in coder.encode([t[: n or 0] for _, t, n in rows]))))
    for doc, g in out.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids[doc])
        assert all(zlib.crc32(ids[doc][r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for r in g.itertuples())
    assert set(out.doc_id) == set(ids)
    padding = most = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        n, lost = int(g.length.sum()), sum(k > r.start and k >= leads[r.doc_id] for r in g.itertuples() for k in range(r.start, r.start + r.length))
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and n <= 4096 and len(g) <= segments and lost == g.loss_tokens.iloc[0] <= loss
        padding += 0 if n & (n - 1) == 0 else 4096 - n
        most = max(most, lost)
    if segments == 512 and loss == packing.MAX_LOSS:
        assert padding < 0.01 * out.length.sum() and most == loss  # the limit binds


def test_last_sequences_keep_the_limits():
    for loss in (0, 5, 1000, 4096):
        packer = packing.Packer(4096, 512, loss)
        bins = [b for k in range(3) for b in packer.add(k, 0, 4000)]
        bins += packer.rest()
        assert sum(n for b in bins for *_, n in b) == 12_000
        assert all(sum(n - 1 for *_, n in b) <= loss and sum(n for *_, n in b) <= 4096 and len(b) <= 512 for b in bins)


# 2: substring dedup


def test_passages_equal_brute_force(spark):
    rows = [*corpus(), (None, corpus()[3][1])]
    got = {r.doc_id: tuple(r) for r in passages.dedup_passages(frame(spark, rows).repartition(5)).collect()}
    want = brute.kept_words(rows)
    assert {w[0]: w[:4] for w in want} == got
    assert sum(w[2] > 0 for w in want) > 10
    cut = {r.doc_id: r.text for r in passages.without_passages(frame(spark, rows)).collect()}
    assert cut == {d: (w[4] if w[2] else t) for (d, t), w in zip(rows, want)}


@pytest.mark.parametrize("parts", [1, 6])
def test_hot_passages_and_rows_without_ids(spark, parts):
    """A passage of most texts, some of them copies, under ids, one repeated id and none: together in one batch or apart."""
    rnd = random.Random(parts)
    hot, warm = (" ".join(f"{c}{k}" for k in range(30)) for c in "hw")
    texts = [f"{t} {hot if k % 3 else ''} {t} {warm if k % 7 == 0 else ''}" for k, t in enumerate(prose(77, 90, 30))]
    rows = [(rnd.choice([None, 5, k, k]), rnd.choice(texts)) for k in range(400)]
    df = frame(spark, rows).repartition(parts)
    want = brute.kept_words(rows)
    assert sorted((tuple(r) for r in passages.dedup_passages(df).collect()), key=str) == sorted((w[:4] for w in want), key=str)
    cut = sorted(((r.doc_id, r.text) for r in passages.without_passages(df).collect()), key=str)
    assert cut == sorted(((d, w[4] if w[2] else t) for (d, t), w in zip(rows, want)), key=str)


def test_cover_has_every_difference():
    cover = set(passages.COVER)
    assert {(a - b) % passages.PERIOD for a in cover for b in cover} == set(range(passages.PERIOD))


# 3: licenses


def test_base_phrases():
    texts = ["CC BY 4.0", "cc\nby cc-by", "Gnu general  public LICENSE, all rights reserved", "accby", "cc éby", None, "all rights. Reserved! all rights reserved"] + noise(4, 300)
    got = licenses.scan_texts(pa.array(texts))
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [(i, n) for n, p in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (got["n_words"][k], got["n_base"][k], got["first_word"][k], got["last_word"][k], got["base_labels"][k]) == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({n for _, n in at})))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the apache license, version 2.0.", {"apache-2.0"}), ("released under the mit license.", {"mit"}), ("this work is licensed under the gnu general public license, version 3.", {"gpl-3.0"}),
        ("spdx-license-identifier: mit", {"mit"}), ("licensed under cc by-nc 4.0.", {"cc-by-nc-4.0"}), ("the summit license plate", set()), ("all rights reserved", {"reserved"}), ("permission granted", set()),
    ],
)
def test_rules(text, labels):
    assert {d[2] for d in licenses.detect(text)} == labels


@pytest.mark.parametrize(
    ("text", "labels", "stated"),
    [
        ("(under the terms of gpl v2)", "gpl-2.0", "under the terms of gpl v2"), ("Free to copy\nunder the terms of the GPL v2.", "gpl-2.0", "under the terms of the GPL v2"),
        ("é\t Licensed under\nthe MIT\nlicense now", "mit", "Licensed under\nthe MIT\nlicense"), (" * released  under\r\n * the terms of\r\n * the mit license\n */", "mit", "released  under\r\n * the terms of\r\n * the mit license"),
        ("# Permission is\n# hereby granted, free of charge, to any person\n# obtaining a copy", "mit", "Permission is\n# hereby granted, free of charge, to any person\n# obtaining a copy"),
        ("under\n// the terms of\n// mpl 2.0", "mpl-2.0", "under\n// the terms of\n// mpl 2.0"), ("licensed under\n\nmit", "", None),
    ],
)
def test_wrapped_statements(text, labels, stated):
    got = licenses.scan_texts(pa.array([text]))
    assert got["labels"] == [labels]
    assert [text[slice(*map(int, x.split(":")[0].split("-")))] for x in got["detections"][0].split(";") if x] == [stated] * bool(stated)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("released under the gpl", "gpl"), ("the bsd license", "bsd"), ("licensed under lgpl.", "lgpl"), ("licensed under cc by-sa", "cc-by-sa"), ("gnu lesser general public license", "lgpl"), ("licensed under the sspl", "sspl-1.0"),
        ("licensed under gplv2", "gpl-2.0"), ("the 3-clause bsd license", "bsd-3-clause"), ("licensed under lgpl 2.1", "lgpl-2.1"), ("under the terms of the mozilla public license, version 2.0", "mpl-2.0"),
    ],
)
def test_names_without_version(text, label):
    assert {d[2] for d in licenses.detect(text)} == {label}


def test_every_identifier_is_found():
    for label, (_, _, spdx) in licenses.FAMILIES.items():
        assert {d[2] for d in licenses.detect(f"spdx-license-identifier: {spdx}")} == {label}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("available under mitigation plans", ""), ("provided under iscariot rule", ""), ("licensed under gpl 21", "gpl"), ("licensed under the gpl version 2", "gpl-2.0"), ("Apache-2.0 OR MIT", "apache-2.0,mit"), ("mit or apache-2.0", "apache-2.0,mit"),
        ("SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause)", "bsd-3-clause,gpl-2.0"), ("gpl-2.0-only OR MIT", "gpl-2.0,mit"), ("# SPDX-License-Identifier: MIT-0", "mit-0"), ('"license": "MIT"', "mit"), ("commit or revert-2", ""),
        ("https://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("http://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"), ("Redistributions of source code must retain the above copyright notice", "bsd"),
        ('The software is provided "as is", without warranty of any kind', "no-warranty"), ("as published by the Free Software Foundation, either version 3", ""), ("general public license as published by the free software foundation, either version 3", "gpl,gpl-3.0"),
    ],
)
def test_more_rules(text, labels):
    assert licenses.scan_texts(pa.array([text]))["labels"] == [labels]


def plain_scan(text: str) -> tuple[str, float]:
    """Labels and score by trying every rule, and every pair of detections."""
    flat = licenses._GAP.sub(" ", "".join(c.lower() if c.isascii() else c for c in text))
    found = [(*m.span("id" if r.named else 0), r.label, r.priority, r.confidence) for r in licenses.rules() for m in r.pattern.finditer(flat)]
    kept: list[tuple] = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        if not any(k[0] <= d[0] and k[1] >= d[1] for k in kept):
            kept.append(d)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", flat)
    base_labels = {n for n, p in licenses.BASE.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    doubt = 1.0
    for d in sorted(kept):
        doubt *= 1 - d[4]
    return ",".join(sorted(base_labels | {d[2] for d in kept})), 1 - (min(doubt, 0.5) if base_labels else doubt)


def test_scan_equals_all_rules_and_pairs():
    """The gate, the wrapped statements and the suppression lose nothing: texts made of statements, sentences, links and other words, in any order and with any gaps."""
    rnd = random.Random(12)
    names = [spdx for _, _, spdx in licenses.FAMILIES.values()] + ["gpl", "gnu general public license", "apache license", "cc by-sa", "mozilla public license 2.0", "bsd", "mit"]
    forms = ["licensed under {}", "SPDX-License-Identifier: {}", "{} or {}", "{} and {}", "released under the {} license", "license: {}", "under the terms of the {}", "the {} license", "subject to {} license", "(provided under {})"]
    plain = [re.sub(r"\(\?:([^|()]*)\|[^()]*\)", r"\1", p).replace("\\", "").replace("?", "") for group in (licenses.SENTENCES, licenses.LINKS) for ps in group.values() for p in ps]
    texts = ["", " ", "© 2020", "copyright (c) 1999 all rights reserved"]
    for _ in range(250):
        parts = [rnd.choice([lambda: rnd.choice(forms).replace("{}", rnd.choice(names), 1).replace("{}", rnd.choice(names)), lambda: rnd.choice(plain), lambda: "some other words é"])() for _ in range(rnd.randint(1, 5))]
        text = rnd.choice([" ", ". ", ", ", "\n\n"]).join(parts)
        texts.append("".join(rnd.choice(["\n", "\n * ", "\t", "  ", "\r\n# "]) if c == " " and rnd.random() < 0.2 else c.upper() if rnd.random() < 0.05 and c.isascii() else c for c in text))
    got = licenses.scan_texts(pa.array(texts))
    want = [plain_scan(t) for t in texts]
    assert got["labels"] == [w[0] for w in want] and got["score"] == pytest.approx([w[1] for w in want])
    assert len({x for w, _ in want for x in w.split(",")}) > 60


def test_keywords_stand_in_every_match():
    assert licenses.keyword(r"gnu\.org/(?:licenses|copyleft)/fdl") == "gnu.org/" and licenses.keyword(r"x{2,80}? (?:has|have) waived all") == " waived all"
    assert all(k and len(w) > 2 for r in licenses.rules() for k in r.keywords for w in k.split("|") if w != "©")
    assert len(licenses.FAMILIES) + len(licenses.UNVERSIONED) + len(licenses.STATEMENTS) + sum(len(p) for g in (licenses.SENTENCES, licenses.LINKS) for p in g.values()) > 250  # written by hand


def test_suppression_equals_all_pairs():
    rnd = random.Random(6)
    for _ in range(300):
        found = list({(a, a + rnd.randint(1, 9), rnd.choice("xyz"), rnd.choice((1, 2, 3)), 0.5) for a in (rnd.randrange(12) for _ in range(rnd.randint(0, 8)))})
        order = sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
        kept = []
        for d in order:
            if not any(k[0] <= d[0] and k[1] >= d[1] for k in kept):
                kept.append(d)
        assert licenses.suppress(found) == sorted(kept)
    assert len(licenses.rules()) > 300


# 4: byte BPE


def test_byte_bpe_equals_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path = vocabulary(bytebpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = noise(7, 3000) + prose(8, 20) + ["we'll they're I'd 'tis '' 's 'S  a\n\n b   c　", "ab" * 900, "あ" * 400, " " * 3000 + "x"]
    ids, starts = bytebpe.encode_texts(pa.array(texts), path)
    assert [i.tolist() for i in ids] == [exact.encode_ordinary(t or "") for t in texts]
    assert all(bytebpe.decode_ids(i, s, path) == (t or "").encode() for t, i, s in zip(texts, ids, starts))
    row = bytebpe.round_trip(frame(spark, [(1, texts[0])]), path).first()
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, exact.encode_ordinary(texts[0]))).encode()).hexdigest() and row.decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
    with pytest.raises(ValueError):
        bytebpe.decode_ids(np.array([5, 6]), np.array([0, 9]), path)


def test_merging_of_long_pieces_is_the_same():
    coder = bytebpe.bpe(vocabulary(bytebpe.VOCABULARY))
    rnd = random.Random(9)
    for _ in range(50):
        piece = bytes(rnd.choice(b"abcdeeinst ") for _ in range(rnd.randint(2, 190)))
        assert coder._merge_long(piece) == coder.merge(piece) or piece in coder.ranks


# 5: JPEG


def test_jpeg_round_trip():
    texts = [t.encode("utf-8", "ignore").decode() if t else t for t in noise(10, 150, 400)] + ["\x7f" * 600_000 + "é"]
    media, sizes, padded = jpegmedia.store(pa.array(texts))
    for t, m, n, p, grids in zip(texts, media, sizes, padded, jpegmedia.read(media)):
        raw = (t or "").encode()
        assert n == len(raw) and p % 64 == 0 and p > 0 and b"".join(g.tobytes() for g in grids) == raw + bytes(int(p) - len(raw))
        assert m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"


def colour_image(rnd, across=3, down=2, interval=0):
    """A small 4:2:0 image with AC coefficients, coded bit by bit, and the DCs of its luminance."""
    dc = {s: (c, n) for s, c, n in jpegmedia.codes(jpegmedia.DC_COUNTS, jpegmedia.DC_SYMBOLS)}
    ac_counts, ac_symbols = (0, 1, 2, 2, *[0] * 12), (0x00, 0x01, 0x11, 0xF0, 0x23)
    ac = {s: (c, n) for s, c, n in jpegmedia.codes(ac_counts, ac_symbols)}
    bits, out, luma, last = "", b"", [], [0, 0, 0]

    def put(code, n):
        nonlocal bits
        bits += format(code, f"0{n}b") if n else ""

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for m in range(across * down):
        if interval and m and m % interval == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            last = [0, 0, 0]
        for part in (0, 0, 0, 0, 1, 2):
            value = rnd.randint(-200, 200)
            d = value - last[part]
            last[part] = value
            size = abs(d).bit_length()
            put(*dc[size])
            put(d if d >= 0 else d + (1 << size) - 1, size)
            if not part:
                luma.append(value)
            seen = 0
            for _ in range(rnd.randint(0, 8)):
                symbol = rnd.choice(ac_symbols[1:])
                if seen + (symbol >> 4) + 1 > 62:
                    break
                seen += (symbol >> 4) + 1
                put(*ac[symbol])
                put(rnd.randrange(1 << (symbol & 15)), symbol & 15)
            put(*ac[0])
    flush()
    seg = jpegmedia._segment
    parts = bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 4, *[1] * 63])) + seg(0xC0, bytes([8]) + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + parts)
    head += seg(0xC4, b"\x00" + bytes(jpegmedia.DC_COUNTS) + bytes(jpegmedia.DC_SYMBOLS) + b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    head += (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    grid = np.array(luma).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).reshape(down * 2, across * 2)
    return head + out + b"\xff\xd9", np.clip(np.rint(grid * 4 / 8 + 128), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("interval", [0, 1, 4])
def test_colour_images(interval):
    rnd = random.Random(interval)
    pictures = [colour_image(rnd, rnd.randint(1, 4), rnd.randint(1, 4), interval) for _ in range(12)]
    for (_, want), (got,) in zip(pictures, jpegmedia.read([p for p, _ in pictures])):
        assert np.array_equal(got, want)


def test_fingerprint_equals_plain_means():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        h, w = (int(x) for x in rnd.integers(1, 30, 2))
        grid = rnd.integers(0, 256, (h, w)).astype(np.uint8)
        cell = lambda r, c: grid[min(r * h // 8, h - 1) : max((r + 1) * h // 8, min(r * h // 8, h - 1) + 1), min(c * w // 8, w - 1) : max((c + 1) * w // 8, min(c * w // 8, w - 1) + 1)].astype(float).mean()  # noqa: E731, B023
        means = [[cell(r, c) for c in range(8)] for r in range(8)]
        middle = sum(map(sum, means)) / 64
        bits = lambda flags: f"{int(''.join('1' if f else '0' for f in flags), 2):016x}"
        average, gradient = bits([m > middle for row in means for m in row]), bits([row[(c + 1) % 8] > row[c] for row in means for c in range(8)])
        size, *got = jpegmedia.fingerprint(grid).split(":")
        assert size == f"{w * 8}x{h * 8}" and got[1] == gradient
        near = [abs(m - middle) < 1e-9 for row in means for m in row]
        assert all(a == b or n for a, b, n in zip(f"{int(got[0], 16):064b}", f"{int(average, 16):064b}", near))


def two_scans(luma: bytes, chroma: bytes) -> bytes:
    """An image of two components, each in a scan of its own; rows of 64 blocks."""
    grey = [jpegmedia.encode([np.frombuffer(x, np.uint8)])[0] for x in (luma, chroma)]
    frame_at, scan_at = grey[0].index(b"\xff\xc0"), grey[0].index(b"\xff\xda")
    coded = [g[len(jpegmedia.header(1)) : -2] for g in grey]
    seg, size = jpegmedia._segment, (len(luma) // 64 * 8).to_bytes(2, "big") + (512).to_bytes(2, "big")
    sof = seg(0xC0, bytes([8]) + size + bytes([2, 1, 0x11, 0, 2, 0x11, 0]))
    tables = grey[0][grey[0].index(b"\xff\xc4") : scan_at]
    scans = [seg(0xDA, bytes([1, k, 0, 0, 63, 0])) + c for k, c in ((2, coded[1]), (1, coded[0]))]
    return grey[0][:frame_at] + sof + tables + b"".join(scans) + b"\xff\xd9"


def test_scans_of_their_own():
    rnd = random.Random(2)
    luma, chroma = rnd.randbytes(64 * 5), rnd.randbytes(64 * 5)
    ((grid,),) = jpegmedia.read([two_scans(luma, chroma)])
    assert grid.tobytes() == luma


def test_media_column(spark):
    """Images of others and of our own, and media that can't be read: each is a row, with an error where it has no values."""
    rnd = random.Random(9)
    good, want = colour_image(rnd, 3, 2, 0)
    own = jpegmedia.encode([np.frombuffer(rnd.randbytes(640), np.uint8)])[0]
    at = good.index(b"\xff\xda") + 14
    zeros = good[:at] + b"\xfe" * (len(good) - at - 2) + good[-2:]
    media = {
        "good": good, "good again": good, "two": own + good, "null": None, "empty": b"", "text": b"hello", "start": b"\xff\xd8", "no end": good[:-2], "cut": good[: at + 3] + b"\xff\xd9", "cut table": good[:40],
        "progressive": good.replace(b"\xff\xc0", b"\xff\xc2"), "no code": zeros, "intervals": own.replace(b"\xff\xd3", b"", 1), "more intervals": own[:-2] + b"\xff\xd1\x00" + own[-2:],
        "no scan": good[: good.index(b"\xff\xda")] + b"\xff\xd9", "huge": good.replace((32).to_bytes(2, "big") + (48).to_bytes(2, "big"), b"\xff\xff\xff\xff"),
    }
    rows = [(k, n, m, "x") for k, (n, m) in enumerate(media.items())]
    out = {n: r for (_, n, _, _), r in zip(rows, sorted(jpegmedia.thumbnails(spark.createDataFrame(rows, "doc_id long, name string, media binary, error string").repartition(3)).collect(), key=lambda r: r.doc_id))}
    fine = {"good", "good again", "two"}
    assert {n for n, r in out.items() if r.error is None} == fine and all(r.feature is None and r.thumbnail_sha256 is None for n, r in out.items() if n not in fine)
    assert out["good"].thumbnail_sha256 == out["good again"].thumbnail_sha256 == hashlib.sha256(want.tobytes()).hexdigest() and out["two"].images == 2
    assert (out["good"].width, out["good"].height) == (48, 32)
    assert jpegmedia.thumbnails(spark.createDataFrame([], "doc_id long, media binary")).collect() == []


def test_damaged_images_never_raise():
    """Any byte changed, or any part cut: thumbnails or an error."""
    rnd = random.Random(4)
    for _ in range(400):
        good, _ = colour_image(rnd, rnd.randint(1, 3), rnd.randint(1, 3), rnd.choice([0, 1, 2]))
        bad = bytearray(good)
        for _ in range(rnd.randint(1, 4)):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        (out,) = jpegmedia.read([bytes(bad[: rnd.randrange(len(bad)) if rnd.random() < 0.3 else len(bad)])])
        assert isinstance(out, (str, list))


# 6: toxicity


def test_near_words_equal_edit_distance():
    terms = ["idiot", "clown", "pathetic", "réeuxê", "scum", "bad", "imbecilic", "scumbag", "idiots", "worthlessness"]
    lexicon, rnd = toxicity.Lexicon(terms), random.Random(1)
    words = [t for t in terms] + ["", "x", "idoit", "scmu", "id!ot", "b" * 70, "owrthlesnsess"]
    for _ in range(6000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.4 and 0 < i < len(w):
                w[i - 1], w[i] = w[i], w[i - 1]
            else:
                w[i : i + rnd.randint(0, 1)] = rnd.choice([[], ["a"], ["t"], ["é"]])
        words.append("".join(w))
    for word, got in zip(words, lexicon.near(words), strict=True):
        reach = [(e, -len(t), k) for k, t in enumerate(terms) if (e := brute.distance(word, t)) <= toxicity.edits(len(t))]
        assert got == (None if not reach else (min(reach)[2], min(reach)[0])), word


def test_features_equal_a_plain_scan():
    """Hits, contexts and features of random texts by edit distances to every term and by looking around every word."""
    terms, exact, fuzzy = ["idiot", "scum", "worthlessness"], [3.0, 2.5, 4.0], [1.5, 0.5, 2.0]
    model, rnd = toxicity.Model(terms, exact, fuzzy, [-3.0, 2.0, 0.5, -0.3, 0.1, 1.0]), random.Random(5)
    pool = ["idiot", "idoit", "idiots", "scum", "scam", "worthlesness", "wrothlesness", "said", "quote", "he", "the", "day", "é", "û", "—", "x9", '"', "“", "”", "Idiot", "id!ot", "sc.um", "yes.no"]
    texts = ["".join(rnd.choice(pool) + rnd.choice([" ", " ", "  ", ", ", "\n", "-"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", None]
    x, count, quoted = toxicity.features(pa.array(texts), model)
    for k, t in enumerate(texts):
        low = (t or "").lower()
        spots = [m.span() for m in re.finditer(r"[0-9a-z\x80-\U0010ffff]+", low)]
        near = lambda w: min(((e, -len(u), j) for j, u in enumerate(terms) if (e := brute.distance(w, u)) <= toxicity.edits(len(u))), default=None)
        alone = [near(low[a:b]) for a, b in spots]
        found = [(i, n) for i, n in enumerate(alone) if n]
        for i, ((a, b), (c, d)) in enumerate(zip(spots, spots[1:])):
            if c - b == 1 and low[b] in "!@$*#+-.|" and not alone[i] and not alone[i + 1] and (n := near(low[a:d])):
                found.append((i, n))
        weights, said = [], 0
        for i, (e, _, j) in found:
            first, last = max(0, i - toxicity.CONTEXT), min(len(spots), i + toxicity.CONTEXT + 1) - 1
            marks = any(c in low[spots[first][0] : spots[i][0]] for c in '"“”') and any(c in low[spots[i][1] : spots[last][1]] for c in '"“”')
            q = marks or any(low[a:b].encode() in toxicity.SPEECH for a, b in spots[first:i])
            weights.append(((fuzzy if e else exact)[j] * (toxicity.QUOTED if q else 1.0), e))
            said += q
        want = [np.log1p(sum(w for w, _ in weights)), max([0.0, *(w for w, _ in weights)]), np.log1p(sum(w for w, e in weights if e)), np.log1p(said), len(weights) / max(1, len(spots))]
        assert (count[k], quoted[k]) == (len(weights), said) and x[k] == pytest.approx(want), t


def test_masked_and_swapped_words_are_hits():
    model = toxicity.Model(["idiot", "moron"], [3.0, 3.0], [2.0, 2.0], [-3.0, 2.0, 0.5, 0.0, 0.0, 0.0])
    _, n, _ = toxicity.features(pa.array(["you id!ot", "a m*ron and an idoit", "idiot.you", "some idea", "id ot", "an id.\not"]), model)
    assert n.tolist() == [1, 2, 1, 0, 0, 0]


def test_quotation_counts_less():
    model = toxicity.Model(["idiot"], [3.0], [2.0], [-3.0, 2.0, 0.5, 0.0, 0.0, 0.0])
    x, n, quoted = toxicity.features(pa.array(["you idiot there", 'she wrote "idiot" there', "you idiott there", "nothing", "", None]), model)
    s = toxicity._scores(x, model.weights)
    assert s[0] > s[2] > s[1] > s[3] and s[3] == s[4] == s[5] and n.tolist() == [1, 1, 1, 0, 0, 0] and quoted.tolist() == [0, 1, 0, 0, 0, 0]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = out[out.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95 and hit.toxic.sum() > 0.8 * out.toxic.sum()
    assert out.score.between(0, 1).all()


def test_toxicity_learns_from_training_rows_only(spark):
    labels = frame(spark, [(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.training_labels(labels).collect()}
    assert got == {k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1}


def test_toxicity_with_repeated_ids_and_labels(spark):
    """Rows and labels that come twice teach nothing new: a text for each id, toxic if any label says so."""
    texts = [(k, f"plain words number {k} here" + (f" you {k % 89} clown" if k % 2 else "")) for k in range(240)]
    labels = [(k, k % 2) for k in range(240)]
    lex = lambda rows, marks: toxicity.fit(frame(spark, rows), frame(spark, marks, "doc_id long, toxic int"))
    once, twice = lex(texts, labels), lex([*texts, *texts], [*labels, *labels, (1, 0)])
    assert once == twice and "clown" in once.terms
    copies = [(k, f"plain words number {k} here" + (" you utter clown and fool" if k % 2 else "")) for k in range(240)]
    assert lex(copies, labels).terms == []  # one passage, however often


def test_keep_civil(spark):
    """Nulls, empty, long and repeated texts stay, with columns whose names are those of results; toxic ones go."""
    model = toxicity.Model(["idiot"], [3.0], [2.0], [-3.0, 4.0, 0.5, 0.0, 0.0, 0.0])
    rows = [(1, None, 7.0), (2, "", None), (2, "", None), (None, "fine", 1.0), (4, LONG, 1.0), (5, "you idiot idiot", 1.0), (6, "x" * 70_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = toxicity.keep_civil(df, model)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "2", "4", "6", "None"]
    assert toxicity.keep_civil(df.limit(0), model).collect() == []


@pytest.mark.parametrize("labelled", [[], [(1, 0)], [(1, 1), (3, None)]])
def test_toxicity_without_both_classes(spark, labelled):
    out = toxicity.toxicity(frame(spark, corpus()), frame(spark, labelled, "doc_id long, toxic int")).collect()
    assert len(out) == len(corpus()) and len({r.score for r in out}) == 1


# 7: near-duplicates


def test_near_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in neardup.near_classes(frame(spark, rows).repartition(4)).collect()}
    assert got == brute.classes(rows)
    kept = {r.doc_id for r in neardup.keep_one(frame(spark, rows)).collect()}
    assert kept == set(got.values())


def test_null_and_repeated_ids_keep_unrelated_texts(spark):
    """Unrelated texts without ids, or under one id, are classes of their own; a copy or near copy of any of them is found."""
    a, b, c, d, e = [t for t in prose(31, 40) if len(t.split()) > 40][:5]
    near = " ".join([*d.split(), "more"])
    rows = [(None, a), (None, b), (None, c), (None, c.upper()), (1, b), (5, d), (5, e), (5, e), (7, near), (8, e + " more")]
    classes = {}
    for r in neardup.near_classes(frame(spark, rows).repartition(3)).collect():
        classes.setdefault((r.class_id, r.class_key), []).append((r.doc_id, r.text_id))
    got = sorted(sorted(str(x) for x in v) for v in classes.values())
    assert got == sorted(sorted(str(x) for x in v) for v in ([(None, None)], [(None, None)] * 2, [(None, 1), (1, 1)], [(5, 5), (7, 7)], [(5, 5), (5, 5), (8, 8)]))
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(frame(spark, rows).repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, min(c, c.upper())), (1, b), (5, d), (5, e)], key=str)


@pytest.mark.parametrize("parts", [0, 7])
def test_links_that_pivots_miss(spark, parts):
    """All links between components around a pivot are found, and only these; parts: texts are in so many components so far (0: each in its own)."""
    import zstandard

    rnd, texts = random.Random(17), []
    for _ in range(3):
        whole = prose(rnd.randrange(1000), 1, 3000)[0].split()[:90]
        for _ in range(25):
            w = whole[: rnd.randint(70, 90)] if rnd.random() < 0.4 else list(whole)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(3)}"
            texts.append(" ".join(w + [f"end{k}" for k in range(rnd.randint(0, 8))]))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    blobs = frame(spark, [(k, zstandard.compress(t.encode())) for k, t in enumerate(texts)], "node long, blob binary")
    around = neardup._verified(frame(spark, [(k - k % 25, k) for k in range(75) if k % 25], "a long, b long"), blobs)
    component = (lambda k: k % parts) if parts else (lambda k: k)
    found = frame(spark, [(k, component(k)) for k in range(75)] if parts else [], "node long, component long")
    got = neardup._missed(around, found, blobs, base.Scratch(spark, "test"))
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = {(a, b) for a in range(75) for b in range(a + 1, 75) if a // 25 == b // 25 and a % 25 and component(a) != component(b) and near(a, b)}
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 20
    assert neardup._missed(around, frame(spark, [(k, 0) for k in range(75)], "node long, component long"), blobs, base.Scratch(spark, "test")) is None


def test_repeats_lose_no_links(spark):
    """A text that repeats a stretch fifty times, which its near copy has once, is still found."""
    rnd, rows = random.Random(23), []
    for k in range(40):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * k, " ".join([*words, *(words[90:] * 50)])), (2 * k + 1, " ".join(words))]
    got = {r.doc_id: r.class_id for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_probability_jaccard():
    """Registers agree as often as the weights say."""
    rnd = np.random.default_rng(1)
    names = base.mix(np.arange(60, dtype=np.uint64))
    a, b = rnd.integers(1, 6, 60) * (rnd.random(60) < 0.8), rnd.integers(1, 6, 60) * (rnd.random(60) < 0.8)
    doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = neardup.prob_minhash(doc, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]).astype(float), 2, 20_000)
    both = (a > 0) & (b > 0)
    want = sum(1 / np.maximum(a / a[k], b / b[k]).sum() for k in np.flatnonzero(both))
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.015)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, 500 + k) for k in range(1, 50)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(80)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    edges += [(None, 3), (7, None), (11, 11), (100, 101)]
    got = {r.node: r.component for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    edges = [e for e in edges if None not in e]
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(frame(spark, [], "a long, b long")).collect() == []


def test_hot_keys_are_dealt_out(spark):
    """A key with most rows is joined in parts, and nothing is lost or doubled."""
    rows = frame(spark, [(0 if k % 3 else k, k) for k in range(3000)], "key long, id long")
    summary = rows.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    out = base.join_back(rows, summary, ["key"], "id").collect()
    assert sorted((r.key, r.id) for r in out) == sorted((r.key, r.id) for r in rows.collect()) and {r.top for r in out if r.key == 0} == {2999}


# 8: WARC


def test_warc(spark):
    big = "é" * 100_000
    rows = [(1, "u", big), (2, "u", big), (None, "u", None), (None, None, big), (3, "a\r\nb", "x"), (2, "u", big), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", "z" * 1000), (7, "u", "z" * 1000)]
    df = frame(spark, rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        refers = max(same) if len(raw) >= 1000 and same and page != max(same) else None
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 200, 1000])
def test_warc_chunks(size):
    payload = random.Random(size).randbytes(size)
    parts = list(warc.pieces(memoryview(payload), 100))
    assert b"".join(p[3] for p in parts) == payload and [p[1] for p in parts] == [False] * (len(parts) - 1) + [True] and all(len(p[3]) <= 100 for p in parts)
    record = warc.head("response", "0-0", 5, "u", size, hashlib.sha1(payload).digest(), None)
    chunks = [(n, last, sha1, (b"" if n else record) + bytes(part) + (warc.TAIL if last else b"")) for n, last, sha1, part in parts]
    reader = warc.Reader(chunks[0][3])
    for c in chunks:
        reader.feed(*c)
    assert reader.result() == (5, size, hashlib.sha1(payload).hexdigest(), "response", None)
    if size:
        broken = warc.Reader(chunks[0][3])
        with pytest.raises(ValueError):
            for number, last, _, data in chunks:
                broken.feed(number, last, b"", data)


def test_warc_revisits_name_their_records(spark, tmp_path):
    """Every WARC-Refers-To is the id of a response with the same digest and the page that is named; ids are unique; no row holds more than a chunk of payload."""
    rows = [(k % 40, f"http://x/{k}", ("a" * 1200 if k % 3 else "b" * 200_000) + str(k % 2)) for k in range(90)]
    warc.write_archive(frame(spark, rows, "page_id long, url string, html string").repartition(4), f"{tmp_path}/w")
    table = spark.read.parquet(f"{tmp_path}/w").collect()
    heads = [warc.parse_head(r.data)[0] for r in table if r.chunk_no == 0]
    assert len(heads) == len({h["WARC-Record-ID"] for h in heads}) == 90 and max(len(r.data) for r in table) < warc.CHUNK + 1000
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            at = responses[h["WARC-Refers-To"]]
            assert (at["WARC-Payload-Digest"], at["X-Page-Id"]) == (h["WARC-Payload-Digest"], h["X-Refers-To-Page-Id"])


def test_warc_other_columns_and_long_pages(spark):
    rows = [(1, None, "x" * 3_000_000, 5, "s"), (2, "u", "", 5, None), (2, "u", "", 5, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long, chunk_no string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.archived(df).collect()) == [(1, 3_000_000, "response"), (2, 0, "response"), (2, 0, "response")]


# 9: token counts


def test_automaton_equals_greedy_search():
    path = vocabulary(wordpieces.VOCABULARY)
    pieces = set(wordpieces.load(path))
    automaton, longest = wordpieces.Automaton(sorted(pieces)), max(map(len, pieces))
    words = {w for t in noise(11, 800) + prose(12, 30) for w in (t or "").lower().encode().split()}
    assert all(automaton.count(w) == brute.greedy_pieces(w, pieces, longest) for w in words)
    few = {(97,), (97, 98), (97, 98, 99, 100), (98,), (99, 256), (256,), (100, 256)}
    small = wordpieces.Automaton(sorted(few))
    for n in range(1, 6):
        for k in range(4**n):
            w = bytes(97 + (k >> 2 * i & 3) for i in range(n))
            assert small.count(w) == brute.greedy_pieces(w, few, 4)


# 10: quality


def test_quality_equals_brute_force():
    texts = noise(13, 400) + prose(14, 40) + ["a\n\na\n a\nb", "x y z x y z", " ".join(prose(15, 1)[0].split() * 3), "\n".join(prose(16, 3) * 2)]
    got = quality.measures(pa.array(texts))
    for k, t in enumerate(texts):
        want = brute.quality(t)
        assert tuple(got[c][k] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert got["kept"][k] == (not want[5] and brute.coverage_keeps(t))


def test_workers_without_labels_of_columns(spark):
    """Operators take other names for the id and the text."""
    df = frame(spark, [(1, "some words here")], "key long, body string").withColumn("text", F.lit("other"))
    assert quality.quality(df, "key", "body").first().n_words == 3
    assert packing.pack(df, vocabulary(packing.VOCABULARY), "key", "body").first().doc_id == 1
    assert passages.dedup_passages(df, "key", "body").first().n_words == 3
