"""The registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(packing.VOCABULARY))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import passages

    return passages.dedup_passages(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import bytebpe

    return bytebpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(bytebpe.VOCABULARY))


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import jpegmedia

    return jpegmedia.media_features(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import neardup

    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import warc

    return warc.archived(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import wordpieces

    return wordpieces.token_counts(table(spark, sf_dir, "documents"), vocabulary(wordpieces.VOCABULARY))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import quality

    return quality.quality(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_jpeg_media": op5_jpeg_media,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}


_WORD = r"[^\x20\x09-\x0D]"
_WORDS = f"""texts as (select doc_id, coalesce(text, '') as t from documents), lists as (select doc_id, regexp_extract_all(t, '{_WORD}+') as l from texts),
 words as (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as p from lists)"""


def _gram(n: int, name: str) -> str:
    """The n words from each word on, null where the text ends before."""
    frame = f"over (partition by doc_id order by p rows between current row and {n - 1} following)"
    return f"case when count(*) {frame} = {n} then string_agg(word, ' ') {frame} end as {name}"


def _covered(flag: str, n: int) -> str:
    """Is a word in a window of n words whose start has the flag."""
    return f"coalesce(bool_or({flag}) over (partition by doc_id order by p rows between {n - 1} preceding and current row), false)"


def _quality_sql() -> str:
    from tarn.llm.quality import GRAM_LIMITS, LINE_LIMIT, MIN_WORDS, SYMBOL_LIMIT

    before = ", ".join(f"g{n} is not null and row_number() over (partition by doc_id, g{n} order by p) > 1 as b{n}" for n in GRAM_LIMITS)
    covers = ", ".join(f"{_covered(f'b{n}', n)} as c{n}" for n in GRAM_LIMITS)
    shares = ", ".join(f"coalesce(sum(n) filter (c{n}), 0)::double / greatest(coalesce(sum(n), 0), 1) as cover_{n}" for n in GRAM_LIMITS)
    fine = " and ".join(f"cover_{n} <= {limit}::double" for n, limit in GRAM_LIMITS.items())
    return f"""with {_WORDS}, grams as (select *, length(word) as n, {_gram(3, 'g3')}, {', '.join(_gram(n, f'g{n}') for n in GRAM_LIMITS)} from words),
 flags as (select *, g3 is not null and count(*) over (partition by doc_id, g3) > 1 as b3, {before} from grams), marks as (select *, {_covered('b3', 3)} as c3, {covers} from flags),
 lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from texts),
 seen as (select doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as n, row_number() over (partition by doc_id, line order by k) > 1 as again from lines where regexp_matches(line, '{_WORD}')),
 by_line as (select doc_id, count(*) filter (again) as n_dup_lines, coalesce(sum(n) filter (again), 0) as dup from seen group by doc_id),
 by_doc as (select doc_id, count(*) as n_words, sum(n)::bigint as word_chars, count(*) filter (c3) as n_repeat_words, {shares} from marks group by doc_id),
 counts as (select t.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
 coalesce(n_repeat_words, 0) as n_repeat_words, {', '.join(f'coalesce(cover_{n}, 0) as cover_{n}' for n in GRAM_LIMITS)}, coalesce(dup, 0) as dup from texts t left join by_doc using (doc_id) left join by_line using (doc_id)),
 shares as (select * exclude (dup), dup::double / greatest(word_chars, 1) as cover_lines, n_symbols::double / greatest(word_chars, 1) as symbol_share, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
 select *, not base_failed and {fine} and cover_lines <= {LINE_LIMIT}::double and symbol_share <= {SYMBOL_LIMIT}::double as kept from shares"""


#: The queries that DuckDB can say; tests/llm holds the others against brute force, exact libraries, round trips or held-out rows.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": f"""with {_WORDS}, windows as (select *, {_gram(13, 'w')} from words), first as (select w, min(doc_id) as first from windows where w is not null group by w),
 flags as (select windows.*, coalesce(first < doc_id, false) as again from windows left join first using (w)), marks as (select *, {_covered('again', 13)} as gone from flags),
 found as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by p) filter (not gone) as kept from marks group by doc_id)
 select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from texts left join found using (doc_id)""",
    "op8_warc": """with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages), g as (select h, max(page_id) as latest from p where n >= 1000 group by h)
 select page_id, n::bigint as payload_bytes, sha1(h) as payload_digest, case when page_id < latest then 'revisit' else 'response' end as record_type, case when page_id < latest then latest end as refers_to from p left join g using (h)""",
    "op10_quality_rules": _quality_sql(),
}
