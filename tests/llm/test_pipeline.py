"""The corpus pipeline against a plain version of its stages, and the registry."""

from __future__ import annotations

import zlib

import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from tarn.llm import packing, toxicity
from tarn.llm.queries import vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = [(d, t) for d, t in rows if not brute.quality(t)[5] and brute.coverage_keeps(t)]
    ids = [d for d, _ in good]
    model = toxicity.fit(docs.where(docs.doc_id.isin(ids)), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity._scores(toxicity.features(pa.array([t for _, t in good]), model)[0], model.weights)
    civil = [row for row, s in zip(good, scores) if s < toxicity.THRESHOLD]
    classes = brute.classes(civil)
    one = [(d, t) for d, t in civil if classes[d] == d]
    cut = {w[0]: (w[4] if w[2] else t) for (_, t), w in zip(one, brute.kept_words(one))}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == set(cut)
    for doc, ids in zip(cut, packing.tokens(vocabulary(packing.VOCABULARY)).encode(list(cut.values()))):
        for r in out[out.doc_id == doc].itertuples():
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32
        assert out[out.doc_id == doc].length.sum() == len(ids)


def test_pipeline_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, null ids, and columns with the names of results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    prose = [r.text for r in docs.where("length(text) > 400 and lang = 'en'").collect()][:6]
    rows = [(None, prose[0], None, "s"), (None, prose[1], 1, None), (7, None, 1, "s"), (8, "", None, None), (9, prose[2], 1, "s"), (9, prose[2], 1, "s"), (10, prose[3] + " unlike words" * 40_000, 2, "k"), (11, prose[4], 3, "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_words long, key string").repartition(3)
    out = corpus_pipeline.run_on(spark, odd, SF).toPandas()
    assert {7, 8}.isdisjoint(set(out.doc_id.dropna())) and set(out.doc_id.dropna()) <= {9, 11}
    kept = [t for _, t, _, _ in rows if t and not brute.quality(t)[5] and brute.coverage_keeps(t)]
    assert out.groupby(["doc_id", "doc_tokens"], dropna=False).ngroups == len(set(kept))
    assert corpus_pipeline.run_on(spark, odd.limit(0), SF).collect() == []


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
