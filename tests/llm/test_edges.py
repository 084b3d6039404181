"""Columns of clashing names, repeated rows, empty tables and long texts, operator by operator, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetmill.llm import jaccard, mixing, pii, sentencepiece, toxicity
from facetmill.llm import registry as llm

NAMES = "_gone _again _pii _score _key _t text_id _found _size copies cut ids exact n_tokens row key pii own token gid n cid bits lead last"
LABELS = "doc_id long, quality int, toxic int"


def clashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, c in enumerate(NAMES.split()):
        docs = docs.withColumn(c, F.lit(i))
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(odd).unionByName(odd.withColumn("text", F.lit(None).cast("string"))).unionByName(docs.where("doc_id < 4"))


def own(df):
    """The values of the clashing columns."""
    return {tuple(r) for r in df.select(*NAMES.split()).distinct().collect()}


WANT = {tuple(range(len(NAMES.split())))}


@pytest.mark.parametrize("name", ["keep_clean", "one_of_each", "sanitised", "apply_mix"])
def test_columns_pass_through(spark, sf, name):
    docs = clashing(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    f = {"keep_clean": lambda d: toxicity.keep_clean(spark, d, labels), "one_of_each": lambda d: jaccard.one_of_each(spark, d), "sanitised": lambda d: pii.sanitised(spark, d), "apply_mix": lambda d: mixing.apply_mix(spark, d)}[name]
    out = f(docs)
    assert out.columns == docs.columns and own(out) == WANT
    assert f(docs.limit(0)).count() == 0


def test_sanitised_by_a_join_keeps_columns(spark, sf, monkeypatch):
    docs = clashing(spark, sf)
    want = sorted(map(str, pii.sanitised(spark, docs).select("doc_id", "text", *NAMES.split()).collect()))
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    out = pii.sanitised(spark, docs)
    assert out.columns == docs.columns and sorted(map(str, out.select("doc_id", "text", *NAMES.split()).collect())) == want


def test_tokens_keep_columns_of_other_names(spark, sf):
    docs = clashing(spark, sf)
    out = sentencepiece.with_tokens(docs)
    assert out.where("exact = false").count() == 0 and out.where("_again <> 1").count() == 0
    assert sentencepiece.with_tokens(docs.limit(0)).count() == 0


def test_tokens_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, "x" * 300_000), (3, " " * 50_000)], "doc_id long, text string")
    rows = sentencepiece.with_tokens(docs).select("doc_id", "exact", "n_tokens").collect()
    assert all(r.exact and r.n_tokens for r in rows)


def test_pii_in_long_texts(spark):
    long = "a word and more of it " * 20_000
    docs = spark.createDataFrame([(1, f"{long} me@mail.example.org {long}"), (2, "x@y.z " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.with_spans(spark, docs).select("doc_id", "_pii.*").collect()}
    assert got[1].n_email == 1 and got[2].n_email == 20_000


@pytest.mark.parametrize("name", sorted(set(llm.queries()) | {"pipeline"}))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    query = corpus_pipeline.run if name == "pipeline" else llm.queries()[name]
    assert query(spark, str(tmp_path)).count() == 0


def test_stages_of_the_pipeline(spark, sf):
    """Each stage takes what the one before kept, with the columns of documents, whatever the rows."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None, None), (90_001, "", "en", "s", 0), (90_002, "you stupid worthless clown " * 3, "en", "s", 80), (90_003, "mail me@home.example.org or call +1 555 010 9999 at once", "en", "s", 55), (90_003, "mail me@home.example.org or call +1 555 010 9999 at once", "en", "s", 55)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == base.columns, name
        if name == "toxicity":
            assert 0.8 * n < out.count() < n and out.where("doc_id = 90002").count() == 0
        if name == "near_copies":
            assert out.where("doc_id IN (90001, 90003)").count() == 2 and out.where("doc_id IS NULL").count() == 1
        if name == "personal_data":
            assert out.count() == docs.count() and out.where("text LIKE '%@home%'").count() == 0
            assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("exact = false").count() == 0
