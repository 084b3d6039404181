"""A corpus for training: toxic texts go, near copies go, personal data is redacted, sources are mixed, texts become tokens.

Edge cases, of every stage: an empty table gives no rows; null ids, texts and sources stay (a null or empty text is clean, no
copy of anything, without personal data, of size 0 and so in no mix but for whole epochs); rows repeated with id and
text are one near copy; ids repeated with other texts are documents of their own; texts of any length are read whole;
further columns pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetmill.llm import jaccard, mixing, pii, sentencepiece, toxicity
from facetmill.sources.scratch import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic."""
    return toxicity.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity 0.8 or more)."""
    return jaccard.one_of_each(spark, docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data redacted in their texts."""
    return pii.sanitised(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each document."""
    return sentencepiece.with_tokens(docs).select("doc_id", "source", "n_tokens", "exact", "ids")


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("personal_data", personal_data), ("mixing", mixed), ("tokens", tokens)]

#: A learned classifier decides the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; what a stage has read goes once the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop_table(last)
        last = docs
    return docs
