"""Corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate class stays, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``. Nulls, empty texts, repeated rows and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import line_dedup, mixing, near_duplicates, sentencepiece_codec, shared
from scoreframe.llm import toxicity as severity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't reject; it is fitted on the labelled ones among ``docs``."""
    return severity.accepted(docs, severity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier one has; n_chars, if there, follows the text."""
    kept = line_dedup.cut_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class."""
    return near_duplicates.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document stands in it as often as it is taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of SentencePiece ids, and the digests of the ids and of what they decode to."""
    return sentencepiece_codec.round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup_stage), ("near dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the toxicity, near-dedup and SentencePiece stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's own tables go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with shared.scratch():
            docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            shared.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
