"""The corpus pipeline: documents from raw rows to token ids, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next one's docs. All but the last return the columns of documents. Stages set their session's Arrow batches to the size for whole
texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import bpe, mixing, pii, quality, simhash
from runlens.llm.common import small_batches, stash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return simhash.near_dedup(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    small_batches(spark)
    return pii.pseudonymise(docs, key=pii.session_key(spark))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates that give the target shares of languages; none is lost."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resampled(docs, mixing.labelled_languages(docs, labels), mixing.WEIGHTS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the text and of what the ids decode to."""
    small_batches(spark)
    return bpe.coded(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("private", replace_private),
    ("mixing", mix_languages),
    ("tokens", encode_tokens),
]

#: The classifier, the search and the encoder have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
