"""A corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import langid, line_dedup, ngram_join, packing, pii
from tracelens.llm.common import written
from tracelens.session import ensure_checkpoint_dir

#: Words of a shingle and least similarity of near duplicates; op9 has its own.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` anew after the text has changed."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told with enough confidence (7); the model is learned from the documents' ``lang``."""
    ensure_checkpoint_dir(spark)
    return langid.tellable(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in too many of a source's different texts go, also where they are most of a text (8)."""
    ensure_checkpoint_dir(spark)
    return _recounted(line_dedup.drop_boilerplate(docs, "doc_id", "source", copies_once=True), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (9)."""
    ensure_checkpoint_dir(spark)
    return ngram_join.first_of_each(docs, SIMILAR_PERCENT, SHINGLE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind (5)."""
    ensure_checkpoint_dir(spark)
    return _recounted(pii.mask(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 2048 (3)."""
    ensure_checkpoint_dir(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", languages),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; packed pieces with a checksum of their ids."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
