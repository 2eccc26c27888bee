"""Phrase-inventory files: a model's JSON answer (possibly inside a code fence)
listing hedge and verification phrases, to be reviewed as lexicon candidates.

Each file is read whole, the fence is stripped, the JSON is parsed with a fixed
schema, and every ``a / b / c`` phrase group becomes one row per variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import text

ENTRY = "array<struct<phrase:string,usage_context:string,reasoning_purpose:string>>"
INVENTORY_SCHEMA = f"struct<hedge_words:{ENTRY},verification_words:{ENTRY},reasoning_patterns:map<string,array<string>>>"
FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def parse_inventory(raw: DataFrame, col: str = "value") -> DataFrame:
    """``(category, phrase_group, phrase, usage_context, reasoning_purpose)`` rows."""
    body = F.when(F.col(col).rlike(FENCE), F.regexp_extract(F.col(col), FENCE, 1)).otherwise(F.col(col))
    parsed = raw.select(F.from_json(body, INVENTORY_SCHEMA).alias("j"))
    words = parsed.select(
        F.inline(
            F.concat(
                F.transform(F.coalesce("j.hedge_words", F.array().cast(ENTRY)), lambda e: F.struct(F.lit("hedge").alias("category"), e.alias("e"))),
                F.transform(F.coalesce("j.verification_words", F.array().cast(ENTRY)), lambda e: F.struct(F.lit("verification").alias("category"), e.alias("e"))),
            )
        )
    )
    variants = words.select(
        "category",
        F.col("e.phrase").alias("phrase_group"),
        F.explode(F.split(F.col("e.phrase"), " / ")).alias("phrase"),
        F.col("e.usage_context").alias("usage_context"),
        F.col("e.reasoning_purpose").alias("reasoning_purpose"),
    )
    patterns = parsed.select(F.explode("j.reasoning_patterns").alias("category", "items")).select(
        "category",
        F.lit(None).cast("string").alias("phrase_group"),
        F.explode("items").alias("phrase"),
        F.lit(None).cast("string").alias("usage_context"),
        F.lit(None).cast("string").alias("reasoning_purpose"),
    )
    out = variants.unionByName(patterns)
    return out.withColumn("phrase", text.strip_ws(F.col("phrase")))


def scan_lexicon_inventory(spark: SparkSession, path: str) -> DataFrame:
    return parse_inventory(spark.read.text(path, wholetext=True))
