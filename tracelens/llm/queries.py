"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from . import bpe, embedding_dedup, hard_negatives, langid, lexical_search, line_dedup, ngram_join, packing, pii, quality, token_store, toxicity, url_filter
from .common import id_bucket, table, unit_hash, written

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label, one row per vector; see ``embedding_dedup.near_duplicates`` for odd rows."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out; null and empty texts get a score, repeated rows each one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = id_bucket("doc_id", 5) != 0
    # labels are chosen before the join, so that the broadcast side is bounded
    toxic = toxicity_labels(labels.where(learned))
    rows = docs.where(learned).select("doc_id", "text").join(F.broadcast(toxic), "doc_id").select("text", "toxic")
    model = toxicity.fit(docs.where(learned), rows)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_labels(labels: DataFrame, per_class: int = 2 * toxicity.SAMPLE_PER_CLASS) -> DataFrame:
    """About ``per_class`` labels of each kind, chosen by hash of the id."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    return rows.where(unit_hash("doc_id", seed=3) < share)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; labelled ones of quality 1 are the trusted target. Null texts have no words."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratios = quality.fit(docs, labels.where("quality = 1").select("doc_id"))
    return quality.verdicts(quality.score(docs, ratios))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and discovered personal data of every document; null texts count as empty, equal texts have equal spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document; null texts count as empty."""
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out; ``und`` for texts that are null or have no letter."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens; null texts count as empty and hold the end id."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines dropped from all pages; null html has no lines, null hosts are one host, repeated rows are pages of their own."""
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", line_dedup.host_of_url(F.col("url")).alias("host"), line_dedup.text_of_html(F.col("html")).alias("text"))
    out = line_dedup.drop_boilerplate(written(texts, "page-texts"), "page_id", "host")
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents; those without words are their own, rows of one doc_id are documents of their own."""
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to the store and read back in the order of doc_id; null texts count as empty."""
    docs = table(spark, sf_dir, "documents")
    path = work_dir(spark, "token-store")
    token_store.write_store(docs, path, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by rules, then by trust and distrust of hosts; null URLs are allowed."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all."""
    return hard_negatives.stated(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_store": op10_token_store,
    "op11_url_filter": op11_url_filter,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_url_filter": url_filter.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_ranked_search": lexical_search.ORACLE,
}
