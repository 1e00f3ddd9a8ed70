"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorlake.llm import bfd, compression, decontam, langid, neardup, oracles, packing, pii, rollup, rules, secretscan, spans
from candorlake.llm.common import discard, shared_folder, stored, table
from candorlake.llm.tokens import token_counts


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd.pack_matrices(table(spark, sf_dir, "documents"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _spans_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(spans.listed(spans.base_of(F.col("spans"))).cast("binary"), 256).alias("base_sha256"),
        spans.listed(F.col("spans")).alias("spans"),
    )


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans_digest(pii.find(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


def op6_network_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans_digest(secretscan.find(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: inserted with their numbers of words, under two versions of a tokenizer;
    the later version revised to the numbers of token ids (this batch is committed twice, as after a crash); the
    documents of the earlier version deleted, but for those whose number of words can be divided by five."""
    counted = stored(token_counts(table(spark, sf_dir, "documents"), ("source", "lang")))
    words, tokens = (counted.withColumn("tokenizer", F.lit(v)) for v in ("words", "word_bpe_49k"))
    totals = rollup.TokenRollup(spark, shared_folder(spark))
    of_words = lambda df: rollup.inserts(df.withColumn("n_tokens", F.col("n_words")))
    totals.commit("0-insert", of_words(words), of_words(tokens))
    for _ in range(2):
        totals.commit("1-revise", rollup.revisions(tokens.withColumn("old_tokens", F.col("n_words"))))
    totals.compact()
    totals.commit("2-delete", rollup.deletes(words.withColumn("n_tokens", F.col("n_words")).filter("n_words % 5 <> 0")))
    out = stored(totals.totals())
    totals.drop()
    discard(counted)
    return out


def op9_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_bm25_decontamination": op2_bm25_decontamination,
    "op3_best_fit_matrices": op3_best_fit_matrices,
    "op4_compression_quality": op4_compression_quality,
    "op5_boosted_pii": op5_boosted_pii,
    "op6_network_secrets": op6_network_secrets,
    "op7_divergence_rules": op7_divergence_rules,
    "op8_token_rollup": op8_token_rollup,
    "op9_coordinate_join": op9_coordinate_join,
    "op10_byte_network_language": op10_byte_network_language,
}
ORACLES: dict[str, str] = {
    "op7_divergence_rules": oracles.QUALITY_RULES,
    "op9_coordinate_join": oracles.NEAR_DUPLICATES,
}
