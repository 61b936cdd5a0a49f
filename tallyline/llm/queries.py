"""The queries of this package: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.context_mixing import scored_texts
from tallyline.llm.decontamination import contained_items
from tallyline.llm.exact_topk import exact_topk
from tallyline.llm.html_text import main_text
from tallyline.llm.line_dedup import without_shared_lines
from tallyline.llm.merkle import merkle_manifest, proof_digest
from tallyline.llm.mixing import quality_domains, with_rates
from tallyline.llm.near_dedup import near_duplicates
from tallyline.llm.token_alignment import aligned_tokens
from tallyline.llm.token_counts import token_counts
from tallyline.llm.token_shards import token_shards
from tallyline.llm.toxicity import toxicity
from tallyline.llm.urls import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_shards(table(spark, sf_dir, "documents"), vocabulary, 2, remembered=1_600_000)


def op4_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_texts(table(spark, sf_dir, "documents"), history=1)


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    chances = (F.round(p, 6).alias(p) for p in ("p_low_quality", "p_toxic"))
    return found.select("doc_id", *chances, "rejected")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Fraction(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_shared_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.md5("clean_text").alias("clean_md5"))


MIX = {"good": 0.88, "low": 0.12, "toxic": 0.0}


def op10_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality_domains(table(spark, sf_dir, "labels"))
    return with_rates(table(spark, sf_dir, "documents"), labels, MIX).select("doc_id", "n_tokens", "rate", "copies")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned_tokens(table(spark, sf_dir, "documents"), *paths)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    received = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(table(spark, sf_dir, "documents"), received)
    proof = proof_digest(F.col("steps")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


QUERIES: dict[str, Query] = {
    "op2_context_mixing": op2_context_mixing,
    "op6_toxicity": op6_toxicity,
    "op10_mixing_rates": op10_mixing_rates,
    "op3_url_verdicts": op3_url_verdicts,
    "op5_exact_topk": op5_exact_topk,
    "op4_contained_items": op4_contained_items,
    "op9_shared_lines": op9_shared_lines,
    "op1_token_shards": op1_token_shards,
    "op7_token_counts": op7_token_counts,
    "op8_near_duplicates": op8_near_duplicates,
    "op11_token_alignment": op11_token_alignment,
    "op12_main_text": op12_main_text,
    "op13_merkle_manifest": op13_merkle_manifest,
}
