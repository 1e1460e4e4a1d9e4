"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, katz, lines, merkle, minhash, packing, phrases, quality, shards, simhash, topk, toxicity, urls
from .common import fold, table
from .oracles import ORACLES

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), 40)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.toxicity_scores(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = fold(F.col("doc_id"), 7)  # null for a null id, which is neither learnt from nor held out
    out = katz.katz_scores(table(spark, sf_dir, "documents"), rest != 2)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"), width=4, distance=4)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_bpe, op3_shards, op4_topk, op5_packing, op6_toxicity, op7_near_dedup, op8_urls, op9_lines, op10_katz, op11_phrases, op12_simhash, op13_manifest, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
