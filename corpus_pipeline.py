"""The training-data pipeline: quality rules, toxicity, line dedup, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read again as the
next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import lines, minhash, packing, quality, toxicity
from folioflow.llm.common import clear, mark, staged, table
from folioflow.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return quality.quality_filter(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model learns from the labelled documents of this stage's input."""
    return toxicity.toxicity_filter(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of a source go from its texts; documents stay."""
    return lines.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.best_fit_packing(docs, tokenizer=tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Training a classifier and packing with a priority rule are no SQL; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = mark(spark)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, at, keep=1)  # what the stage staged, and the stage before
    return docs
