"""Corpus pipeline: from raw documents to packed token sequences.

Each stage works on all rows its predecessor kept. The first three return the columns of
``documents``, less the rows they reject; the last returns the places of token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facejobs.llm import common, near_copies, packing, quality_rules, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, by a model of the labelled rows among them."""
    common.small_batches(spark)
    return toxicity.keep(docs, common.labels(spark, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a quality rule."""
    return quality_rules.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies: five-word shingle
    sets of Jaccard similarity 0.8 or more, found exactly (op4's 3 bits miss most of these)."""
    common.small_batches(spark)
    return near_copies.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs: a row per piece with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: The toxicity model, XXH64 fingerprints and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again for the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
