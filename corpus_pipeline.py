"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every stage's
rows as Parquet below the session's shared folder and rereads them as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specsheet.llm.scratch import Scratch
from specsheet.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    from specsheet.llm.quality import keep_documents

    return keep_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the one
    with the smallest id."""
    from specsheet.llm.jaccard_join import drop_near_duplicates

    return drop_near_duplicates(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    from specsheet.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    from specsheet.llm.secrets import mask_secrets

    return mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens."""
    from specsheet.llm.packing import pack_documents
    from specsheet.llm.queries import default_tokenizer

    return pack_documents(docs, default_tokenizer(), size=1024)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

# A fitted classifier and a tokenizer have no SQL form: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return docs
