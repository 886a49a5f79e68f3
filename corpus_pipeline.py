"""A training corpus from `documents`: filter, deduplicate, decontaminate, sanitise, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylake.llm import decontaminate, jaccard, mixing, pii, quality
from quarrylake.llm._work import MADE, stored, tidy, without
from quarrylake.llm.entry import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard."""
    return jaccard.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = stored(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "pipeline-contaminated")
    return without(docs, "doc_id", found)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and telling terms replaced."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (mix_<name> where documents have such a column)."""
    out = mixing.mix(docs)
    return out.where(f"{'mix_taken' if 'mix_taken' in out.columns else 'taken'} > 0")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("source_mixing", mixing_stage),
]

ORACLE_SQL = None  # neither the classifier nor the near-duplicate components can be put in SQL that ends in time


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(MADE)
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tidy(spark, before, keep=(MADE[-1],))
    return STAGES[-1][1](spark, docs, sf_dir)
