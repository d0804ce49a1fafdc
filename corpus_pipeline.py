"""From documents to a tokenised training mix: quality rules, line dedup, near duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmetrics.llm import stages
from callmetrics.llm.common import stored, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup_stage),
    ("ngram_jaccard", stages.near_duplicates),
    ("mix_sources", stages.mix_sources),
    ("bpe", stages.bpe_stage),
]

#: SQL can't express the tokens; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
