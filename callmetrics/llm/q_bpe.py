"""Query op4: all documents through the BPE encoder and decoder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import bpe
from callmetrics.llm.common import table


def vocabulary_path() -> str:
    """The published vocabulary that the queries use."""
    try:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    except ImportError:
        return os.path.join("/opt/tokenizers", "word_bpe_49k.json")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe.encode_and_decode(docs, vocabulary_path()))


SQL: dict[str, str] = {}
