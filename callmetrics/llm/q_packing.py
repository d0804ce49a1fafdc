"""Query op13: all documents packed into sequences of 2,048 tokens."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import packing
from callmetrics.llm.common import table

#: The id that ends a document.
END_ID = 1


def vocabulary_path() -> str:
    """The published byte-level vocabulary that the query uses."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return os.path.join("/opt/tokenizers", "byte_bpe_50k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: SQL knows no tokenizer; tests hold the pieces against the library and the sequences against the contract.
SQL: dict[str, str] = {}
