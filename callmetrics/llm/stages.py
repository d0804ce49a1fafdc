"""Stages of the corpus pipeline: each takes documents (doc_id, text, lang, source, n_chars) and, but for the last,
returns documents again.

Rows are told apart by all that a stage looks at, not by their id alone: an id that stands for several texts has each
judged by itself, null ids are kept like any other, repeated rows are treated alike (near duplicates keep one of them).
Empty and null texts fail the quality rules; texts of any length are read whole; an empty table gives no rows; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import bpe, jaccard, line_dedup, mixing, quality
from callmetrics.llm.common import WORD, cut, row_key, split_by
from callmetrics.llm.q_bpe import digests, vocabulary_path


def _packed(documents: DataFrame, *key: str) -> DataFrame:
    """(doc_id, source, text, others): other columns in a struct, where their names are in nobody's way; with ``key``,
    the hashes ``_k1`` and ``_k2`` of these columns too."""
    others = [c for c in documents.columns if c not in ("doc_id", "source", "text")]
    return documents.select(*(row_key(*key) if key else []), "doc_id", "source", "text", F.struct(F.lit(1), *others).alias("others"))


def _unpacked(made: DataFrame, like: DataFrame, measured: bool = True) -> DataFrame:
    """The columns of ``like`` again; ``measured``: with ``n_chars`` of the text as it is now."""
    now = {c: F.col(c) for c in ("doc_id", "source", "text")}
    if measured:
        now["n_chars"] = F.length("text").cast("long")
    return made.select(*[now.get(c, F.col("others").getField(c)).alias(c) for c in like.columns])


def quality_rules(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    key = ("doc_id", "text", "lang", "source")
    judged = quality.judge(documents.select(*row_key(*key), "lang", "source", "text"), keep=("_k1", "_k2"))
    refused = cut(judged.where(~F.col("kept")).select("_k1", "_k2").distinct())
    return _unpacked(split_by(_packed(documents, *key), refused)[1], documents, measured=False)


def line_dedup_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document that loses all its words that way goes."""
    made = line_dedup.dedup_lines(_packed(documents))
    return _unpacked(made.where((F.size("removed") == 0) | F.regexp_like("text", F.lit(WORD))), documents)


def near_duplicates(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component (five words, 0.8), once."""
    found = jaccard.near_components(documents.select("doc_id", "text"), jaccard.Similarity(n=5, percent=80), named=True)
    found = cut(found.groupBy("_k1", "_k2").agg(F.first(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1"))
    touched, untouched = split_by(_packed(documents, "doc_id", "text"), found)
    once = touched.join(found.where("stays"), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    columns = ["doc_id", "source", "text", "others"]
    return _unpacked(untouched.select(*columns).unionByName(once.select(*columns)), documents, measured=False)


def mix_sources(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each serving of a document in the mix; the one at which the budget ends keeps its first words, with
    all that stands between them."""
    mixed = mixing.mix(documents.select("doc_id", "source", "text", *row_key("doc_id", "text", "source")), keep=("_k1", "_k2"))
    served = cut(mixed.where("taken > 0").select("_k1", "_k2", "row", "size", "taken"))
    counted = served.groupBy("_k1", "_k2").agg(F.countDistinct("row").alias("rows"), F.count(F.lit(1)).alias("n"), F.min("taken").alias("least"), F.first("size").alias("size"))
    often = cut(counted.where("n > 1 or least < size"))
    keyed = _packed(documents, "doc_id", "text", "source")
    rest = split_by(keyed, cut(served.select("_k1", "_k2").distinct()))[0]
    several, single = split_by(rest, often)  # served once and whole: as they are
    met = several.join(often.where("rows = 1"), ["_k1", "_k2"]).drop("rows", "n", "least", "size")
    same = several.join(often.where("rows > 1"), ["_k1", "_k2"]).drop("rows", "n", "least", "size").dropDuplicates(["_k1", "_k2"])
    again = met.unionByName(same).join(served.select("_k1", "_k2", "size", "taken"), ["_k1", "_k2"])
    # the pieces of a text up to the end of each word: blanks, then the word
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), "")).otherwise(F.col("text"))
    columns = ["doc_id", "source", "text", "others"]
    return _unpacked(single.select(*columns).unionByName(again.withColumn("text", first).select(*columns)), documents)


def bpe_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each serving."""
    return digests(bpe.encode_and_decode(documents.select("doc_id", "text"), vocabulary_path()))
