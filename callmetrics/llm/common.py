"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one of this process only where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="callmetrics-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared folder and cut its lineage; executors may be lost afterwards."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut` for wide rows: a compressed columnar table in the shared folder."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    made = frame.sparkSession.read.parquet(path)
    made.stored_at = path
    return made


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` once everything that reads them has been cut."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let go of what no frame refers to any more. Spark deletes shuffle files, broadcasts and checkpoints when the
    driver's collector finds their frames unused, which a long chain of steps can't wait for."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a few numbers that may be broadcast: some 50 MB at most.
MOST_BROADCAST_ROWS = 500_000


def small_or_not(cut_frame: DataFrame) -> DataFrame:
    """A materialised frame of a few numbers a row, to be broadcast if it has few enough rows; any larger one is joined
    by a shuffle of both sides. The rows that come out are the same."""
    return F.broadcast(cut_frame) if cut_frame.count() <= MOST_BROADCAST_ROWS else cut_frame


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that name the rows equal in ``columns``, nulls included."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns] + [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*kept).alias("_k1"), F.xxhash64(F.lit(7), *kept).alias("_k2")]


def split_by(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``_k1`` and ``_k2`` are among those of ``named`` (distinct, materialised), and the others."""
    keys = small_or_not(named.select("_k1", "_k2"))
    return rows.join(keys, ["_k1", "_k2"], "left_semi"), rows.join(keys, ["_k1", "_k2"], "left_anti")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
