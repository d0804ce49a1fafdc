"""Session building and table access shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer switched on."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` dealt over all cores if it comes in fewer partitions, as a small file does: worth a shuffle of its rows
    where much is computed of each. Larger inputs stay as they are read."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register driver tables as temporary views for SQL text shared with an oracle, rows dealt over the cores."""
    for name in names:
        spread(table(spark, sf_dir, name)).createOrReplaceTempView(name)
