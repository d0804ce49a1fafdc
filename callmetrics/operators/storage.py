"""Checkpoints and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of this process serves only where that setting is missing in a local
    session, as in tests. A cluster without it is refused."""
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


def stored(frame: DataFrame, name: str, *by: str) -> DataFrame:
    """``frame`` as a columnar table in the shared folder, a folder for each value of ``by``, so that one can be read alone."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (frame.write.partitionBy(*by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
