"""Write-once documents on any file system that Spark knows.

A document carries the digest of its content. It is written whole under a name of its own and then moved to its place by
a step that fails if something stands there: a hard link on a local disk, a rename without overwriting elsewhere, which
a distributed file system decides in one place. So of two writers one wins, and no reader meets half a document. Object
stores that only imitate a rename give no such promise.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.functions.jsontext import canonical
from callmetrics.operators import select
from callmetrics.sources.writers import LockError, content_hash

# The version and the words of a final selection.
LOCK_VERSION = 1
SELECTION_RULE = "task_success,value_f1,schema_validity,lower_rss,higher_generation_throughput,lexical_fingerprint"
SELECTION_SOURCE = "validation_only_controlled_runs"
RECIPE_FIELDS = ("resolved_fingerprint", "recipe", "hashes", "validation_metrics", "git_commit", "immutable")


def local_path(path: str) -> str | None:
    return path.removeprefix("file://").removeprefix("file:") if "://" not in path or path.startswith("file:") else None


class _Files:
    """The few calls of Hadoop's file system that a lock needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.context = spark._jsc.hadoopConfiguration()
        self.spark, self.path = spark, self.hadoop.Path(path)
        self.system = self.path.getFileSystem(self.context)

    def put_once(self, data: bytes) -> bool:
        """Whether the bytes are now at the path; False if another document was there before."""
        own = self.hadoop.Path(self.path.getParent(), f".{self.path.getName()}.{uuid.uuid4().hex}")
        out = self.system.create(own, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        place = self.hadoop.FileContext.getFileContext(self.system.getUri(), self.context)
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            place.rename(own, self.path, options)
            return True
        except Exception:
            if not self.system.exists(self.path):
                raise
            return False
        finally:
            self.system.delete(own, False)

    def put(self, data: bytes) -> None:
        out = self.system.create(self.path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self) -> bytes | None:
        if not self.system.exists(self.path):
            return None
        held = self.system.open(self.path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held))
        finally:
            held.close()


def _put_once(path: str, data: bytes, spark: SparkSession | None) -> bool:
    local = local_path(path)
    if local is None:
        return _Files(spark or SparkSession.active(), path).put_once(data)
    own = os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.{uuid.uuid4().hex}")
    with open(own, "xb") as file:
        file.write(data)
        file.flush()
        os.fsync(file.fileno())
    try:
        os.link(own, local)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(own)


def put(path: str, data: bytes, spark: SparkSession | None = None) -> None:
    """Write bytes on any file system, in place of what is there."""
    local = local_path(path)
    if local is None:
        _Files(spark or SparkSession.active(), path).put(data)
    else:
        with open(local, "wb") as file:
            file.write(data)
        sums = os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc")
        if os.path.exists(sums):  # of what Hadoop's local file system wrote there before
            os.unlink(sums)


def get(path: str, spark: SparkSession | None = None) -> bytes | None:
    """The bytes at a path, None if there is nothing."""
    return _read(path, spark)


def _read(path: str, spark: SparkSession | None) -> bytes | None:
    local = local_path(path)
    if local is None:
        return _Files(spark or SparkSession.active(), path).read()
    try:
        with open(local, "rb") as file:
            return file.read()
    except FileNotFoundError:
        return None


def write_lock(path: str, document: dict[str, Any], spark: SparkSession | None = None) -> dict[str, Any]:
    """Write a document with its content hash once; writing the same again is allowed, another is a LockError."""
    made = {**document, "content_sha256": content_hash(document)}
    data = (canonical(made) + "\n").encode()
    if not _put_once(path, data, spark) and _read(path, spark) != data:
        raise LockError(f"{path.rsplit('/', 1)[-1]} is locked with other content")
    return made


def read_lock(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """The document at a path; LockError if it isn't there, or isn't what was locked."""
    data = _read(path, spark)
    if data is None:
        raise LockError(f"{path.rsplit('/', 1)[-1]} is not there")
    try:
        made = json.loads(data)
    except ValueError as error:
        raise LockError(f"{path.rsplit('/', 1)[-1]} is no document") from error
    if not isinstance(made, dict) or made.get("content_sha256") != content_hash(made):
        raise LockError(f"{path.rsplit('/', 1)[-1]} was changed after it was locked")
    return made


def final_selection(rows: DataFrame, rivals: int = 2, completed: Column | None = None, validation_only: Column | None = None, key: list[Column] | None = None) -> dict[str, Any]:
    """The document of a final selection: the winner among controlled, completed, validation-only runs, its first rivals on
    the skyline of success, value F1 and memory, and the recipe of each. ``rows`` are one row for each run, with run_id,
    controlled, fingerprint, the metrics of the selection key, and any of the recipe's fields as JSON text."""
    there = lambda name, other: F.col(name) if name in rows.columns else F.lit(other)
    done = completed if completed is not None else F.coalesce(there("status", "completed"), F.lit("completed")) == "completed"
    only = validation_only if validation_only is not None else there("validation_only", True)
    fit = rows.where(select.is_final_candidate(done, only, F.col("controlled"), F.col("run_id")))
    front = select.skyline(fit, "run_id", ["task_success", "argument_value_f1"], ["rss_gib"], missing="zero")
    chosen = select.winner_and_rivals(fit, key or select.selection_key(), front, "run_id", rivals).where("run_id is not null").orderBy("place").collect()  # 1 + rivals rows
    if not chosen:
        raise ValueError("no controlled validation-only runs are available for final selection")
    names = [r["run_id"] for r in chosen]
    recipes = {}
    for r in chosen:
        said = r.asDict()
        resolved = said.get("resolved_fingerprint") or said.get("fingerprint") or ""
        given = {f: json.loads(said[f]) if f not in ("resolved_fingerprint", "git_commit") and said.get(f) else said.get(f) for f in RECIPE_FIELDS}
        recipes[r["run_id"]] = {f: {} if v is None and f != "git_commit" else v for f, v in given.items()} | {"source_run": r["run_id"], "resolved_fingerprint": resolved}
    return {"lock_version": LOCK_VERSION, "winner": names[0], "pareto_competitors": names[1:], "candidates": names, "candidate_recipes": recipes, "selection_rule": SELECTION_RULE, "selection_source": SELECTION_SOURCE}


def lock_final_selection(path: str, rows: DataFrame, rivals: int = 2) -> dict[str, Any]:
    """Select and lock in one step; the lock stands once and for all."""
    return write_lock(path, final_selection(rows, rivals), rows.sparkSession)
