"""Run directories as a data source: ``spark.read.format("callmetrics_runs").option("table", ...).load(root)``.

A partition is one run, listed when the scan is planned. Its file is read as a whole and strictly: where a line isn't
what the table holds, the run has no rows. Positions count the lines with something on them, from 0 within each run.

Tables: ``predictions`` (record, prediction, source_id), ``samples`` (numbers of ``system_metrics.csv``) and
``documents`` (one JSON document as text: ``option("file", "manifest.json")``). Paths may be local or any URI that
pyarrow's file systems know; files that only Spark's own readers reach are for the functions in ``readers``.
"""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from callmetrics.functions.jsontext import StrictJsonError, canonical, strict_loads

NAME = "callmetrics_runs"
FILES = {"predictions": "predictions.jsonl", "samples": "system_metrics.csv", "documents": "manifest.json"}
SCHEMAS = {
    "predictions": "run string, pos long, record string, prediction string, source_id string",
    "samples": "run string, pos long, timestamp double, rss_gib double, memory_available_gib double, swap_used_gib double, disk_free_gib double, mlx_allocator_active_bytes double, mlx_allocator_peak_bytes double, pressure_state string",
    "documents": "run string, value string",
}


@dataclass
class RunPartition(InputPartition):
    run: str
    path: str


def _prediction(line: str) -> tuple:
    row = strict_loads(line)
    if not isinstance(row, dict) or not isinstance(row.get("record"), dict) or not isinstance(row.get("prediction"), str):
        raise ValueError("a prediction needs an object record and a text")
    record = row["record"] if row["record"].get("query") is not None else {"query": "[redacted]", **{k: v for k, v in row["record"].items() if k != "query"}}
    name = row.get("source_id")
    return canonical(record), row["prediction"], name if name is None or isinstance(name, str) else canonical(name)


def _number(text: str | None) -> float | None:
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def rows_of(table: str, run: str, text: str) -> list[tuple]:
    """The rows of one run's file; none if any line is unfit."""
    try:
        if table == "documents":
            value = strict_loads(text)
            return [(run, canonical(value))] if isinstance(value, dict) else []
        if table == "predictions":
            lines = [line for line in text.split("\n") if line.strip()]
            return [(run, pos, *_prediction(line)) for pos, line in enumerate(lines)]
        names = [f.split(" ")[0] for f in SCHEMAS["samples"].split(", ")[2:]]
        held = list(csv.DictReader(io.StringIO(text), strict=True))
        return [(run, pos, *[row.get(n) or None if n == "pressure_state" else _number(row.get(n)) for n in names]) for pos, row in enumerate(held)]
    except (StrictJsonError, ValueError, csv.Error):
        return []


class RunReader(DataSourceReader):
    def __init__(self, table: str, root: str, file: str):
        self.table, self.root, self.file = table, root, file

    def partitions(self) -> list[RunPartition]:
        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(self.root)
        folders = [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and not f.base_name.startswith(".")]
        return [RunPartition(f.base_name, f"{f.path}/{self.file}") for f in sorted(folders, key=lambda f: f.base_name)]

    def read(self, partition: RunPartition) -> Iterator[tuple]:
        import pyarrow.fs as fs

        system, _ = fs.FileSystem.from_uri(self.root)
        if partition is None or system.get_file_info(partition.path).type != fs.FileType.File:
            return
        with system.open_input_stream(partition.path) as file:
            data = file.read()
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return
        yield from rows_of(self.table, partition.run, text)


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "predictions")
        if table not in SCHEMAS:
            raise ValueError(f"no such table of runs: {table}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema: StructType) -> RunReader:
        root = self.options.get("path")
        if not root:
            raise ValueError("a path to the run directories is needed")
        table = self._table()
        return RunReader(table, root if "://" in root else f"file://{root}", self.options.get("file", FILES[table]))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(RunSource)
