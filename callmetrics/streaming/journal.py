"""Last write wins on a stream of journal entries, and what is still to do.

Each key keeps its latest entry as state and gives an entry on when it is the latest so far. A timer lets go of a key
that has been quiet for a while; the table that the entries go to holds them for good, and compares again. Entries may
come late, in any order and more than once.

The table is a folder of batches, each written as a whole and again in the same place if a batch is repeated. What
counts is the last write among all batches; ``compact`` puts them into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from callmetrics.operators.select import last_write, to_resume

#: What a session needs: the state store that knows timers, and no batches without data, which timers by the clock would
#: call for without end. Timers then go off along with a later batch.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class LastWrite(StatefulProcessor):
    """Keeps the latest entry of a key by ``order`` and gives on each that replaces it."""

    def __init__(self, schema: StructType, order: tuple[str, ...], quiet_ms: int):
        self.schema, self.order, self.quiet_ms = schema, order, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def _place(self, entry) -> tuple:
        return tuple((entry[c] is not None, entry[c]) if entry[c] is not None else (False, 0) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=self._place)
        held = self.latest.get() if self.latest.exists() else None
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(now + self.quiet_ms)
        self.timer.update((now + self.quiet_ms,))
        if held is None or self._place(best) > self._place(dict(zip(self.schema.names, held))):
            self.latest.update(tuple(best[c] for c in self.schema.names))
            yield Row(**{c: best[c] for c in self.schema.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_writes(journal: DataFrame, key: str, order: list[str], quiet_ms: int = 3_600_000) -> DataFrame:
    """The entries of a stream that are their key's latest when they come; a session needs ``SETTINGS``.

    Timestamps are held as microseconds: the state gives them back with a time zone, a row's own come without one, and
    the two don't compare.
    """
    times = [f.name for f in journal.schema if isinstance(f.dataType, TimestampType)]
    plain = journal.withColumns({c: F.unix_micros(F.col(f"`{c}`")) for c in times})
    made = LastWrite(plain.schema, tuple(order), quiet_ms)
    latest = plain.groupBy(key).transformWithState(made, plain.schema, "Update", "ProcessingTime")
    return latest.withColumns({c: F.timestamp_micros(F.col(f"`{c}`")) for c in times})


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a batch stands in a folder of its own, and a repeated one takes its place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """The latest entry of each key that the table holds."""
    return last_write(spark.read.parquet(path).drop("batch"), key, order)


def compact(spark: SparkSession, path: str, to: str, key: str, order: list[str]) -> str:
    """The table in one batch below ``to``; new batches of the same stream may go on there. Returns the new table's path."""
    place = f"{to}/{uuid.uuid4().hex}"
    current(spark, path, key, order).write.parquet(f"{place}/batch=-1")
    return place


def still_to_do(plan: DataFrame, spark: SparkSession, path: str, key: str, order: list[str], done: Callable[[], Column]) -> DataFrame:
    """Planned rows whose key's last entry isn't finished: a run that failed after it had finished is to be done again."""
    return to_resume(plan, current(spark, path, key, order), key, done())
