"""The telemetry operators on streams of system samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callmetrics.operators.telemetry import STREAK


def per_second(samples: DataFrame, time: str, value: str, by: str, late: str = "10 seconds") -> DataFrame:
    """Tumbling one-second windows with first, peak and last value; rows later than ``late`` are dropped."""
    at = F.struct(F.col(time), F.col(value))
    windows = samples.withWatermark(time, late).groupBy(F.window(time, "1 second"), by)
    return windows.agg(F.min_by(value, at).alias("before"), F.max(value).alias("peak"), F.max_by(value, at).alias("after"), F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("second"), by, "before", "peak", "after", "n"
    )


def run_summary(flags: np.ndarray) -> tuple[int, int, int, int]:
    """(length, prefix, best, suffix) of the flagged runs in a stretch of samples."""
    breaks = np.flatnonzero(~flags)
    if not len(breaks):
        return (len(flags),) * 4
    gaps = np.diff(np.concatenate([[-1], breaks, [len(flags)]])) - 1
    return len(flags), int(gaps[0]), int(gaps.max()), int(gaps[-1])


def joined_runs(a: tuple, b: tuple) -> tuple[int, int, int, int]:
    """The summary of two stretches, one after the other."""
    prefix = a[0] + b[1] if a[1] == a[0] else a[1]
    suffix = b[0] + a[3] if b[3] == b[0] else b[3]
    return a[0] + b[0], prefix, max(a[2], b[2], a[3] + b[1]), suffix


def running_streaks(samples: DataFrame, flag: Column, by: str, order: str, length: int = STREAK) -> DataFrame:
    """(by, longest, has_streak) after each batch: the state of a key is the summary of the runs among its samples so far.

    Summaries are joined over batches; within a batch rows are taken in ``order``, and batches are taken to follow one
    another in it.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags = pd.concat(list(frames)).sort_values("o")["f"].to_numpy(dtype=bool)
        held = joined_runs(state.get, run_summary(flags)) if state.exists else run_summary(flags)
        state.update(held)
        yield pd.DataFrame({by: [key[0]], "longest": [held[2]], "has_streak": [held[2] >= length]})

    marked = samples.select(by, F.col(order).alias("o"), F.coalesce(flag, F.lit(False)).alias("f"))
    kind = samples.schema[by].dataType.simpleString()
    return marked.groupBy(by).applyInPandasWithState(count, f"{by} {kind}, longest long, has_streak boolean", "length long, prefix long, best long, suffix long", "update", GroupStateTimeout.NoTimeout)


def resumable(journal: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Journal entries of a stream, the first of each key within the watermark: a key that was seen is not taken up again.
    What a key's entries come to in the end is for ``journal.last_writes``, by which the last one wins."""
    return journal.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
