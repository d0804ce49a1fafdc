"""Bootstrap by Poisson weights: one pass over the rows, no table of rows by draws.

In each draw a row counts Poisson(1) times, independently of the others, so draws need no row numbers and no total, and
their sums merge. A row's weight in a draw comes from 64 bits of a digest of its id and the draw's number, mixed in
32-bit arithmetic that any engine can repeat, and compared with the cumulative Poisson probabilities. A task keeps one
array of sums for each column, as long as there are draws; these are added up by draw.

Null ids count as the empty text, equal ids have equal weights; a null value counts as 0; a draw in which no row counts
has no statistic; a series without rows is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constants of the mix, fixed values: a step between draws and two odd multipliers.
DRAW_STEP, FIRST_FACTOR, SECOND_FACTOR = 2654435769, 2246822507, 3266489909
#: Rows whose weights are held at once.
ROWS_AT_ONCE = 256


def poisson_bounds(most: int = 12) -> list[int]:
    """Of 2 ** 32 equally likely numbers, those from the k-th bound on stand for more than k."""
    shares = [math.exp(-1) / math.factorial(k) for k in range(most + 1)]
    return [min(2**32 - 1, round(math.fsum(shares[: k + 1]) * 2**32)) for k in range(most + 1)]


def words_of(row_id: Column, seed: int) -> list[Column]:
    """Two 32-bit words of a row's digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"))
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "_h1"), (9, "_h2"))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST_FACTOR)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND_FACTOR)
    x ^= x >> np.uint32(16)
    return x


def weights(first: np.ndarray, second: np.ndarray, samples: int) -> np.ndarray:
    """Poisson(1) weights by row and draw, for the rows' two words."""
    steps = (np.arange(samples, dtype=np.uint64) * DRAW_STEP).astype(np.uint32)
    mixed = _mixed(first.astype(np.uint32)[:, None] ^ steps[None, :])
    mixed ^= second.astype(np.uint32)[:, None]
    return np.searchsorted(np.array(poisson_bounds(), np.uint32), _mixed(mixed), side="right")


def poisson_sums(rows: DataFrame, row_id: str, columns: tuple[str, ...], samples: int, seed: int = 42) -> DataFrame:
    """(draw, weight, columns): for each draw the weights and the weighted columns added up."""
    kept = rows.select(*words_of(F.col(row_id), seed), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(columns) + 1, samples))
        met = False
        for batch in batches:
            met |= batch.num_rows > 0
            first, second = (batch.column(i).to_numpy() for i in (0, 1))
            values = np.stack([np.ones(batch.num_rows), *(batch.column(i + 2).to_numpy() for i in range(len(columns)))])
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                sums += values[:, some] @ weights(first[some], second[some], samples).astype(np.float64)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples, dtype=np.int32)), *map(pa.array, sums)], names=["draw", "weight", *columns])

    schema = ", ".join(["draw int", *(f"`{c}` double" for c in ("weight", *columns))])
    by_task = kept.mapInArrow(run, schema)
    return by_task.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("weight", *columns)])


def mean_of(value: str) -> Column:
    """The mean of a draw from its sums."""
    return F.when(F.col("weight") > 0, F.col(value) / F.col("weight"))


def f1_of(matches: str, predicted: str, gold: str) -> Column:
    """Micro F1 of a draw from its sums."""
    m, p, g = F.col(matches), F.col(predicted), F.col(gold)
    f1 = F.when((p == 0) & (g == 0), 1.0).when(m == 0, 0.0).otherwise(2 * (m / p) * (m / g) / (m / p + m / g))
    return F.when(F.col("weight") > 0, f1)
