"""Skyline of points by sorting and filtering: no point meets all others.

A grid over quantiles of each coordinate drops whole cells, those below an occupied cell in every coordinate. What is
left is range-sorted from the largest down, in which order no point is dominated by a later one, and each range keeps
its own skyline. Survivors are put into fewer ranges as long as that thins them out; one that fits a block is done.
Blocks that remain, in data where little dominates, are compared two by two, a task for each pair whose corners allow it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.operators.storage import cut

#: Cells of the grid at most; their numbers are all that the driver gets to see.
MOST_CELLS = 4096
#: Survivors that one task takes together, and points compared at once.
BLOCK, AT_ONCE = 16_384, 256


def below(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``points`` another of ``others`` dominates; equal points don't dominate each other."""
    found = np.zeros(len(points), bool)
    for at in range(0, len(others), AT_ONCE):
        some = others[at : at + AT_ONCE]
        left = np.flatnonzero(~found)
        for start in range(0, len(left), AT_ONCE):
            index = left[start : start + AT_ONCE]
            p = points[index][:, None, :]
            found[index] = ((some >= p).all(axis=2) & (some > p).any(axis=2)).any(axis=1)
    return found


def local_front(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The skyline of a range whose points come from the largest down; it is all that is held."""
    held, schema = None, None
    for batch in batches:
        schema = batch.schema
        points = np.column_stack([c.to_numpy() for c in batch.columns])
        for at in range(0, len(points), AT_ONCE):
            some = points[at : at + AT_ONCE]
            if held is not None:
                some = some[~below(some, held)]
            some = some[~below(some, some)]
            held = some if held is None else np.concatenate([held, some])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], names=schema.names)


def undominated_cells(occupied: np.ndarray) -> np.ndarray:
    """Occupied cells that no occupied cell exceeds in every coordinate."""
    reached = occupied
    for axis in range(occupied.ndim):
        reached = np.flip(np.maximum.accumulate(np.flip(reached, axis), axis), axis)
    above = np.zeros_like(occupied)
    above[tuple(slice(0, -1) for _ in occupied.shape)] = reached[tuple(slice(1, None) for _ in occupied.shape)]
    return occupied & ~above


def _thinned(points: DataFrame, names: list[str]) -> DataFrame:
    """``points`` without those of dominated grid cells."""
    sides = max(2, min(64, int(MOST_CELLS ** (1 / len(names)) + 1e-9)))
    at = [i / sides for i in range(1, sides)]
    cuts = points.agg(*[F.percentile_approx(n, at, 10 * sides).alias(n) for n in names]).first()
    if cuts[names[0]] is None:
        return points
    passed = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])), lambda c: c <= F.col(n)))
    cell = F.lit(0).cast("long")
    for n in names:
        cell = cell * sides + passed(n)
    marked = points.withColumn("_cell", cell)
    met = [r["_cell"] for r in marked.select("_cell").distinct().collect()]  # MOST_CELLS numbers at most
    occupied = np.zeros(sides ** len(names), bool)
    occupied[met] = True
    kept = np.flatnonzero(undominated_cells(occupied.reshape([sides] * len(names))).ravel()).tolist()
    return marked.where(F.col("_cell").isin(kept)).drop("_cell")


def _fronts(points: DataFrame, names: list[str], ranges: int | None) -> DataFrame:
    order = [F.col(n).desc() for n in names]
    lined_up = points.repartitionByRange(ranges, *order) if ranges else points.repartitionByRange(*order)
    return cut(lined_up.sortWithinPartitions(*order).mapInArrow(local_front, ", ".join(f"{n} double" for n in names)))


def _across(fronts: DataFrame, names: list[str]) -> DataFrame:
    """The skyline of several ranges' skylines, by pairs of ranges."""
    blocks = cut(fronts.withColumn("_block", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    corners = blocks.groupBy("_block").agg(*[F.max(n).alias(f"max_{n}") for n in names], *[F.min(n).alias(f"min_{n}") for n in names]).orderBy("_block").collect()
    high = np.array([[r[f"max_{n}"] for n in names] for r in corners])
    low = np.array([[r[f"min_{n}"] for n in names] for r in corners])
    pairs = [(corners[i]["_block"], corners[j]["_block"]) for j in range(len(corners)) for i in np.flatnonzero((high[:j] >= low[j]).all(axis=1)).tolist()]
    met = fronts.sparkSession.createDataFrame(pairs, "_i int, _j int")
    over = blocks.join(met, F.col("_block") == F.col("_i")).select("_i", "_j", *names)
    under = blocks.join(met, F.col("_block") == F.col("_j")).select("_i", "_j", "_at", *names).toDF("_ui", "_uj", "_at", *[f"_u_{n}" for n in names])

    def dominated(a: pa.Table, b: pa.Table) -> pa.Table:
        stack = lambda t: np.column_stack([c.to_numpy() for c in t.columns[-len(names) :]])
        if not a.num_rows or not b.num_rows:
            return b.select(["_at"]).slice(0, 0)
        return b.select(["_at"]).filter(pa.array(below(stack(b), stack(a))))

    lost = over.groupBy("_i", "_j").cogroup(under.groupBy("_ui", "_uj")).applyInArrow(dominated, "_at long")
    return blocks.join(lost.distinct(), "_at", "left_anti").select(*names)


def front(points: DataFrame, names: list[str]) -> DataFrame:
    """The undominated among distinct ``points``, larger being better in each of ``names`` (doubles without nulls)."""
    left = _fronts(_thinned(cut(points.select(*names)), names), names, None)
    n = left.count()
    while n > BLOCK:
        left = _fronts(left, names, -(-n // BLOCK))
        before, n = n, left.count()
        if n > before * 0.7:
            return _across(left, names)
    return _fronts(left, names, 1)
