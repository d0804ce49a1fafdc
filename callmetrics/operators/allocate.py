"""Ordered folds over groups, dealt over tasks: first fit into one target, and allocation to splits with quotas by stratum.

Both take groups in rank order and decide each by what earlier ones have left, so neither is a prefix sum. Groups are
range-sorted by rank; a part is one range.

*First fit*: to a part its groups are a function from the room on entry to the room on exit, a table of target + 1
numbers. Tables compose. Each part makes its own; stretches of parts are composed, the room is followed through the
stretches and then through the parts of each, and every part, with its room known, picks its takers.

*Quotas*: room is a number for each split and stratum, too much for a table. But while no split runs short, where a group
goes depends on its needs alone, so a part's sums by need pattern tell what it leaves. The driver follows the rooms over
those sums, a few numbers a part. A part in which a room may run out, or the order of the splits may turn, is folded by
a task that gives back the rooms. Then all parts are folded at once, each from its own rooms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.operators.storage import cut, stored

#: Parts of a stretch, whose tables are composed by one task.
STRETCH = 64
#: Groups between which equal rooms of a table are united.
UNITE = 256


def ranged(ranked: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``ranked`` sorted by ranges of ``order``, materialised, with ``_part``: a partition is one file and keeps its order."""
    lined_up = ranked.repartitionByRange(parts, *order) if parts else ranked.repartitionByRange(*order)
    return cut(lined_up.sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())


# -- first fit ------------------------------------------------------------------------------------------------------


def exit_rooms(sizes: Iterable[np.ndarray], target: int) -> np.ndarray:
    """For every room on entry from 0 to ``target`` the room that is left after groups of these sizes, each taken if it fits.

    Rooms that have become equal stay so, and only the distinct ones are followed.
    """
    rooms, of = np.arange(target + 1, dtype=np.int32), np.arange(target + 1, dtype=np.int32)
    largest, seen = target, 0
    for batch in sizes:
        for size in batch.tolist():
            if size > largest:
                continue
            rooms[rooms >= size] -= size
            seen += 1
            if seen % UNITE == 0:
                rooms, place = np.unique(rooms, return_inverse=True)
                of, largest = place.astype(np.int32)[of], int(rooms[-1])
                if not largest:
                    return rooms[of]
    return rooms[of]


def _walk(key: str, at: str, room: str | None, start: int) -> Callable:
    """Follows a room through tables in order: (at, room) at each, and (-1, room) behind the last of a ``key``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, at, "table", *([room] if room else [])]
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
        for _, held in groupby(rows, key=lambda r: r[0]):
            now, made = None, []
            for row in held:
                now = (row[3] if room else start) if now is None else now
                made.append((row[1], now))
                now = int(np.frombuffer(row[2], np.int32)[now])
            made.append((-1, now))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*made)], names=[at, "room"])

    return run


def entry_rooms(tables: DataFrame, target: int) -> tuple[DataFrame, int]:
    """((_part, room on entry) of each part, the room left at the end) from (_part, table) of the parts that have groups."""
    spread = tables.withColumn("_stretch", F.floor(F.col("_part") / STRETCH).cast("int"))

    def compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("_stretch").to_pylist(), b.column("table").to_pylist()))
        for stretch, held in groupby(rows, key=lambda r: r[0]):
            whole = None
            for _, table in held:
                table = np.frombuffer(table, np.int32)
                whole = table if whole is None else table[whole]
            yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["_stretch", "table"])

    in_order = spread.repartition("_stretch").sortWithinPartitions("_stretch", "_part")
    composed = in_order.mapInArrow(compose, "_stretch int, table binary").withColumn("one", F.lit(1))
    over = cut(composed.repartition(1).sortWithinPartitions("_stretch").mapInArrow(_walk("one", "_stretch", None, target), "_stretch int, room int"))
    left = over.where("_stretch = -1").first()
    inner = spread.join(F.broadcast(over), "_stretch").repartition("_stretch").sortWithinPartitions("_stretch", "_part")  # a row for 64 parts
    return inner.mapInArrow(_walk("_stretch", "_part", "room", target), "_part int, room int").where("_part >= 0"), left["room"] if left else target


def first_fit(ranked: DataFrame, target: int, group: str, parts: int | None = None) -> DataFrame:
    """(total, group) of the groups of (group, size, rank_key) that are taken; ``total`` is what all of them hold."""
    kind = ranked.schema[group].dataType.simpleString()
    placed = ranged(ranked.where((F.col("size") <= target) & (F.col("size") > 0)).select("rank_key", group, F.col("size").cast("int").alias("size")), ["rank_key", group], parts)

    def table(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[int] = []

        def sizes() -> Iterator[np.ndarray]:
            for batch in batches:
                if batch.num_rows:
                    part[:] = [batch.column("_part")[0].as_py()]
                    yield batch.column("size").to_numpy()

        made = exit_rooms(sizes(), target)
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["_part", "table"])

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = None
        for batch in batches:
            if not batch.num_rows:
                continue
            room = batch.column("room")[0].as_py() if room is None else room
            taken = []
            for size in batch.column("size").to_pylist():
                taken.append(size <= room)
                room -= size if size <= room else 0
            yield batch.select([group]).filter(pa.array(taken))

    rooms, left = entry_rooms(cut(placed.select("_part", "size").mapInArrow(table, "_part int, table binary")), target)
    met = placed.join(F.broadcast(rooms), "_part").select(group, "size", "room")  # a row for each part
    return met.mapInArrow(take, f"{group} {kind}").select(F.lit(target - left).cast("long").alias("total"), group)


# -- quotas ---------------------------------------------------------------------------------------------------------


def choose(need: list[int], names: list[str], rooms: list[list[int]]) -> int:
    """Which of ``names`` a group goes to, the fitting one with the least room left, the first by name; -1 if none fits."""
    fitting = [i for i in range(len(names)) if all(n <= r for n, r in zip(need, rooms[i]))]
    return min(fitting, key=lambda i: (sum(rooms[i]), names[i])) if fitting else -1


def fold(needs: Iterable[list[int]], names: list[str], rooms: list[list[int]]) -> Iterator[int]:
    """The choices for groups in order; ``rooms`` is left as it is after the last."""
    for need in needs:
        at = choose(need, names, rooms)
        if at >= 0:
            rooms[at] = [r - n for r, n in zip(rooms[at], need)]
        yield at


def leaves(patterns: list[tuple[list[int], list[int]]], names: list[str], rooms: list[list[int]]) -> list[list[int]] | None:
    """The rooms that a part leaves, from the (sums, least needs) of its need patterns, or None if they don't settle it.

    A pattern goes to the first split in order that some group of it may fit. That is what the fold does if no room runs
    short even when all are taken, and if no split's room falls below that of one before it.
    """
    order = sorted(range(len(names)), key=lambda i: (sum(rooms[i]), names[i]))
    after = [list(r) for r in rooms]
    for sums, least in patterns:
        for i in order:
            if all(n <= r for n, r in zip(least, rooms[i])):
                after[i] = [r - s for r, s in zip(after[i], sums)]
                break
    if any(r < 0 for room in after for r in room):
        return None
    keys = [(sum(rooms[i]), names[i]) for i in order], [(sum(after[i]), names[i]) for i in order]
    if any(keys[0][a] > keys[1][b] for a in range(len(order)) for b in range(a + 1, len(order))):
        return None
    return after


def by_quota(sizes: DataFrame, group: str, strata: list[str], rooms: dict[str, list[int]], parts: int | None = None) -> tuple[DataFrame, dict[str, list[int]]]:
    """((group, split), the rooms left) for groups (group, rank_key, a column of ``strata`` each) taken in rank order."""
    spark, names = sizes.sparkSession, sorted(rooms)
    kind = sizes.schema[group].dataType.simpleString()
    order = ["rank_key", group]
    lined_up = sizes.select(*order, *[F.col(s).cast("int").alias(s) for s in strata])
    placed = stored((lined_up.repartitionByRange(parts, *order) if parts else lined_up.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id()), "allocation", "_part")
    pattern = F.array(*[F.col(s) > 0 for s in strata])
    held = placed.groupBy("_part", pattern.alias("pattern")).agg(F.array(*[F.sum(s) for s in strata]).alias("sums"), F.array(*[F.min(s) for s in strata]).alias("least"))
    summed: dict[int, list] = {}
    for row in held.collect():  # a few numbers for each part and need pattern
        summed.setdefault(row["_part"], []).append((row["sums"], row["least"]))

    def last_rooms(start: list[list[int]]) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = [list(r) for r in start]
            for batch in batches:
                for _ in fold(zip(*(batch.column(s).to_pylist() for s in strata)), names, now):
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([[r for room in now for r in room]], pa.list_(pa.int32()))], names=["rooms"])

        return run

    now, entries = [list(rooms[n]) for n in names], []
    for part in sorted(summed):
        if not any(r for room in now for r in room):
            break
        entries.append((part, [r for room in now for r in room]))
        after = leaves(summed[part], names, now)
        if after is None:
            one = placed.where(F.col("_part") == part).drop("_part").coalesce(1).sortWithinPartitions(*order)
            flat = one.mapInArrow(last_rooms(now), "rooms array<int>").first()["rooms"]
            after = [flat[i : i + len(strata)] for i in range(0, len(flat), len(strata))]
        now = after

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_part", group, "rooms", *strata))))
        for _, of_part in groupby(rows, key=lambda r: r[0]):
            of_part = iter(of_part)
            first = next(of_part)
            room = [first[2][i : i + len(strata)] for i in range(0, len(first[2]), len(strata))]
            chosen = []

            def needs() -> Iterator[tuple]:
                for row in (first, *of_part):
                    chosen.append(row[1])
                    yield row[3:]

            splits = list(fold(needs(), names, room))
            kept = [(g, names[s]) for g, s in zip(chosen, splits) if s >= 0]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept)], names=[group, "split"])

    starts = spark.createDataFrame(entries, "_part int, rooms array<int>")
    met = placed.join(F.broadcast(starts), "_part").repartition("_part").sortWithinPartitions("_part", *order)  # a row for each part
    return met.mapInArrow(assign, f"{group} {kind}, split string"), dict(zip(names, now))
