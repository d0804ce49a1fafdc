"""Bootstrap by slots: slot j of draw i takes the row that a digest of (seed, i, j) names.

A draw has as many slots as there are rows, so there are far more pairs of draw and row than rows. They never become
rows of a table: a task makes the rows of a stretch of slots as one array of numbers, sorts them and sends each block of
``BLOCK`` rows its share, a byte or two a pair. At a block the pairs of some draws meet its rows, and how often rows with
equal values were taken is added up there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, whose places fit 16 bits; draws that meet a block at once; slots of a stretch, a multiple of ``STEP``.
BLOCK, DRAWS, STRETCH, STEP = 1 << 16, 64, 2_000_000, 10_000

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The four digits of 0 to 9999 as little-endian words.
_DIGITS = np.frombuffer("".join(f"{i:04d}" for i in range(STEP)).encode(), "<u4").astype(np.uint32)


def first_words(words: list, n: int) -> np.ndarray:
    """The first 32 bits of the MD5 of ``n`` messages of one block; each of its 16 words is a number or one for each message."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            at = 7 * i % 16
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        t += a
        if isinstance(words[at], np.ndarray):
            t += words[at]
            t += np.uint32(_SINES[i])
        else:
            t += np.uint32((_SINES[i] + words[at]) & 0xFFFFFFFF)
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=u)
        np.left_shift(t, np.uint32(_TURNS[i]), out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()


def _step(head: str, high: int, low: int, up: int) -> np.ndarray:
    """First digest words of ``head`` and the slots from STEP * high + low, at least 1000, up to STEP * high + up."""
    before = f"{head}{high or ''}".encode()
    size = len(before) + 4
    block = bytearray(64)
    block[: len(before)], block[size], block[56:64] = before, 0x80, (8 * size).to_bytes(8, "little")
    words: list = np.frombuffer(bytes(block), "<u4").tolist()
    at, shift, digits = len(before) // 4, 8 * (len(before) % 4), _DIGITS[low:up]
    words[at] = (digits << np.uint32(shift)) | np.uint32(words[at])
    if shift:
        words[at + 1] = (digits >> np.uint32(32 - shift)) | np.uint32(words[at + 1])
    return first_words(words, up - low)


def slot_words(seed: int, draw: int, start: int, end: int) -> np.ndarray:
    """The first 32 bits of md5("seed:draw:slot") of the slots from ``start``, a multiple of STEP, to ``end``."""
    head = f"{seed}:{draw}:"
    short = [int(hashlib.md5(f"{head}{slot}".encode()).hexdigest()[:8], 16) for slot in range(start, min(end, 1000))]
    parts = [np.array(short, np.uint32)]
    for high in range(start // STEP, -(-end // STEP)):
        low, up = 0 if high else 1000, min(STEP, end - high * STEP)
        if low < up:
            parts.append(_step(head, high, low, up))
    return np.concatenate(parts)


def packed(places: np.ndarray) -> bytes:
    """Sorted 16-bit places as steps of a byte each if all are short, or as they are."""
    steps = np.diff(places, prepend=places.dtype.type(0))
    return b"\1" + steps.astype(np.uint8).tobytes() if steps.max() < 256 else b"\2" + places.astype("<u2").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(held, np.uint8, offset=1), dtype=np.int64) if held[:1] == b"\1" else np.frombuffer(held, "<u2", offset=1)


def pairs(spark, n: int, samples: int, seed: int) -> DataFrame:
    """(block, some, draw, taken): of each stretch of a draw's slots the places taken in a block; ``some`` is a set of draws."""
    stretches = -(-n // STRETCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for call in batch.column(0).to_pylist():
                draw, start = call // stretches, call % stretches * STRETCH
                rows = slot_words(seed, draw, start, min(n, start + STRETCH))
                rows = np.sort(rows % np.uint32(n) if n < 2**32 else rows)
                blocks, first = np.unique(rows >> np.uint32(16), return_index=True)
                taken = [packed(part) for part in np.split((rows & np.uint32(0xFFFF)).astype(np.int32), first[1:])]
                columns = [pa.array(blocks.astype(np.int64)), *(pa.array(np.full(len(taken), x, np.int32)) for x in (draw // DRAWS, draw)), pa.array(taken, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "some", "draw", "taken"])

    calls = samples * stretches
    tasks = min(calls, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, calls, 1, tasks).mapInArrow(run, "block long, some int, draw int, taken binary")


def redrawn(placed: DataFrame, n: int, samples: int, seed: int) -> DataFrame:
    """(draw, times, columns): how often rows with these values are taken in a draw, in parts to be added up. ``placed``
    has ``row``, the place from 0 to n - 1, and the columns of values."""
    values = [c for c in placed.columns if c != "row"]
    every = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // DRAWS)))
    rows = placed.select(F.shiftright("row", 16).cast("long").alias("block"), every.alias("some"), F.col("row").bitwiseAND(0xFFFF).cast("int").alias("at"), *values)
    schema = ", ".join(["draw int", "times long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "row")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = np.zeros(left.num_rows, np.int64)
        for c in values:
            codes = left.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            kinds = np.unique(kinds * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
        first = np.unique(kinds, return_index=True)[1]
        kind_at = np.zeros(BLOCK, np.int64)
        kind_at[left.column("at").to_numpy()] = kinds
        counts: dict[int, np.ndarray] = {}
        for draw, taken in zip(right.column("draw").to_pylist(), right.column("taken").to_pylist()):
            counts.setdefault(draw, np.zeros(len(first), np.int64))
            counts[draw] += np.bincount(kind_at[unpacked(taken)], minlength=len(first))
        drawn = np.array(list(counts), np.int32)
        times = np.array(list(counts.values()), np.int64).reshape(len(drawn), len(first))
        i, j = np.nonzero(times)
        same = left.select(values).take(pa.array(first[j]))
        return pa.table([pa.array(drawn[i]), pa.array(times[i, j]), *same.columns], names=["draw", "times", *values])

    return rows.groupBy("block", "some").cogroup(pairs(placed.sparkSession, n, samples, seed).groupBy("block", "some")).applyInArrow(meet, schema)
