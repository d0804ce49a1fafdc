"""What the operators on conversations share: turns in order, and digests of long ordered lists.

Turns are ordered by turn (null first); ties by the SHA-256 digest of role and text, so that the order never moves
texts. A null role or text counts as ``if_null``. Rows without a conversation id belong to no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named_turns(rows: DataFrame, if_null: str = "") -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text and without rows that name no conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(if_null)).alias(c)
    return rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))


def turn_digest(role: Column, text: Column) -> Column:
    """One digest for each pair of role and text: the role's length keeps the two apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def turn_order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of a text in UTF-8."""
    return F.crc32(text.cast("binary"))


def digest_in_order(rows: DataFrame, keys: list[str], order: list[str], piece: str, separator: str, name: str) -> DataFrame:
    """(keys, ``name``): SHA-256 of each key's pieces, joined by ``separator`` in the given order, in lower-case hex.

    A key's rows stream through the task that sorts them; a digest in the making is all that is held, however many
    there are. ``keys`` are never null.
    """
    kept = [*keys, *order, piece]
    lined_up = rows.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*[lined_up.schema[k] for k in keys], T.StructField(name, T.StringType())])
    between, n = separator.encode(), len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        state = None
        done: list[tuple] = []
        for batch in batches:
            pieces = batch.column(batch.num_columns - 1).to_pylist()
            for key, text in zip(zip(*(batch.column(i).to_pylist() for i in range(n))), pieces):
                if key != at:
                    if state is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(between)
                    state.update(text.encode())
            if len(done) >= 10_000:
                yield _batch(done, names)
                done = []
        if state is not None:
            done.append((*at, state.hexdigest()))
        if done:
            yield _batch(done, names)

    names = schema.names
    return lined_up.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
