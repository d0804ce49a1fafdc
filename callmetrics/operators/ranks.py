"""Exact order statistics without sorting everything: brackets from mergeable sketches, then counts inside them.

A quantile sketch of a large group gives two values that enclose a wanted rank; they are a share of about 4 / ACCURACY
of the rows apart. One pass counts what lies below and, value by value, what lies between, sums that combine before the
shuffle; the rank then falls on one of the few values between. Counts tell if a bracket missed its rank, and such ranks
are looked for among all values of their group. Groups of at most ``SMALL`` rows need no sketch.

Nulls are no values. A group is what groupBy makes of its columns, null being a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.operators.storage import cut

ACCURACY = 20_000
SMALL = 100_000


def _joined(rows: DataFrame, more: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``more`` where ``keys`` are the same, null being equal to null."""
    if not keys:
        return rows.crossJoin(F.broadcast(more))  # a row for each rank asked for
    named = more.select(*[F.col(c).alias(f"_g_{c}") for c in keys], *[c for c in more.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(named, same, how).drop(*[f"_g_{c}" for c in keys])


def _counted(rows: DataFrame, by: tuple[str, ...], value: str, asked: DataFrame) -> DataFrame:
    """(by, _name, _rank, _value, _count, _upto): per rank the values between its brackets in order, with the rows up to
    each; what lies below the lower bracket comes first, as null."""
    met = _joined(rows, asked, by).where(F.col("_high").isNull() | (F.col(value) <= F.col("_high")))
    inside = F.when(F.col("_low").isNull() | (F.col(value) >= F.col("_low")), F.col(value))
    counts = met.groupBy(*by, "_name", "_rank", inside.alias("_value")).agg(F.count(F.lit(1)).alias("_count"))
    upto = Window.partitionBy(*by, "_name").orderBy(F.col("_value").asc_nulls_first())
    return counts.withColumn("_upto", F.sum("_count").over(upto))


def _hit(counted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, _name, _rank, _value, _before, _ties): the value that has each rank, the rows below it and those equal to it."""
    before = F.col("_upto") - F.col("_count")
    found = counted.where(F.col("_value").isNotNull() & (before <= F.col("_rank")) & (F.col("_upto") > F.col("_rank")))
    return found.select(*by, "_name", "_rank", "_value", before.alias("_before"), F.col("_count").alias("_ties"))


def _sketched(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def select(rows: DataFrame, by: tuple[str, ...], value: str, asked: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(by, _name, _rank, _value, _before, _ties) for ``asked`` (by, _n, _name, _rank): the value at each rank, from 0,
    among the ``_n`` values of a group. ``shares`` say roughly where in a large group the rank of each name lies."""
    kind = rows.schema[value].dataType
    nothing = F.lit(None).cast(kind)
    if not _sketched(kind):
        return _hit(_counted(rows, by, value, asked.withColumn("_low", nothing).withColumn("_high", nothing)), by)
    if asked.where(F.col("_n") > SMALL).isEmpty():
        return _hit(_counted(rows, by, value, asked.withColumn("_low", nothing).withColumn("_high", nothing)), by)
    margin = 2.0 / ACCURACY
    points = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-margin, margin)]
    large = asked.where(F.col("_n") > SMALL).select(F.lit(1).alias("_large"), *by).distinct()
    sketch = _joined(rows, large, by).groupBy(*by).agg(F.percentile_approx(value, points, ACCURACY).alias("_q"))
    ends = [F.struct(F.lit(name).alias("_name"), F.get("_q", F.lit(2 * i)).alias("_low"), F.get("_q", F.lit(2 * i + 1)).alias("_high")) for i, name in enumerate(shares)]
    brackets = sketch.select(*by, F.inline(F.array(*ends)))
    asked = cut(_joined(asked, brackets, (*by, "_name"), "left"))
    found = cut(_hit(_counted(rows, by, value, asked), by))
    if found.count() == asked.count():
        return found
    again = _joined(asked, found.select(*by, "_name", F.lit(True).alias("_found")), (*by, "_name"), "left").where("_found is null")
    again = again.select(*by, "_n", "_name", "_rank", nothing.alias("_low"), nothing.alias("_high"))
    return found.unionByName(_hit(_counted(rows, by, value, again), by))


def sizes(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("_n"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Floor-rank percentiles: the value at floor(share (n - 1)) of each group's values; 0 in a group without values."""
    held = rows.select(*by, value)
    groups = cut(sizes(held, by, value))
    at = lambda s: F.floor(F.lit(s) * (F.col("_n") - 1))
    asked = groups.where("_n > 0").select(*by, "_n", F.inline(F.array(*[F.struct(F.lit(k).alias("_name"), at(s).alias("_rank")) for k, s in shares.items()])))
    picked = select(held.where(F.col(value).isNotNull()), by, value, asked, shares)
    none = F.lit(0).cast(rows.schema[value].dataType)
    empty = groups.where("_n = 0").select(*by, F.lit(None).cast("string").alias("_name"), F.lit(None).cast(rows.schema[value].dataType).alias("_value"))
    both = picked.select(*by, "_name", "_value").unionByName(empty)
    return both.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("_name") == k, F.col("_value"))), none).alias(k) for k in shares])


def _places(rows: DataFrame, by: tuple[str, ...], order: list[str], asked: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(by, _name, _rank, _ties, one column ``_k<i>`` for each of ``order``): the order key at each rank; ``_rank`` is what
    is left of it among the ``_ties`` rows that have this very key. Ties in one column are told apart by the next."""
    found, keys = None, []
    for i, column in enumerate(order):
        if found is None:
            held, ask, group = rows, asked, by
        else:  # only rows that tie with a key found so far, by the name of the rank it has
            tied = found.select(*by, F.col("_name").alias("_of"), *keys)
            held, group = _joined(rows, tied, by), (*by, "_of")
            for done, key in zip(order, keys):
                held = held.where(F.col(done).eqNullSafe(F.col(key)))
            ask = found.select(*by, F.col("_name").alias("_of"), F.col("_ties").alias("_n"), "_name", "_rank")
        hit = select(held.withColumn("_order", F.col(column)), group, "_order", ask, shares)
        made = hit.select(*by, "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_ties", F.col("_value").alias(f"_k{i}"))
        if found is not None:
            made = _joined(made, found.select(*by, "_name", *keys), (*by, "_name"))
        found, keys = cut(made), [*keys, f"_k{i}"]
        if found.where("_ties > 1").isEmpty():
            break
    return found.select(*by, "_name", "_rank", "_ties", *keys)


def end_quartiles(rows: DataFrame, value: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, first_quartile, last_quartile): means of the first and last max(1, n / 4) values in arrival order.

    The order's columns have no nulls. Of rows that tie in all of them at the edge of a quarter each counts in part.
    """
    known = rows.where(F.col(value).isNotNull()).select(*dict.fromkeys((*by, value, *order)))
    part = F.greatest(F.lit(1), F.floor(F.col("_n") / 4)).cast("long")
    asks = [F.struct(F.lit("first").alias("_name"), (part - 1).alias("_rank")), F.struct(F.lit("last").alias("_name"), (F.col("_n") - part).alias("_rank"))]
    groups = cut(sizes(known, by, value))
    asked = groups.where("_n > 0").select(*by, "_n", F.inline(F.array(*asks)))
    found = _places(known, by, order, asked, {"first": 0.25, "last": 0.75})
    keys = [c for c in found.columns if c.startswith("_k")]
    ends = cut(found)
    met = _joined(known, ends, by)
    here, edge = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order[: len(keys)])]), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    needed = F.when(F.col("_name") == "first", F.col("_rank") + 1).otherwise(F.col("_ties") - F.col("_rank"))
    inside = F.when(F.col("_name") == "first", here < edge).otherwise(here > edge)
    within, on_edge = F.when(inside, F.col(value)), F.when(here == edge, F.col(value))
    added = met.groupBy(*by, "_name").agg(F.coalesce(F.sum(within), F.lit(0)).alias("_sum"), F.count(within).alias("_in"), F.avg(on_edge).alias("_edge"), F.first(needed).alias("_needed"))
    weighed = added.select(*by, "_name", ((F.col("_sum") + F.col("_edge") * F.col("_needed")) / (F.col("_in") + F.col("_needed"))).alias("_mean"))
    pick = lambda name: F.max(F.when(F.col("_name") == name, F.col("_mean")))
    return weighed.groupBy(*by).agg(pick("first").alias("first_quartile"), pick("last").alias("last_quartile"))
