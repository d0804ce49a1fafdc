"""System samples of runs: first, peak and last values, streaks and the safety verdict of a probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.operators.storage import cut

# Sampled fields, the order of pressure states and the limits of a probe.
FIELDS = ("rss_gib", "mlx_allocator_active_bytes", "mlx_allocator_peak_bytes", "swap_used_gib")
PRESSURE = ("unknown", "normal", "warning", "critical")
LEAST_MEMORY_GIB, MOST_SWAP_GROWTH_GIB, LEAST_DISK_GIB, STREAK = 1.0, 2.0, 30.0, 3
FINITE_FIELDS = ("memory_available_gib", "swap_used_gib", "disk_free_gib", "rss_gib")


def first_peak_last(rows: DataFrame, values: list[str], order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """For each value ``<value>_before``, ``_peak`` and ``_after`` in the given order, missing values skipped."""
    at = F.struct(*order)
    made = []
    for v in values:
        there = F.when(F.col(v).isNotNull(), at)
        made += [F.min_by(v, there).alias(f"{v}_before"), F.max(v).alias(f"{v}_peak"), F.max_by(v, there).alias(f"{v}_after")]
    return rows.groupBy(*by).agg(*made)


def pressure_level(state: Column) -> Column:
    """Rank of a pressure state; unknown words rank lowest."""
    return F.greatest(F.array_position(F.array(*map(F.lit, PRESSURE)), F.coalesce(state, F.lit(""))) - 1, F.lit(0))


def summarize(samples: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Samples and first, peak and last value of the sampled fields and of the pressure state."""
    fields = [f for f in FIELDS if f in samples.columns]
    made = first_peak_last(samples, fields, order, by)
    at = F.struct(*order)
    state = F.when(F.col("pressure_state") != "", F.col("pressure_state"))
    there = F.when(state.isNotNull(), at)
    rest = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.min_by(state, there).alias("pressure_before"),
        F.max_by(state, F.when(state.isNotNull(), pressure_level(state))).alias("pressure_peak"),
        F.max_by(state, there).alias("pressure_after"),
    )
    return made.join(rest, list(by)) if by else made.crossJoin(rest)


def run_summaries(rows: DataFrame, flag: Column, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, part, length, prefix, best, suffix): for each range of a group its rows and the flagged runs at its beginning,
    at its longest and at its end.

    Rows are range-sorted by group and order, so that a large group lies in many ranges; no window spans more than one.
    """
    marked = rows.select(*by, *[c for c in order if c not in by], F.coalesce(flag, F.lit(False)).alias("_f"))
    placed = cut(marked.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))
    all_rows, of_flag = Window.partitionBy("part", *by).orderBy(*order), Window.partitionBy("part", *by, "_f").orderBy(*order)
    at = placed.withColumn("_at", F.row_number().over(all_rows)).withColumn("_island", F.col("_at") - F.row_number().over(of_flag))
    runs = at.groupBy("part", *by, "_f", "_island").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    flagged = F.when(F.col("_f"), F.col("n")).otherwise(0)
    return runs.groupBy(*by, "part").agg(
        F.sum("n").alias("length"), F.min_by(flagged, "_at").alias("prefix"), F.max(flagged).alias("best"), F.max_by(flagged, "_at").alias("suffix")
    )


def joined_run(before: Column, after: Column) -> Column:
    """(length, prefix, best, suffix) of two stretches of rows, one after the other."""
    whole = lambda x: x["prefix"] == x["length"]
    return F.struct(
        (before["length"] + after["length"]).alias("length"),
        F.when(whole(before), before["length"] + after["prefix"]).otherwise(before["prefix"]).alias("prefix"),
        F.greatest(before["best"], after["best"], before["suffix"] + after["prefix"]).alias("best"),
        F.when(whole(after), after["length"] + before["suffix"]).otherwise(after["suffix"]).alias("suffix"),
    )


def streaks(rows: DataFrame, flag: Column, order: list[str], by: tuple[str, ...] = (), length: int = STREAK) -> DataFrame:
    """(by, longest, has_streak): longest run of consecutive flagged rows, from the summaries of each group's ranges."""
    made = run_summaries(rows, flag, order, by)
    held = made.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "length", "prefix", "best", "suffix"))).alias("held"))  # one for each range
    nothing = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("length", "prefix", "best", "suffix")])
    longest = F.aggregate("held", nothing, joined_run, lambda x: x["best"])
    return held.select(*by, longest.alias("longest")).withColumn("has_streak", F.col("longest") >= length)


def probe_safety(samples: DataFrame, order: list[str], by: tuple[str, ...], failed: Column | None = None, projected_disk: Column | None = None) -> DataFrame:
    """One row per probe: what speaks against it, and ``status`` safe or infeasible."""
    keys = list(by)
    odd = F.lit(False)
    for f in FINITE_FIELDS:
        if f in samples.columns:
            value = F.col(f).try_cast("double")
            odd = odd | (F.col(f).isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))))
    totals = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        (F.coalesce(F.max("swap_used_gib") - F.min("swap_used_gib"), F.lit(0.0)) > MOST_SWAP_GROWTH_GIB).alias("swap_growth"),
        F.coalesce(projected_disk if projected_disk is not None else F.min("disk_free_gib"), F.min("disk_free_gib")).alias("projected_free_disk_gib"),
        F.max(odd).alias("nonfinite"),
        F.coalesce(F.max(failed), F.lit(False)).alias("aborted_or_killed") if failed is not None else F.lit(False).alias("aborted_or_killed"),
    )
    memory = streaks(samples, F.col("memory_available_gib") < LEAST_MEMORY_GIB, order, by).select(*by, F.col("has_streak").alias("available_memory"))
    pressed = streaks(samples, F.col("pressure_state") == "critical", order, by).select(*by, F.col("has_streak").alias("critical_pressure"))
    made = totals.join(memory, keys).join(pressed, keys)
    made = made.withColumn("projected_disk", F.coalesce(F.col("projected_free_disk_gib") < LEAST_DISK_GIB, F.lit(False)))
    against = F.col("available_memory") | F.col("critical_pressure") | F.col("swap_growth") | F.col("aborted_or_killed") | F.col("nonfinite") | F.col("projected_disk")
    return made.withColumn("status", F.when(against, "infeasible").otherwise("safe"))


def peak(samples: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The largest value of each group as a number; 0 where no sample has one."""
    return samples.groupBy(*by).agg(F.coalesce(F.max(F.when(~F.isnan(F.col(value).try_cast("double")), F.col(value).try_cast("double"))), F.lit(0.0)).alias(f"peak_{value}"))
