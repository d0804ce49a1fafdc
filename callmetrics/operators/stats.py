"""Bootstrap intervals, paired deltas, order statistics and seed summaries.

Three ways to resample. ``poisson`` weighs every row in every draw by a digest of its id, in one pass whose sums merge;
it is the one for large series. ``hash`` draws slot j of draw i as a row by a digest of (seed, i, j), the same in any
engine; ``redraw`` makes the pairs and the statistic is an aggregate per draw. ``parity`` replays the Mersenne
Twister sequence inside one Arrow group, for series that fit a task.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.operators import redraw, resample
from callmetrics.operators.ranks import end_quartiles, percentiles  # noqa: F401
from callmetrics.operators.storage import cut


class SeriesError(ValueError):
    """A series that a statistic is not defined on."""


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``row``, their place from 0 by a unique ``order``: range-sorted, counted by partition and shifted."""
    spread = cut(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return spread.withColumn("_within", within).join(starts, "_p").withColumn("row", F.col("_start") + F.col("_within")).drop("_p", "_start", "_within")


def draws(rows: DataFrame, order: str, samples: int, statistic: dict[str, Column], seed: int = 42) -> DataFrame:
    """(draw, statistics): each draw resamples all rows with replacement; rows are numbered by ``order``. A statistic is of
    columns other than ``order`` and of ``times``; rows with equal columns may come as one with their times added up."""
    if "times" in rows.columns:
        raise SeriesError("a column is named times")
    held = cut(rows)
    n = held.count()
    if not n:
        raise SeriesError("there is nothing to resample")
    if samples <= 0:
        raise SeriesError("samples must be positive")
    placed = numbered(held, order).drop(order)
    return redraw.redrawn(placed, n, samples, seed).groupBy("draw").agg(*[column.alias(name) for name, column in statistic.items()])


def interval(samples: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """(low, high): order statistics of the draws, floor(alpha n) and floor((1 - alpha) n), the latter n - 1 at most."""
    if not 0 < confidence < 1:
        raise SeriesError("confidence must be between zero and one")
    alpha = (1.0 - confidence) / 2.0
    held = samples.agg(F.array_sort(F.collect_list(value)).alias("v"))  # one number for each draw
    at = lambda share: F.get("v", F.least(F.size("v") - 1, F.floor(F.lit(share) * F.size("v")).cast("int")))
    return held.select(at(alpha).alias("low"), at(1.0 - alpha).alias("high"))


def weighted_mean(value: str) -> Column:
    return F.sum(F.col(value) * F.col("times")) / F.sum("times")


def weighted_f1(matches: str, predicted: str, gold: str) -> Column:
    m, p, g = (F.sum(F.col(c) * F.col("times")) for c in (matches, predicted, gold))
    return F.when((p == 0) & (g == 0), 1.0).when(m == 0, 0.0).otherwise(2 * (m / p) * (m / g) / (m / p + m / g))


def paired(base: DataFrame, tuned: DataFrame, row_id: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of both sides by id, as ``base_*`` and ``tuned_*``; ids must be unique and the same on both sides."""
    sides = []
    for name, frame in (("base", base), ("tuned", tuned)):
        if frame.groupBy(row_id).count().where("count > 1").limit(1).count():
            raise SeriesError(f"{name} ids are not unique")
        sides.append(frame.select(row_id, *[F.col(c).alias(f"{name}_{c}") for c in columns], F.lit(True).alias(f"_{name}")))
    joined = sides[0].join(sides[1], row_id, "full")
    if joined.where("_base is null or _tuned is null").limit(1).count():
        raise SeriesError("base and tuned ids differ")
    return joined.drop("_base", "_tuned")


#: Metrics that have intervals, and how each is resampled.
MEANS = ("tool_accuracy", "json_validity", "schema_validity", "exact_match", "task_success")
RATIOS = ("argument_key_f1", "argument_value_f1")


def metric_interval(scored: DataFrame, row_id: str, metric: str, samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of a named metric of scored rows; SeriesError for a name that is none of ``MEANS`` and ``RATIOS``."""
    if metric in RATIOS:
        matches = "key_matches" if metric == "argument_key_f1" else "value_matches"
        return f1_interval(scored, row_id, (matches, "n_predicted", "n_gold"), samples, confidence, seed)
    if metric not in MEANS:
        raise SeriesError(f"no such metric: {metric}")
    flag = {"json_validity": "json_valid", "schema_validity": "schema_valid", "exact_match": "exact"}.get(metric, metric)
    return mean_interval(scored.withColumn("_flag", F.col(flag).cast("double")), row_id, "_flag", samples, confidence, seed)


def _poisson_interval(rows: DataFrame, row_id: str, columns: tuple[str, ...], statistic: Column, samples: int, confidence: float, seed: int) -> DataFrame:
    if samples <= 0:
        raise SeriesError("samples must be positive")
    if rows.isEmpty():
        raise SeriesError("there is nothing to resample")
    made = resample.poisson_sums(rows, row_id, columns, samples, seed)
    return interval(made.select(statistic.alias("statistic")).where("statistic is not null"), "statistic", confidence)


def mean_interval(rows: DataFrame, row_id: str, value: str, samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of the mean by Poisson weights."""
    return _poisson_interval(rows, row_id, (value,), resample.mean_of(value), samples, confidence, seed)


def f1_interval(rows: DataFrame, row_id: str, counts: tuple[str, str, str], samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of micro F1 from (matches, predicted, gold) counts by Poisson weights."""
    return _poisson_interval(rows, row_id, counts, resample.f1_of(*counts), samples, confidence, seed)


def paired_mean_interval(base: DataFrame, tuned: DataFrame, row_id: str, value: str, samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of the mean difference, tuned less base, of the same rows on both sides."""
    both = paired(base, tuned, row_id, (value,)).withColumn("_delta", F.col(f"tuned_{value}").cast("double") - F.col(f"base_{value}").cast("double"))
    return mean_interval(both, row_id, "_delta", samples, confidence, seed)


def paired_f1_interval(base: DataFrame, tuned: DataFrame, row_id: str, counts: tuple[str, str, str], samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of the difference in micro F1, tuned less base, both resampled alike."""
    both = paired(base, tuned, row_id, counts)
    sides = [tuple(f"{side}_{c}" for c in counts) for side in ("tuned", "base")]
    return _poisson_interval(both, row_id, sides[0] + sides[1], resample.f1_of(*sides[0]) - resample.f1_of(*sides[1]), samples, confidence, seed)


def _twister(statistic: Callable[[list, list[int]], float], samples: int, confidence: float, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("pos")["value"].tolist()
        source, n = random.Random(seed), len(rows)
        made = sorted(statistic(rows, [source.randrange(n) for _ in range(n)]) for _ in range(samples))
        alpha = (1.0 - confidence) / 2.0
        return pd.DataFrame({"low": [made[int(alpha * samples)]], "high": [made[min(samples - 1, int((1.0 - alpha) * samples))]]})

    return run


def parity_mean_interval(rows: DataFrame, order: str, value: str, samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of the mean by the Twister sequence; the whole series goes to one task."""
    series = rows.select(F.col(order).alias("pos"), F.col(value).cast("double").alias("value"))
    mean = lambda values, picks: sum(values[i] for i in picks) / len(picks)
    return series.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(_twister(mean, samples, confidence, seed), "low double, high double")


def micro_f1(counts: list, picks: list[int]) -> float:
    m, p, g = (sum(counts[i][k] for i in picks) for k in range(3))
    return 1.0 if not p and not g else 0.0 if not m else 2 * (m / p) * (m / g) / (m / p + m / g)


def parity_f1_interval(rows: DataFrame, order: str, counts: tuple[str, str, str], samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of micro F1 by the Twister sequence."""
    series = rows.select(F.col(order).alias("pos"), F.array(*[F.col(c).cast("long") for c in counts]).alias("value"))
    return series.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(_twister(micro_f1, samples, confidence, seed), "low double, high double")


# -- order statistics -----------------------------------------------------------------------------------------------


def floor_rank(values: Column, share: float) -> Column:
    """Element floor(share (n - 1)) of a sorted array, 0 if it is empty."""
    at = F.least(F.size(values) - 1, F.floor(F.lit(share) * (F.size(values) - 1)).cast("int"))
    return F.coalesce(F.get(values, at), F.lit(0.0))


def rates(rows: DataFrame, amount: str, seconds: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(ratio_of_sums, mean_of_ratios) of amounts per second; rows without a positive time don't count in the mean."""
    each = F.when(F.col(seconds) > 0, F.col(amount) / F.col(seconds))
    return rows.groupBy(*by).agg((F.sum(amount) / F.sum(seconds)).alias("ratio_of_sums"), F.avg(each).alias("mean_of_ratios"))


def seed_summary(rows: DataFrame, by: tuple[str, ...], value: str, seeds: int = 3) -> DataFrame:
    """(by, mean, std, n) of groups with exactly ``seeds`` runs."""
    made = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return made.where(F.col("n") == seeds)
