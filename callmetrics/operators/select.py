"""Winners, skylines, journals and sweeps over study runs."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmetrics.functions.jsontext import canonical
from callmetrics.operators.skyline import front

LOWEST = float("-inf")


def numeric(column: Column, missing: float | None) -> Column:
    """A number, from text too; what is none, NaN included, becomes ``missing``, so that no NaN outranks a number."""
    value = column.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(missing).cast("double")).otherwise(value)


def best(rows: DataFrame, highest: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """The row with the lexicographically largest key of each group; the last key should be unique."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(highest)])
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), key).alias("_row")).select("_row.*")


def selection_key(success: str = "task_success", value: str = "argument_value_f1", schema: str = "schema_validity", rss: str = "rss_gib", throughput: str = "generation_throughput_tokens_per_second", tiebreak: str = "fingerprint") -> list[Column]:
    """Success, value F1 and schema validity high, memory low, throughput high, then the largest fingerprint."""
    return [numeric(F.col(success), 0.0), numeric(F.col(value), 0.0), numeric(F.col(schema), 0.0), numeric(-F.col(rss).try_cast("double"), LOWEST), numeric(F.col(throughput), 0.0), F.col(tiebreak)]


def skyline(rows: DataFrame, row_id: str, high: list[str], low: list[str], missing: str = "apart") -> DataFrame:
    """Rows that no other row dominates: at least as good everywhere and better somewhere.

    A missing ``low`` value is the worst. ``apart``: rows with a missing ``high`` value neither dominate nor are
    dominated, so they stay. ``zero``: missing ``high`` values count as 0. Equal points are one point, and of points
    that agree in all values but the last only the best is compared further.
    """
    fill = 0.0 if missing == "zero" else None
    values = [numeric(F.col(c), fill) for c in high] + [numeric(-F.col(c).try_cast("double"), LOWEST) for c in low]
    names = [f"v{i}" for i in range(len(values))]
    points = rows.select(row_id, *[v.alias(n) for v, n in zip(values, names, strict=True)])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    known = points.where(whole)
    distinct = known.groupBy(*names[:-1]).agg(F.max(names[-1]).alias(names[-1]))
    kept = known.join(front(distinct, names), names, "left_semi").select(row_id).unionByName(points.where(~whole).select(row_id))
    return rows.join(kept, row_id, "left_semi")


def winner_and_rivals(rows: DataFrame, key: list[Column], front: DataFrame, row_id: str, rivals: int = 2) -> DataFrame:
    """The best row and up to ``rivals`` further rows of the front in order, with ``place`` from 0."""
    first = best(rows, key).withColumn("place", F.lit(0))
    rest = front.join(first.select(row_id), row_id, "left_anti")
    order = Window.orderBy(*[c.desc() for c in key])
    next_best = rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rivals)
    return first.unionByName(next_best)


def is_final_candidate(completed: Column, validation_only: Column, controlled: Column, run_id: Column) -> Column:
    """Completion and validation-only default to true when missing, control never does."""
    yes = lambda c: F.coalesce(c, F.lit(True))
    return yes(completed) & yes(validation_only) & F.coalesce(controlled, F.lit(False)) & F.coalesce(run_id != "", F.lit(False))


# -- journals -------------------------------------------------------------------------------------------------------


def last_write(journal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest entry of each key."""
    at = F.struct(*order)
    return journal.groupBy(key).agg(F.max_by(F.struct(*[c for c in journal.columns if c != key]), at).alias("_row")).select(key, "_row.*")


def with_run_files(journal: DataFrame, manifests: DataFrame, statuses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Journal entries that made a selection, with what their runs' files say; runs whose files are not there have nulls.

    ``journal`` (run_id, split, recipe, resolved_fingerprint, fingerprint), ``manifests`` (run_id, controlled,
    artifact_version, git_commit, config_hash), ``statuses`` (run_id, status), ``artifacts`` (run_id, name, sha256, bytes).
    """
    of = lambda name: artifacts.where(F.col("name") == name)
    adapter = of("adapter/adapters.safetensors").select("run_id", F.col("sha256").alias("adapter_sha256"), F.col("bytes").alias("adapter_bytes"))
    resolved = of("resolved_config.yaml").select("run_id", F.col("sha256").alias("resolved_config_sha256"))
    fixed = adapter.join(resolved, "run_id")  # both or neither
    made = journal.join(manifests, "run_id", "left").join(statuses, "run_id", "left").join(fixed, "run_id", "left")
    kept = [c for c in journal.columns if c not in ("split", "resolved_fingerprint")]
    return made.select(
        *kept,
        F.coalesce(F.col("controlled") & (F.col("artifact_version") == 2), F.lit(False)).alias("controlled"),
        F.coalesce((F.col("status") == "completed") & (F.coalesce("split", F.lit("validation")) == "validation"), F.lit(False)).alias("validation_only"),
        F.coalesce("resolved_fingerprint", "fingerprint").alias("resolved_fingerprint"),
        "git_commit", "adapter_sha256", "adapter_bytes", "resolved_config_sha256",
        F.when(F.col("adapter_sha256").isNotNull(), F.coalesce("config_hash", F.lit(""))).alias("config_sha256"),
    )


def latest_run(runs: DataFrame, name: str, base: Column) -> DataFrame:
    """(base, run): of each base name the run with the largest ``-attempt-N`` suffix, the plain name counting as 0."""
    number = F.regexp_extract(F.col(name), r"-attempt-(\d+)$", 1)
    attempt = F.when(number != "", number.cast("int")).otherwise(0)
    return runs.groupBy(base.alias("base")).agg(F.max_by(F.col(name), F.struct(attempt, F.col(name))).alias("run"))


def latest_completed(runs: DataFrame, by: tuple[str, ...], after: str = "", order: str = "started_at") -> DataFrame:
    """Of each ``by`` (kind and workflow, say) the completed run that started last, at ``after`` or later; ties in ``order``
    go to the larger run name. ``runs`` has run, status, started_at and what ``by`` and ``order`` name; a missing time
    counts as the earliest."""
    time = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    there = runs.where((F.col("status") == "completed") & (time("started_at") >= after))
    return there.groupBy(*by).agg(F.max_by("run", F.struct(time(order), "run")).alias("run"))


def to_resume(plan: DataFrame, journal: DataFrame, key: str, done: Column) -> DataFrame:
    """Planned rows whose key has no finished entry."""
    return plan.join(journal.where(done).select(key).distinct(), key, "left_anti")


def next_attempt(runs: DataFrame, name: str, base: Column) -> DataFrame:
    """(base, attempt): one more than the largest ``-attempt-N`` suffix, 1 without any."""
    number = F.regexp_extract(F.col(name), r"-attempt-(\d+)$", 1)
    return runs.groupBy(base.alias("base")).agg((F.coalesce(F.max(F.when(number != "", number.cast("int"))), F.lit(0)) + 1).alias("attempt"))


def joined_pairs(runs: DataFrame, keys: list[str], workflow: str, order: str, base: str = "base", tuned: str = "tuned") -> DataFrame:
    """Base and tuned runs of equal ``keys``, the last of each side by ``order``."""
    payload = F.struct(*[c for c in runs.columns if c not in keys])
    side = lambda name: F.max_by(F.when(F.col(workflow) == name, payload), F.when(F.col(workflow) == name, F.col(order)))
    return runs.groupBy(*keys).agg(side(base).alias("base"), side(tuned).alias("tuned")).where("base is not null and tuned is not null")


def drift(source: DataFrame, lock: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """(on, failed): the names of fields in which a run differs from its lock; a missing run fails them all."""
    both = lock.select(on, *[F.col(f).alias(f"want_{f}") for f in fields]).join(source.select(on, *fields), on, "left")
    failed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"want_{f}")), F.lit(f)) for f in fields]))
    return both.select(on, failed.alias("failed"))


# -- sweeps ---------------------------------------------------------------------------------------------------------


def run_fingerprint(values: Mapping[str, Any]) -> str:
    return hashlib.sha256(canonical(dict(values), ascii_only=True).encode()).hexdigest()


def with_path(tree: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy of a nested mapping with the value at a dotted path set."""
    head, _, rest = path.partition(".")
    below = tree.get(head, {}) if isinstance(tree.get(head), dict) else {}
    return tree | {head: with_path(below, rest, value) if rest else value}


def expand(plan: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Rows of a plan: its explicit ``runs``, else the product of its ``axes`` in the order of their paths, else one."""
    if plan.get("runs"):
        rows = [dict(r) for r in plan["runs"]]
    else:
        axes = plan.get("axes") or {}
        paths = sorted(axes)
        rows = [dict(zip(paths, combo, strict=True)) for combo in itertools.product(*(axes[p] for p in paths))]
    return [{"index": i, "values": row, "fingerprint": run_fingerprint(row)} for i, row in enumerate(rows)]


def cross_axes(spark: SparkSession, axes: Mapping[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Product of one-column frames of axis values with ``run_index`` in lexicographic order of the axes."""
    frame = None
    for name in order:
        axis = axes[name]
        frame = axis if frame is None else frame.crossJoin(F.broadcast(axis))
    return frame.withColumn("run_index", F.row_number().over(Window.orderBy(*order)) - 1)


def with_best_rate(rows: DataFrame, pilots: DataFrame, fallback: str = "4bit") -> DataFrame:
    """Rows other than pilots take the learning rate of their precision's best pilot, or of the fallback precision."""
    chosen = best(pilots, selection_key(), ("precision",)).select("precision", F.col("learning_rate").alias("_rate"))
    spare = chosen.where(F.col("precision") == fallback).select(F.col("_rate").alias("_spare"))
    joined = rows.join(chosen, "precision", "left").join(F.broadcast(spare), F.lit(True), "left")
    rate = F.when(F.col("study_role") == "lr_pilot", F.col("learning_rate")).otherwise(F.coalesce("_rate", "_spare", "learning_rate"))
    return joined.withColumn("learning_rate", rate).drop("_rate", "_spare")
