"""Sweeps: overlays on a base recipe, probes, recipes of seed runs, conditions after a run, comparable runs, audits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.operators.splits import STRATA, audit_queue, stratum
from callmetrics.operators.select import best

THINKING = "<think>"


def overlay(rows: DataFrame, base: Mapping[str, int]) -> DataFrame:
    """Rows with the base recipe under their nulls, ``iters`` (microbatches) and ``fits``: whether a stated
    ``effective_batch`` is the product of batch size and accumulation; the computed one stands in the result.

    ``base`` names batch_size, grad_accumulation_steps and iters; the updates of a row without any are the base's iters.
    """
    filled = rows.withColumns({c: F.coalesce(c, F.lit(base[c])) for c in ("batch_size", "grad_accumulation_steps")})
    product = F.col("batch_size") * F.col("grad_accumulation_steps")
    return filled.withColumns({
        "iters": F.coalesce("updates", F.lit(base["iters"])) * F.col("grad_accumulation_steps"),
        "fits": F.coalesce(F.col("effective_batch") == product, F.lit(True)),
        "effective_batch": product,
    })


def probe_key(settings: Mapping[str, Column]) -> Column:
    """SHA-256 of the settings as JSON with sorted keys, nulls included: equal settings need one probe."""
    fields = F.struct(*[settings[name].alias(name) for name in sorted(settings)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)


def distinct_probes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each probe key, with ``runs``: how many rows share its probe."""
    whole = F.struct(*[c for c in rows.columns if c != key])
    made = rows.groupBy(key).agg(F.min_by(whole, order).alias("_row"), F.count(F.lit(1)).alias("runs"))
    return made.select(key, "_row.*", "runs")


def probe_verdicts(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(run_id, verdict): ``new`` without an earlier probe, ``reuse`` if the earlier one is completed, safe and of the
    same model hash and fingerprint, else ``refuse``.

    ``planned`` (run_id, model_hash, fingerprint), ``existing`` (run_id, status, safety, model_hash, fingerprint).
    """
    old = existing.select("run_id", F.struct("status", "safety", "model_hash", "fingerprint").alias("old"))
    fits = (F.col("old.status") == "completed") & (F.col("old.safety") == "safe") & (F.col("old.model_hash") == F.col("model_hash")) & (F.col("old.fingerprint") == F.col("fingerprint"))
    verdict = F.when(F.col("old").isNull(), "new").when(fits, "reuse").otherwise("refuse")
    return planned.join(old, "run_id", "left").select("run_id", verdict.alias("verdict"))


def broken_conditions(runs: DataFrame, order: str) -> DataFrame:
    """(run_id, failed): conditions that finished training runs break. ``updates`` and ``microbatches`` must be as asked
    for, and endpoints of the size study must have measured the same exposure as the first one in ``order``.

    ``runs`` (run_id, study_role, updates, grad_accumulation_steps, done_updates, done_microbatches, prompt_tokens,
    target_tokens); counts that are missing are wrong.
    """
    endpoint = F.coalesce(F.col("study_role") == "size_endpoint", F.lit(False))
    seen = F.struct("prompt_tokens", "target_tokens")
    measured = endpoint & F.col("prompt_tokens").isNotNull() & F.col("target_tokens").isNotNull()
    first = runs.agg(F.min_by(F.when(measured, seen), F.when(measured, F.col(order))).alias("first"))  # one row
    wrong = {
        "updates": ~F.col("done_updates").eqNullSafe(F.col("updates")),
        "microbatches": ~F.col("done_microbatches").eqNullSafe(F.col("updates") * F.col("grad_accumulation_steps")),
        "exposure": endpoint & (~measured | (seen != F.col("first"))),
    }
    failed = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in wrong.items()]))
    return runs.join(F.broadcast(first)).select("run_id", failed.alias("failed")).where(F.size("failed") > 0)


def seed_recipes(rows: DataFrame, finished: DataFrame, key: list[Column], recipe: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``winner_source_run``: seed rows of the winner take the ``recipe`` columns of the best finished run
    that is no pilot; other rows stay as they are. Without such a run the seed rows' ``winner_source_run`` is null."""
    pool = finished.where(F.coalesce(F.col("study_role") != "lr_pilot", F.lit(True)))
    winner = best(pool, key).select(F.col("run_id").alias("_run"), *[F.col(c).alias(f"_w_{c}") for c in recipe])
    seeded = F.col("study_role").eqNullSafe(F.lit("winner_seed")) & F.col("_run").isNotNull()
    joined = rows.join(F.broadcast(winner), F.lit(True), "left")  # the winner is one row
    taken = {c: F.when(seeded, F.col(f"_w_{c}")).otherwise(F.col(c)) if c in recipe else F.col(c) for c in rows.columns}
    return joined.select(*[v.alias(c) for c, v in taken.items()], F.when(seeded, F.col("_run")).alias("winner_source_run"))


def incomparable(base: DataFrame, tuned: DataFrame, pos: str = "pos") -> DataFrame:
    """(check, n): in how many positions a base and a tuned evaluation differ in presence, prompt hash or decoding, and
    how many base predictions think aloud. All counts are 0 for comparable runs."""
    side = lambda frame, name: frame.select(pos, F.struct("prompt_hash", "decoding", "prediction").alias(name))
    both = side(base, "base").join(side(tuned, "tuned"), pos, "full")
    apart = lambda field: ~F.col(f"base.{field}").eqNullSafe(F.col(f"tuned.{field}"))
    paired = F.col("base").isNotNull() & F.col("tuned").isNotNull()
    tests = {
        "count": ~paired,
        "prompt_hash": paired & apart("prompt_hash"),
        "decoding": paired & apart("decoding"),
        "thinking": F.coalesce(F.lower("base.prediction").contains(THINKING), F.lit(False)),
    }
    counts = both.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    return counts.unpivot([], list(tests), "check", "n")


def registry_problems(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs with ``problem``: ``unknown`` for a model outside the registry, ``revision`` for one pinned at another
    revision, null if it is fine or names no revision. ``registry`` (model, pinned) is a short list."""
    known = F.broadcast(registry.select("model", F.col("pinned").alias("_pinned"), F.lit(True).alias("_known")))
    problem = F.when(F.col("_known").isNull(), "unknown").when(F.col("revision") != F.col("_pinned"), "revision")
    return runs.join(known, "model", "left").withColumn("problem", problem).drop("_pinned", "_known")


def first_rows(rows: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The rows at the first n positions, in any order."""
    return rows.where(F.col(pos) < n)


def audit_summary(rows: DataFrame, row_id: str, calls: Column, version: str, samples: int = 100, seed: int = 42) -> DataFrame:
    """One row that describes a population and its audit sample without any of its data: counts, strata by number of
    calls, and the digest of the sampled ids in rank order. The sample is the feature: it is bounded by ``samples``."""
    if samples < 0:
        raise ValueError("samples must not be negative")
    ids = F.array_sort(F.collect_list(F.struct("rank", F.col(row_id).cast("string").alias("id"))))
    joined = F.array_join(F.transform(ids, lambda x: x["id"]), "\n")
    sample = audit_queue(rows.select(row_id), row_id, samples, seed).agg(F.count(F.lit(1)).alias("sample_count"), F.sha2(joined.cast("binary"), 256).alias("sample_id_hash"))
    tier = stratum(calls)
    counted = rows.agg(F.count(F.lit(1)).alias("population_count"), *[F.count_if(tier == s).alias(f"stratum_{i}") for i, s in enumerate(STRATA)])
    named = counted.join(F.broadcast(sample))  # one row each
    return named.select(F.lit(version).alias("version"), F.lit(1).alias("audit_version"), F.lit(seed).alias("seed"), "sample_count", "population_count", "sample_id_hash", *[f"stratum_{i}" for i in range(len(STRATA))])
