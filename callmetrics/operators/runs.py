"""Run directories as a table: completeness, eligibility, metric audits and the report's slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.operators.render import LEGACY_RUNS, precision_of

# Files that a run must have, and the fields that an audit compares.
COMMON = ("resolved_config.yaml", "manifest.json", "status.json")
BY_KIND = {
    "training": ("adapter", "train.log", "training_metrics.jsonl", "system_metrics.csv"),
    "evaluation": ("predictions.jsonl", "evaluation.json", "system_metrics.csv"),
    "benchmark": ("system_metrics.csv",),
    "robustness": ("predictions.jsonl", "evaluation.json", "system_metrics.csv"),
    "bfcl": ("predictions.jsonl", "evaluation.json", "system_metrics.csv"),
}
KINDS = ("training", "evaluation", "robustness", "bfcl")
WORKFLOWS = ("validation", "final", "base", "tuned")
AUDITED = ("task_success", "argument_key_f1", "argument_value_f1", "schema_validity", "exact_match")
TOLERANCE = 1e-9


def missing_parts(runs: DataFrame, listing: DataFrame, required: DataFrame, run: str = "run", kind: str = "kind") -> DataFrame:
    """(run, missing): sorted names that a run of its kind lacks or has empty; complete runs have an empty array.

    ``required`` is (kind, name), one row per demand; ``listing`` is (run, name, bytes).
    """
    wanted = runs.select(run, kind).join(F.broadcast(required), kind)  # a few rows for each kind
    there = listing.where(F.col("bytes") > 0).select(run, "name").distinct()
    gaps = wanted.join(there, [run, "name"], "left_anti").groupBy(run).agg(F.array_sort(F.collect_set("name")).alias("missing"))
    return runs.select(run).join(gaps, run, "left").select(run, F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def requirements(spark) -> DataFrame:
    """(kind, name) of what completed runs need."""
    return spark.createDataFrame([(k, n) for k, names in BY_KIND.items() for n in (*COMMON, *names)], "kind string, name string")


def unmet_evidence(manifest: Column) -> Column:
    """Names of manifest entries that the manifest itself requires and lacks."""
    needs = lambda name: F.coalesce(manifest["requirements"][name], F.lit(False))
    return F.array_compact(
        F.array(
            F.when(needs("tokenizer_hash") & (F.coalesce(manifest["hashes"]["tokenizer"], F.lit("")) == ""), "manifest.hashes.tokenizer"),
            F.when(needs("checkpoint_bytes") & manifest["bytes"]["checkpoint"].isNull(), "manifest.bytes.checkpoint"),
        )
    )


def is_controlled(manifest: Column, registered: Column, model_hash: Column, rendering: dict[str, Column], examples: Column | None = None, updates: Column | None = None, safe_probe: bool = False) -> Column:
    """Whether a run has the pinned evidence that controlled reports need."""
    true = lambda c: F.coalesce(c, F.lit(False))
    holds = true(registered) & true(manifest["artifact_version"] == 2) & true(manifest["prompt_contract_version"] == 1) & true(manifest["dataset_prompt_contract_version"] == 1)
    holds = holds & true(manifest["hashes"]["model"] == model_hash) & true(manifest["comparable_rendering"]) & manifest["counts"]["examples"].isNotNull()
    for name, want in rendering.items():
        holds = holds & true((want != "") & (manifest["hashes"][name] == want))
    if examples is not None:
        holds = holds & (examples.isNull() | true(manifest["counts"]["examples"] == examples))
    if updates is not None:
        holds = holds & (updates.isNull() | true(manifest["counts"]["updates"] == updates))
    if safe_probe:
        holds = holds & true(manifest["safety_probe"]["status"] == "safe") & true(manifest["safety_probe"]["model_hash"] == model_hash)
    return holds


def eligible(run: Column, manifest: Column, status: Column, missing: Column) -> Column:
    """Whether a run may enter reports."""
    true = lambda c: F.coalesce(c, F.lit(False))
    kind = F.coalesce(manifest["kind"], F.lit("evaluation"))
    config = manifest["config"]
    version = F.coalesce(config["dataset"]["version"], config["dataset_version"], F.lit(""))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        ~run.isin(*LEGACY_RUNS)
        & manifest.isNotNull()
        & true(manifest["artifact_version"] == 2)
        & true(manifest["prompt_contract_version"] == 1)
        & (true(manifest["controlled"]) | true(manifest["controlled_run"]["status"] == "controlled"))
        & kind.isin(*KINDS)
        & ((kind != "evaluation") | true(config["workflow"].isin(*WORKFLOWS)))
        & ((kind != "training") | true(manifest["selection"].startswith("{")))
        & some(manifest["hashes"]["model"])
        & some(manifest["hashes"]["config"])
        & some(manifest["hashes"]["dataset"])
        & some(manifest["git"]["commit"])
        & (version != "")
        & true(status == "completed")
        & true(manifest["status"] == "completed")
        & (F.size(missing) == 0)
    )


def metric_audit(stored: DataFrame, computed: DataFrame, on: str, fields: tuple[str, ...] = AUDITED, count: str = "count", tolerance: float = TOLERANCE) -> DataFrame:
    """(on, matches): whether stored metrics equal recomputed ones; a missing field or run fails."""
    right = computed.select(on, F.col(count).alias("_count"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = stored.join(right, on, "left")
    holds = F.col(count) == F.col("_count")
    for f in fields:
        holds = holds & (F.abs(F.col(f) - F.col(f"_{f}")) <= tolerance)
    return joined.select(on, F.coalesce(holds, F.lit(False)).alias("matches"))


def row_count_audit(runs: DataFrame, predictions: DataFrame, run: str = "run", count: str = "count") -> DataFrame:
    """(run, prediction_rows, evaluation_count, row_count_match); a run without predictions doesn't match."""
    rows = predictions.groupBy(run).agg(F.count(F.lit(1)).alias("prediction_rows"))
    made = runs.select(run, F.col(count).alias("evaluation_count")).join(rows, run, "left")
    return made.select(run, "prediction_rows", "evaluation_count", F.coalesce(F.col("prediction_rows") == F.col("evaluation_count"), F.lit(False)).alias("row_count_match"))


def report_rows(runs: DataFrame) -> DataFrame:
    """Flat columns of eligible runs (run, manifest, status, evaluation) for the report's tables."""
    m, e, c = F.col("manifest"), F.col("evaluation"), F.col("manifest.config")
    return runs.select(
        "run",
        *[e[f].alias(f) for f in ("count", *AUDITED)],
        F.coalesce(c["model"], m["model"], F.lit("")).alias("model"),
        F.coalesce(c["dataset"]["version"], c["dataset_version"], F.lit("")).alias("dataset_version"),
        F.coalesce(m["rss_gib"], e["rss_gib"], e["peak_rss_gib"]).alias("rss_gib"),
        F.coalesce(e["generation_throughput_tokens_per_second"], e["throughput_tokens_per_second"]).alias("generation_throughput_tokens_per_second"),
        m["counts"]["examples"].alias("train_examples"),
        c["training"]["lora_parameters"]["rank"].alias("rank"),
        c["training"]["num_layers"].alias("layers"),
        F.coalesce(c["training"]["seed"], m["seed"]).alias("seed"),
        F.coalesce(c["study_role"], m["study_role"], e["study_role"], F.lit("")).alias("study_role"),
        F.coalesce(c["axis"], m["axis"], e["axis"], F.lit("")).alias("axis"),
        F.coalesce(m["kind"], F.lit("")).alias("kind"),
        F.coalesce(c["workflow"], F.lit("")).alias("workflow"),
        m["git"]["commit"].alias("git_commit"),
        precision_of(F.coalesce(c["model"], F.lit("")), c["precision"]).alias("precision"),
        F.coalesce(m["prompt_hash"], e["prompt_hash"]).alias("prompt_hash"),
        F.coalesce(m["decoding_hash"], e["decoding_hash"]).alias("decoding_hash"),
        m["winner_source_run"].alias("winner_source_run"),
        e["task_error_categories"].alias("task_errors"),
    )


def on_axis(rows: DataFrame, axis: str) -> DataFrame:
    return rows.where(F.col("axis") == axis)


def headline(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("study_role") == "headline")


def final_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("workflow") == "final") | F.col("run").startswith("final-"))


def heatmap(rows: DataFrame, row: str, column: str, value: str, columns: list, order: str = "run") -> DataFrame:
    """``row`` by ``column``: the value of the first run in order, NaN where there is none."""
    first = F.min_by(value, order)
    made = rows.groupBy(row).pivot(column, columns).agg(first)
    return made.select(row, *[F.coalesce(F.col(str(c)), F.lit(float("nan"))).alias(f"{column}_{c}") for c in columns])


def error_distribution(rows: DataFrame, vocabulary: tuple[str, ...], run: str = "run", errors: str = "task_errors") -> DataFrame:
    """(run, term, n): error counts per run with absent terms 0."""
    terms = rows.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    return rows.select(run, errors).crossJoin(F.broadcast(terms)).select(run, "term", F.coalesce(F.try_element_at(errors, "term"), F.lit(0)).alias("n"))


def winner_seeds(rows: DataFrame, seeds: int = 3) -> DataFrame:
    """Mean and sample deviation of the metrics per recipe with at least ``seeds`` seed runs; the seeds of a winner and
    the run that it came from count."""
    sources = rows.where("study_role = 'winner_seed' and winner_source_run is not null").select(F.col("winner_source_run").alias("run")).distinct()
    part = rows.where("study_role = 'winner_seed'").select(*rows.columns).unionByName(rows.join(sources, "run", "left_semi").where("study_role != 'winner_seed'"))
    metrics = ("task_success", "argument_value_f1", "schema_validity")
    made = part.groupBy("model", "dataset_version", "rank", "layers").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first_run"), *[a(m).alias(f"{m}_{s}") for m in metrics for a, s in ((F.avg, "mean"), (F.stddev_samp, "std"))])
    return made.where(F.col("n") >= seeds)


def repaired_examples(base: DataFrame, tuned: DataFrame, on: str, success: str = "task_success", k: int = 5) -> DataFrame:
    """The first k rows by id that failed before tuning and succeed after. The failed ids are joined by a shuffle: those
    of a large run are too many for a broadcast, which Spark would choose from the size of what they are read from."""
    failed = base.where(~F.col(success)).select(on).hint("merge")
    return tuned.where(F.col(success)).join(failed, on, "left_semi").orderBy(on).limit(k)


def first_seed_group(rows: DataFrame, seeds: int = 3) -> DataFrame:
    """The summary of the report: of the recipes with enough seed runs the one whose first run comes first, or no row."""
    return winner_seeds(rows, seeds).orderBy("first_run").limit(1)


#: Of each table of the report the rows that are in it, by role or axis, and its columns.
REPORT_TABLES = {
    "headline-precision-table": ("study_role", ("headline",), ("run", "model", "precision", "task_success", "argument_value_f1", "schema_validity")),
    "data-scaling": ("axis", ("dataset_size",), ("run", "dataset_version", "train_examples", "task_success", "argument_value_f1")),
    "adapter-capacity": ("axis", ("adapter_rank", "adapter_layers", "adapter_targets"), ("run", "rank", "layers", "task_success")),
    "model-size-quality-throughput-frontier": ("axis", ("model_size",), ("run", "model", "generation_throughput_tokens_per_second", "task_success")),
}


def report_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the report's figures, each in the order of the runs."""
    return {name: rows.where(F.col(column).isin(*values)).select(*columns).orderBy("run") for name, (column, values, columns) in REPORT_TABLES.items()}


def exposure(examples: DataFrame, prompt: Column, target: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(prompt_tokens, target_tokens): tokens that training sees as context and as targets; unknown ones count as none."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return examples.groupBy(*by).agg(total(prompt, "prompt_tokens"), total(target, "target_tokens"))
