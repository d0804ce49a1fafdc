"""What may leave a run: scrubbed texts, redacted keys, allowlisted columns, salted row hashes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.functions.jsontext import canonical

# Patterns and their replacements, in the order of their use; secret key words; allowlists.
SCRUB = (
    (r"/(?:Users|home|private|var|tmp)/[^\s,'\"]+", "<path>"),
    (r"(?i)(?:bearer\s+|hf_)[A-Za-z0-9._-]{8,}", "<credential>"),
    (r"(?i)(?:api[_-]?key|secret|password|token)\s*[:=]\s*[^\s,;]+", "<credential>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"),
)
SECRET_WORDS = ("password", "secret", "credential", "api_key", "token", "username", "user_name", "home")
REDACTED = "[redacted]"
ROW_COLUMNS = ("row_hash", "prompt_tokens", "candidate_count", "parsed", "task_success", "error_category")
FORBIDDEN = ("query", "schema", "function", "function_name", "source_id", "arguments", "output", "log", "path", "dataset", "adapter", "checkpoint", "directory", "prompt", "completion")
MOST_CHARS = 256
CONFIG_COLUMNS = ("run_label", "seed", "model_revision", "dataset_revision", "split", "max_seq_length", "prompt_contract_version")
METRIC_COLUMNS = (
    "count", "tool_accuracy", "json_validity", "schema_validity", "argument_key_f1", "argument_value_f1", "exact_match", "task_success",
    "extra_argument_rate", "extra_argument_count", "bootstrap_low", "bootstrap_high", "sample_std", "microbatches", "optimizer_updates",
    "train_loss", "val_loss", "learning_rate", "iterations_per_second", "tokens_per_second", "trained_tokens", "peak_memory", "val_time", "exit_code",
)


class PrivacyError(ValueError):
    """Something that may not be uploaded."""


def project_label(path: Column, project: str) -> Column:
    """An absolute path relative to the project's folder, or a digest in place of a path outside it."""
    root = project.rstrip("/")
    outside = F.concat(F.lit("external:"), F.substring(F.sha2(path.cast("binary"), 256), 1, 16))
    return F.when(path == root, ".").when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(outside)


def scrub_value(text: Column, project: str) -> Column:
    """A text on its way into a run's files: an absolute path gets its label, any other text is scrubbed."""
    return F.when(text.startswith("/"), project_label(text, project)).otherwise(scrub(text, project))


def metric_rows(metrics: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Metrics that may be uploaded: listed names with a finite number."""
    number = F.col(value).try_cast("double")
    return metrics.where(F.col(name).isin(*METRIC_COLUMNS) & number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))).withColumn(value, number)


def scrub(text: Column, project: str | None = None) -> Column:
    """A text without paths, credentials and UUIDs; the project's own folder becomes ``<project>``."""
    made = F.replace(text, F.lit(project), F.lit("<project>")) if project else text
    for pattern, label in SCRUB:
        made = F.regexp_replace(made, pattern, label)
    return made


def scrub_text(text: str, project: str | None = None) -> str:
    made = text.replace(project, "<project>") if project else text
    for pattern, label in SCRUB:
        made = re.sub(pattern, label, made)
    return made


def redact(value, project: str | None = None):
    """Nested values with secret keys blanked and strings scrubbed."""
    if isinstance(value, dict):
        return {k: REDACTED if any(w in k.casefold() for w in SECRET_WORDS) else redact(v, project) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, project) for v in value]
    return scrub_text(value, project) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """Redacted JSON text; null where the text is no JSON."""

    def one(t: str) -> str | None:
        try:
            return canonical(redact(json.loads(t)))
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def row_hash(run_id: Column, source_id: Column) -> Column:
    """24 hex digits that name a row without its source id."""
    return F.substring(F.sha2(F.concat_ws(":", run_id.cast("string"), source_id.cast("string")).cast("binary"), 256), 1, 24)


def sanitized_rows(scored: DataFrame, run_id: Column, source_id: str, prompt_tokens: str, candidate_count: str, parsed: Column, task_success: Column, error: Column) -> DataFrame:
    """The six columns that may be uploaded for a row."""
    return scored.select(
        row_hash(run_id, F.col(source_id)).alias("row_hash"),
        F.col(prompt_tokens).cast("int").alias("prompt_tokens"),
        F.col(candidate_count).cast("int").alias("candidate_count"),
        parsed.alias("parsed"),
        task_success.alias("task_success"),
        F.coalesce(error, F.lit("")).alias("error_category"),
    )


def check_upload(frame: DataFrame, allowed: tuple[str, ...] = ROW_COLUMNS) -> DataFrame:
    """``frame`` itself if its columns are allowed and scalar; texts that are too long fail when it is read."""
    strange = sorted(c for c in frame.columns if c not in allowed)
    if strange:
        raise PrivacyError(f"upload contains disallowed fields: {strange}")
    nested = sorted(f.name for f in frame.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)))
    if nested:
        raise PrivacyError(f"upload fields must be scalar: {nested}")
    texts = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    bounded = [F.when(F.coalesce(F.length(c) <= MOST_CHARS, F.lit(True)), F.col(c)).otherwise(F.raise_error(F.lit(f"upload field {c} is too long"))).alias(c) for c in texts]
    return frame.withColumns({c: b for c, b in zip(texts, bounded, strict=True)}) if texts else frame


def forbidden_columns(names: list[str], allowed: tuple[str, ...] = ROW_COLUMNS) -> list[str]:
    return sorted(n for n in names if n not in allowed and any(part in n.lower() for part in FORBIDDEN))
