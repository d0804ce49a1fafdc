"""Raw tool-call records (JSON text) to accepted and rejected rows, and removal of contradicting duplicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.jsontext import canonical, clean, has_non_finite, nfc_casefold, strict_loads
from callmetrics.functions.schema import fingerprint, first_violation, parameter_schema

ACCEPTED = (
    "source_id string, query string, tools string, function_name string, arguments string, normalized_task string, "
    "candidate_prefixes array<string>, candidate_fingerprints array<string>, rendered_length long, tool_count int, reason string"
)
#: Names under which a field may come, the first present one counts.
ALIASES = {"source_id": ("id", "source_id"), "query": ("query", "prompt", "question"), "tools": ("tools", "functions"), "answers": ("answers", "answer")}
# Reasons.
CONFLICT = "duplicate-group gold conflict"
TOO_LONG = "rendered length exceeds max_seq_length"
NOT_JSON = "{} is not valid JSON: {}"
NON_FINITE = "{} contains non-finite number"
NO_QUERY = "query is missing"
TOOLS_NOT_LIST = "tools must be an array"
TOOL_NOT_OBJECT = "each tool must be an object"
TOOL_WITHOUT_NAME = "tool function name is required"
TOOL_TWICE = "candidate function names are not unique"
ONE_ANSWER = "exactly one gold answer is required"
ANSWER_NOT_OBJECT = "gold answer must be an object"
ANSWER_PARTS = "gold function and object arguments are required"
UNKNOWN_FUNCTION = "gold function is not in candidate tools"
ARGUMENTS_FAIL = "gold arguments fail schema: {}"
LENGTH_NOT_WHOLE = "rendered_length must be an integer"
LENGTH_FAILED = "rendered length failed: {}"
NOT_RECORD = "record must be an object"


def api_prefix(name: Column) -> Column:
    """First segment of a name split at everything but ASCII letters and digits, in lower case."""
    dotted = F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9]+", "."), F.lit("."))
    return F.element_at(F.split(F.lower(dotted), r"\."), 1)


def _prefix(name: str) -> str:
    parts = [p for p in re.split(r"[^a-zA-Z0-9]+", name) if p]
    return parts[0].lower() if parts else ""


def _pick(record: dict[str, Any], field: str, default: Any = None) -> Any:
    return next((record[name] for name in ALIASES[field] if name in record), default)


def _json_field(value: Any, field: str) -> Any:
    if isinstance(value, str):
        try:
            value = strict_loads(value)
        except ValueError as error:
            raise ValueError(NOT_JSON.format(field, error) if getattr(error, "syntax", False) else str(error)) from error
    if has_non_finite(value):
        raise ValueError(NON_FINITE.format(field))
    return value


def _tools(value: Any) -> list[dict[str, Any]]:
    listed = _json_field(value, "tools")
    if not isinstance(listed, list):
        raise ValueError(TOOLS_NOT_LIST)
    found: dict[str, dict[str, Any]] = {}
    for tool in listed:
        if not isinstance(tool, dict):
            raise ValueError(TOOL_NOT_OBJECT)
        inner = tool.get("function", tool)
        if not isinstance(inner, dict) or not isinstance(inner.get("name"), str):
            raise ValueError(TOOL_WITHOUT_NAME)
        schema = parameter_schema(inner.get("parameters", inner.get("schema")))
        if inner["name"] in found:
            raise ValueError(TOOL_TWICE)
        found[inner["name"]] = {"name": inner["name"], "description": inner.get("description", ""), "parameters": schema}
    return [found[name] for name in sorted(found)]


def _gold(value: Any) -> tuple[str, dict[str, Any]]:
    answers = _json_field(value, "answers")
    answers = [answers] if isinstance(answers, dict) else answers
    if not isinstance(answers, list) or len(answers) != 1:
        raise ValueError(ONE_ANSWER)
    if not isinstance(answers[0], dict):
        raise ValueError(ANSWER_NOT_OBJECT)
    wrapped = answers[0].get("function")
    inner = wrapped if isinstance(wrapped, dict) else {"name": wrapped}
    name = answers[0].get("name") or inner.get("name")
    arguments = _json_field(answers[0].get("arguments", inner.get("arguments", {})), "arguments")
    if not isinstance(name, str) or not isinstance(arguments, dict):
        raise ValueError(ANSWER_PARTS)
    return name, arguments


def normal_record(record: dict[str, Any], position: Any, most_length: int | None = None) -> dict[str, Any]:
    """An accepted row with a null ``reason``, or only ``source_id`` and the first reason to reject."""
    source = str(_pick(record, "source_id", position))
    try:
        query = _pick(record, "query")
        if not isinstance(query, str) or not query.strip():
            raise ValueError(NO_QUERY)
        tools = _tools(_pick(record, "tools"))
        name, arguments = _gold(_pick(record, "answers"))
        schema = next((t["parameters"] for t in tools if t["name"] == name), None)
        if schema is None:
            raise ValueError(UNKNOWN_FUNCTION)
        broken = first_violation(arguments, schema)
        if broken:
            raise ValueError(ARGUMENTS_FAIL.format(broken[2]))
        length = record.get("rendered_length")
        if length is not None and not isinstance(length, int):
            raise ValueError(LENGTH_NOT_WHOLE)
        if length is not None and most_length is not None and length > most_length:
            raise ValueError(TOO_LONG)
    except ValueError as error:
        return {"source_id": source, "reason": str(error)}
    return {
        "source_id": source,
        "query": clean(query),
        "tools": canonical(tools),
        "function_name": name,
        "arguments": canonical(arguments),
        "normalized_task": canonical({"query": clean(query), "tools": tools}),
        "candidate_prefixes": sorted({p for p in (_prefix(t["name"]) for t in tools) if p}),
        "candidate_fingerprints": sorted({fingerprint(t["parameters"]) for t in tools}),
        "rendered_length": length,
        "tool_count": len(tools),
        "reason": None,
    }


def normalize(records: DataFrame, text: str = "value", position: str = "pos", most_length: int | None = None, length_of: Callable[[dict[str, Any]], int] | None = None) -> DataFrame:
    """One row per record text: the columns of ``ACCEPTED`` and ``position``; rejected ones have a ``reason``.

    ``length_of`` measures accepted rows and then ``most_length`` applies to what it measures. Text that isn't a JSON
    object is rejected as such.
    """
    names = [part.split()[0] for part in ACCEPTED.split(", ")]

    def one(value: str | None, pos: Any) -> dict[str, Any]:
        try:
            record = strict_loads(value or "")
        except ValueError as error:
            return {"source_id": str(pos), "reason": NOT_JSON.format("record", error)}
        if not isinstance(record, dict):
            return {"source_id": str(pos), "reason": NOT_RECORD}
        row = normal_record(record, pos, None if length_of else most_length)
        if row["reason"] is None and length_of:
            try:
                row["rendered_length"] = int(length_of(row))
            except (TypeError, ValueError) as error:
                return {"source_id": row["source_id"], "reason": LENGTH_FAILED.format(error)}
            if most_length and row["rendered_length"] > most_length:
                return {"source_id": row["source_id"], "reason": TOO_LONG}
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(v, p) for v, p in zip(batch[text], batch[position], strict=True)]
            made = pd.DataFrame([[row.get(n) for n in names] for row in rows], columns=names, dtype=object)
            made["rendered_length"] = made["rendered_length"].astype("Int64")
            made["tool_count"] = made["tool_count"].astype("Int32")
            yield made.assign(**{position: batch[position].to_numpy()})

    return records.select(text, position).mapInPandas(run, f"{ACCEPTED}, {position} {records.schema[position].dataType.simpleString()}")


def query_key(query: Column) -> Column:
    return F.concat(F.lit("query:"), nfc_casefold(query))


def conflicting_ids(rows: DataFrame, row_id: str, keys: Column, gold: Column) -> DataFrame:
    """Ids of rows that share a key, one of an array of ``keys``, with a row of another ``gold``.

    A key's rows are never gathered: it conflicts when the smallest and the largest gold hash differ.
    """
    pairs = rows.select(row_id, F.explode(F.array_distinct(keys)).alias("key"), F.sha2(gold.cast("binary"), 256).alias("gold"))
    split = pairs.groupBy("key").agg(F.min("gold").alias("low"), F.max("gold").alias("high")).where("low != high").select("key")
    return pairs.join(split, "key", "left_semi").select(row_id).distinct()


def drop_conflicts(normal: DataFrame, position: str = "pos") -> DataFrame:
    """Normalised rows with ``reason`` set where an accepted row's query or task also has another gold answer."""
    accepted = normal.where("reason is null")
    keys = F.array(query_key(F.col("query")), F.concat(F.lit("task:"), F.sha2(F.col("normalized_task").cast("binary"), 256)))
    bad = conflicting_ids(accepted, position, keys, F.concat_ws("\x00", "function_name", "arguments")).withColumn("_conflict", F.lit(True))
    marked = normal.join(bad, position, "left")
    return marked.withColumn("reason", F.coalesce("reason", F.when(F.col("_conflict"), F.lit(CONFLICT)))).drop("_conflict")


def within_context(rows: DataFrame, most: int, length: str = "rendered_length") -> tuple[DataFrame, DataFrame]:
    """Rows that fit a context and those that don't; an unknown length fits."""
    if most <= 0:
        raise ValueError("max_seq_length must be positive")
    fits = F.col(length).isNull() | (F.col(length) <= most)
    return rows.where(fits), rows.where(~fits).withColumn("reason", F.lit(TOO_LONG))


def flow(rows: DataFrame, reason: Column) -> DataFrame:
    """(status, reason, n): totals of all, accepted and rejected rows and of each reason, in one grouping-sets pass."""
    marked = rows.select(F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))
    sets = marked.groupingSets([["status", "reason"], ["status"], []], "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    named = F.when(F.col("g") == 3, "source").when(F.col("g") == 1, F.col("status")).when(F.col("status") == "rejected", F.concat(F.lit("rejected:"), "reason"))
    return sets.select(named.alias("step"), "n").where("step is not null")
