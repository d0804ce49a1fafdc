"""Model outputs against the strict single-call grammar.

Everything up to the payload is column logic in the order of the grammar; only the payload's JSON and the tool's schema
need Python, once per row, through Arrow.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.functions.jsontext import StrictJsonError, canonical, strict_loads
from callmetrics.functions.schema import violations

# Marks, categories and message texts of the output contract.
CALL_START, CALL_END, TURN_END = "<tool_call>", "</tool_call>", "<|im_end|>"
THINK = ("<think>", "</think>")
PRIMARY = ("valid", "no_call", "thinking", "truncated", "multiple_calls", "extra_output", "invalid_json", "invalid_call", "unknown_tool", "schema_invalid")
PRIMARY_OF = {
    "non_text": "extra_output",
    "thinking_block": "thinking",
    "partial_boundary": "truncated",
    "truncation": "truncated",
    "no_call": "no_call",
    "multiple_calls": "multiple_calls",
    "extra_output": "extra_output",
    "invalid_json": "invalid_json",
    "json_fragment": "invalid_call",
    "non_object_arguments": "invalid_call",
    "invalid_call": "invalid_call",
    "unknown_tool": "unknown_tool",
    "schema_invalid": "schema_invalid",
}
JSON_VALID = ("json_fragment", "non_object_arguments", "invalid_call", "unknown_tool", "schema_invalid")
MESSAGES = {
    "non_text": "prediction is not text",
    "truncation": "generation reached its length limit",
    "thinking_block": "thinking blocks are not allowed",
    "boundary": "one complete tool boundary is required",
    "terminators": "multiple template terminators",
    "outside": "output outside the tool boundary is not allowed",
    "json_fragment": "tool call must be a JSON object",
    "keys": "call must contain only name and arguments",
    "name": "tool name must be a string",
    "non_object_arguments": "arguments must be an object",
    "unknown_tool": "unknown tool: {}",
}
#: Characters that Python's str.strip() removes.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

CALL = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "message", "name", "arguments")])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def occurrences(text: Column, mark: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def tool_functions(tools: list) -> list[dict]:
    found = (t.get("function", t) if isinstance(t, dict) else None for t in tools)
    return [f for f in found if isinstance(f, dict)]


def judge_payload(payload: str, tools: list) -> tuple[str | None, str | None, str, str]:
    """(category, message, name, arguments as JSON text) of the text between the marks; category null if valid."""

    def verdict(category: str | None, message: str | None = None, name: str = "", arguments: dict | None = None):
        return category, message, name, canonical(arguments or {})

    try:
        call = strict_loads(payload)
    except StrictJsonError as error:
        return verdict("invalid_json", str(error))
    if not isinstance(call, dict):
        return verdict("json_fragment", MESSAGES["json_fragment"])
    name, arguments = call.get("name"), call.get("arguments")
    given = arguments if isinstance(arguments, dict) else None
    if call.keys() != {"name", "arguments"}:
        return verdict("invalid_call", MESSAGES["keys"], str(name or ""), given)
    if not isinstance(name, str) or not name:
        return verdict("invalid_call", MESSAGES["name"])
    if given is None:
        return verdict("non_object_arguments", MESSAGES["non_object_arguments"], name)
    functions = [f for f in tool_functions(tools) if f.get("name") == name]
    if not functions:
        return verdict("unknown_tool", MESSAGES["unknown_tool"].format(name), name, given)
    schema = functions[0].get("parameters", functions[0].get("schema"))
    broken = next(violations(given, schema), None) if isinstance(schema, dict) else None
    return verdict("schema_invalid", broken[2], name, given) if broken else verdict(None, None, name, given)


@F.pandas_udf(CALL)
def _judge(payload: pd.Series, tools: pd.Series) -> pd.DataFrame:
    known: dict[str | None, list] = {}
    rows = []
    for text, listed in zip(payload, tools, strict=True):
        if text is None:
            rows.append((None,) * 4)
            continue
        if listed not in known:
            known[listed] = json.loads(listed) if listed else []
        rows.append(judge_payload(text, known[listed]))
    return pd.DataFrame(rows, columns=CALL.names)


def parse(predictions: DataFrame, text: str = "prediction", tools: str = "tools", truncated: Column | None = None, generated: Column | None = None, limit: Column | None = None) -> DataFrame:
    """``predictions`` with ``category`` (null if valid), ``message``, ``name``, ``arguments`` (JSON text), ``primary``,
    ``json_valid``, ``tool_valid``, ``schema_valid``.

    ``truncated``, or ``generated`` reaching ``limit``, marks an output as cut off and outranks everything but null text.
    """
    t = F.col(text)
    cut = F.coalesce(F.lit(False) if truncated is None else truncated, F.lit(False))
    if generated is not None and limit is not None:
        cut = cut | F.coalesce(generated >= limit, F.lit(False))
    opened, closed = occurrences(t, CALL_START), occurrences(t, CALL_END)
    trimmed = strip(t)
    one_end = trimmed.endswith(TURN_END)
    inner = F.when(one_end, F.regexp_replace(F.expr(f"left(_trimmed, length(_trimmed) - {len(TURN_END)})"), f"{BLANK}+$", "")).otherwise(F.col("_trimmed"))
    framed = F.col("_inner").startswith(CALL_START) & F.col("_inner").endswith(CALL_END)
    before_payload = (
        F.when(t.isNull(), "non_text")
        .when(cut, "truncation")
        .when(t.contains(THINK[0]) | t.contains(THINK[1]), "thinking_block")
        .when((opened > 1) | (closed > 1), "multiple_calls")
        .when((opened == 0) & (closed == 0), "no_call")
        .when((opened != 1) | (closed != 1), "partial_boundary")
        .when(one_end & F.col("_inner").contains(TURN_END), "extra_output:terminators")
        .when(~framed, "extra_output:outside")
    )
    staged = predictions.withColumn("_trimmed", trimmed).withColumn("_inner", inner).withColumn("_early", before_payload)
    payload = strip(F.expr(f"substring(_inner, {len(CALL_START) + 1}, length(_inner) - {len(CALL_START) + len(CALL_END)})"))
    called = staged.withColumn("_call", _judge(F.when(F.col("_early").isNull(), payload), F.col(tools)))
    early = F.col("_early")
    words = F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v)])
    key = F.when(early.isin("multiple_calls", "no_call", "partial_boundary"), "boundary").otherwise(F.element_at(F.split(early, ":"), -1))
    category = F.when(early.isNull(), F.col("_call.category")).otherwise(F.element_at(F.split(early, ":"), 1))
    primary = F.create_map(*[F.lit(x) for pair in PRIMARY_OF.items() for x in pair])
    made = called.select(
        *predictions.columns,
        category.alias("category"),
        F.when(early.isNull(), F.col("_call.message")).otherwise(F.element_at(words, key)).alias("message"),
        F.coalesce("_call.name", F.lit("")).alias("name"),
        F.coalesce("_call.arguments", F.lit("{}")).alias("arguments"),
    )
    c = F.col("category")
    return made.select(
        "*",
        F.when(c.isNull(), "valid").otherwise(F.coalesce(F.element_at(primary, c), F.lit("extra_output"))).alias("primary"),
        (c.isNull() | c.isin(*JSON_VALID)).alias("json_valid"),
        (c.isNull() | (c == "schema_invalid")).alias("tool_valid"),
        c.isNull().alias("schema_valid"),
    )
