"""Prompts, completions and their digests, from canonical JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmetrics.operators.parse import CALL_END, CALL_START

# Contract versions and the runs made under the old one.
CONTRACT, LEGACY_CONTRACT = 1, 0
LEGACY_RUNS = ("20260809T104310.301493Z-base-test", "20260809T104939.096339Z-base-test", "20260809T105219.723552Z-smoke-06b", "20260809T105438.796044Z-tuned-test")
PRECISIONS = ("bf16", "8bit", "4bit")


def prompt(tools: Column, query: Column) -> Column:
    """The template-free prompt of canonical tools JSON and a clean query."""
    return F.concat(F.lit("<tools>\n"), tools, F.lit("\n</tools>\n<|user|>\n"), query, F.lit("\n<|assistant|>\n"))


def completion(name: Column, arguments: Column) -> Column:
    """The call between its marks; the name is put into JSON text, arguments are canonical JSON already."""
    quoted = F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r"(?s)^\{\"n\":(.*)\}$", 1)
    return F.concat(F.lit(CALL_START + '\n{"arguments":'), arguments, F.lit(',"name":'), quoted, F.lit("}\n" + CALL_END))


def spaced_call(name: Column, arguments: Column) -> Column:
    """The call as JSON text with blanks behind commas and colons, keys in order, characters as they are."""
    from callmetrics.functions.jsontext import canonical_json

    quoted = F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r"(?s)^\{\"n\":(.*)\}$", 1)
    return canonical_json(spaced=True)(F.concat(F.lit('{"arguments":'), arguments, F.lit(',"name":'), quoted, F.lit("}")))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prompt_contract(run_id: Column) -> Column:
    version = F.when(run_id.isin(*LEGACY_RUNS), LEGACY_CONTRACT).otherwise(CONTRACT)
    return F.struct(version.alias("prompt_contract_version"), (version == LEGACY_CONTRACT).alias("legacy"))


def precision_of(model: Column, given: Column | None = None) -> Column:
    """A stated precision, or the first one that a model name ends a part with."""
    named = F.lit("")
    for p in reversed(PRECISIONS):
        named = F.when(model.contains(f"-{p}"), p).otherwise(named)
    stated = given if given is not None else F.lit(None).cast("string")
    return F.when(stated != "", stated).otherwise(named)


def prefix_holds(full: Column, prefix: Column) -> Column:
    """Whether a token array begins with the prompt's tokens."""
    return F.slice(full, F.lit(1), F.size(prefix)) == prefix
