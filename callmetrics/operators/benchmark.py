"""Selection of external benchmark rows and integrity of their results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.functions.jsontext import canonical
from callmetrics.functions.schema import PERMISSIVE, normal_schema
from callmetrics.operators.splits import AllocationError

CATEGORIES = ("simple_python", "irrelevance")


def schemas_in(value: Any) -> Iterator[dict]:
    """Every object under a ``parameters`` or ``schema`` key, at any depth."""
    if isinstance(value, dict):
        for key, child in value.items():
            if key in ("parameters", "schema") and isinstance(child, dict):
                yield child
            yield from schemas_in(child)
    elif isinstance(value, list):
        for child in value:
            yield from schemas_in(child)


def is_supported(row: Any) -> bool:
    try:
        for schema in schemas_in(row):
            normal_schema(schema or PERMISSIVE)
    except ValueError:
        return False
    return True


#: Keys under which rows keep their question, functions and schemas; the first that is there counts.
KEPT_AS = {"question": ("query", "question"), "functions": ("tools", "functions", "function"), "schema": ("parameters", "schema")}


def _kept(row: dict, what: str) -> Any:
    return next((row[key] for key in KEPT_AS[what] if key in row), None)


def _alone(value: Any, kind: type) -> Any:
    """What single-element lists hold in the end, if it is of a kind; at most two lists deep."""
    for _ in range(2):
        value = value[0] if isinstance(value, list) and len(value) == 1 else value
    return value if isinstance(value, kind) else None


def facts(row: dict[str, Any]) -> dict[str, Any]:
    """What a row says, in whatever form it says it: its turn, the text asked, and a (name, schema, source) per function."""
    question, listed = _kept(row, "question"), _kept(row, "functions")
    turn = {"content": question, "free": True} if isinstance(question, str) else _alone(question, dict) if isinstance(question, list) else None
    listed = listed if isinstance(listed, list) else [listed] if isinstance(listed, dict) else []
    sources = [source.get("function", source) if isinstance(source, dict) else None for source in listed]
    held = [source if isinstance(source, dict) else {} for source in sources]
    return {"turn": turn, "text": (turn or {}).get("content"), "functions": [(f.get("name"), _kept(f, "schema"), f) for f in held]}


#: (what has to hold, what is said if it doesn't), in the order in which refusals rank.
RULES = (
    (lambda f: f["turn"] is not None and f["turn"].get("role") in (None, "user"), "question must contain exactly one user turn"),
    (lambda f: isinstance(f["text"], str) and ("free" in f["turn"] or f["text"].strip() != ""), "user turn content must be a non-empty string"),
    (lambda f: f["functions"] != [], "row must contain a non-empty function list"),
    (lambda f: all(isinstance(name, str) for name, _, _ in f["functions"]), "function descriptor must contain a name"),
    (lambda f: all(isinstance(schema, dict) for _, schema, _ in f["functions"]), "function descriptor must contain an object schema"),
)


def row_inputs(row: dict[str, Any]) -> tuple[str, list[dict[str, Any]]]:
    """(query, tools) of a row with exactly one user turn and at least one function; ValueError with the first refusal."""
    found = facts(row)
    refused = [message for holds, message in RULES if not holds(found)] if found["turn"] is not None else [RULES[0][1]]
    if refused:
        raise ValueError(refused[0])
    described = [({k: f[k] for k in ("name", "description") if k in f}, schema) for _, schema, f in found["functions"]]
    return found["text"], [{"type": "function", "function": named | {"parameters": normal_schema(schema)}} for named, schema in described]


CASE = T.StructType([T.StructField("category", T.StringType()), T.StructField("case_hash", T.StringType()), T.StructField("supported", T.BooleanType()), T.StructField("query", T.StringType()), T.StructField("tools", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(CASE)
def read_case(text: pd.Series) -> pd.DataFrame:
    """Category, content hash, support and prompt inputs of a row's JSON text."""
    rows = []
    for t in text:
        row = json.loads(t)
        digest = hashlib.sha256(canonical(row, spaced=True).encode()).hexdigest()
        try:
            query, tools = row_inputs(row)
            made = (query, canonical(tools), None)
        except ValueError as error:
            made = (None, None, str(error))
        rows.append((row.get("category", row.get("type")), digest, is_supported(row), *made))
    return pd.DataFrame(rows, columns=CASE.names)


def select_cases(rows: DataFrame, text: str = "value", per_category: int = 200, seed: int = 42, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The first ``per_category`` supported rows of each category by the digest of seed and content hash."""
    from pyspark.sql import Window

    read = rows.withColumn("_c", read_case(F.col(text))).select(*rows.columns, "_c.*").where(F.col("supported") & F.col("category").isin(*categories))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), "case_hash").cast("binary"), 256)
    ranked = read.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(key, text))).where(F.col("rank") <= per_category)
    counts = {r["category"]: r["count"] for r in ranked.groupBy("category").count().collect()}
    for category in categories:
        if counts.get(category, 0) < per_category:
            raise AllocationError(f"category {category} has only {counts.get(category, 0)} supported cases")
    return ranked


def integrity(selected: DataFrame, results: DataFrame, case_id: str = "case_id", hashed: str = "case_hash") -> DataFrame:
    """(case_id, problem): cases that are missing, unexpected, repeated or changed between selection and results."""
    given = results.groupBy(case_id).agg(F.count(F.lit(1)).alias("n"), F.max(hashed).alias("got"))
    both = selected.select(case_id, F.col(hashed).alias("want"), F.lit(True).alias("chosen")).join(given, case_id, "full")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("chosen").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(~F.col("want").eqNullSafe(F.col("got")), "changed")
    )
    return both.select(case_id, problem.alias("problem")).where("problem is not null")


def require_exact_set(selected: DataFrame, results: DataFrame, case_id: str = "case_id", hashed: str = "case_hash") -> DataFrame:
    """``results`` themselves; an error naming the first cases that are missing, unexpected, repeated or changed."""
    found = integrity(selected, results, case_id, hashed).orderBy(case_id).limit(5).collect()
    if found:
        raise AllocationError("results do not match the selection: " + ", ".join(f"{r[case_id]} {r['problem']}" for r in found))
    return results


def require_sources(files: DataFrame, path: str = "path", categories: tuple[str, ...] = CATEGORIES) -> dict[str, str]:
    """The one file of each category; an error naming categories with none or several."""
    found = unique_sources(files, path, categories).collect()
    wrong = sorted(r["category"] for r in found if r["n"] != 1)
    if wrong:
        raise ValueError("category files are ambiguous or missing: " + ", ".join(wrong))
    return {r["category"]: r["path"] for r in found}


def export_rows(responses: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, value): result lines in the benchmark's own form. The response is the first of prediction, model_response
    and result that the row has; optional fields stand only where they have a value; a run id never does."""
    have = lambda names: [F.col(c) for c in names if c in responses.columns]
    said = F.coalesce(*have(("prediction", "model_response", "result")), F.lit(""))
    name = F.coalesce(*[c.cast("string") for c in have(("id",))], F.col(pos).cast("string"))
    more = [c for c in ("inference_log", "latency", "tokens") if c in responses.columns]
    fields = sorted([("id", name), ("result", said), *[(c, F.col(c)) for c in more]], key=lambda x: x[0])
    return responses.select(pos, F.to_json(F.struct(*[v.alias(k) for k, v in fields]), {"ignoreNullFields": "true"}).alias("value"))


def unique_sources(files: DataFrame, path: str = "path", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(category, n, path): how many JSON files name a category; exactly one is wanted."""
    name = F.regexp_extract(F.col(path), r"([^/]+)\.jsonl?$", 1)
    found = files.select(F.col(path).alias("path"), name.alias("name"))
    spark = files.sparkSession
    wanted = spark.createDataFrame([(c,) for c in categories], "category string")
    return wanted.join(found, F.col("name").contains(F.col("category")), "left").groupBy("category").agg(F.count("path").alias("n"), F.min("path").alias("path"))
