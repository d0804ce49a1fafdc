"""Sources: record files, prepared manifests, run directories, journals, configurations. All go through Spark's file
readers, so any file system that Spark knows will do."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.functions.jsontext import canonical, strict_loads

MANIFEST = """artifact_version int, prompt_contract_version int, dataset_prompt_contract_version int, kind string, status string,
controlled boolean, controlled_run struct<status string>, git struct<commit string>, selection string, comparable_rendering boolean,
hashes map<string,string>, counts struct<examples bigint, updates bigint>, bytes map<string,bigint>, requirements map<string,boolean>,
safety_probe struct<status string, model_hash string>, prompt_hash string, decoding_hash string, winner_source_run string, seed bigint,
axis string, study_role string, model string, rss_gib double, config struct<model string, precision string, workflow string, axis string,
study_role string, dataset_version string, dataset struct<version string>, training struct<seed bigint, num_layers int, lora_parameters struct<rank int>>>"""
EVALUATION = """count bigint, tool_accuracy double, json_validity double, schema_validity double, argument_key_f1 double, argument_value_f1 double,
exact_match double, task_success double, rss_gib double, peak_rss_gib double, prompt_processing_tokens_per_second double,
generation_throughput_tokens_per_second double, throughput_tokens_per_second double, task_error_categories map<string,bigint>,
allocator_memory_bytes struct<before bigint, peak bigint, after bigint>, study_role string, axis string, prompt_hash string, decoding_hash string"""


@F.pandas_udf(T.ArrayType(T.StringType()))
def _elements(text: pd.Series) -> pd.Series:
    def one(t: str) -> list[str]:
        value = strict_loads(t)
        value = value.get("rows", []) if isinstance(value, dict) else value
        if not isinstance(value, list) or not all(isinstance(v, dict) for v in value):
            raise ValueError("fixture must contain an array of records")
        return [canonical(v) for v in value]

    return text.map(one)


def numbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """``rows`` with their position from 0, without gaps, in the order of their partitions. Row numbers within a
    partition need no shuffle; only the partitions' counts, a number for each, are added up."""
    marked = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = marked.join(counts.select("_p", before.alias("_before")), "_p")
    return placed.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): non-blank lines with their position from 0."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return numbered(lines.select("value")).select("pos", "value")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a JSON-lines file, or of the elements of a JSON array file."""
    if path.endswith(".jsonl"):
        return read_lines(spark, path)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(_elements("value")).alias("pos", "value")).select(F.col("pos").cast("long").alias("pos"), "value")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("split", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])))
def _split_rows(text: pd.Series) -> pd.Series:
    def one(t: str) -> list[tuple[str, int, str]]:
        splits = strict_loads(t).get("splits", {})
        return [(name, pos, canonical(row)) for name, rows in splits.items() for pos, row in enumerate(rows)]

    return text.map(one)


def read_manifest_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, pos, value) of a prepared manifest's ``splits``; numbers stay as they are written."""
    return spark.read.text(path, wholetext=True).select(F.explode(_split_rows("value")).alias("r")).select("r.*")


def read_prepared(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(split, pos, value) of a prepared version: the splits in ``<root>/<version>/manifest.json``, or where that is not
    there, in its sibling ``<root>/<version>.manifest.json``; splits that the manifest doesn't hold itself are read from
    the JSON-lines files beside its rows, ``<root>/<version>/<split>.jsonl``."""
    for path in (f"{root}/{version}/manifest.json", f"{root}/{version}.manifest.json"):
        try:
            inline = read_manifest_splits(spark, path)
            break
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    else:
        raise FileNotFoundError(f"version {version} has no manifest")
    try:
        lines = spark.read.option("pathGlobFilter", "*.jsonl").text(f"{root}/{version}").where(F.trim("value") != "")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return inline
    split = F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1)
    marked = lines.select(split.alias("split"), F.monotonically_increasing_id().alias("_m"), "value")
    placed = marked.select("split", (F.row_number().over(Window.partitionBy("split").orderBy("_m")) - 1).alias("pos"), "value")
    beside = placed.join(inline.select("split").distinct(), "split", "left_anti")
    return inline.unionByName(beside)


def _run_of(column: str = "_metadata.file_path"):
    return F.element_at(F.split(F.col(column), "/"), -2)


def read_run_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run, value): whole text of one named file of every run directory."""
    return spark.read.text(f"{root}/*/{name}", wholetext=True).select(_run_of().alias("run"), "value")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run: manifest, status and evaluation as structs; unreadable JSON is null."""
    manifest = read_run_files(spark, root, "manifest.json").select("run", F.from_json("value", MANIFEST).alias("manifest"))
    status = read_run_files(spark, root, "status.json").select("run", F.get_json_object("value", "$.status").alias("status"))
    evaluation = read_run_files(spark, root, "evaluation.json").select("run", F.from_json("value", EVALUATION).alias("evaluation"))
    return manifest.join(status, "run", "left").join(evaluation, "run", "left")


def read_run_listing(spark: SparkSession, root: str) -> DataFrame:
    """(run, name, bytes): every file below the run directories, directories as the first part of their files' names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    depth = len(root.rstrip("/").split("/"))
    parts = F.split(F.regexp_replace("path", "^file:/*", "/"), "/")
    return files.select(F.get(parts, depth).alias("run"), F.get(parts, depth + 1).alias("name"), F.col("length").alias("bytes"))


def placed_by_run(lines: DataFrame, *columns: str) -> DataFrame:
    """(run, pos, columns) of lines just read from the runs' files, ``pos`` from 0 within each run without gaps. A file's
    splits are read in the order of their offsets, so row numbers of the reader rise along a file."""
    marked = lines.select(_run_of().alias("run"), F.monotonically_increasing_id().alias("_m"), *columns)
    return marked.select("run", (F.row_number().over(Window.partitionBy("run").orderBy("_m")) - 1).cast("long").alias("pos"), *columns)


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """(run, pos, record, prediction, source_id) of runs all of whose rows have an object record and a text prediction;
    a record without a query gets a placeholder. Other runs have no rows here."""
    lines = placed_by_run(spark.read.text(f"{root}/*/predictions.jsonl").where(F.trim("value") != ""), "value")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    record, prediction = F.try_variant_get("v", "$.record", "map<string,variant>"), F.try_variant_get("v", "$.prediction", "variant")
    usable = F.col("v").isNotNull() & record.isNotNull() & (F.schema_of_variant(prediction) == "STRING")
    marked = parsed.withColumn("ok", F.coalesce(usable, F.lit(False)))
    good = marked.groupBy("run").agg(F.bool_and("ok").alias("all")).where("all").select("run")
    text = F.get_json_object("value", "$.record")
    with_query = F.when(F.get_json_object("value", "$.record.query").isNull(), F.concat(F.lit('{"query":"[redacted]",'), F.expr("substring(r, 2)"))).otherwise(F.col("r"))
    rows = marked.join(good, "run").withColumn("r", text)
    return rows.select("run", "pos", with_query.alias("record"), F.get_json_object("value", "$.prediction").alias("prediction"), F.get_json_object("value", "$.source_id").alias("source_id"))


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """(run, pos, columns as text) of ``system_metrics.csv``; numbers that don't parse are null once cast."""
    frame = spark.read.option("header", "true").csv(f"{root}/*/system_metrics.csv")
    numbers = [c for c in frame.columns if c not in ("pressure_state",)]
    placed = placed_by_run(frame, *frame.columns)
    return placed.select("run", "pos", *[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in frame.columns])


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(pos, fields) of a JSON-lines journal under an explicit schema."""
    return read_lines(spark, path).select("pos", F.from_json("value", schema).alias("e")).select("pos", "e.*")


def read_plan(path: str) -> dict:
    """A sweep plan: JSON, or YAML where a YAML reader is installed. A mapping is required."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a plan must be a mapping")
    return value


#: Keys of a training section that a plan may hold at its top.
TRAINING_KEYS = (
    "fine_tune_type", "train", "mask_prompt", "seed", "num_layers", "batch_size", "grad_accumulation_steps", "iters",
    "max_seq_length", "optimizer", "learning_rate", "steps_per_report", "steps_per_eval", "val_batches", "save_every",
    "grad_checkpoint", "lora_parameters",
)


def experiment_sections(plan: dict) -> dict:
    """A plan in sections: training keys at its top form its ``training``, which also gives ``rendering`` its defaults;
    a model that is a mere name gets a ``model_info``. What the plan says itself wins, but for ``training``."""
    flat = {k: v for k, v in plan.items() if k in TRAINING_KEYS}
    made = {k: v for k, v in plan.items() if k not in flat}
    if flat:
        defaults = {"max_seq_length": flat.get("max_seq_length", 512), "mask_prompt": flat.get("mask_prompt", True)}
        made |= {"training": flat, "rendering": defaults | made.get("rendering", {})}
    if isinstance(made.get("model"), str):
        made.setdefault("model_info", {"name": made["model"]})
    return made


#: Names of tokenizer files, and the function and question of the prompt that pins a tokenizer.
TOKENIZER_FILES = ("tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.json", "merges.txt", "added_tokens.json", "spiece.model", "sentencepiece.bpe.model")
GOLDEN_TOOLS = '[{"name":"fixture.echo","parameters":{"properties":{},"type":"object"}}]'
GOLDEN_QUERY = "Say hello."


def golden_prompt(spark: SparkSession) -> str:
    """The prompt whose tokens pin a tokenizer, as the engine renders it without a template."""
    from callmetrics.operators.render import prompt

    return spark.range(1).select(prompt(F.lit(GOLDEN_TOOLS), F.lit(GOLDEN_QUERY))).first()[0]


def tokenizer_hashes(folder: str, template: str, tokens: list[int]) -> dict[str, str]:
    """Digests that pin a tokenizer: of its files below ``folder`` (paths below it and contents, in the order of the
    paths), of its chat template, and of the tokens that it gives for :func:`golden_prompt`. Files are read and hashed
    on the executors, on any file system; without any there is a FileNotFoundError."""
    spark = SparkSession.active()
    name = F.element_at(F.split("path", "/"), -1)
    below = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/").split(":")[-1]) + "/", "").cast("binary")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError("there are no tokenizer files to hash") from error
        raise
    held = files.where(name.isin(*TOKENIZER_FILES) | name.contains("tokenizer")).select(F.struct(below.alias("at"), "content").alias("file"))
    joined = F.aggregate(F.array_sort(F.collect_list("file")), F.lit(b""), lambda a, f: F.concat(a, f["at"], f["content"]))
    found = held.agg(F.count("file").alias("n"), F.sha2(joined, 256).alias("files")).first()
    if not found["n"]:
        raise FileNotFoundError("there are no tokenizer files to hash")
    text = lambda value: hashlib.sha256(value.encode()).hexdigest()
    return {"tokenizer_files": found["files"], "chat_template": text(template), "golden_tokens": text(json.dumps(tokens))}


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
