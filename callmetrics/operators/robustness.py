"""The distractor suite: calls among 0 to 7 distracting tools, and questions that call for no tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.functions.jsontext import canonical
from callmetrics.operators.parse import CALL_END, CALL_START, parse

LEVELS = (0, 1, 3, 7)
TARGET = "fixture.target"
# The suite's texts.
CALLS = (
    "Find the weather in Paris.",
    "Set a reminder to call Alex tomorrow.",
    "Search for flights from Paris to Delhi.",
    "Convert 3 USD to EUR.",
    "Look up the stock price for ACME.",
    "Book a table for 2 at cafe.",
    "Translate cache into French.",
    "Check whether weather is available.",
    "Send a message to Alex saying hello.",
    "Find the nearest cafe.",
    "Calculate 3 plus 4.",
    "Get the population of Paris.",
    "Create a task named weekly review.",
    "Delete the draft named weekly review.",
    "List events for Paris this weekend.",
    "Get the exchange rate for ACME.",
    "Check the status of order A-17.",
    "Find a recipe using cache.",
    "Open a support ticket for weather.",
    "Schedule a meeting with Alex.",
)
NO_CALLS = (
    "What is the purpose of this test?",
    "Respond with a short greeting only.",
    "Explain the word cache.",
    "Do not select a tool for this question.",
    "Summarize this sentence without taking an action.",
    "What does offline mean?",
    "Write one sentence about rain.",
    "Say thank you.",
    "Explain a queue simply.",
    "Give a harmless example of a list.",
    "What is two plus two?",
    "Define latency.",
    "Describe a blue sky.",
    "Reply with the word okay.",
    "Explain NFC normalization.",
    "What is a JSON object?",
    "Give a short study tip.",
    "Name a fruit.",
    "Describe a quiet room.",
    "Do not call any function.",
)


def cases_of(templates: DataFrame, silent: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(pos, case_id, query, tools, expected_name, distractors): every template (t, query), numbered from 0, at every level
    of distracting tools, template by template, and then the questions (i, query) that call for no tool."""
    spark = templates.sparkSession
    offered = [canonical([{"name": f"fixture.distractor.{k}" if k >= 0 else TARGET, "parameters": {"type": "object", "properties": {}}} for k in range(-1, n)]) for n in levels]
    level = spark.createDataFrame([(i, n, tools) for i, (n, tools) in enumerate(zip(levels, offered))], "at int, distractors int, tools string")
    calls = templates.crossJoin(F.broadcast(level)).select(  # a row for each level
        (F.col("t") * len(levels) + F.col("at")).cast("long").alias("pos"), F.format_string("call-%02d-%d", "t", "distractors").alias("case_id"), "query", "tools", F.lit(TARGET).alias("expected_name"), "distractors"
    )
    after = templates.agg(F.count(F.lit(1)).alias("_n"))
    quiet = silent.crossJoin(F.broadcast(after)).select(
        (F.col("_n") * len(levels) + F.col("i")).cast("long").alias("pos"), F.format_string("no-call-%d", "i").alias("case_id"), "query", F.lit("[]").alias("tools"), F.lit(None).cast("string").alias("expected_name"), F.lit(None).cast("int").alias("distractors")
    )
    return calls.unionByName(quiet)


def cases(spark: SparkSession) -> DataFrame:
    """The fixed suite: 80 calls, template by level, then 20 questions without a call."""
    return cases_of(spark.createDataFrame(list(enumerate(CALLS)), "t long, query string"), spark.createDataFrame(list(enumerate(NO_CALLS)), "i long, query string"))


def makes_no_call(text: Column) -> Column:
    return ~text.contains(CALL_START) & ~text.contains(CALL_END)


def no_call_accuracy(predictions: DataFrame, text: str) -> DataFrame:
    return predictions.agg(F.avg(makes_no_call(F.coalesce(F.col(text), F.lit(""))).cast("double")).alias("no_call_accuracy"))


def silent_cases(spark: SparkSession, n: int = 4) -> DataFrame:
    """The first questions without a call alone: (pos, case_id, query)."""
    return spark.createDataFrame([(i, f"no-call-{i}", q) for i, q in enumerate(NO_CALLS[:n])], "pos long, case_id string, query string")


def suite_no_call_accuracy(suite: DataFrame, predictions: DataFrame, text: str) -> DataFrame:
    """As :func:`no_call_accuracy`, for as many predictions as the suite has cases; 0 without any."""
    sides = [frame.agg(F.count(F.lit(1))).first()[0] for frame in (suite, predictions)]
    if sides[0] != sides[1]:
        raise ValueError("no-call predictions must match the deterministic suite size")
    return no_call_accuracy(predictions, text).fillna(0.0)


def judge_cases(suite: DataFrame, predictions: DataFrame) -> DataFrame:
    """Suite rows with their prediction (none is empty), the parse and ``success``."""
    given = suite.join(predictions.select("case_id", "prediction"), "case_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))
    parsed = parse(given)
    hit = F.when(F.col("expected_name").isNull(), makes_no_call(F.col("prediction"))).otherwise(F.col("schema_valid") & (F.col("name") == F.col("expected_name")))
    return parsed.withColumn("success", hit)


def breakdown(judged: DataFrame) -> DataFrame:
    """(part, n, success): all calls, calls by number of distractors and no-call cases, in one grouping-sets pass."""
    marked = judged.select(F.when(F.col("expected_name").isNull(), "no_call").otherwise("call").alias("kind"), "distractors", F.col("success").cast("double").alias("s"))
    sets = marked.groupingSets([["kind"], ["kind", "distractors"]], "kind", "distractors").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("success"), F.grouping("distractors").alias("all"))
    part = F.when(F.col("all") == 1, F.col("kind")).when(F.col("kind") == "call", F.concat(F.lit("call:"), F.col("distractors").cast("string")))
    return sets.select(part.alias("part"), "n", "success").where("part is not null")


def no_call_diagnostics(judged: DataFrame) -> DataFrame:
    """What the parser says of calls made where none was due."""
    return judged.where("expected_name is null and not success").groupBy(F.coalesce("category", F.lit("valid")).alias("diagnostic")).agg(F.count(F.lit(1)).alias("n"))
