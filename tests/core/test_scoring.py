import json

import pytest

from callmetrics.operators import parse, score

TOOLS = [
    {"name": "get", "parameters": {"type": "object", "properties": {"city": {"type": "string"}, "n": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}, "mode": {"type": "string", "enum": ["A", "B"]}}, "required": ["city"], "additionalProperties": False}},
    {"name": "put", "parameters": {"type": "object", "properties": {}}},
]


def call(name, arguments):
    return "<tool_call>\n" + json.dumps({"name": name, "arguments": arguments}) + "\n</tool_call>"


def parsed(spark, texts, **more):
    rows = [(i, t, json.dumps(TOOLS), "get", '{"city":"Rome"}') for i, t in enumerate(texts)]
    return parse.parse(spark.createDataFrame(rows, "pos long, prediction string, tools string, gold_name string, gold_arguments string"), **more)


GRAMMAR = [
    (call("get", {"city": "x"}), None, "valid", ""),
    (" " + call("get", {"city": "x"}) + "<|im_end|>\n", None, "valid", ""),
    (call("get", {"city": "x"}) + "<|im_end|><|im_end|>", "extra_output", "extra_output", "multiple template terminators"),
    (None, "non_text", "extra_output", "prediction is not text"),
    ("plain", "no_call", "no_call", "one complete tool boundary is required"),
    ("<think>a</think>", "thinking_block", "thinking", "thinking blocks are not allowed"),
    ("<tool_call>{", "partial_boundary", "truncated", "one complete tool boundary is required"),
    (call("get", {}) * 2, "multiple_calls", "multiple_calls", "one complete tool boundary is required"),
    ("a " + call("get", {}), "extra_output", "extra_output", "output outside the tool boundary is not allowed"),
    ("<tool_call>{x}</tool_call>", "invalid_json", "invalid_json", "Expecting property name enclosed in double quotes"),
    ('<tool_call>{"name":"get","arguments":{"city":Infinity}}</tool_call>', "invalid_json", "invalid_json", "non-finite JSON number: Infinity"),
    ('<tool_call>{"name":"get","arguments":{"o":{"a":1,"a":2}}}</tool_call>', "invalid_json", "invalid_json", "duplicate JSON object key: a"),
    ("<tool_call>[]</tool_call>", "json_fragment", "invalid_call", "tool call must be a JSON object"),
    ('<tool_call>{"name":"get"}</tool_call>', "invalid_call", "invalid_call", "call must contain only name and arguments"),
    ('<tool_call>{"name":"","arguments":{}}</tool_call>', "invalid_call", "invalid_call", "tool name must be a string"),
    ('<tool_call>{"name":"get","arguments":[]}</tool_call>', "non_object_arguments", "invalid_call", "arguments must be an object"),
    (call("nope", {}), "unknown_tool", "unknown_tool", "unknown tool: nope"),
    (call("get", {"city": 1}), "schema_invalid", "schema_invalid", "1 is not of type 'string'"),
]


def test_grammar(spark):
    got = {r.pos: r for r in parsed(spark, [g[0] for g in GRAMMAR]).collect()}
    for i, (_, category, primary, message) in enumerate(GRAMMAR):
        assert (got[i].category, got[i].primary, got[i].message or "") == (category, primary, message), i
    assert [got[i].json_valid for i in (0, 16, 17, 9)] == [True, True, True, False] and [got[i].tool_valid for i in (0, 16, 17)] == [True, False, True]


def test_truncation_outranks_a_complete_call(spark):
    from pyspark.sql import functions as F

    rows = parsed(spark, [call("get", {"city": "x"}), None], generated=F.lit(5), limit=F.lit(5)).orderBy("pos").collect()
    assert rows[0].category == "truncation" and rows[1].category == "non_text"


def scores(spark, gold, predicted, tools=TOOLS, name="get", gold_name="get"):
    row = (0, call(name, predicted), json.dumps(tools), gold_name, json.dumps(gold))
    frame = spark.createDataFrame([row], "pos long, prediction string, tools string, gold_name string, gold_arguments string")
    return score.compare(parse.parse(frame)).first()


def test_flags(spark):
    one = scores(spark, {"city": " Rome"}, {"city": "Rome"})
    assert one.exact and one.task_success and one.value_matches == 1 and one.task_error is None
    more = scores(spark, {"city": "Rome"}, {"city": "Rome", "n": 3})
    assert more.task_success and not more.exact and more.extra and more.task_error is None
    wrong = scores(spark, {"city": "Rome"}, {"city": "Oslo"})
    assert wrong.task_error == "wrong_enum_or_value" and not wrong.task_success
    assert scores(spark, {"city": "a", "n": 1}, {"city": "a", "n": 1.0}).value_matches == 2
    assert scores(spark, {"city": "a", "mode": "A"}, {"city": "a", "mode": "B"}).value_matches == 1
    assert scores(spark, {"city": "a"}, {"city": "a"}, name="put").task_error == "wrong_supplied_tool"
    assert scores(spark, {"city": "a"}, {}, name="nope").task_error == "nonexistent_tool"
    assert scores(spark, {"city": "a"}, {}).task_error == "missing_required_argument"
    assert scores(spark, {"city": "a"}, {"city": "a", "zz": 1}).task_error == "extra_hallucinated_argument"
    assert scores(spark, {"city": "a"}, {"city": 5}).task_error == "wrong_type"
    empty = scores(spark, {}, {"x": {}}, name="put", gold_name="put")
    assert not empty.exact and empty.task_success and empty.extra


def test_required_arrays_never_succeed(spark):
    tools = [{"name": "get", "parameters": {"type": "object", "properties": {"tags": {"type": "array", "items": {"type": "string"}}}, "required": ["tags"]}}]
    made = scores(spark, {"tags": ["a"]}, {"tags": ["a"]}, tools)
    assert made.exact and not made.task_success


def test_metrics_of_nothing_and_totals(spark):
    made = score.compare(parsed(spark, [g[0] for g in GRAMMAR]))
    total = score.evaluate(made).first()
    assert total["count"] == len(GRAMMAR) and total.json_validity == pytest.approx(8 / 18)
    empty = score.evaluate(made.limit(0)).first()
    assert empty.tool_accuracy == 0.0 and empty.argument_key_f1 == 1.0
    assert sum(r.n for r in score.primary_counts(made).collect()) == len(GRAMMAR)
    assert {r.term: r.n for r in score.task_error_counts(made).collect()}["truncated_output"] == 1
    assert score.leaf_table(made).where("same").count() == sum(r.value_matches for r in made.collect())
