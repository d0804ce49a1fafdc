import json

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import jsontext, schema
from callmetrics.operators import normalize

TOOL = {"name": "weather.get", "parameters": {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}}, "required": ["city"]}}


def record(**more):
    base = {"id": "a", "query": " What? ", "tools": [TOOL], "answers": [{"name": "weather.get", "arguments": {"city": "Rome"}}]}
    return base | more


def reason(value, pos=0, most=None):
    return normalize.normal_record(value, pos, most)["reason"]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, None),
        ({"query": None, "prompt": "x"}, "query is missing"),
        ({"query": "  "}, "query is missing"),
        ({"tools": "[1"}, "tools is not valid JSON: Expecting ',' delimiter"),
        ({"tools": {}}, "tools must be an array"),
        ({"tools": [TOOL, TOOL]}, "candidate function names are not unique"),
        ({"tools": [{"parameters": {}}]}, "tool function name is required"),
        ({"answers": []}, "exactly one gold answer is required"),
        ({"answers": [{"name": "x", "arguments": {}}]}, "gold function is not in candidate tools"),
        ({"answers": '[{"name": "weather.get", "arguments": {"city": "a", "city": "b"}}]'}, "duplicate JSON object key: city"),
        ({"answers": '[{"name": "weather.get", "arguments": {"city": NaN}}]'}, "non-finite JSON number: NaN"),
        ({"answers": [{"name": "weather.get", "arguments": {"days": 1}}]}, "gold arguments fail schema: 'city' is a required property"),
        ({"answers": [{"name": "weather.get", "arguments": {"city": "x", "days": True}}]}, "gold arguments fail schema: True is not of type 'integer'"),
        ({"answers": [{"name": "weather.get", "arguments": {"city": "x", "days": 2.0}}]}, None),
        ({"rendered_length": 9.5}, "rendered_length must be an integer"),
    ],
)
def test_reasons(change, want):
    assert reason(record(**change)) == want


def test_shapes_of_answers_and_tools():
    wrapped = {"function": {"name": "weather.get", "arguments": '{"city": "x"}'}}
    made = normalize.normal_record(record(answers=wrapped, tools=[{"type": "function", "function": TOOL}], id=None), 7)
    assert made["reason"] is None and made["source_id"] == "None" and made["arguments"] == '{"city":"x"}'
    assert normalize.normal_record({k: v for k, v in record().items() if k != "id"}, 7)["source_id"] == "7"
    assert reason(record(rendered_length=600), most=512) == normalize.TOO_LONG and reason(record(rendered_length=512), most=512) is None


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("int, optional", {"type": "integer"}),
        ("List[List[str]], optional, default: []", {"type": "array", "items": {"type": "array", "items": {"type": "string"}}}),
        ("float, default: 1", {"type": "number"}),
        ("list", "bare list types are not supported"),
        ("Union[int, str]", "union types are not supported"),
        ("int | str", "union types are not supported"),
        ("Tuple[int]", "tuple types are not supported"),
        ("Dict[str, int]", "dict types without properties are not supported"),
        ("Set[int]", "set types are not supported"),
        ("Callable", "callable types are not supported"),
        ("object", "object types without properties are not supported"),
        ("List[]", "homogeneous list item type is required"),
        ("", "legacy parameter type is empty"),
        ("thing", "unsupported legacy parameter type: thing"),
    ],
)
def test_type_labels(label, want):
    if isinstance(want, dict):
        assert schema.label_schema(label) == want
    else:
        with pytest.raises(ValueError, match=want.replace("(", r"\(")):
            schema.label_schema(label)


@pytest.mark.parametrize(
    ("given", "message"),
    [
        ({"type": ["string", "null"]}, "nullable unions are not supported"),
        ({"type": "object", "oneOf": []}, "unsupported schema keyword: oneOf"),
        ({}, "schema type is required"),
        ({"type": "list"}, "bare list types are not supported"),
        ({"type": "array", "items": [{}]}, "tuple arrays are not supported"),
        ({"type": "array"}, "homogeneous array items are required"),
        ({"type": "string", "enum": []}, "enum must be a non-empty array"),
        ({"type": "object", "required": "x"}, "required must be an array of strings"),
        ({"type": "object", "additionalProperties": {}}, "additionalProperties must be boolean"),
        ({"type": "null"}, "unsupported schema type: null"),
    ],
)
def test_refused_schemas(given, message):
    with pytest.raises(ValueError, match=message):
        schema.normal_schema(given)


def test_empty_and_absent_parameters_differ():
    assert schema.parameter_schema({})["additionalProperties"] is False
    assert schema.parameter_schema(None)["additionalProperties"] is True
    assert schema.fingerprint({"type": "object", "description": "x"}) == schema.fingerprint({"type": "object", "properties": {}})


def test_violations():
    rules = schema.normal_schema({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "e": {"type": "integer", "enum": [1, 2]}}, "additionalProperties": False})
    found = {(p, k) for p, k, _ in schema.violations({"a": [1, "x", 1.0, 1.5], "e": True, "z": 0}, rules)}
    assert found == {(("a", 1), "type"), (("a", 3), "type"), (("e",), "type"), (("e",), "enum"), ((), "additionalProperties")}
    assert not list(schema.violations({"e": 1.0}, rules))


def test_normalize_and_conflicts(spark):
    rows = [record(), record(id="b", query="WHAT?", answers=[{"name": "weather.get", "arguments": {"city": "Oslo"}}]), record(id="c", query="other"), record(id="d", query=""), "not json", [1]]
    rows += [record(id="e", query="Straße"), record(id="f", query="STRASSE", answers=[{"name": "weather.get", "arguments": {"city": "x"}}])]
    frame = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "pos long, value string")
    got = {r.source_id: r for r in normalize.drop_conflicts(normalize.normalize(frame)).collect()}
    assert got["a"].reason == got["b"].reason == got["e"].reason == got["f"].reason == normalize.CONFLICT
    assert got["c"].reason is None and got["c"].candidate_prefixes == ["weather"] and got["c"].tool_count == 1
    assert got["4"].reason.startswith("record is not valid JSON") and got["5"].reason == "record must be an object"
    steps = {r.step: r.n for r in normalize.flow(normalize.drop_conflicts(normalize.normalize(frame)), F.col("reason")).collect()}
    assert steps["source"] == 8 and steps["accepted"] == 1 and steps["rejected:" + normalize.CONFLICT] == 4


def test_length_function_and_context(spark):
    frame = spark.createDataFrame([(0, json.dumps(record(query="q" * 9))), (1, json.dumps(record(id="b", query="q" * 99)))], "pos long, value string")
    got = {r.source_id: r for r in normalize.normalize(frame, most_length=50, length_of=lambda row: len(row["query"])).collect()}
    assert got["a"].rendered_length == 9 and got["b"].reason == normalize.TOO_LONG
    kept, dropped = normalize.within_context(spark.createDataFrame([(1, None), (2, 5), (3, 9)], "i int, rendered_length int"), 5)
    assert [r.i for r in kept.orderBy("i").collect()] == [1, 2] and dropped.count() == 1
    with pytest.raises(ValueError):
        normalize.within_context(kept, 0)


def test_canonical_text(spark):
    frame = spark.createDataFrame([('{"b": 1.0, "a": [1e3, "é"]}',), ('{"a":1,"a":2}',), ("NaN",), (None,)], "t string")
    got = [tuple(r) for r in frame.select(jsontext.canonical_json()("t"), jsontext.canonical_json(True, True)("t"), jsontext.strict_parse("t")["error"]).collect()]
    assert got[0] == ('{"a":[1000.0,"é"],"b":1.0}', '{"a": [1000.0, "\\u00e9"], "b": 1.0}', None)
    assert got[1][:2] == (None, None) and got[1][2] == "duplicate JSON object key: a" and got[2][2] == "non-finite JSON number: NaN" and got[3] == (None, None, None)
    keys = spark.createDataFrame([("Straße  ",), ("STRASSE",), ("é",), ("é",)], "t string").select(jsontext.nfc_casefold("t")).collect()
    assert keys[0] == keys[1] and keys[2] == keys[3]
