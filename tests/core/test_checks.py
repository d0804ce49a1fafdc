import json

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import schema
from callmetrics.operators import benchmark, privacy, score, select, splits
from callmetrics.sources import readers, writers


@pytest.mark.parametrize(
    ("gold", "predicted", "more"),
    [
        ({"a": 1}, {"a": 2}, False),
        ({"a": 1}, {"a": 1, "b": None}, True),
        ({"a": {"b": 1}}, {"a": {"c": 1}}, True),
        ({"a": 1}, {"a": {}}, True),
        ({"a": {}}, {"a": 1}, False),
        ({"a": [1, 2]}, {"a": [1]}, False),
        ({"a": [1]}, {"a": [1, 2]}, True),
        ({"a": [1]}, {"a": {"0": 1}}, True),
        ({"a": [{"x": 1}]}, {"a": [{"x": 2, "y": 1}]}, True),
        ({}, {}, False),
    ],
)
def test_what_a_prediction_adds(gold, predicted, more):
    assert bool(score.shape(predicted) - score.shape(gold)) is more


def test_required_values():
    inner = {"type": "object", "properties": {"x": {"type": "integer"}, "z": {"type": "object", "required": ["q"]}}, "required": ["x", "z"]}
    places = score.required_places({"type": "object", "properties": {"a": inner, "b": {"type": "array"}}, "required": ["a", "b", "c"]})
    assert score.required_values({"a": {"x": 1, "z": {}}, "b": [1], "d": 2}, places) == {("a", "x"): 1, ("a", "z"): {}, ("b",): [1]}
    assert score.required_values({"a": {"y": 1}}, places) == {("a",): {"y": 1}}
    assert score.required_values({"a": 5, "c": None}, places) == {("a",): 5, ("c",): None}
    assert score.required_values({}, places) == {}


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("  Str ", "unsupported legacy parameter type: Str"),
        ("LIST [ int ], Optional", {"type": "array", "items": {"type": "integer"}}),
        ("List[int, optional]", {"type": "array", "items": {"type": "integer"}}),
        ("typing.List", "bare list types are not supported"),
        ("typing.Union[int]", "unsupported legacy parameter type: typing.Union"),
        ("List[Tuple[int]]", "tuple types are not supported"),
        ("str, default: a, optional", {"type": "string"}),
        (", optional", "legacy parameter type is empty"),
    ],
)
def test_labels(label, want):
    if isinstance(want, dict):
        assert schema.label_schema(label) == want
    else:
        with pytest.raises(ValueError) as error:
            schema.label_schema(label)
        assert str(error.value).startswith(want)


def test_positions_must_match(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, x string")
    assert score.by_position(rows, rows.withColumnRenamed("x", "y")).count() == 2
    with pytest.raises(ValueError, match="prediction count 1 does not match record count 2"):
        score.by_position(rows, rows.limit(1))


def test_overlap_is_an_error(spark):
    rows = spark.createDataFrame([(i, [f"k{i // 2}"]) for i in range(6)], "id long, keys array<string>")
    test = rows.where("id >= 4")
    assert splits.require_disjoint(test, rows.where("id < 4"), "id", F.col("keys")).count() == 2
    with pytest.raises(splits.AllocationError, match=r"\[4\]"):
        splits.require_disjoint(rows.where("id = 4"), rows.where("id != 4"), "id", F.col("keys"))


def test_views_keep_the_locks(spark):
    rows = spark.createDataFrame([(i, [f"k{i // 2}"], 3, 100 * i) for i in range(40)], "id long, keys array<string>, n int, length int")
    locked = rows.where("id in (0, 5)").withColumn("split", F.when(F.col("id") == 0, "validation").otherwise("test"))
    view = splits.context_view(rows, locked, "id", F.col("keys"), "length", 2000).collect()
    assert {r.id for r in view if r.split == "train"} == set(range(21)) - {0, 1, 4, 5} and {(r.id, r.split) for r in view if r.split != "train"} == {(0, "validation"), (5, "test")}
    full = splits.full_allocation(rows, locked, "id", F.col("keys"), F.col("n"), 10, "length", 3100).collect()
    train = {r.id for r in full if r.split == "train"}
    assert len(train) == 10 and not train & {0, 1, 4, 5} and all(i ^ 1 in train for i in train) and len(full) == 12


def test_exact_set_and_sources(spark):
    chosen = spark.createDataFrame([("a", "1"), ("b", "2")], "case_id string, case_hash string")
    assert benchmark.require_exact_set(chosen, chosen).count() == 2
    with pytest.raises(splits.AllocationError, match="b missing"):
        benchmark.require_exact_set(chosen, chosen.limit(1))
    files = spark.createDataFrame([(f"/x/{c}.json",) for c in benchmark.CATEGORIES], "path string")
    assert set(benchmark.require_sources(files)) == set(benchmark.CATEGORIES)
    with pytest.raises(ValueError, match="ambiguous or missing"):
        benchmark.require_sources(files.unionByName(files))


def test_export_lines(spark):
    rows = spark.createDataFrame([(0, None, "said", None), (1, "x", None, 3)], "pos long, id string, model_response string, tokens int")
    assert [json.loads(r.value) for r in benchmark.export_rows(rows).orderBy("pos").collect()] == [{"id": "0", "result": "said"}, {"id": "x", "result": "", "tokens": 3}]


def test_latest_run_and_labels(spark):
    runs = spark.createDataFrame([("a",), ("a-attempt-2",), ("a-attempt-10",), ("b",)], "name string")
    got = select.latest_run(runs, "name", F.regexp_replace("name", r"-attempt-\d+$", "")).collect()
    assert {(r.base, r.run) for r in got} == {("a", "a-attempt-10"), ("b", "b")}
    paths = spark.createDataFrame([("/w/p/x/y",), ("/w/p",), ("/w/pq",)], "path string")
    labels = [r[0] for r in paths.select(privacy.project_label(F.col("path"), "/w/p/")).collect()]
    assert labels[:2] == ["x/y", "."] and labels[2].startswith("external:") and len(labels[2]) == 25


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text("\n".join(["{}", "", *[f'{{"n": {i}}}' for i in range(500)]]))
    lines = readers.read_lines(spark, str(tmp_path / "lines.jsonl")).orderBy("pos").collect()
    assert [r.pos for r in lines] == list(range(501)) and lines[3].value == '{"n": 2}'
    (tmp_path / "rows.json").write_text('{"rows": [{"a": 2.0}, {"b": 1}]}')
    assert [r.value for r in readers.read_records(spark, str(tmp_path / "rows.json")).orderBy("pos").collect()] == ['{"a":2.0}', '{"b":1}']
    (tmp_path / "manifest.json").write_text('{"splits": {"train": [{"x": 2.0}, {"x": 1e3}], "test": []}}')
    assert [(r.split, r.pos, r.value) for r in readers.read_manifest_splits(spark, str(tmp_path / "manifest.json")).orderBy("pos").collect()] == [("train", 0, '{"x":2.0}'), ("train", 1, '{"x":1000.0}')]
    writers.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'
    path = str(tmp_path / "rows.json")
    writers.write_sidecar(path)
    writers.check_sidecar(path)
    (tmp_path / "rows.json").write_text("other")
    with pytest.raises(writers.LockError):
        writers.check_sidecar(path)
