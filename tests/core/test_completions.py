"""Report tables, prepared versions, value checks, interval names and the smaller suite."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import jsontext
from callmetrics.operators import render, robustness, runs, stats
from callmetrics.sources import readers, writers


def test_report_tables_and_seed_group(spark):
    schema = "run string, study_role string, axis string, model string, precision string, dataset_version string, rank int, layers int, train_examples long, task_success double, argument_value_f1 double, schema_validity double, generation_throughput_tokens_per_second double, winner_source_run string"
    row = lambda run, role, axis, source=None, model="m", success=0.5: (run, role, axis, model, "4bit", "v", 8, 16, 10, success, 0.4, 0.9, 20.0, source)
    rows = [row("b", "headline", ""), row("a", "headline", ""), row("c", "x", "dataset_size"), row("d", "x", "adapter_layers"), row("e", "x", "model_size"), row("f", "x", None)]
    made = {name: [r.run for r in frame.collect()] for name, frame in runs.report_tables(spark.createDataFrame(rows, schema)).items()}
    assert made == {"headline-precision-table": ["a", "b"], "data-scaling": ["c"], "adapter-capacity": ["d"], "model-size-quality-throughput-frontier": ["e"]}
    seeds = [row(f"s{i}", "winner_seed", "", "w", "m2", 0.1 * i) for i in range(2)] + [row("w", "headline", "", None, "m2", 0.2)] + [row(f"a{i}", "winner_seed", "", None, "m1") for i in range(3)]
    frame = spark.createDataFrame(seeds, schema)
    first = runs.first_seed_group(frame).collect()
    assert [(r.model, r.n) for r in first] == [("m1", 3)] and runs.winner_seeds(frame).count() == 2
    assert runs.first_seed_group(frame.where("model = 'm2' and run != 'w'")).count() == 0


def test_prepared_versions(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "manifest.json").write_text('{"splits": {"train": [{"id": 1}]}}')
    (tmp_path / "v1" / "test.jsonl").write_text('{"id": 7}\n\n{"id": 8}\n')
    (tmp_path / "v1" / "train.jsonl").write_text('{"id": 99}\n')
    (tmp_path / "v2.manifest.json").write_text('{"splits": {"test": [{"id": 5}, {"id": 6}]}}')
    read = lambda v: sorted((r.split, r.pos, json.loads(r.value)["id"]) for r in readers.read_prepared(spark, str(tmp_path), v).collect())
    assert read("v1") == [("test", 0, 7), ("test", 1, 8), ("train", 0, 1)] and read("v2") == [("test", 0, 5), ("test", 1, 6)]
    with pytest.raises(FileNotFoundError):
        readers.read_prepared(spark, str(tmp_path), "v3")


def test_value_checks():
    jsontext.check_values({"a": [1, 2.5, None, True, {"b": "x"}]}, "row")
    for bad, said in (({"a": (1,)}, "tuple"), ([{1}], "set"), ({1: 2}, "non-string"), ([float("nan")], "non-finite"), ({"a": b"x"}, "bytes"), (frozenset(), "frozenset")):
        with pytest.raises(ValueError, match=said):
            jsontext.check_values(bad, "row")


def test_named_intervals(spark):
    rows = [(i, i % 2 == 0, i % 3 == 0, True, i % 5 == 0, 1, i % 2, 1, 1) for i in range(200)]
    frame = spark.createDataFrame(rows, "pos int, tool_accuracy boolean, json_valid boolean, schema_valid boolean, exact boolean, key_matches int, value_matches int, n_predicted int, n_gold int").withColumn("task_success", F.col("exact"))
    for name, share in (("tool_accuracy", 0.5), ("json_validity", 1 / 3), ("exact_match", 0.2), ("task_success", 0.2), ("argument_value_f1", 0.5)):
        got = stats.metric_interval(frame, "pos", name, 300).first()
        assert got.low < share + 0.01 < got.high + 0.01 and got.high - got.low < 0.2
    assert tuple(stats.metric_interval(frame, "pos", "schema_validity", 50).first()) == (1.0, 1.0) == tuple(stats.metric_interval(frame, "pos", "argument_key_f1", 50).first())
    with pytest.raises(stats.SeriesError, match="no such metric"):
        stats.metric_interval(frame, "pos", "speed", 50)


def test_small_suite(spark):
    suite = robustness.silent_cases(spark)
    assert [r.case_id for r in suite.orderBy("pos").collect()] == [f"no-call-{i}" for i in range(4)]
    said = spark.createDataFrame([("a",), ("<tool_call>x",), (None,), ("</tool_call>",)], "prediction string")
    assert robustness.suite_no_call_accuracy(suite, said, "prediction").first()[0] == 0.5
    with pytest.raises(ValueError, match="suite size"):
        robustness.suite_no_call_accuracy(suite, said.limit(3), "prediction")


def test_exposure(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", None, 2), ("b", 5, None)], "g string, p int, t int")
    assert {r.g: (r.prompt_tokens, r.target_tokens) for r in runs.exposure(rows, F.col("p"), F.col("t"), ("g",)).collect()} == {"a": (3, 3), "b": (5, 0)}
    assert tuple(runs.exposure(rows.limit(0), F.col("p"), F.col("t")).first()) == (0, 0)


def test_sidecars_anywhere(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sidecars.link./in", f"file://{tmp_path}")
    (tmp_path / "a.bin").write_bytes(b"abc")
    far, near = "viewfs://sidecars/in/a.bin", str(tmp_path / "a.bin")
    assert writers.write_sidecar(far) == hashlib.sha256(b"abc").hexdigest()
    writers.check_sidecar(near)
    writers.check_sidecar(far)
    (tmp_path / "a.bin").write_bytes(b"abd")
    for path in (near, far):
        with pytest.raises(writers.LockError):
            writers.check_sidecar(path)
    writers.write_sidecar(near)
    writers.check_sidecar(far)


def test_appended_csv_and_spaced_calls(spark, tmp_path):
    frame = spark.createDataFrame([(1, "é"), (2, 'q"')], "n int, s string")
    for part in (frame.where("n = 1"), frame.where("n = 2")):
        writers.append_csv(part, str(tmp_path / "t"), ["s", "missing", "n"])
    back = spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "t"))
    assert back.columns == ["s", "missing", "n"] and sorted(int(r.n) for r in back.collect()) == [1, 2]
    got = frame.select(render.spaced_call(F.col("s"), F.lit('{"b":[1,2],"a":"ü"}')).alias("c")).collect()
    assert [r.c for r in got] == ['{"arguments": {"a": "ü", "b": [1, 2]}, "name": "é"}', '{"arguments": {"a": "ü", "b": [1, 2]}, "name": "q\\""}']
