import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from callmetrics.operators import benchmark, privacy, robustness, runs, select, stats, telemetry
from callmetrics.sources import readers, writers


def test_twister_intervals(spark):
    values = [float(i % 3 == 0) for i in range(40)]
    rng, made = random.Random(42), []
    for _ in range(200):
        made.append(sum(values[rng.randrange(40)] for _ in range(40)) / 40)
    made.sort()
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = stats.parity_mean_interval(frame, "i", "v", samples=200).first()
    assert (got.low, got.high) == (made[int((1 - 0.95) / 2 * 200)], made[min(199, int((1 - (1 - 0.95) / 2) * 200))])
    counts = spark.createDataFrame([(i, i % 2, 1, 1) for i in range(20)], "i int, m int, p int, g int")
    f = stats.parity_f1_interval(counts, "i", ("m", "p", "g"), samples=100).first()
    assert 0 < f.low < 0.5 < f.high < 1


def test_hash_draws_and_numbering(spark):
    frame = spark.createDataFrame([(i * 3, float(i)) for i in range(50)], "i long, v double").repartition(7)
    assert {r.i: r.row for r in stats.numbered(frame, "i").collect()} == {i * 3: i for i in range(50)}
    got = stats.interval(stats.draws(frame, "i", 300, {"m": stats.weighted_mean("v")}), "m").first()
    assert got.low < 24.5 < got.high
    with pytest.raises(stats.SeriesError):
        stats.draws(frame.limit(0), "i", 10, {"m": stats.weighted_mean("v")})


def test_pairs_are_checked(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0)], "i int, v double")
    assert stats.paired(a, a, "i", ("v",)).count() == 2
    for bad in (a.unionByName(a.limit(1)), a.where("i = 1")):
        with pytest.raises(stats.SeriesError):
            stats.paired(a, bad, "i", ("v",))


def test_order_statistics(spark):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3, 9, 8, 7, 6, 0])], "i int, v double")
    got = stats.percentiles(frame, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got.p50, got.p95) == (4.0, 8.0)
    groups = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", None), (None, 5.0), ("b", None)] + [("h", float(i % 7)) for i in range(500)], "g string, v double").repartition(9)
    got = {r.g: (r.low, r.mid, r.high) for r in stats.percentiles(groups, "v", {"low": 0.0, "mid": 0.5, "high": 1.0}, ("g",)).collect()}
    assert got == {"a": (1.0, 1.0, 3.0), None: (5.0, 5.0, 5.0), "b": (0.0, 0.0, 0.0), "h": (0.0, float(sorted(i % 7 for i in range(500))[249]), 6.0)}
    assert stats.percentiles(groups.limit(0), "v", {"p": 0.5}).first().p == 0.0
    assert stats.percentiles(groups.limit(0), "v", {"p": 0.5}, ("g",)).count() == 0
    ends = {r.g: (r.first_quartile, r.last_quartile) for r in stats.end_quartiles(groups.withColumn("o", F.col("v")), "v", ["o"], ("g",)).collect()}
    held = sorted(i % 7 for i in range(500))
    assert ends == {"a": (1.0, 3.0), None: (5.0, 5.0), "h": (sum(held[:125]) / 125, sum(held[-125:]) / 125)}
    q = stats.end_quartiles(frame, "v", ["i"]).first()
    assert (q.first_quartile, q.last_quartile) == (3.0, 3.0)
    three = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)], "g string, v double")
    one = stats.seed_summary(three, ("g",), "v").collect()
    assert len(one) == 1 and one[0]["std"] == pytest.approx(statistics.stdev([1, 2, 4]))


def test_streaks_and_safety(spark):
    rows = [("a", i, m, 1.0, 50.0, p) for i, (m, p) in enumerate([(0.5, "normal"), (0.5, "x"), (2.0, "normal"), (0.5, "critical"), (0.5, "critical")])]
    rows += [("b", i, 0.9, 1.0, 50.0, "normal") for i in range(3)] + [("c", i, 5.0, float(i * 2), 50.0, "normal") for i in range(3)] + [("d", 0, float("nan"), 0.0, 50.0, None)] + [("e", 0, 9.0, 0.0, 20.0, "normal"), ("f", 0, 9.0, 0.0, 40.0, "normal")]
    frame = spark.createDataFrame(rows, "run string, t int, memory_available_gib double, swap_used_gib double, disk_free_gib double, pressure_state string")
    got = {r.run: r for r in telemetry.probe_safety(frame, ["t"], ("run",)).collect()}
    assert {k: v.status for k, v in got.items()} == {"a": "safe", "b": "infeasible", "c": "infeasible", "d": "infeasible", "e": "infeasible", "f": "safe"}
    assert got["b"].available_memory and got["c"].swap_growth and got["d"].nonfinite and got["e"].projected_disk
    summary = telemetry.summarize(frame.withColumn("rss_gib", F.when(F.col("t") > 0, F.col("t").cast("double"))), ["t"], ("run",)).where("run = 'a'").first()
    assert (summary.rss_gib_before, summary.rss_gib_after, summary.pressure_peak, summary.samples) == (1.0, 4.0, "critical", 5)


def test_skylines(spark):
    rows = [("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 3.0, 9.0), ("d", None, 1.0), ("e", 3.0, None), ("f", 2.0, 5.0)]
    frame = spark.createDataFrame(rows, "r string, q double, m double")
    assert sorted(r.r for r in select.skyline(frame, "r", ["q"], ["m"]).collect()) == ["b", "c", "d", "f"]
    rng = random.Random(3)
    many = [(str(i), float(rng.randrange(9)), float(rng.randrange(9)), float(rng.randrange(9))) for i in range(150)]
    got = {r.r for r in select.skyline(spark.createDataFrame(many, "r string, a double, b double, c double"), "r", ["a", "b"], ["c"]).collect()}
    beats = lambda x, y: x[1] >= y[1] and x[2] >= y[2] and x[3] <= y[3] and x[1:] != y[1:]
    assert got == {y[0] for y in many if not any(beats(x, y) for x in many)}


def test_repaired_examples_broadcast_no_ids(spark):
    """Spark would take the failed ids, of unknown number, for small enough to send to every task."""
    base = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "pos long, task_success boolean")
    tuned = base.withColumn("task_success", F.col("pos") % 2 == 0)
    made = runs.repaired_examples(base, tuned, "pos")
    assert [r.pos for r in made.collect()] == [2, 4, 8, 10, 14]
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_selection_order_and_journal(spark):
    rows = [("r1", "0.9", 0.5, 1.0, None, 1.0, "f1"), ("r2", "0.9", 0.5, 1.0, 2.0, 1.0, "f2"), ("r3", "0.9", 0.5, 1.0, 2.0, 1.0, "f3"), ("r4", "bad", 1.0, 1.0, 1.0, 9.0, "f9")]
    frame = spark.createDataFrame(rows, "run string, task_success string, argument_value_f1 double, schema_validity double, rss_gib double, generation_throughput_tokens_per_second double, fingerprint string")
    assert select.best(frame, select.selection_key()).first().run == "r3"
    journal = spark.createDataFrame([("a", 1, "running"), ("a", 2, "completed"), ("b", 3, "failed")], "fp string, pos int, status string")
    assert {r.fp: r.status for r in select.last_write(journal, "fp", ["pos"]).collect()} == {"a": "completed", "b": "failed"}
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "fp string")
    assert sorted(r.fp for r in select.to_resume(plan, journal, "fp", F.col("status") == "completed").collect()) == ["b", "c"]


def test_plans():
    rows = select.expand({"axes": {"b": [1, 2], "a": ["x"]}})
    assert [r["values"] for r in rows] == [{"a": "x", "b": 1}, {"a": "x", "b": 2}] and rows[0]["fingerprint"] == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()
    assert select.expand({"runs": [{"q": 1}], "axes": {"a": [1]}})[0]["values"] == {"q": 1} and len(select.expand({})) == 1
    assert select.with_path({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}}


def test_suite(spark):
    suite = robustness.cases(spark)
    assert suite.count() == 100 and suite.where("expected_name is null").count() == 20
    ids = [r.case_id for r in suite.orderBy("pos").collect()]
    assert ids[:5] == ["call-00-0", "call-00-1", "call-00-3", "call-00-7", "call-01-0"] and ids[-1] == "no-call-19"
    judged = robustness.judge_cases(suite, spark.createDataFrame([("no-call-3", "<tool_call>{</tool_call>")], "case_id string, prediction string"))
    parts = {r.part: r.success for r in robustness.breakdown(judged).collect()}
    assert parts["call"] == 0.0 and parts["no_call"] == pytest.approx(0.95) and robustness.no_call_diagnostics(judged).first().diagnostic == "invalid_json"


def test_benchmark_rows(spark):
    row = {"id": "x", "category": "simple_python", "question": [[{"role": "user", "content": "q"}]], "function": {"name": "f", "parameters": {"type": "dict", "properties": {"a": {"type": "integer"}}}}}
    query, tools = benchmark.row_inputs(row)
    assert query == "q" and tools[0]["function"]["parameters"]["type"] == "object" and benchmark.is_supported(row)
    assert not benchmark.is_supported({"function": {"parameters": {"type": "tuple"}}}) and benchmark.is_supported({"x": 1})
    for bad in ({"question": [{"role": "user", "content": "a"}] * 2, "function": {}}, {"question": "q", "function": []}, {"question": [{"role": "system", "content": "a"}], "function": {}}):
        with pytest.raises(ValueError):
            benchmark.row_inputs(bad)
    rows = spark.createDataFrame([(json.dumps(row | {"id": str(i)}),) for i in range(6)], "value string")
    chosen = benchmark.select_cases(rows, per_category=3, categories=("simple_python",))
    assert chosen.count() == 3
    with pytest.raises(ValueError):
        benchmark.select_cases(rows, per_category=7, categories=("simple_python",))
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "case_id string, case_hash string")
    have = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "9"), ("z", "0")], "case_id string, case_hash string")
    assert {r.case_id: r.problem for r in benchmark.integrity(want, have).collect()} == {"a": "repeated", "b": "changed", "c": "missing", "z": "unexpected"}


def test_privacy(spark):
    text = "at /home/me/x.py with token: abc, hf_abcdefghij and 550e8400-e29b-41d4-a716-446655440000 in /work/p/a"
    want = "at <path> with <credential>, <credential> and <uuid> in <project>/a"
    assert privacy.scrub_text(text, "/work/p") == want
    assert spark.createDataFrame([(text,)], "t string").select(privacy.scrub(F.col("t"), "/work/p")).first()[0] == want
    assert json.loads(spark.createDataFrame([('{"API_KEY": 1, "a": [{"home_dir": "x"}, "/tmp/q"]}',)], "t string").select(privacy.redact_json("t")).first()[0]) == {"API_KEY": "[redacted]", "a": [{"home_dir": "[redacted]"}, "<path>"]}
    frame = spark.createDataFrame([("h", "e" * 300)], "row_hash string, error_category string")
    with pytest.raises(privacy.PrivacyError):
        privacy.check_upload(frame.withColumn("query", F.lit(1)))
    with pytest.raises(Exception, match="too long"):
        privacy.check_upload(frame).collect()
    assert privacy.forbidden_columns(["row_hash", "prompt_text", "Source_ID"]) == ["Source_ID", "prompt_text"]


def run_tree(root, name, **changes):
    path = root / name
    (path / "adapter").mkdir(parents=True)
    manifest = {"artifact_version": 2, "prompt_contract_version": 1, "kind": "evaluation", "status": "completed", "controlled": True, "git": {"commit": "c"}, "hashes": {"model": "m", "config": "c", "dataset": "d"}, "config": {"workflow": "base", "model": "q-4bit", "dataset_version": "v1"}} | changes
    (path / "manifest.json").write_text(json.dumps(manifest))
    (path / "status.json").write_text('{"status": "completed"}')
    (path / "resolved_config.yaml").write_text("a: 1\n")
    (path / "evaluation.json").write_text('{"count": 2, "task_success": 0.5}')
    (path / "predictions.jsonl").write_text('{"record": {"tools": []}, "prediction": "x", "source_id": "1"}\n\n{"record": {"query": "q"}, "prediction": "y", "source_id": "2"}\n')
    (path / "system_metrics.csv").write_text("timestamp,rss_gib,pressure_state\n1,2.5,normal\n2,,critical\n")
    return path


def test_run_tree(spark, tmp_path):
    run_tree(tmp_path, "good")
    run_tree(tmp_path, "final-1", controlled=False, controlled_run={"status": "controlled"})
    run_tree(tmp_path, "uncontrolled", controlled=False)
    (run_tree(tmp_path, "empty") / "system_metrics.csv").write_text("")
    (run_tree(tmp_path, "broken") / "predictions.jsonl").write_text('{"record": 1, "prediction": "x"}\n')
    (run_tree(tmp_path, "unreadable") / "manifest.json").write_text("{")
    table = readers.read_runs(spark, str(tmp_path))
    kinds = table.select("run", F.coalesce("manifest.kind", F.lit("evaluation")).alias("kind"))
    missing = runs.missing_parts(kinds, readers.read_run_listing(spark, str(tmp_path)), runs.requirements(spark))
    judged = table.join(missing, "run").withColumn("ok", runs.eligible(F.col("run"), F.col("manifest"), F.col("status"), F.col("missing")))
    assert {r.run: r.ok for r in judged.collect()} == {"good": True, "final-1": True, "uncontrolled": False, "empty": False, "broken": True, "unreadable": False}
    rows = runs.report_rows(judged.where("ok"))
    assert {r.run: (r.precision, r["count"]) for r in rows.collect()}["good"] == ("4bit", 2) and [r.run for r in runs.final_rows(rows).collect()] == ["final-1"]
    predictions = readers.read_predictions(spark, str(tmp_path))
    assert {r.run for r in predictions.collect()} == {"good", "final-1", "uncontrolled", "empty", "unreadable"}
    assert '"query":"[redacted]"' in predictions.where("run = 'good' and source_id = '1'").first().record
    audit = {r.run: r.row_count_match for r in runs.row_count_audit(rows, predictions).collect()}
    assert audit == {"good": True, "final-1": True, "broken": False}
    samples = readers.read_samples(spark, str(tmp_path)).where("run = 'good'")
    assert telemetry.summarize(samples, ["pos"], ("run",)).first().pressure_peak == "critical"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 1.0, "a": 2}, {"c": null}]')
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "m.json").write_text('{"splits": {"train": [{"id": 1}, {"id": 2}], "test": []}}')
    assert [r.value for r in readers.read_records(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ['{"a":2,"b":1.0}', '{"c":null}']
    assert readers.read_records(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert [(r.split, r.pos, json.loads(r.value)["id"]) for r in readers.read_manifest_splits(spark, str(tmp_path / "m.json")).collect()] == [("train", 0, 1), ("train", 1, 2)]
    frame = spark.createDataFrame([(2, "é", 1.5), (1, "z", 2.5)], "b int, a string, x double")
    writers.write_json_lines(frame, str(tmp_path / "out"), ["b"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"z","b":1,"x":2.5}', '{"a":"é","b":2,"x":1.5}']
    writers.write_csv(frame, str(tmp_path / "csv"), ["a", "missing"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["a", "missing"]
    assert writers.write_document(frame.limit(1), str(tmp_path / "d.json"))["a"] in ("é", "z")
    with pytest.raises(Exception, match="not finite"):
        writers.write_document(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "d.json"))
    lock = str(tmp_path / "lock.json")
    assert writers.write_lock(lock, {"a": 1}) == writers.write_lock(lock, {"a": 1}) == writers.read_lock(lock)
    with pytest.raises(writers.LockError):
        writers.write_lock(lock, {"a": 2})
    (tmp_path / "lock.json").write_text((tmp_path / "lock.json").read_text().replace("1", "3", 1))
    with pytest.raises(writers.LockError):
        writers.read_lock(lock)
    made = writers.dataset_descriptor("v", 42, {"train": 1}, {"train": "0" * 64})
    writers.check_descriptor(made)
    with pytest.raises(ValueError, match="content hash"):
        writers.check_descriptor(made | {"seed": 1})


def test_streaming_twin(spark, tmp_path):
    from callmetrics.streaming import telemetry as live

    rows = [("a", i, i in (1, 2, 3)) for i in range(5)] + [("b", i, i != 2) for i in range(4)]
    frame = spark.createDataFrame(rows, "run string, t int, low boolean")
    for k in range(2):
        frame.where(F.col("t") % 10 < 3 if k == 0 else F.col("t") >= 3).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = live.running_streaks(stream, F.col("low"), "run", "t").writeStream.outputMode("update").format("memory").queryName("streaks").start()
    query.processAllAvailable()
    query.stop()
    live_best = {r.run: r.n for r in spark.sql("select run, max(longest) n from streaks group by run").collect()}
    assert live_best == {r.run: r.longest for r in telemetry.streaks(frame, F.col("low"), ["t"], ("run",)).collect()} == {"a": 3, "b": 2}
