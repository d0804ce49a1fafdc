"""Locks, manifests, run directories as a source, and journals on a stream."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.operators import runs, select
from callmetrics.sources import locks, readers, run_source, writers
from callmetrics.streaming import journal, telemetry


# -- locks ----------------------------------------------------------------------------------------------------------


def test_of_racing_writers_one_wins(tmp_path):
    path, won, lost = str(tmp_path / "final.lock.json"), [], []
    start = threading.Barrier(12)

    def write(i):
        start.wait()
        try:
            won.append(locks.write_lock(path, {"winner": i // 2}))
        except locks.LockError:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len({w["winner"] for w in won}) == 1 and len(won) == 2 and len(lost) == 10  # the winner's equal gets it too
    assert locks.read_lock(path) == won[0] and [p.name for p in tmp_path.iterdir()] == ["final.lock.json"]


def test_locks_elsewhere(spark, tmp_path):
    """A file system that only Hadoop's classes reach."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.locks.link./in", f"file://{tmp_path}")
    path = "viewfs://locks/in/a.lock.json"
    made = locks.write_lock(path, {"a": "é"}, spark)
    assert locks.write_lock(path, {"a": "é"}, spark) == made == locks.read_lock(path, spark)
    assert locks.read_lock(str(tmp_path / "a.lock.json")) == made
    with pytest.raises(locks.LockError, match="other content"):
        locks.write_lock(path, {"a": "f"}, spark)
    with pytest.raises(locks.LockError, match="not there"):
        locks.read_lock("viewfs://locks/in/b.lock.json", spark)
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(locks.LockError, match="no document"):
        locks.read_lock(str(tmp_path / "c.json"))
    with pytest.raises(locks.LockError, match="changed"):
        (tmp_path / "d.json").write_text(json.dumps(made | {"a": "x"}))
        locks.read_lock(str(tmp_path / "d.json"))


def test_final_selection(spark, tmp_path):
    schema = "run_id string, status string, controlled boolean, validation_only boolean, fingerprint string, task_success double, argument_value_f1 double, schema_validity double, rss_gib double, generation_throughput_tokens_per_second double, recipe string"
    rows = [
        ("a", "completed", True, None, "fa", 0.9, 0.5, 1.0, 8.0, 10.0, '{"lr": 1}'), ("b", "completed", True, True, "fb", 0.8, 0.9, 1.0, 4.0, 10.0, None),
        ("c", "completed", True, True, "fc", 0.7, 0.4, 1.0, 2.0, 10.0, None), ("d", "completed", None, True, "fd", 1.0, 1.0, 1.0, 1.0, 99.0, None),
        ("e", "failed", True, True, "fe", 1.0, 1.0, 1.0, 1.0, 99.0, None), ("f", "completed", True, False, "ff", 1.0, 1.0, 1.0, 1.0, 99.0, None),
        ("g", "completed", True, True, "fg", 0.1, 0.1, 1.0, 9.0, 1.0, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    made = locks.lock_final_selection(str(tmp_path / "l.json"), frame)
    assert (made["winner"], made["pareto_competitors"], made["candidates"]) == ("a", ["b", "c"], ["a", "b", "c"])
    assert made["candidate_recipes"]["a"]["recipe"] == {"lr": 1} and made["candidate_recipes"]["b"] == {"source_run": "b", "resolved_fingerprint": "fb", "recipe": {}, "hashes": {}, "validation_metrics": {}, "git_commit": None, "immutable": {}}
    assert locks.lock_final_selection(str(tmp_path / "l.json"), frame) == locks.read_lock(str(tmp_path / "l.json"))
    with pytest.raises(locks.LockError):
        locks.lock_final_selection(str(tmp_path / "l.json"), frame.where("run_id != 'a'"))
    with pytest.raises(ValueError):
        locks.final_selection(frame.where("run_id = 'e'"))


def test_latest_completed(spark):
    rows = [("r1", "evaluation", "base", "completed", "2026-01-01"), ("r2", "evaluation", "base", "completed", "2026-01-03"), ("r3", "evaluation", "base", "failed", "2026-01-09"), ("r4", "evaluation", "tuned", "completed", "2026-01-02"), ("r5", "evaluation", "tuned", "completed", "2026-01-02"), ("r6", "training", None, "completed", None)]
    frame = spark.createDataFrame(rows, "run string, kind string, workflow string, status string, started_at string")
    latest = lambda *a: {(r.kind, r.workflow): r.run for r in select.latest_completed(frame, ("kind", "workflow"), *a).collect()}
    assert latest() == {("evaluation", "base"): "r2", ("evaluation", "tuned"): "r5", ("training", None): "r6"}
    assert latest("2026-01-03") == {("evaluation", "base"): "r2"} and latest("2027") == {}


# -- manifests ------------------------------------------------------------------------------------------------------


def test_dataset_manifest(spark):
    splits = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "id string, split string")
    sources = [{"dataset": "d", "revision": "r", "kind": "hub"}, {"dataset": "c"}]
    made = writers.dataset_manifest(splits, "id", "v1", {"eligible_512": 2, "eligible_2048": 3}, sources, 1)
    writers.check_dataset_manifest(json.loads(json.dumps(made)))
    assert made["split_locks"]["train"]["count"] == 2 and made["sources"][0] == {"dataset": "c"}
    bad = {"dataset_manifest_version": 1, "token_tiers": {}, "eligibility_counts": {"eligible_512": 1}, "sources": [{"path": "x"}], "split_locks": {"a": {"count": 1, "id_hash": "x"}}, "prompt_contract_version": 0, "seed": 3}
    messages = {writers.manifest_problems(made | {k: v})[0] for k, v in bad.items()}
    assert len(messages) == len(bad)
    assert "version" in writers.manifest_problems({k: v for k, v in made.items() if k != "version"})[0]
    for wrong in ([{"dataset": "/abs"}], [{"other": "x"}]):
        with pytest.raises(ValueError):
            writers.dataset_manifest(splits, "id", "v1", {"eligible_512": 2, "eligible_2048": 3}, wrong, 1)


def test_merged_manifest_is_redacted():
    made = writers.merged_manifest({"hashes": {"a": "1"}}, {"note": "see /home/ann/x", "hashes": {"b": "2"}})
    assert "/home/ann" not in json.dumps(made) and made["hashes"] == {"a": "1", "b": "2"}


# -- run directories ------------------------------------------------------------------------------------------------


def test_run_source(spark, tmp_path):
    lines = lambda *rows: "\n".join(json.dumps(r) for r in rows) + "\n"
    trees = {
        "good": (lines({"record": {"b": 1.5, "a": None}, "prediction": "x", "source_id": "1"}) + "\n" + lines({"record": {"query": "q"}, "prediction": "y"}), '{"count": 2, "k": 1}', "timestamp,rss_gib,pressure_state,other\n1,2.5,normal,z\n2,inf,critical,z\n3,,,z\n"),
        "twice": ('{"record": {}, "prediction": "x", "record": {}}\n', '{"count": 1, "count": 2}', "timestamp\n1\n"),
        "half": (lines({"record": {}, "prediction": "x"}, {"record": [], "prediction": "x"}), '{"count": 5}', ""),
        "empty": ("", "[]", "rss_gib\n"),
    }
    for name, (predictions, evaluation, samples) in trees.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "predictions.jsonl").write_text(predictions)
        (tmp_path / name / "evaluation.json").write_text(evaluation)
        (tmp_path / name / "system_metrics.csv").write_text(samples)
    (tmp_path / "bare").mkdir()
    (tmp_path / "file").write_text("no run")
    run_source.register(spark)
    load = lambda **options: spark.read.format(run_source.NAME).options(**options).load(str(tmp_path))
    rows = load().orderBy("run", "pos").collect()
    assert [(r.run, r.pos, r.record, r.prediction, r.source_id) for r in rows] == [("good", 0, '{"a":null,"b":1.5,"query":"[redacted]"}', "x", "1"), ("good", 1, '{"query":"q"}', "y", None)]
    samples = load(table="samples").where("run = 'good'").orderBy("pos").collect()
    assert [(s.pos, s.rss_gib, s.pressure_state) for s in samples] == [(0, 2.5, "normal"), (1, None, "critical"), (2, None, None)]
    stored = load(table="documents", file="evaluation.json")
    assert {r.run: r.value for r in stored.collect()} == {"good": '{"count":2,"k":1}', "half": '{"count":5}'}
    # what runs say of themselves against what their predictions give
    said = stored.select("run", F.get_json_object("value", "$.count").cast("long").alias("count"))
    again = load().groupBy("run").agg(F.count(F.lit(1)).alias("count"))
    audit = runs.metric_audit(said.join(again.select("run"), "run", "left_semi"), again, "run", ())
    assert {r.run: r.matches for r in audit.collect()} == {"good": True}
    assert load().rdd.getNumPartitions() == len(trees) + 1
    with pytest.raises(Exception, match="no such table"):
        load(table="none").collect()


def test_positions_within_runs(spark, tmp_path):
    for run, n in (("a", 3_000), ("b", 5)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "predictions.jsonl").write_text("\n\n".join(json.dumps({"record": {"query": str(i)}, "prediction": str(i)}) for i in range(n)) + "\n")
        (tmp_path / run / "system_metrics.csv").write_text("timestamp,pressure_state\n" + "".join(f"{i},normal\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.read_predictions(spark, str(tmp_path)).collect()
        samples = readers.read_samples(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.run, r.pos) for r in rows) == [("a", i) for i in range(3_000)] + [("b", i) for i in range(5)]
    assert all(int(r.prediction) == r.pos for r in rows) and all(s.timestamp == s.pos for s in samples) and len(samples) == 3_005


def test_golden_prompt(spark):
    assert readers.golden_prompt(spark).startswith('<tools>\n[{"name":"fixture.echo"') and "Say hello." in readers.golden_prompt(spark)


# -- streams --------------------------------------------------------------------------------------------------------


def test_run_summaries_join():
    rng = random.Random(3)
    for _ in range(300):
        flags = [rng.random() < 0.7 for _ in range(rng.randrange(1, 20))]
        at = rng.randrange(len(flags) + 1)
        whole = telemetry.run_summary(np.array(flags, bool))
        parts = [telemetry.run_summary(np.array(p, bool)) for p in (flags[:at], flags[at:])]
        assert telemetry.joined_runs(*parts) == whole
        runs_ = "".join("x" if f else " " for f in flags)
        assert whole == (len(flags), len(runs_) - len(runs_.lstrip("x")), max(map(len, runs_.split())) if runs_.strip() else 0, len(runs_) - len(runs_.rstrip("x")))


ENTRY = "run string, seq long, at string, status string"


@pytest.fixture
def state_store(spark):
    for name, value in journal.SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name in journal.SETTINGS:
        spark.conf.unset(name)


def test_last_write_on_a_stream(spark, tmp_path, state_store):
    rng = random.Random(5)
    entries = [(f"r{rng.randrange(12)}", i, f"t{i % 7}", rng.choice(("completed", "failed"))) for i in range(60)]
    entries += [("quiet", 1, "t", "failed"), ("nulls", None, "t", "failed"), ("nulls", 2, None, "completed")]
    batches = [entries[i::4] for i in range(4)]
    rng.shuffle(batches)
    batches.append(batches[0])  # late and repeated
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ENTRY).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    table = f"{tmp_path}/table"

    def run(check, quiet=3_600_000):
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        made = journal.last_writes(stream, "run", ["seq", "at"], quiet)
        query = made.writeStream.foreachBatch(journal.upsert(table)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None and not query.isActive

    run(f"{tmp_path}/check")
    want = {tuple(r) for r in select.last_write(spark.createDataFrame(entries, ENTRY), "run", ["seq", "at"]).collect()}
    assert {tuple(r) for r in journal.current(spark, table, "run", ["seq", "at"]).collect()} == want
    run(f"{tmp_path}/check")  # nothing new
    run(f"{tmp_path}/again", quiet=1)  # from the beginning, into the same table, keys let go of at once
    assert {tuple(r) for r in journal.current(spark, table, "run", ["seq", "at"]).collect()} == want
    small = journal.compact(spark, table, f"{tmp_path}/small", "run", ["seq", "at"])
    assert {tuple(r) for r in spark.read.parquet(small).drop("batch").collect()} == want
    plan = spark.createDataFrame([(f"r{i}",) for i in range(15)] + [("quiet",)], "run string")
    left = {r.run for r in journal.still_to_do(plan, spark, table, "run", ["seq", "at"], lambda: F.col("status") == "completed").collect()}
    done = {w[0] for w in want if w[3] == "completed"}
    assert left == ({f"r{i}" for i in range(15)} | {"quiet"}) - done


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_last_write_by_time_over_many_batches(spark, tmp_path, state_store, kind):
    """Keys come again in later batches, so that rows are compared with what the state holds."""
    rng = random.Random(6)
    rows = [(f"r{i % 5}", f"2024-03-{1 + rng.randrange(28):02d} 02:30:00.{rng.randrange(10**6):06d}" if i % 9 else None, i) for i in range(40)]
    entries = spark.createDataFrame(rows, "run string, at string, seq int").withColumn("at", F.col("at").cast(kind))
    for i in range(4):
        entries.where(F.col("seq") % 4 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    made = journal.last_writes(stream, "run", ["at", "seq"])
    assert made.schema["at"].dataType == entries.schema["at"].dataType
    query = made.writeStream.foreachBatch(journal.upsert(f"{tmp_path}/table")).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and spark.read.parquet(f"{tmp_path}/table").select("batch").distinct().count() > 1
    want = {tuple(r) for r in select.last_write(entries, "run", ["at", "seq"]).collect()}
    assert {tuple(r) for r in journal.current(spark, f"{tmp_path}/table", "run", ["at", "seq"]).collect()} == want
