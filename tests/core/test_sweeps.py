import hashlib
import json

import pytest
from pyspark.sql import functions as F

from callmetrics.operators import select, sweeps, telemetry
from callmetrics.sources import readers, writers


def test_overlay_and_keys(spark):
    rows = spark.createDataFrame([(1, 2, 3, 6, 10), (2, None, None, None, None), (3, 2, 2, 5, 1)], "i int, batch_size int, grad_accumulation_steps int, effective_batch int, updates int")
    got = {r.i: (r.effective_batch, r.iters, r.fits) for r in sweeps.overlay(rows, {"batch_size": 1, "grad_accumulation_steps": 4, "iters": 7}).collect()}
    assert got == {1: (6, 30, True), 2: (4, 28, True), 3: (4, 2, False)}
    assert sweeps.overlay(rows.limit(0), {"batch_size": 1, "grad_accumulation_steps": 4, "iters": 7}).count() == 0
    key = sweeps.probe_key({"b": F.col("i"), "a": F.lit(None).cast("string")})
    assert rows.where("i = 1").select(key).first()[0] == hashlib.sha256(json.dumps({"a": None, "b": 1}, separators=(",", ":")).encode()).hexdigest()


def test_probes_and_conditions(spark):
    planned = spark.createDataFrame([("a", "m", "f"), ("b", "m", "f"), ("c", "m", "f"), ("d", "m", "f")], "run_id string, model_hash string, fingerprint string")
    old = spark.createDataFrame([("b", "completed", "safe", "m", "f"), ("c", "completed", "safe", "m", None), ("d", None, None, None, None)], "run_id string, status string, safety string, model_hash string, fingerprint string")
    assert {r.run_id: r.verdict for r in sweeps.probe_verdicts(planned, old).collect()} == {"a": "new", "b": "reuse", "c": "refuse", "d": "refuse"}
    schema = "run_id string, study_role string, updates int, grad_accumulation_steps int, done_updates int, done_microbatches int, prompt_tokens int, target_tokens int"
    runs = spark.createDataFrame([
        ("a", "size_endpoint", 2, 3, 2, 6, None, 1), ("b", "size_endpoint", 2, 3, 2, 6, 5, 5), ("c", "size_endpoint", 2, 3, 2, 6, 5, 6),
        ("d", None, 2, 3, None, 5, None, None), ("e", "size_endpoint", 2, 3, 2, 6, 5, 5),
    ], schema)
    assert {r.run_id: r.failed for r in sweeps.broken_conditions(runs, "run_id").collect()} == {"a": ["exposure"], "c": ["exposure"], "d": ["updates", "microbatches"]}


def test_seed_recipes_without_a_winner(spark):
    schema = "run_id string, study_role string, rank int, score double"
    rows = spark.createDataFrame([("a", "winner_seed", 1, 0.0), ("b", "headline", 2, 0.5), ("c", None, 3, 0.9), ("p", "lr_pilot", 4, 1.0)], schema)
    key = [F.col("score"), F.col("run_id")]
    got = {r.run_id: (r.rank, r.winner_source_run) for r in sweeps.seed_recipes(rows, rows, key, ("rank",)).collect()}
    assert got == {"a": (3, "c"), "b": (2, None), "c": (3, None), "p": (4, None)}
    got = {r.run_id: (r.rank, r.winner_source_run) for r in sweeps.seed_recipes(rows, rows.limit(0), key, ("rank",)).collect()}
    assert got["a"] == (1, None) and len(got) == 4
    assert select.best(rows.limit(0), key).count() == 0 or select.best(rows.limit(0), key).first()[0] is None


def test_incomparable_registry_and_audit(spark):
    schema = "pos int, prompt_hash string, decoding string, prediction string"
    base = spark.createDataFrame([(0, "h", "g", "x"), (1, None, "g", "<Think>"), (2, "h", "g", None)], schema)
    same = {r.check: r.n for r in sweeps.incomparable(base, base).collect()}
    assert same == {"count": 0, "prompt_hash": 0, "decoding": 0, "thinking": 1}
    tuned = spark.createDataFrame([(0, "h", "t", "x"), (1, "h", "g", ""), (3, "h", "g", "")], schema)
    assert {r.check: r.n for r in sweeps.incomparable(base, tuned).collect()} == {"count": 2, "prompt_hash": 1, "decoding": 1, "thinking": 1}
    assert {r.check: r.n for r in sweeps.incomparable(base.limit(0), base.limit(0)).collect()} == dict.fromkeys(same, 0)
    registry = spark.createDataFrame([("m", "1")], "model string, pinned string")
    runs = spark.createDataFrame([(0, "m", None), (1, "m", "1"), (2, "m", "2"), (3, None, "1")], "i int, model string, revision string")
    assert {r.i: r.problem for r in sweeps.registry_problems(runs, registry).collect()} == {0: None, 1: None, 2: "revision", 3: "unknown"}
    rows = spark.createDataFrame([(f"r{i}", i % 6) for i in range(30)], "id string, n int")
    made = sweeps.audit_summary(rows, "id", F.col("n"), "v", samples=4).first()
    first = sorted((f"r{i}" for i in range(30)), key=lambda r: hashlib.sha256(f"42:{r}".encode()).hexdigest())[:4]
    assert (made.sample_count, made.population_count, made.sample_id_hash) == (4, 30, hashlib.sha256("\n".join(first).encode()).hexdigest())
    assert (made.stratum_0, made.stratum_1, made.stratum_2) == (10, 15, 5)
    assert sweeps.audit_summary(rows.limit(0), "id", F.col("n"), "v").first().population_count == 0
    with pytest.raises(ValueError):
        sweeps.audit_summary(rows, "id", F.col("n"), "v", samples=-1)
    samples = spark.createDataFrame([("a", "1.5"), ("a", "NaN"), ("a", "12"), ("b", None)], "run string, rss string")
    assert {r.run: r.peak_rss for r in telemetry.peak(samples, "rss", ("run",)).collect()} == {"a": 12.0, "b": 0.0}


def test_sections_manifests_and_space(tmp_path):
    made = readers.experiment_sections({"model": "m", "seed": 1, "mask_prompt": False, "rendering": {"max_seq_length": 9}, "axis": "a"})
    assert made == {"model": "m", "axis": "a", "training": {"seed": 1, "mask_prompt": False}, "rendering": {"max_seq_length": 9, "mask_prompt": False}, "model_info": {"name": "m"}}
    assert readers.experiment_sections({"training": {"seed": 2}}) == {"training": {"seed": 2}}
    assert writers.merged_manifest({"hashes": {"a": 1}, "status": "x"}, {"hashes": {"b": 2}, "status": {"s": 1}, "counts": {"n": 3}, "bytes": 4}) == {"hashes": {"a": 1, "b": 2}, "status": {"s": 1}, "counts": {"n": 3}, "bytes": 4}
    writers.require_space(str(tmp_path), floor_gib=0.0)
    with pytest.raises(OSError):
        writers.require_space(str(tmp_path), floor_gib=1e9)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "vocab.json").write_text("{}")
    (tmp_path / "tokenizer.json").write_text("[]")
    (tmp_path / "other").write_text("no")
    got = readers.tokenizer_hashes(str(tmp_path), "t", [1, 2])
    assert got["tokenizer_files"] == hashlib.sha256(b"sub/vocab.json{}tokenizer.json[]").hexdigest() and got["golden_tokens"] == hashlib.sha256(b"[1, 2]").hexdigest()
    with pytest.raises(FileNotFoundError):
        readers.tokenizer_hashes(str(tmp_path / "none"), "t", [])
