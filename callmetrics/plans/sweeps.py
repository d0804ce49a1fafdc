"""Queries on sweeps, probes, seeds, comparability, registries and audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions.jsontext import nfc_strip
from callmetrics.operators import normalize, runs, select, sweeps, telemetry
from callmetrics.session import table


def _key(name: str):
    return F.col(name).cast("string")


def sweep_overlay(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    some = lambda n, value: F.when(F.col("p_partkey") % n != 0, value)
    rows = part.select("p_partkey", some(3, F.col("p_size")).alias("batch_size"), some(4, F.col("p_size") % 5 + 1).alias("grad_accumulation_steps"), some(5, F.col("p_size") * 2).alias("effective_batch"), some(7, F.col("p_size") + 10).alias("updates"))
    return sweeps.overlay(rows, {"batch_size": 1, "grad_accumulation_steps": 8, "iters": 100}).drop("updates")


def probe_plan(spark, sf_dir):
    """One probe for each set of brand, type and rank."""
    part = table(spark, sf_dir, "part")
    key = sweeps.probe_key({"model": F.col("p_brand"), "precision": F.when(F.col("p_type") != "ECONOMY", F.col("p_type")), "rank": F.col("p_size") % 4, "probe_steps": F.lit(32)})
    return sweeps.distinct_probes(part.select("p_partkey", key.alias("probe")), "probe", "p_partkey")


def probe_reuse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    planned = orders.select(_key("o_orderkey").alias("run_id"), _key("o_custkey").alias("model_hash"), _key("o_orderkey").alias("fingerprint"))
    at = F.col("o_orderkey")
    existing = orders.where(at % 3 != 0).select(
        _key("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") != "P", "completed").alias("status"), F.when(at % 5 != 0, "safe").otherwise("unsafe").alias("safety"),
        F.when(at % 7 != 0, _key("o_custkey")).alias("model_hash"), F.when(at % 11 != 0, _key("o_orderkey")).otherwise("x").alias("fingerprint"),
    )
    return sweeps.probe_verdicts(planned, existing)


def sweep_conditions(spark, sf_dir):
    at = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select(
        at.alias("run_id"), F.when(at % 4 == 0, "size_endpoint").otherwise("headline").alias("study_role"), F.col("o_custkey").alias("updates"), (at % 3 + 1).alias("grad_accumulation_steps"),
        F.when(at % 13 != 0, F.col("o_custkey")).alias("done_updates"), F.when(at % 17 != 0, F.col("o_custkey") * (at % 3 + 1)).otherwise(0).alias("done_microbatches"),
        F.when(at % 20 != 0, 512).alias("prompt_tokens"), F.when(at % 24 == 0, 65).otherwise(64).alias("target_tokens"),
    )
    return sweeps.broken_conditions(made, "run_id")


def _studies(spark, sf_dir):
    at = F.col("c_custkey")
    role = F.when(at % 5 == 0, "lr_pilot").when(at % 5 == 1, "winner_seed").otherwise("headline")
    return table(spark, sf_dir, "customer").select(
        at.alias("run_id"), role.alias("study_role"), F.when(at % 3 == 0, "8bit").when(at % 3 == 1, "4bit").otherwise("bf16").alias("precision"), (F.col("c_nationkey") * 1.0).alias("learning_rate"), (at % 8).alias("rank"),
        F.round(F.col("c_acctbal"), 0).alias("task_success"), F.lit(0.5).alias("argument_value_f1"), F.lit(1.0).alias("schema_validity"), (at % 10 + 1.0).alias("rss_gib"), F.lit(3.0).alias("generation_throughput_tokens_per_second"), F.lpad(_key("c_custkey"), 12, "0").alias("fingerprint"),
    )


def seed_recipes(spark, sf_dir):
    rows = _studies(spark, sf_dir)
    made = sweeps.seed_recipes(rows.select("run_id", "study_role", "learning_rate", "rank"), rows, select.selection_key(), ("learning_rate", "rank"))
    return made.select("run_id", "learning_rate", "rank", "winner_source_run")


def best_rates(spark, sf_dir):
    rows = _studies(spark, sf_dir)
    pilots = rows.where("study_role = 'lr_pilot' and precision != 'bf16'")
    return select.with_best_rate(rows.select("run_id", "study_role", "precision", "learning_rate"), pilots).select("run_id", "learning_rate")


def final_candidates(spark, sf_dir):
    at = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    ok = select.is_final_candidate(F.when(at % 3 != 0, F.col("o_orderstatus") == "F"), F.when(at % 4 != 0, at % 5 != 0), F.when(at % 7 != 0, at % 2 == 0), F.when(at % 11 != 0, F.when(at % 13 == 0, "").otherwise("r")))
    return rows.where(ok).select("o_orderkey")


def base_tuned_checks(spark, sf_dir):
    at = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(at.alias("pos"), F.md5(_key("event_id").cast("binary")).alias("prompt_hash"), F.lit("greedy").alias("decoding"), F.when(at % 50 == 0, F.lit("a <THINK>b")).otherwise(F.col("event_type")).alias("prediction"))
    tuned = rows.where("pos % 31 != 0").withColumns({"prompt_hash": F.when(F.col("pos") % 37 != 0, F.col("prompt_hash")), "decoding": F.when(F.col("pos") % 41 == 0, "sampled").otherwise(F.col("decoding"))})
    return sweeps.incomparable(rows, tuned)


def registry_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    registry = spark.range(1, 20).select(F.concat(F.lit("Brand#"), _key("id")).alias("model"), _key("id").alias("pinned"))
    named = part.select("p_partkey", F.col("p_brand").alias("model"), F.when(F.col("p_partkey") % 3 != 0, F.when(F.col("p_partkey") % 3 == 1, F.substring("p_brand", 7, 2)).otherwise("other")).alias("revision"))
    return sweeps.registry_problems(named, registry).select("p_partkey", "problem")


def first_training_rows(spark, sf_dir):
    return sweeps.first_rows(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pos"), "l_linenumber", "l_partkey"), 100)


def audit_summary(spark, sf_dir):
    turns = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sweeps.audit_summary(turns, "l_orderkey", F.col("n"), "v2", 100)


def report_views(spark, sf_dir):
    """Rows of an axis, headline rows and final rows, told apart."""
    at = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.when(at % 9 == 0, F.lit("final-")).otherwise("run-"), _key("o_orderkey")).alias("run"), F.when(at % 4 == 0, "rank").otherwise("").alias("axis"), F.when(at % 6 == 0, "headline").otherwise("axis").alias("study_role"), F.when(at % 25 == 0, "final").otherwise("tuned").alias("workflow"))
    views = {"axis": runs.on_axis(rows, "rank"), "headline": runs.headline(rows), "final": runs.final_rows(rows)}
    made = [frame.select(F.lit(name).alias("view"), "run") for name, frame in views.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


def error_distribution(spark, sf_dir):
    """Types of events by user as error categories of runs, absent ones 0."""
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("task_errors"))
    return runs.error_distribution(maps, ("click", "error", "none"), run="user_id")


def winner_seed_summary(spark, sf_dir):
    """Suppliers as runs: every third is a seed of the winner and names its source."""
    at = F.col("s_suppkey")
    value = F.col("s_acctbal").cast("long")
    rows = table(spark, sf_dir, "supplier").select(
        F.format_string("run%06d", at).alias("run"), F.when(at % 3 == 0, "winner_seed").otherwise("headline").alias("study_role"), F.when(at % 6 == 0, F.format_string("run%06d", at + 1)).alias("winner_source_run"),
        F.lit("m").alias("model"), F.lit("v").alias("dataset_version"), (at % 2).alias("rank"), F.col("s_nationkey").alias("layers"), value.alias("task_success"), value.alias("argument_value_f1"), value.alias("schema_validity"),
    )
    return runs.winner_seeds(rows).select("rank", "layers", "n", "first_run", F.round("task_success_mean", 6).alias("mean"), F.round("task_success_std", 6).alias("std"))


def query_keys(spark, sf_dir):
    """Keys that tell queries apart, and names without outer blanks: upper case and blanks make no difference."""
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" \t"), F.upper("c_mktsegment"), F.lit(" x\n")).alias("q"))
    return named.select("c_custkey", normalize.query_key(F.col("q")).alias("key"), nfc_strip("q").alias("clean"))


def peak_values(spark, sf_dir):
    """The largest value of each user's samples, some of which are texts or missing."""
    at = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 7 == 0, "none").when(at % 3 == 0, "NaN").when(at % 5 != 0, F.col("value").cast("string")).alias("rss"))
    return telemetry.peak(rows, "rss", ("user_id",))


QUERIES = {f.__name__: f for f in (sweep_overlay, probe_plan, probe_reuse, sweep_conditions, seed_recipes, best_rates, final_candidates, base_tuned_checks, registry_lookup, first_training_rows, audit_summary, report_views, error_distribution, winner_seed_summary, query_keys, peak_values)}

_STUDIES = """WITH s AS (SELECT c_custkey AS run_id, CASE c_custkey % 5 WHEN 0 THEN 'lr_pilot' WHEN 1 THEN 'winner_seed' ELSE 'headline' END AS study_role,
  CASE c_custkey % 3 WHEN 0 THEN '8bit' WHEN 1 THEN '4bit' ELSE 'bf16' END AS precision, c_nationkey::DOUBLE AS learning_rate, c_custkey % 8 AS rank,
  row_number() OVER (ORDER BY round(c_acctbal, 0) DESC, c_custkey % 10, c_custkey DESC) AS place FROM customer)
"""
SQL = {
    "sweep_overlay": """SELECT p_partkey, b AS batch_size, a AS grad_accumulation_steps, b * a AS effective_batch, u * a AS iters, coalesce(e = b * a, true) AS fits
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 1 END AS b, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 5 + 1 ELSE 8 END AS a,
  CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2 END AS e, CASE WHEN p_partkey % 7 <> 0 THEN p_size + 10 ELSE 100 END AS u FROM part)""",
    "probe_plan": """SELECT sha256('{"model":"' || p_brand || '","precision":' || CASE WHEN p_type <> 'ECONOMY' THEN '"' || p_type || '"' ELSE 'null' END || ',"probe_steps":32,"rank":' || (p_size % 4) || '}') AS probe,
  min(p_partkey) AS p_partkey, count(*) AS runs FROM part GROUP BY 1""",
    "probe_reuse": """SELECT o_orderkey::VARCHAR AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'reuse' ELSE 'refuse' END AS verdict FROM orders""",
    "sweep_conditions": """WITH c AS (SELECT o_orderkey AS run_id, o_orderkey % 13 = 0 AS u, o_orderkey % 17 = 0 AND o_custkey <> 0 AS m,
  CASE WHEN o_orderkey % 20 <> 0 THEN CASE WHEN o_orderkey % 24 = 0 THEN 65 ELSE 64 END END AS seen, o_orderkey % 4 = 0 AS e FROM orders),
f AS (SELECT arg_min(seen, run_id) AS first FROM c WHERE e AND seen IS NOT NULL)
SELECT run_id, list_concat(CASE WHEN u THEN ['updates'] ELSE [] END, CASE WHEN m THEN ['microbatches'] ELSE [] END, CASE WHEN e AND (seen IS NULL OR seen <> first) THEN ['exposure'] ELSE [] END) AS failed
FROM c, f WHERE u OR m OR (e AND (seen IS NULL OR seen <> first))""",
    "seed_recipes": _STUDIES + """, w AS (SELECT run_id, learning_rate, rank FROM s WHERE study_role <> 'lr_pilot' ORDER BY place LIMIT 1)
SELECT s.run_id, CASE WHEN study_role = 'winner_seed' THEN w.learning_rate ELSE s.learning_rate END AS learning_rate, CASE WHEN study_role = 'winner_seed' THEN w.rank ELSE s.rank END AS rank,
  CASE WHEN study_role = 'winner_seed' THEN w.run_id END AS winner_source_run FROM s, w""",
    "best_rates": _STUDIES + """, b AS (SELECT precision, arg_min(learning_rate, place) AS rate FROM s WHERE study_role = 'lr_pilot' AND precision <> 'bf16' GROUP BY 1)
SELECT run_id, CASE WHEN study_role = 'lr_pilot' THEN learning_rate ELSE coalesce(b.rate, (SELECT rate FROM b WHERE precision = '4bit')) END AS learning_rate FROM s LEFT JOIN b USING (precision)""",
    "final_candidates": """SELECT o_orderkey FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderstatus = 'F') AND (o_orderkey % 4 = 0 OR o_orderkey % 5 <> 0) AND o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""",
    "base_tuned_checks": """SELECT 'count' AS "check", count(*) AS n FROM events WHERE event_id % 31 = 0
UNION ALL SELECT 'prompt_hash', count(*) FROM events WHERE event_id % 31 <> 0 AND event_id % 37 = 0
UNION ALL SELECT 'decoding', count(*) FROM events WHERE event_id % 31 <> 0 AND event_id % 41 = 0
UNION ALL SELECT 'thinking', count(*) FROM events WHERE event_id % 50 = 0""",
    "registry_lookup": """SELECT p_partkey, CASE WHEN substr(p_brand, 7)::INT NOT BETWEEN 1 AND 19 THEN 'unknown' WHEN p_partkey % 3 = 2 THEN 'revision' END AS problem FROM part""",
    "first_training_rows": "SELECT l_orderkey AS pos, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey < 100",
    "audit_summary": """WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, sha256('42:' || l_orderkey) AS k FROM t ORDER BY k LIMIT 100)
SELECT 'v2' AS version, CAST(1 AS INTEGER) AS audit_version, CAST(42 AS INTEGER) AS seed, (SELECT count(*) FROM r) AS sample_count, count(*) AS population_count,
  (SELECT sha256(string_agg(l_orderkey::VARCHAR, chr(10) ORDER BY k)) FROM r) AS sample_id_hash,
  count(*) FILTER (n <= 1) AS stratum_0, count(*) FILTER (n BETWEEN 2 AND 4) AS stratum_1, count(*) FILTER (n >= 5) AS stratum_2 FROM t""",
    "report_views": """WITH r AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'final-' ELSE 'run-' END || o_orderkey AS run, o_orderkey AS k FROM orders)
SELECT 'axis' AS "view", run FROM r WHERE k % 4 = 0 UNION ALL SELECT 'headline', run FROM r WHERE k % 6 = 0 UNION ALL SELECT 'final', run FROM r WHERE k % 9 = 0 OR k % 25 = 0""",
    "error_distribution": """SELECT u.user_id, t.term, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.term) AS n
FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('error'), ('none')) t(term)""",
    "winner_seed_summary": """WITH s AS (SELECT s_suppkey AS k, printf('run%06d', s_suppkey) AS run, s_suppkey % 2 AS rank, s_nationkey AS layers, trunc(s_acctbal) AS v FROM supplier)
SELECT rank, layers, count(*) AS n, min(run) AS first_run, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM s WHERE k % 3 = 0 OR k % 6 = 1 GROUP BY 1, 2 HAVING count(*) >= 3""",
    "query_keys": """SELECT c_custkey, 'query:' || lower(c_mktsegment) || ' x' AS key, upper(c_mktsegment) || ' x' AS clean FROM customer""",
    "peak_values": "SELECT user_id, coalesce(max(value) FILTER (user_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0), 0.0) AS peak_rss FROM events GROUP BY 1",
}
