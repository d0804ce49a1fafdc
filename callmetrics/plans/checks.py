"""Queries on positions, overlaps, locks, journals, exports and labels over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.operators import benchmark, privacy, score, select, splits, stats
from callmetrics.session import table


def _two_keys(name: str, c):
    text = c.cast("string")
    return F.array(F.substring(F.md5(F.concat(F.lit(f"{name}p"), text).cast("binary")), 1, 3), F.substring(F.md5(F.concat(F.lit(f"{name}f"), text).cast("binary")), 1, 3))


def ood_overlap(spark, sf_dir):
    """Test customers (keys divisible by 7) that share a key with any other."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return splits.sharing(rows.where("c_custkey % 7 = 0"), rows.where("c_custkey % 7 != 0"), "c_custkey", _two_keys("", F.col("c_custkey")))


def positional_join(spark, sf_dir):
    """Orders beside each other by their position in two orders that agree."""
    orders = table(spark, sf_dir, "orders")
    place = lambda name: stats.numbered(orders.select(F.col("o_orderkey").alias(name)), name).withColumnRenamed("row", "pos")
    return score.by_position(place("o_orderkey"), place("other"))


def split_locks(spark, sf_dir):
    """Splits of suppliers by key against a list hash that fits for one split, and against two nested versions."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    split = F.when(F.col("s_suppkey") % 10 == 0, "validation").when(F.col("s_suppkey") % 10 == 1, "test").otherwise("train")
    made = rows.select("s_suppkey", split.alias("split"))
    stored = splits.list_hash(made, "s_suppkey", "s_suppkey", ("split",)).select("split", F.when(F.col("split") == "test", F.lit("changed")).otherwise(F.col("content_hash")).alias("want"))
    smaller = made.where("s_suppkey % 4 != 2")
    return splits.lock_checks(made, "s_suppkey", stored, {"same": made, "smaller": smaller})


def journal_runs(spark, sf_dir):
    """Orders as journal entries; customers as manifests, priorities as statuses, line items as files."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    run = F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run_id")
    journal = orders.select(run, F.when(F.col("o_orderkey") % 3 == 0, "test").alias("split"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("r")).alias("resolved_fingerprint"), F.col("o_orderpriority").alias("fingerprint"))
    manifests = orders.where("o_orderkey % 5 != 0").select(run, (F.col("o_orderkey") % 4 == 0).alias("controlled"), (F.col("o_orderkey") % 3).alias("artifact_version"), F.col("o_orderstatus").alias("git_commit"), F.when(F.col("o_orderkey") % 7 != 0, "c").alias("config_hash"))
    statuses = orders.select(run, F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    of = F.concat(F.lit("run"), F.col("l_orderkey").cast("string")).alias("run_id")
    name = F.when(F.col("l_linenumber") == 1, "adapter/adapters.safetensors").otherwise("resolved_config.yaml")
    files = items.where("l_linenumber <= 2").groupBy(of, name.alias("name")).agg(F.max(F.col("l_partkey").cast("string")).alias("sha256"), F.max("l_suppkey").alias("bytes"))
    return select.with_run_files(journal, manifests, statuses, files)


def latest_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u"), "user_id")).otherwise(F.concat(F.lit("u"), "user_id", F.lit("-attempt-"), (F.col("event_id") % 13).cast("string")))
    return select.latest_run(events.select(name.alias("name")), "name", F.regexp_replace("name", r"-attempt-\d+$", ""))


def latest_completed(spark, sf_dir):
    """Orders as runs by priority and status of their customer's segment: the last completed one of a year on."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    runs = orders.select(F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 3).alias("workflow"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"))
    return select.latest_completed(runs, ("kind", "workflow"), "1995-01-01")


def exact_set_problems(spark, sf_dir):
    """Parts as selected cases; results lack some, repeat some, change some and add some."""
    parts = table(spark, sf_dir, "part")
    chosen = parts.where("p_partkey % 11 != 0").select(F.col("p_partkey").alias("case_id"), F.md5(F.col("p_name").cast("binary")).alias("case_hash"))
    given = parts.where("p_partkey % 7 != 0").select(F.col("p_partkey").alias("case_id"), F.md5(F.when(F.col("p_partkey") % 5 == 0, F.lit("x")).otherwise(F.col("p_name")).cast("binary")).alias("case_hash"))
    return benchmark.integrity(chosen, given.unionByName(given.where("case_id % 13 = 0")))


def export_lines(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("prediction"), F.col("event_type").alias("result"), F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("tokens"), F.lit("run").alias("run_id"))
    return benchmark.export_rows(rows)


def project_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "/work/project/data/").when(F.col("doc_id") % 3 == 1, "/work/projects/").otherwise("note "), F.col("doc_id").cast("string"))
    return docs.select("doc_id", privacy.scrub_value(path, "/work/project").alias("label"))


def allowed_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "click", "task_success").when(F.col("event_type") == "view", "count").otherwise(F.col("event_type"))
    value = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("user_id").cast("string"))
    return privacy.metric_rows(events.select("event_id", name.alias("metric"), value.alias("value")))


QUERIES = {f.__name__: f for f in (ood_overlap, positional_join, split_locks, journal_runs, latest_runs, latest_completed, exact_set_problems, export_lines, project_labels, allowed_metrics)}
SQL = {
    "ood_overlap": "WITH k AS (SELECT c_custkey, substr(md5('p' || c_custkey::VARCHAR), 1, 3) AS key FROM customer UNION ALL SELECT c_custkey, substr(md5('f' || c_custkey::VARCHAR), 1, 3) FROM customer) SELECT DISTINCT c_custkey FROM k WHERE c_custkey % 7 = 0 AND key IN (SELECT key FROM k WHERE c_custkey % 7 <> 0)",
    "positional_join": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_orderkey AS other FROM orders",
    "split_locks": """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM supplier),
h AS (SELECT split, sha256(string_agg(s_suppkey::VARCHAR, chr(10) ORDER BY s_suppkey)) AS hash FROM s GROUP BY 1)
SELECT 'hash:' || split AS "check", split <> 'test' AS ok, hash AS detail FROM h
UNION ALL SELECT * FROM (VALUES ('nested_locks:same', true, '0'), ('nested_train:same', true, '0')) v(a, b, c)
UNION ALL SELECT 'nested_locks:smaller', count(*) = 0, count(*)::VARCHAR FROM s WHERE split <> 'train' AND s_suppkey % 4 = 2
UNION ALL SELECT 'nested_train:smaller', count(*) = 0, count(*)::VARCHAR FROM s WHERE split = 'train' AND s_suppkey % 4 = 2""",
    "journal_runs": """WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS k, max(l_partkey::VARCHAR) AS sha, max(l_suppkey) AS bytes FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
fixed AS (SELECT a.l_orderkey, a.sha, a.bytes, b.sha AS resolved FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.k = 1 AND b.k = 2)
SELECT 'run' || o_orderkey AS run_id, o_orderpriority AS fingerprint, o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0 AND o_orderkey % 3 = 2 AS controlled,
  o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS validation_only, CASE WHEN o_orderkey % 2 = 0 THEN 'r' ELSE o_orderpriority END AS resolved_fingerprint,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS git_commit, sha AS adapter_sha256, bytes AS adapter_bytes, resolved AS resolved_config_sha256,
  CASE WHEN sha IS NOT NULL THEN CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'c' ELSE '' END END AS config_sha256
FROM orders LEFT JOIN fixed ON l_orderkey = o_orderkey""",
    "latest_runs": "WITH n AS (SELECT 'u' || user_id AS base, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 13 END AS attempt, CASE WHEN event_id % 4 = 0 THEN 'u' || user_id ELSE 'u' || user_id || '-attempt-' || (event_id % 13) END AS name FROM events) SELECT base, arg_max(name, (attempt, name)) AS run FROM n GROUP BY 1",
    "latest_completed": "SELECT o_orderpriority AS kind, o_custkey % 3 AS workflow, arg_max('run' || o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), 'run' || o_orderkey)) AS run FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' GROUP BY 1, 2",
    "exact_set_problems": """WITH c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 11 <> 0), g AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(c.id, g.id) AS case_id, CASE WHEN g.id IS NULL THEN 'missing' WHEN c.id IS NULL THEN 'unexpected' WHEN g.id % 13 = 0 THEN 'repeated' ELSE 'changed' END AS problem
FROM c FULL JOIN g ON c.id = g.id WHERE g.id IS NULL OR c.id IS NULL OR g.id % 13 = 0 OR g.id % 5 = 0""",
    "export_lines": """SELECT event_id AS pos, '{"id":"' || CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id ELSE event_id::VARCHAR END || '","result":"' || event_type || '"' || CASE WHEN event_id % 5 = 0 THEN ',"tokens":' || user_id ELSE '' END || '}' AS value FROM events""",
    "project_labels": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data/' || doc_id WHEN 1 THEN 'external:' || substr(sha256('/work/projects/' || doc_id), 1, 16) ELSE 'note ' || doc_id END AS label FROM documents",
    "allowed_metrics": "SELECT event_id, CASE event_type WHEN 'click' THEN 'task_success' ELSE 'count' END AS metric, user_id::DOUBLE AS value FROM events WHERE event_type IN ('click', 'view') AND event_id % 5 <> 0 AND event_id % 7 <> 0",
}
