"""Queries on splits, statistics, selection, telemetry, runs and privacy over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.operators import privacy, resample, runs, score, select, splits, stats, telemetry
from callmetrics.operators.storage import cut
from callmetrics.plans.calls import scored
from callmetrics.session import table

# -- splits ---------------------------------------------------------------------------------------------------------


def _doc_keys():
    head = F.md5(F.substring_index(F.col("text"), "\n", 1).cast("binary"))
    return splits.duplicate_keys(F.md5(F.trim("text").cast("binary")), head)


def dup_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return splits.components(docs, "doc_id", _doc_keys())


def ood_components(spark, sf_dir):
    """Components over schema keys: two bucketed keys per customer."""
    rows = table(spark, sf_dir, "customer")
    keys = splits.schema_keys(F.array(F.substring(F.md5(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).cast("binary")), 1, 3)), F.array(F.substring(F.md5(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).cast("binary")), 1, 3)))
    return splits.components(rows, "c_custkey", keys)


def _members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(splits.components(docs, "doc_id", _doc_keys()), "doc_id")


def hash_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return splits.audit_queue(rows, "doc_id", 100).select("doc_id", "rank", "rank_key")


def group_rank(spark, sf_dir):
    return splits.group_ranks(_members(spark, sf_dir), "doc_id").select("component", "size", "rank_key")


def topk_per_category(spark, sf_dir):
    return splits.top_per_group(table(spark, sf_dir, "events"), "event_type", "event_id", 20).select("event_type", "event_id", "rank")


def greedy_first_fit(spark, sf_dir):
    ranked = splits.group_ranks(_members(spark, sf_dir), "doc_id")
    return splits.first_fit(ranked, 150).select("component")


def sequential_splits(spark, sf_dir):
    ranked = splits.group_ranks(_members(spark, sf_dir), "doc_id")
    return splits.sequential(ranked, {"test": 60, "validation": 40}).select("component", "split")


def strata_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return score.zero_filled(turns.select(splits.stratum(F.col("n")).alias("stratum")), "stratum", splits.STRATA).select("stratum", "n")


def largest_remainder_quotas(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    counts = turns.groupBy(splits.stratum(F.col("n")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return splits.quotas(counts, 37)


def locked_anti_join(spark, sf_dir):
    """Documents outside the components of locked ones (ids divisible by 9)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return splits.without_locked_components(docs, docs.where("doc_id % 9 = 0"), "doc_id", _doc_keys()).select("doc_id")


def schema_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    keys = F.array(F.concat_ws(":", "source", "lang"), F.concat(F.lit("b"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2)))
    return splits.without_shared_keys(docs, docs.where("doc_id % 50 = 3"), "doc_id", keys).select("doc_id")


def ood_split(spark, sf_dir):
    """The suppliers that first fit takes, 20 or as many as whole components give."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    keys = F.array(F.substring(F.md5(F.col("s_suppkey").cast("string").cast("binary")), 1, 2))
    return splits.schema_ood_test(rows, rows.where("s_suppkey % 10 = 0"), "s_suppkey", keys, 20, strict=False).select("s_suppkey")


def component_leakage(spark, sf_dir):
    """Components that a split by id digest tears apart."""
    made = _members(spark, sf_dir).withColumn("split", F.when(F.substring(splits.row_rank_key(F.col("doc_id")), 1, 1) < "8", "train").otherwise("test"))
    return splits.leaking(made)


def content_hash(spark, sf_dir):
    return splits.list_hash(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", ("o_orderpriority",))


def list_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    left = rows.select(F.col("o_orderkey").alias("at"), F.col("o_custkey").alias("v"))
    right = rows.where("o_orderkey % 97 != 0").select(F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 41 == 0, -1).otherwise(F.col("o_custkey")).alias("v"))
    return splits.same_lists(left, right, "v", "at")


# -- statistics -----------------------------------------------------------------------------------------------------

_DRAWS = 200


def bootstrap_quality_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("v"))
    made = stats.interval(stats.draws(rows, "doc_id", _DRAWS, {"m": stats.weighted_mean("v")}), "m")
    return made.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def _triples(spark, sf_dir):
    return scored(spark, sf_dir).select("pos", "value_matches", "n_predicted", "n_gold")


def micro_f1_bootstrap(spark, sf_dir):
    made = stats.interval(stats.draws(_triples(spark, sf_dir), "pos", _DRAWS, {"f": stats.weighted_f1("value_matches", "n_predicted", "n_gold")}), "f")
    return made.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def paired_delta(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    both = stats.paired(labels.select("doc_id", F.col("toxic").alias("v")), labels.select("doc_id", F.col("quality").alias("v")), "doc_id", ("v",))
    rows = both.withColumn("d", (F.col("tuned_v") - F.col("base_v")).cast("double"))
    made = stats.interval(stats.draws(rows, "doc_id", _DRAWS, {"m": stats.weighted_mean("d")}), "m")
    return made.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def paired_f1_delta(spark, sf_dir):
    rows = cut(_triples(spark, sf_dir))  # scored once for both sides
    base = rows.withColumn("value_matches", F.when(F.col("pos") % 5 == 0, 0).otherwise(F.col("value_matches")))
    both = stats.paired(base, rows, "pos", ("value_matches", "n_predicted", "n_gold"))
    delta = stats.weighted_f1("tuned_value_matches", "tuned_n_predicted", "tuned_n_gold") - stats.weighted_f1("base_value_matches", "base_n_predicted", "base_n_gold")
    made = stats.interval(stats.draws(both, "pos", _DRAWS, {"d": delta}), "d")
    return made.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def poisson_mean_ci(spark, sf_dir):
    return _rounded(stats.mean_interval(table(spark, sf_dir, "labels"), "doc_id", "quality", _DRAWS))


def poisson_f1_ci(spark, sf_dir):
    return _rounded(stats.f1_interval(_triples(spark, sf_dir), "pos", ("value_matches", "n_predicted", "n_gold"), _DRAWS))


def poisson_paired_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    sides = (rows.select("p_partkey", F.col(c).alias("v")) for c in ("p_size", "p_retailprice"))
    return _rounded(stats.paired_mean_interval(*sides, "p_partkey", "v", _DRAWS))


def poisson_paired_f1(spark, sf_dir):
    rows = _triples(spark, sf_dir)
    base = rows.withColumn("value_matches", F.when(F.col("pos") % 5 == 0, 0).otherwise(F.col("value_matches")))
    return _rounded(stats.paired_f1_interval(base, rows, "pos", ("value_matches", "n_predicted", "n_gold"), _DRAWS))


def _rounded(made):
    return made.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def percentiles_floor_rank(spark, sf_dir):
    return stats.percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ("event_type",))


def throughput_quartiles(spark, sf_dir):
    made = stats.end_quartiles(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ("event_type",))
    return made.select("event_type", F.round("first_quartile", 6).alias("first_quartile"), F.round("last_quartile", 6).alias("last_quartile"))


def throughput_rates(spark, sf_dir):
    made = stats.rates(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ("l_returnflag",))
    return made.select("l_returnflag", F.round("ratio_of_sums", 6).alias("ratio_of_sums"), F.round("mean_of_ratios", 6).alias("mean_of_ratios"))


def seed_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("recipe"), "o_totalprice")
    made = stats.seed_summary(rows, ("recipe",), "o_totalprice")
    return made.select("recipe", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


def training_exposure(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    size = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    return runs.exposure(rows, F.when(F.col("role") != "assistant", size), F.when(F.col("role") == "assistant", size))


# -- telemetry ------------------------------------------------------------------------------------------------------


def first_peak_last(spark, sf_dir):
    return telemetry.first_peak_last(table(spark, sf_dir, "events"), ["value"], ["ts", "event_id"], ("user_id",))


def streak_events(spark, sf_dir):
    return telemetry.streaks(table(spark, sf_dir, "events"), F.col("value") < 50, ["ts", "event_id"], ("event_type",))


def _samples(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "user_id", "ts", "event_id", (F.col("value") / 40).alias("memory_available_gib"), (F.col("value") / 60).alias("swap_used_gib"), (F.col("value") + 20).alias("disk_free_gib"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "warning").otherwise("normal").alias("pressure_state"), (F.col("value") / 10).alias("rss_gib"),
    )


def probe_safety(spark, sf_dir):
    made = telemetry.probe_safety(_samples(spark, sf_dir), ["ts", "event_id"], ("user_id",))
    return made.select("user_id", "sample_count", "available_memory", "critical_pressure", "swap_growth", "nonfinite", "aborted_or_killed", "projected_disk", "status")


def system_summary(spark, sf_dir):
    made = telemetry.summarize(_samples(spark, sf_dir), ["ts", "event_id"], ("user_id",))
    return made.select("user_id", "samples", "rss_gib_before", "rss_gib_peak", "rss_gib_after", "pressure_before", "pressure_peak", "pressure_after")


# -- selection ------------------------------------------------------------------------------------------------------


def best_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return select.best(rows, [F.floor(F.col("c_acctbal") / 1000), -F.col("c_nationkey"), F.col("c_name")], ("c_mktsegment",)).select("c_mktsegment", "c_custkey")


def skyline_parts(spark, sf_dir):
    return select.skyline(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], ["p_retailprice"]).select("p_partkey")


def skyline_missing(spark, sf_dir):
    """The variant whose missing qualities count as 0, on orders and their sizes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("q"), F.col("o_totalprice").alias("c"))
    return select.skyline(rows, "o_orderkey", ["q"], ["c"], missing="zero").select("o_orderkey")


def winner_and_rivals(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    key = [F.col("p_size").cast("double"), -F.col("p_retailprice"), F.col("p_partkey")]
    return select.winner_and_rivals(rows, key, select.skyline(rows, "p_partkey", ["p_size"], ["p_retailprice"]), "p_partkey").select("p_partkey", "place")


def sweep_cross(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("a"))
    priority = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("b")).distinct()
    flag = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("c")).distinct()
    rows = select.cross_axes(spark, {"a": region, "b": priority, "c": flag}, ["a", "b", "c"])
    return rows.select("run_index", "a", "b", "c", F.sha2(F.concat_ws("|", "a", "b", "c").cast("binary"), 256).alias("fingerprint"))


def last_write_wins(spark, sf_dir):
    return select.last_write(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def resume_antijoin(spark, sf_dir):
    plan = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return select.to_resume(plan, table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase")


def attempt_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("-attempt-"), (F.col("o_orderkey") % 9).cast("string")))).alias("name"))
    return select.next_attempt(rows, "name", F.regexp_replace("name", r"-attempt-\d+$", ""))


def paired_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("tuned").alias("workflow"), "o_orderkey")
    made = select.joined_pairs(rows, ["o_custkey", "o_orderpriority"], "workflow", "o_orderkey")
    return made.select("o_custkey", "o_orderpriority", F.col("base.o_orderkey").alias("base_run"), F.col("tuned.o_orderkey").alias("tuned_run"))


def drift_check(spark, sf_dir):
    lock = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    source = lock.where("s_suppkey % 11 != 0").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.lit("x")).otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(99)).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return select.drift(source, lock, "s_suppkey", ["s_name", "s_nationkey"]).select("s_suppkey", F.array_join("failed", ",").alias("failed"))


# -- runs and reports -----------------------------------------------------------------------------------------------


def zero_filled_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return score.zero_filled(rows, "event_type", ("signup", "error", "click", "view", "purchase", "never"), ("user_id",)).select("user_id", "event_type", "n")


def heatmap_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("v"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    return runs.heatmap(rows, "l_returnflag", "l_linestatus", "v", ["F", "O", "X"], "o").fillna(-1.0)


def completeness_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    wanted = spark.createDataFrame([(k, n) for k in ("0", "1") for n in ("view", "click", "purchase")[: 2 + int(k)]], "kind string, name string")
    people = rows.select(F.col("user_id").alias("run"), (F.col("user_id") % 2).cast("string").alias("kind")).distinct()
    made = runs.missing_parts(people, rows.select(F.col("user_id").alias("run"), F.col("event_type").alias("name"), F.floor("value").alias("bytes")), wanted)
    return made.select(F.col("run").alias("user_id"), F.array_join("missing", ",").alias("missing"))


def metric_audit(spark, sf_dir):
    """Stored order totals, some off by a little, against totals computed again."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("count"), F.sum("l_quantity").alias("q"))
    stored = rows.select("l_orderkey", F.when(F.col("l_orderkey") % 10 == 0, F.col("count") + 1).otherwise(F.col("count")).alias("count"), F.when(F.col("l_orderkey") % 7 == 0, F.col("q") + 1e-6).when(F.col("l_orderkey") % 11 != 0, F.col("q")).alias("q"))
    return runs.metric_audit(stored, rows, "l_orderkey", ("q",))


def row_count_audit(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 20).cast("long").alias("count"))
    return runs.row_count_audit(stored, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"))).select("run", F.coalesce("prediction_rows", F.lit(-1)).alias("prediction_rows"), "evaluation_count", "row_count_match")


def repaired_examples(spark, sf_dir):
    made = cut(scored(spark, sf_dir).select("pos", "task_success"))  # scored once for both sides
    return runs.repaired_examples(made.withColumn("task_success", F.col("task_success") & (F.col("pos") % 3 == 0)), made, "pos").select("pos")


def precision_names(spark, sf_dir):
    from callmetrics.operators.render import precision_of

    model = F.concat(F.col("p_name"), F.element_at(F.array(F.lit("-bf16"), F.lit("-8bit"), F.lit("-4bit"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").groupBy(precision_of(model).alias("precision")).agg(F.count(F.lit(1)).alias("n"))


def grouping_sets_flow(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    made = rows.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


# -- privacy --------------------------------------------------------------------------------------------------------


def sanitize_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    secret = F.concat(F.col("text"), F.lit(" see /home/ann/x.txt or token=abc123, Bearer abcdefgh12 550e8400-e29b-41d4-a716-446655440000 "), F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.md5(privacy.scrub(secret).cast("binary")).alias("scrubbed"))


def row_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return privacy.check_upload(rows.select(privacy.row_hash(F.lit("run-1"), F.col("o_orderkey")).alias("row_hash"), F.col("o_orderstatus").alias("error_category")))


def sanitized_rows(spark, sf_dir):
    made = scored(spark, sf_dir).withColumn("prompt_tokens", F.size(F.split("tools", " "))).withColumn("candidate_count", F.lit(2))
    return privacy.check_upload(privacy.sanitized_rows(made, F.lit("run-1"), "pos", "prompt_tokens", "candidate_count", F.col("schema_valid"), F.col("task_success"), F.col("task_error")))


def stratified_split(spark, sf_dir):
    """Validation and test over components and strata."""
    members = _members(spark, sf_dir).withColumn("stratum", splits.stratum(F.col("doc_id") % 7))
    done = splits.stratified(members.select("doc_id", "component", "stratum"), "doc_id", {"validation": 40, "test": 60})
    return members.join(done, "component").select("doc_id", "component", "split")


def split_checks(spark, sf_dir):
    made = stratified_split(spark, sf_dir)
    return splits.checks(made, "doc_id", {"validation": 40, "test": 60})


_KEYED = """keys AS (
  SELECT doc_id, 'query:' || md5(trim(text)) AS key FROM documents UNION SELECT doc_id, 'task:' || md5(string_split(text, chr(10))[1]) FROM documents
)"""
_REACH = """edges AS (SELECT DISTINCT a.{id} AS x, b.m AS y FROM keys a JOIN (SELECT key, min({id}) AS m FROM keys GROUP BY key) b USING (key)),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x AS {id}, min(y) AS component FROM reach GROUP BY x)"""
_DOC_COMP = f"{_KEYED}, {_REACH.format(id='doc_id')}"
_RANKED = "ranked AS (SELECT component, count(*) AS size, sha256('42:' || string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS rank_key FROM comp GROUP BY component)"
_FOLD = """queue AS (SELECT component, size, row_number() OVER (ORDER BY rank_key, component) AS at FROM ranked),
fold AS (SELECT 0::BIGINT AS at, 0::BIGINT AS total, NULL::BIGINT AS component, false AS taken
  UNION ALL SELECT q.at, CASE WHEN f.total + q.size <= {target} THEN f.total + q.size ELSE f.total END, q.component, f.total + q.size <= {target} FROM fold f JOIN queue q ON q.at = f.at + 1)"""
_QUOTAS = """quotas AS (SELECT split, stratum, base + CASE WHEN place <= target - sum(base) OVER (PARTITION BY split) THEN 1 ELSE 0 END AS quota FROM (
  SELECT *, floor(exact) AS base, row_number() OVER (PARTITION BY split ORDER BY exact - floor(exact) DESC, stratum) AS place FROM (
  SELECT split, target, stratum, target * n / sum(n) OVER (PARTITION BY split) AS exact FROM counts, (VALUES ('validation', 40), ('test', 60)) t(split, target))))"""
_STRATIFIED = f"""{_DOC_COMP}, {_RANKED},
members AS (SELECT doc_id, component, CASE WHEN doc_id % 7 <= 1 THEN '1' WHEN doc_id % 7 <= 4 THEN '2-4' ELSE '>=5' END AS stratum FROM comp),
counts AS (SELECT stratum, count(*) AS n FROM members GROUP BY 1), {_QUOTAS},
need AS (SELECT component, count(*) FILTER (WHERE stratum = '1') AS a, count(*) FILTER (WHERE stratum = '2-4') AS b, count(*) FILTER (WHERE stratum = '>=5') AS c FROM members GROUP BY 1),
queue AS (SELECT component, a, b, c, row_number() OVER (ORDER BY rank_key, component) AS pos FROM ranked JOIN need USING (component)),
fold AS (
  SELECT CAST(0 AS BIGINT) AS pos, {', '.join(f"(SELECT CAST(coalesce(max(quota), 0) AS BIGINT) FROM quotas WHERE split = '{name}' AND stratum = '{s}') AS {name[0]}{x}" for name in ("test", "validation") for s, x in (("1", "a"), ("2-4", "b"), (">=5", "c")))},
    CAST(NULL AS BIGINT) AS component, CAST(NULL AS VARCHAR) AS split
  UNION ALL
  SELECT pos, ta - (split = 'test')::INT * a, tb - (split = 'test')::INT * b, tc - (split = 'test')::INT * c,
    va - (split = 'validation')::INT * a, vb - (split = 'validation')::INT * b, vc - (split = 'validation')::INT * c, component, nullif(split, '')
  FROM (SELECT q.*, ta, tb, tc, va, vb, vc, CASE
    WHEN a <= ta AND b <= tb AND c <= tc AND (ta + tb + tc <= va + vb + vc OR NOT (a <= va AND b <= vb AND c <= vc)) THEN 'test'
    WHEN a <= va AND b <= vb AND c <= vc THEN 'validation' ELSE '' END AS split FROM fold f JOIN queue q ON q.pos = f.pos + 1))"""
_INDEX = "('0x' || substr(md5('42:' || d || ':' || s), 1, 8))::BIGINT % (SELECT count(*) FROM series)"


def _boot(series: str, statistic: str) -> str:
    return f"""WITH {series}, picks AS (SELECT d, {_INDEX} AS row FROM range({_DRAWS}) a(d), range((SELECT count(*) FROM series)) b(s)),
draws AS (SELECT d, {statistic} AS m FROM picks JOIN series USING (row) GROUP BY d), held AS (SELECT list(m ORDER BY m) AS v FROM draws)
SELECT round(v[1 + CAST(floor((1.0::DOUBLE - 0.95::DOUBLE) / 2 * len(v)) AS BIGINT)], 9) AS low,
  round(v[1 + least(len(v) - 1, CAST(floor((1.0::DOUBLE - (1.0::DOUBLE - 0.95::DOUBLE) / 2) * len(v)) AS BIGINT))], 9) AS high FROM held"""


def _poisson(series: str, statistic: str) -> str:
    """The same weights in SQL: ``series`` has ``id`` and values, ``statistic`` reads their weighted sums."""
    factors = [f"{x}::UBIGINT" for x in (resample.DRAW_STEP, resample.FIRST_FACTOR, resample.SECOND_FACTOR)]
    step = lambda name, of, body: f"{name} AS (SELECT * REPLACE ({body} AS x) FROM {of})"
    mixed = lambda a, of: [step(f"{a}1", of, "xor(x, x >> 16)"), step(f"{a}2", f"{a}1", f"x * {factors[1]} % 4294967296"), step(f"{a}3", f"{a}2", "xor(x, x >> 13)"), step(f"{a}4", f"{a}3", f"x * {factors[2]} % 4294967296"), step(f"{a}5", f"{a}4", "xor(x, x >> 16)")]
    times = " + ".join(f"(x >= {b})::INT" for b in resample.poisson_bounds())
    steps = [
        f"hashed AS (SELECT s.*, d, ('0x' || substr(md5('42:' || id), 1, 8))::UBIGINT AS h1, ('0x' || substr(md5('42:' || id), 9, 8))::UBIGINT AS h2 FROM series s, range({_DRAWS}) a(d))",
        f"began AS (SELECT *, xor(h1, d::UBIGINT * {factors[0]} % 4294967296) AS x FROM hashed)", *mixed("m", "began"), step("again", "m5", "xor(x, h2)"), *mixed("n", "again"),
        f"weighed AS (SELECT *, {times} AS w FROM n5)", f"draws AS (SELECT d, {statistic} AS m FROM weighed GROUP BY d)", "held AS (SELECT list(m ORDER BY m) AS v FROM draws WHERE m IS NOT NULL)",
    ]
    return f"""WITH {series}, {", ".join(steps)}
SELECT round(v[1 + CAST(floor((1.0::DOUBLE - 0.95::DOUBLE) / 2 * len(v)) AS BIGINT)], 9) AS low,
  round(v[1 + least(len(v) - 1, CAST(floor((1.0::DOUBLE - (1.0::DOUBLE - 0.95::DOUBLE) / 2) * len(v)) AS BIGINT))], 9) AS high FROM held"""


def _f1(m: str, p: str = "n_predicted", g: str = "n_gold") -> str:
    return f"CASE WHEN sum({p}) = 0 AND sum({g}) = 0 THEN 1.0 WHEN sum({m}) = 0 THEN 0.0 ELSE 2 * (sum({m}) / sum({p})) * (sum({m}) / sum({g})) / (sum({m}) / sum({p}) + sum({m}) / sum({g})) END"


def _triple_series() -> str:
    from callmetrics.plans.calls import _PARSED

    return f"{_PARSED}, series AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS row, pos, value_matches, n_predicted, n_gold FROM s)"


_STREAK = """numbered AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) - row_number() OVER (PARTITION BY {by}, f ORDER BY ts, event_id) AS island FROM flagged),
islands AS (SELECT {by}, f, island, count(*) AS n FROM numbered GROUP BY ALL)"""
_SAMPLES = """samples AS (SELECT user_id, ts, event_id, value / 40 AS mem, value / 60 AS swap, value + 20 AS disk, value / 10 AS rss,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'warning' ELSE 'normal' END AS pressure FROM events)"""


def _three(flag: str) -> str:
    return f"coalesce(min(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) = 1 AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3"


QUERIES = {
    f.__name__: f
    for f in (
        dup_components, ood_components, hash_rank, group_rank, topk_per_category, greedy_first_fit, sequential_splits, strata_counts, largest_remainder_quotas, locked_anti_join, schema_anti_join, ood_split,
        component_leakage, content_hash, list_differences, bootstrap_quality_ci, micro_f1_bootstrap, paired_delta, paired_f1_delta, poisson_mean_ci, poisson_f1_ci, poisson_paired_mean, poisson_paired_f1, percentiles_floor_rank, throughput_quartiles, throughput_rates,
        seed_summary, training_exposure, first_peak_last, streak_events, probe_safety, system_summary, best_by_group, skyline_parts, skyline_missing, winner_and_rivals, sweep_cross, last_write_wins,
        resume_antijoin, attempt_numbers, paired_runs, drift_check, zero_filled_errors, heatmap_pivot, completeness_check, metric_audit, row_count_audit, repaired_examples, precision_names,
        grouping_sets_flow, sanitize_text, row_hash, sanitized_rows, stratified_split, split_checks,
    )
}
_SCRUBBED = "text || ' see /home/ann/x.txt or token=abc123, Bearer abcdefgh12 550e8400-e29b-41d4-a716-446655440000 ' || doc_id::VARCHAR"
for _pattern, _label in privacy.SCRUB:
    _SCRUBBED = "regexp_replace({}, '{}', '{}', 'g')".format(_SCRUBBED, _pattern.replace("'", "''"), _label)


def _sql() -> dict[str, str]:
    from callmetrics.plans.calls import _PARSED

    return {
        "dup_components": f"WITH RECURSIVE {_DOC_COMP} SELECT doc_id, component FROM comp",
        "ood_components": f"WITH RECURSIVE keys AS (SELECT c_custkey, 'p' || substr(md5('p' || c_custkey::VARCHAR), 1, 3) AS key FROM customer UNION ALL SELECT c_custkey, 'f' || substr(md5('f' || c_custkey::VARCHAR), 1, 3) FROM customer), {_REACH.format(id='c_custkey')} SELECT c_custkey, component FROM comp",
        "hash_rank": "SELECT doc_id, rank, rank_key FROM (SELECT doc_id, sha256('42:' || doc_id::VARCHAR) AS rank_key, row_number() OVER (ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= 100",
        "group_rank": f"WITH RECURSIVE {_DOC_COMP}, {_RANKED} SELECT component, size, rank_key FROM ranked",
        "topk_per_category": "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('42:' || event_id::VARCHAR), event_id) AS rank FROM events) WHERE rank <= 20",
        "greedy_first_fit": f"WITH RECURSIVE {_DOC_COMP}, {_RANKED}, {_FOLD.format(target=150)} SELECT component FROM fold WHERE taken",
        "sequential_splits": f"WITH RECURSIVE {_DOC_COMP}, {_RANKED}, {_FOLD.format(target=60)}, spare AS (SELECT * FROM ranked WHERE component NOT IN (SELECT component FROM fold WHERE taken)), {_FOLD.format(target=40).replace('FROM ranked', 'FROM spare').replace('queue', 'queue2').replace('fold ', 'fold2 ')} SELECT component, 'test' AS split FROM fold WHERE taken UNION ALL SELECT component, 'validation' FROM fold2 WHERE taken",
        "stratified_split": f"WITH RECURSIVE {_STRATIFIED} SELECT doc_id, component, split FROM fold JOIN members USING (component) WHERE split IS NOT NULL",
        "split_checks": f"""WITH RECURSIVE {_STRATIFIED}, made AS (SELECT doc_id, component, split FROM fold JOIN members USING (component) WHERE split IS NOT NULL)
SELECT 'size:' || w.split AS "check", count(m.doc_id) = w.want AS ok, count(m.doc_id) || '/' || w.want AS detail FROM (VALUES ('validation', 40), ('test', 60)) w(split, want) LEFT JOIN made m ON m.split = w.split GROUP BY w.split, w.want
UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT doc_id), (count(*) - count(DISTINCT doc_id))::VARCHAR FROM made
UNION ALL SELECT 'component_leakage', count(*) = 0, count(*)::VARCHAR FROM (SELECT component FROM made GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
        "strata_counts": "WITH t AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id), s AS (SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '>=5' END AS stratum FROM t) SELECT v.stratum, count(s.stratum) AS n FROM (VALUES ('1'), ('2-4'), ('>=5')) v(stratum) LEFT JOIN s USING (stratum) GROUP BY v.stratum",
        "largest_remainder_quotas": """WITH t AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id), c AS (SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '>=5' END AS stratum, count(*) AS n FROM t GROUP BY 1),
e AS (SELECT *, 37 * n / sum(n) OVER () AS exact FROM c), b AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS place FROM e)
SELECT stratum, n, CAST(base + CASE WHEN place <= 37 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b""",
        "locked_anti_join": f"WITH RECURSIVE {_DOC_COMP} SELECT doc_id FROM comp WHERE component NOT IN (SELECT component FROM comp WHERE doc_id % 9 = 0)",
        "schema_anti_join": "WITH k AS (SELECT doc_id, source || ':' || lang AS key FROM documents UNION ALL SELECT doc_id, 'b' || substr(md5(doc_id::VARCHAR), 1, 2) FROM documents) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE key IN (SELECT key FROM k WHERE doc_id % 50 = 3))",
        "ood_split": """WITH RECURSIVE k AS (SELECT s_suppkey, substr(md5(s_suppkey::VARCHAR), 1, 2) AS key FROM supplier), free AS (SELECT * FROM k WHERE key NOT IN (SELECT key FROM k WHERE s_suppkey % 10 = 0)),
ranked AS (SELECT min(s_suppkey) AS component, count(*) AS size, sha256('42:' || string_agg(s_suppkey::VARCHAR, chr(10) ORDER BY s_suppkey::VARCHAR)) AS rank_key, key FROM free GROUP BY key), """
        + _FOLD.format(target=20)
        + " SELECT s_suppkey FROM free WHERE key IN (SELECT key FROM ranked WHERE component IN (SELECT component FROM fold WHERE taken))",
        "component_leakage": f"WITH RECURSIVE {_DOC_COMP} SELECT component FROM comp GROUP BY component HAVING count(DISTINCT substr(sha256('42:' || doc_id::VARCHAR), 1, 1) < '8') > 1",
        "content_hash": "SELECT o_orderpriority, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS content_hash, count(*) AS n FROM orders GROUP BY 1",
        "list_differences": "WITH l AS (SELECT o_orderkey AS at_, o_custkey AS v FROM orders), r AS (SELECT o_orderkey AS at_, CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 97 <> 0) SELECT at_ AS \"at\", l.v AS \"left\", r.v AS \"right\" FROM l FULL JOIN r USING (at_) WHERE l.v IS DISTINCT FROM r.v",
        "bootstrap_quality_ci": _boot("series AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, quality AS v FROM labels)", "avg(v)"),
        "micro_f1_bootstrap": _boot(_triple_series(), _f1("value_matches")),
        "paired_delta": _boot("series AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, quality - toxic AS v FROM labels)", "avg(v)"),
        "paired_f1_delta": _boot(_triple_series(), f"({_f1('value_matches')}) - ({_f1('CASE WHEN pos % 5 = 0 THEN 0 ELSE value_matches END')})"),
        "poisson_mean_ci": _poisson("series AS (SELECT doc_id::VARCHAR AS id, quality AS v FROM labels)", "sum(w * v) / nullif(sum(w), 0)"),
        "poisson_f1_ci": _poisson(f"{_PARSED}, series AS (SELECT pos::VARCHAR AS id, value_matches, n_predicted, n_gold FROM s)", _f1("w * value_matches", "w * n_predicted", "w * n_gold")),
        "poisson_paired_mean": _poisson("series AS (SELECT p_partkey::VARCHAR AS id, p_retailprice - p_size AS v FROM part)", "sum(w * v) / nullif(sum(w), 0)"),
        "poisson_paired_f1": _poisson(f"{_PARSED}, series AS (SELECT pos::VARCHAR AS id, pos, value_matches, n_predicted, n_gold FROM s)", f"({_f1('w * value_matches', 'w * n_predicted', 'w * n_gold')}) - ({_f1('w * CASE WHEN pos % 5 = 0 THEN 0 ELSE value_matches END', 'w * n_predicted', 'w * n_gold')})"),
        "percentiles_floor_rank": "WITH h AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[1 + CAST(floor(0.5::DOUBLE * (len(v) - 1)) AS BIGINT)] AS p50, v[1 + CAST(floor(0.95::DOUBLE * (len(v) - 1)) AS BIGINT)] AS p95, v[1 + CAST(floor(0.99::DOUBLE * (len(v) - 1)) AS BIGINT)] AS p99 FROM h",
        "throughput_quartiles": "WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, round(avg(value) FILTER (WHERE i <= greatest(1, c // 4)), 6) AS first_quartile, round(avg(value) FILTER (WHERE i > c - greatest(1, c // 4)), 6) AS last_quartile FROM n GROUP BY 1",
        "throughput_rates": "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio_of_sums, round(avg(CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END), 6) AS mean_of_ratios FROM lineitem GROUP BY 1",
        "seed_summary": "SELECT o_orderkey // 3 AS recipe, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 3",
        "training_exposure": "SELECT CAST(sum(len(string_split(coalesce(text, ''), ' '))) FILTER (WHERE role <> 'assistant') AS BIGINT) AS prompt_tokens, CAST(sum(len(string_split(coalesce(text, ''), ' '))) FILTER (WHERE role = 'assistant') AS BIGINT) AS target_tokens FROM conversations",
        "first_peak_last": "SELECT user_id, arg_min(value, (ts, event_id)) AS value_before, max(value) AS value_peak, arg_max(value, (ts, event_id)) AS value_after FROM events GROUP BY 1",
        "streak_events": f"WITH flagged AS (SELECT *, value < 50 AS f FROM events), {_STREAK.format(by='event_type')} SELECT event_type, coalesce(max(n) FILTER (WHERE f), 0) AS longest, coalesce(max(n) FILTER (WHERE f), 0) >= 3 AS has_streak FROM islands GROUP BY 1",
        "probe_safety": f"""WITH {_SAMPLES}, w AS (SELECT *, {_three('mem < 1')} AS m3, {_three("pressure = 'critical'")} AS p3 FROM samples),
a AS (SELECT user_id, count(*) AS sample_count, bool_or(m3) AS available_memory, bool_or(p3) AS critical_pressure, max(swap) - min(swap) > 2 AS swap_growth, bool_or(isnan(mem) OR isinf(mem)) AS nonfinite, min(disk) < 30 AS projected_disk FROM w GROUP BY 1)
SELECT *, false AS aborted_or_killed, CASE WHEN available_memory OR critical_pressure OR swap_growth OR nonfinite OR projected_disk THEN 'infeasible' ELSE 'safe' END AS status FROM a""",
        "system_summary": f"""WITH {_SAMPLES} SELECT user_id, count(*) AS samples, arg_min(rss, (ts, event_id)) AS rss_gib_before, max(rss) AS rss_gib_peak, arg_max(rss, (ts, event_id)) AS rss_gib_after,
  arg_min(pressure, (ts, event_id)) AS pressure_before, ['unknown', 'normal', 'warning', 'critical'][max(list_position(['unknown', 'normal', 'warning', 'critical'], pressure))] AS pressure_peak, arg_max(pressure, (ts, event_id)) AS pressure_after FROM samples GROUP BY 1""",
        "best_by_group": "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY floor(c_acctbal / 1000) DESC, c_nationkey, c_name DESC) AS r FROM customer) WHERE r = 1",
        "skyline_parts": "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))",
        "skyline_missing": "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey ELSE 0 END AS q, o_totalprice AS c FROM orders) SELECT o_orderkey FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c))",
        "winner_and_rivals": "WITH f AS (SELECT * FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))), w AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice, p_partkey DESC LIMIT 1) SELECT p_partkey, 0 AS place FROM w UNION ALL SELECT p_partkey, place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey DESC) AS place FROM f WHERE p_partkey NOT IN (SELECT p_partkey FROM w)) WHERE place <= 2",
        "sweep_cross": "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS run_index, a, b, c, sha256(a || '|' || b || '|' || c) AS fingerprint FROM (SELECT r_name AS a FROM region), (SELECT DISTINCT o_orderpriority AS b FROM orders), (SELECT DISTINCT l_returnflag AS c FROM lineitem)",
        "last_write_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
        "resume_antijoin": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)",
        "attempt_numbers": r"WITH n AS (SELECT 'run-' || (o_custkey % 50)::VARCHAR AS base, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 9 END AS a FROM orders) SELECT base, CAST(coalesce(max(a), 0) + 1 AS INTEGER) AS attempt FROM n GROUP BY 1",
        "paired_runs": "SELECT o_custkey, o_orderpriority, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS base_run, max(o_orderkey) FILTER (WHERE o_orderkey % 2 <> 0) AS tuned_run FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey % 2) = 2",
        "drift_check": "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 's_name,s_nationkey' ELSE concat_ws(',', CASE WHEN s_suppkey % 7 = 0 THEN 's_name' END, CASE WHEN s_suppkey % 5 = 0 THEN 's_nationkey' END) END AS failed FROM supplier",
        "zero_filled_errors": "WITH r AS (SELECT user_id, event_type FROM events) SELECT u.user_id, t.event_type, count(r.event_type) AS n FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase'), ('never')) t(event_type) LEFT JOIN r ON r.user_id = u.user_id AND r.event_type = t.event_type GROUP BY 1, 2",
        "heatmap_pivot": "WITH r AS (SELECT * FROM lineitem) SELECT l_returnflag, coalesce(arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) FILTER (WHERE l_linestatus = 'F'), -1) AS \"l_linestatus_F\", coalesce(arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) FILTER (WHERE l_linestatus = 'O'), -1) AS \"l_linestatus_O\", -1.0::DOUBLE AS \"l_linestatus_X\" FROM r GROUP BY 1",
        "completeness_check": "WITH w AS (SELECT * FROM (VALUES (0, 'view'), (0, 'click'), (1, 'view'), (1, 'click'), (1, 'purchase')) t(kind, name)), p AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, string_agg(name, ',' ORDER BY name) AS missing FROM p JOIN w ON w.kind = user_id % 2 WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = name AND floor(e.value) > 0) GROUP BY 1) SELECT user_id, coalesce(missing, '') AS missing FROM p LEFT JOIN g USING (user_id)",
        "metric_audit": "SELECT l_orderkey, l_orderkey % 10 <> 0 AND l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0 AS matches FROM lineitem GROUP BY 1",
        "row_count_audit": "SELECT c_custkey AS run, coalesce(n, -1) AS prediction_rows, c_custkey % 20 AS evaluation_count, coalesce(n = c_custkey % 20, false) AS row_count_match FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
        "repaired_examples": f"WITH {_PARSED} SELECT pos FROM s WHERE task_success AND pos % 3 <> 0 ORDER BY pos LIMIT 5",
        "precision_names": "SELECT ['bf16', '8bit', '4bit', ''][1 + p_partkey % 4] AS precision, count(*) AS n FROM part GROUP BY 1",
        "grouping_sets_flow": "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
        "sanitize_text": f"SELECT doc_id, md5({_SCRUBBED}) AS scrubbed FROM documents",
        "row_hash": "SELECT substr(sha256('run-1:' || o_orderkey::VARCHAR), 1, 24) AS row_hash, o_orderstatus AS error_category FROM orders",
        "sanitized_rows": f"WITH {_PARSED} SELECT substr(sha256('run-1:' || pos::VARCHAR), 1, 24) AS row_hash, len(string_split(tools, ' ')) AS prompt_tokens, 2 AS candidate_count, schema_valid AS parsed, task_success, task_error AS error_category FROM s",
    }


SQL = _sql()
