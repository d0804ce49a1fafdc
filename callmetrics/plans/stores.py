"""Queries on sources and sinks, benchmark rows, nested versions, manifests, reports and streams over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callmetrics.operators import benchmark, normalize, privacy, render, robustness, runs, select, splits
from callmetrics.operators.storage import shared_dir
from callmetrics.plans.calls import RECORDS, predictions
from callmetrics.plans.study import _DOC_COMP, _FOLD, _doc_keys
from callmetrics.session import table, views
from callmetrics.sources import locks, readers, writers
from callmetrics.streaming import journal as live_journal
from callmetrics.streaming import telemetry as live


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- files ----------------------------------------------------------------------------------------------------------


def json_lines_round_trip(spark, sf_dir):
    """Customers as canonical JSON lines, read back as records."""
    path = _fresh(spark, "customers") + ".jsonl"
    writers.write_json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    back = readers.read_records(spark, path)
    return back.select(F.get_json_object("value", "$.c_custkey").cast("long").alias("c_custkey"), F.md5(F.col("value").cast("binary")).alias("line"))


def csv_round_trip(spark, sf_dir):
    """Suppliers under fixed fields, one of which they don't have."""
    path = _fresh(spark, "suppliers")
    writers.write_csv(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "missing", "s_name"])
    back = spark.read.option("header", "true").csv(path)
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.coalesce("missing", F.lit("")).alias("missing"), "s_name")


def telemetry_append(spark, sf_dir):
    """Events appended in two goes and read back."""
    path, events = _fresh(spark, "samples"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 != 0")):
        writers.append_samples(part, path)
    return spark.read.schema(events.schema).json(path)


def manifest_splits(spark, sf_dir):
    """Suppliers as the splits of one manifest, read back row by row."""
    path = _fresh(spark, "manifest")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("row"))
    of = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.col("row")))), lambda r: r)
    held = rows.agg(of(F.col("s_suppkey") % 5 == 0).alias("test"), of(F.col("s_suppkey") % 5 != 0).alias("train"))
    held.select(F.to_json(F.struct(F.struct("test", "train").alias("splits"))).alias("value")).write.text(path)
    return readers.read_manifest_splits(spark, path)


def file_digests(spark, sf_dir):
    """Digests of files, one of the customers of each segment."""
    path = _fresh(spark, "segments")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat_ws("|", "c_custkey", "c_name").alias("value"))
    rows.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path)
    segment = F.regexp_extract("path", r"c_mktsegment=([^/]+)/", 1)
    return readers.file_hashes(spark, path).select(segment.alias("segment"), "sha256", "bytes")


# -- records --------------------------------------------------------------------------------------------------------


def record_fingerprints(spark, sf_dir):
    """Of accepted records the fingerprints of their schemas and the digest of their normalised task."""
    views(spark, sf_dir, "events")
    made = normalize.normalize(spark.sql(RECORDS)).where("reason is null")
    return made.select("pos", F.array_join("candidate_fingerprints", ",").alias("fingerprints"), render.digest(F.col("normalized_task")).alias("task"))


_LENGTHS = """SELECT event_id AS pos, '{"id": "e' || CAST(event_id AS STRING) || '", "query": "q", "rendered_length": ' || CASE event_id % 3 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN 'null' ELSE CAST(user_id * 10 AS STRING) END
  || ', "tools": [{"name": "f", "parameters": {"type": "object", "properties": {}}}], "answers": [{"name": "f", "arguments": {}}]}' AS value FROM events"""


def length_gate(spark, sf_dir):
    """Records whose rendered length is over a limit are rejected; an unknown length is not."""
    views(spark, sf_dir, "events")
    made = normalize.normalize(spark.sql(_LENGTHS), most_length=500)
    return made.select("pos", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(F.col("rendered_length").cast("long"), F.lit(-1)).alias("length"))


def prompt_contracts(spark, sf_dir):
    legacy = F.element_at(F.array(*map(F.lit, render.LEGACY_RUNS)), (F.col("event_id") % 4 + 1).cast("int"))
    run = F.when(F.col("event_type") == "click", legacy).otherwise(F.concat(F.lit("run-"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", render.prompt_contract(run).alias("c")).select("event_id", "c.*")


def prefix_tokens(spark, sf_dir):
    """Whether the words of a conversation's turn begin with those of the turn before."""
    turns = table(spark, sf_dir, "conversations")
    words = F.split("text", " ")
    before = F.slice(words, 1, F.pmod(F.col("turn"), F.lit(3)).cast("int") + 1)
    damaged = F.when(F.col("turn") % 4 == 1, F.concat(before, F.array(F.lit("#")))).otherwise(before)
    return turns.select("conv_id", "turn", render.prefix_holds(words, damaged).alias("holds"))


def redacted_props(spark, sf_dir):
    text = F.concat(F.lit('{"api_key": "'), F.col("event_type"), F.lit('", "n": '), F.col("user_id").cast("string"), F.lit(', "where": ["/home/ann/'), F.col("event_id").cast("string"), F.lit('"]}'))
    broken = F.when(F.col("event_id") % 6 == 0, F.concat(text, F.lit("}"))).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(privacy.redact_json(broken), F.lit("")).alias("props"))


def prompt_hash_list(spark, sf_dir):
    """The digest of each kind's prompt digests, in the order of their ids."""
    tools = F.concat(F.lit('[{"name":"'), F.col("event_type"), F.lit('"}]'))
    prompts = table(spark, sf_dir, "events").select("event_type", "event_id", render.digest(render.prompt(tools, F.col("user_id").cast("string"))).alias("hash"))
    return splits.list_hash(prompts, "hash", "event_id", ("event_type",))


# -- benchmark ------------------------------------------------------------------------------------------------------

_TOOLS = '"function": [{"name": "f", "parameters": {"properties": {"a": {"type": "integer"}}, "type": "dict"}}]'
_TURN = '"question": [[{"content": "q \' || CAST(event_id AS STRING) || \'", "role": "user"}]]'
#: (what stands before the id, what stands after it, refusal): forms of benchmark rows.
BENCHMARK_FORMS = (
    (f'"category": "simple_python", {_TOOLS}', _TURN, ""),
    (f'"category": "irrelevance", {_TOOLS}', '"query": "plain"', ""),
    (f'"category": "simple_python", {_TOOLS}', '"question": [{"content": "a", "role": "user"}, {"content": "b", "role": "user"}]', "question must contain exactly one user turn"),
    (f'"category": "simple_python", {_TOOLS}', '"question": [[{"content": " ", "role": "user"}]]', "user turn content must be a non-empty string"),
    ('"category": "simple_python", "function": []', _TURN, "row must contain a non-empty function list"),
    ('"category": "irrelevance", "function": [{"parameters": {"properties": {}, "type": "object"}}]', '"query": "q"', "function descriptor must contain a name"),
    ('"category": "irrelevance", "function": [{"name": "f", "parameters": 1}]', '"query": "q"', "function descriptor must contain an object schema"),
    (f'"category": "other", {_TOOLS}', '"question": [{"content": "a", "role": "system"}]', "question must contain exactly one user turn"),
)
_BENCHMARK = " ".join(f"WHEN {i} THEN '{{{head}, \"id\": \"' || CAST(event_id AS STRING) || '\", {tail}}}'" for i, (head, tail, _) in enumerate(BENCHMARK_FORMS))
BENCHMARK_ROWS = f"SELECT event_id, CASE event_id % {len(BENCHMARK_FORMS)} {_BENCHMARK} END AS value FROM events"


def benchmark_cases(spark, sf_dir):
    """Events as benchmark rows of every form: category, support, content hash, prompt inputs or refusal."""
    views(spark, sf_dir, "events")
    read = spark.sql(BENCHMARK_ROWS).select("event_id", benchmark.read_case("value").alias("c"))
    text = lambda c: F.coalesce(f"c.{c}", F.lit("")).alias(c)
    return read.select("event_id", text("category"), text("case_hash"), "c.supported", text("query"), text("tools"), text("error"))


def selected_cases(spark, sf_dir):
    """The first fifty supported rows of each category by their digests."""
    views(spark, sf_dir, "events")
    return benchmark.select_cases(spark.sql(BENCHMARK_ROWS).select("value"), per_category=50).select("category", "rank", "case_hash")


def no_call_accuracy(spark, sf_dir):
    """Events' outputs that hold no call."""
    return robustness.no_call_accuracy(predictions(spark, sf_dir), "prediction").select(F.round("no_call_accuracy", 9).alias("no_call_accuracy"))


# -- versions -------------------------------------------------------------------------------------------------------


def nested_training(spark, sf_dir):
    """A training view of 120 documents: whole components, first fit in rank order."""
    members = splits.components(table(spark, sf_dir, "documents"), "doc_id", _doc_keys())
    return splits.nested_subset(members, "doc_id", 120).select("doc_id", "component")


def _locked(docs):
    return docs.where("doc_id % 11 = 0").withColumn("split", F.when(F.col("doc_id") % 2 == 0, "validation").otherwise("test"))


def context_version(spark, sf_dir):
    """Documents of at most 2,000 characters outside the locked ones' components, and the locked ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    made = splits.context_view(docs, _locked(docs), "doc_id", _doc_keys(), "n_chars", 2000)
    return made.select("doc_id", "split", F.coalesce("place", F.lit("")).alias("place"))


def full_version(spark, sf_dir):
    """A stratified training split of 100 documents of at most 5,000 characters beside locked ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return splits.full_allocation(docs, _locked(docs), "doc_id", _doc_keys(), F.col("doc_id") % 7, 100, "n_chars", 5000)


def dataset_manifest(spark, sf_dir):
    """Suppliers' splits as a manifest names them."""
    split = F.when(F.col("s_suppkey") % 10 == 0, "validation").when(F.col("s_suppkey") % 10 == 1, "test").otherwise("train")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", split.alias("split"))
    made = writers.dataset_manifest(rows, "s_suppkey", "v1", {"eligible_512": 1, "eligible_2048": 2}, [{"dataset": "suppliers", "kind": "table"}], 1)
    writers.check_dataset_manifest(made)
    return spark.createDataFrame([(name, held["count"], held["id_hash"]) for name, held in made["split_locks"].items()], "split string, n long, id_hash string")


# -- runs -----------------------------------------------------------------------------------------------------------

#: Orders as manifests of runs, in SQL that Spark and DuckDB share.
MANIFESTS = """SELECT o_orderkey, 'run-' || CAST(o_orderkey AS STRING) AS run,
  '{"artifact_version": ' || CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '2' END || ', "prompt_contract_version": 1, "dataset_prompt_contract_version": ' || CASE WHEN o_orderkey % 13 = 0 THEN '0' ELSE '1' END
  || ', "kind": "' || CASE WHEN o_orderkey % 3 = 0 THEN 'training' ELSE 'evaluation' END || '", "status": "completed", "controlled": ' || CASE WHEN o_orderkey % 7 = 0 THEN 'false' ELSE 'true' END
  || ', "comparable_rendering": true, "selection": ' || CASE WHEN o_orderkey % 2 = 0 THEN '"{}"' ELSE 'null' END || ', "git": {"commit": "c"}, "hashes": {"model": "' || o_orderpriority || '", "config": "x", "dataset": "d", "tokenizer": "t"}'
  || ', "counts": {"examples": ' || CAST(o_custkey AS STRING) || ', "updates": 16}, "seed": 7, "config": {"model": "m-4bit", "workflow": "' || CASE WHEN o_orderkey % 4 = 0 THEN 'final' ELSE 'base' END
  || '", "study_role": "' || CASE WHEN o_orderkey % 6 = 1 THEN 'headline' ELSE 'other' END || '", "axis": "' || CASE WHEN o_orderkey % 6 = 2 THEN 'dataset_size' WHEN o_orderkey % 6 = 4 THEN 'model_size' ELSE '' END || '", "dataset": {"version": "v1"}, "training": {"num_layers": 16, "lora_parameters": {"rank": 8}}}}' AS manifest,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
  '{"count": ' || CAST(o_custkey AS STRING) || ', "task_success": 0.5, "rss_gib": 1.5, "generation_throughput_tokens_per_second": 20.0}' AS evaluation FROM orders"""


def _runs(spark, sf_dir):
    views(spark, sf_dir, "orders")
    return spark.sql(MANIFESTS).select("o_orderkey", "run", "status", F.from_json("manifest", readers.MANIFEST).alias("manifest"), F.from_json("evaluation", readers.EVALUATION).alias("evaluation"))


def run_eligibility(spark, sf_dir):
    """Whether orders, as runs, may enter reports, and whether they have the evidence of controlled runs."""
    nothing = F.array().cast("array<string>")
    missing = F.when(F.col("o_orderkey") % 17 == 0, F.array(F.lit("status.json"))).otherwise(nothing)
    fit = runs.eligible(F.col("run"), F.col("manifest"), F.col("status"), missing)
    pinned = runs.is_controlled(F.col("manifest"), F.col("o_orderkey") % 19 != 0, F.lit("1-URGENT"), {"tokenizer": F.lit("t")}, updates=F.lit(16))
    return _runs(spark, sf_dir).select("run", fit.alias("eligible"), pinned.alias("controlled"))


def report_row_fields(spark, sf_dir):
    """Flat report rows of orders as runs."""
    made = runs.report_rows(_runs(spark, sf_dir))
    return made.select("run", "count", "model", "precision", "dataset_version", "rss_gib", "train_examples", "rank", "layers", "seed", "study_role", "axis", "kind", "workflow", "git_commit", "generation_throughput_tokens_per_second", "task_success")


def report_tables(spark, sf_dir):
    """The tables behind the report's figures, one below another."""
    made = runs.report_tables(runs.report_rows(_runs(spark, sf_dir)))
    size = {"headline-precision-table": "precision", "data-scaling": "train_examples", "model-size-quality-throughput-frontier": "generation_throughput_tokens_per_second"}
    parts = [made[name].select(F.lit(name).alias("table"), "run", F.col(column).cast("string").alias("value"), "task_success") for name, column in size.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def final_selection(spark, sf_dir):
    """Parts as validation runs: the winner and its rivals, as the final lock names them."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("run_id"), (F.col("p_partkey") % 3 != 0).alias("controlled"), F.when(F.col("p_partkey") % 5 != 0, "completed").otherwise("failed").alias("status"),
        F.lit(True).alias("validation_only"), F.format_string("%08d", "p_partkey").alias("fingerprint"), (F.col("p_size") / 50).alias("task_success"), F.lit(0.5).alias("argument_value_f1"), F.lit(1.0).alias("schema_validity"),
        F.col("p_retailprice").alias("rss_gib"), F.lit(1.0).alias("generation_throughput_tokens_per_second"),
    )
    made = locks.lock_final_selection(_fresh(spark, "final") + ".json", rows)
    return spark.createDataFrame(list(enumerate(made["candidates"])), "place int, run_id string")


# -- streams --------------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, make, mode: str):
    """The batches that a stream over events gives, as a table with their number."""
    kept, check = _fresh(spark, "stream"), _fresh(spark, "stream-state")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    given = _fresh(spark, "events")
    events.write.parquet(given)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(given)
    made = make(stream)
    query = made.writeStream.outputMode(mode).foreachBatch(live_journal.upsert(kept)).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in made.schema)}, batch long").parquet(kept)


def stream_seconds(spark, sf_dir):
    """Events by second and kind, from a stream."""
    made = _streamed(spark, sf_dir, lambda s: live.per_second(s, "ts", "value", "event_type", "3650 days"), "update")
    last = select.last_write(made.withColumn("key", F.concat_ws("|", "second", "event_type")), "key", ["batch"])
    return last.select(F.col("second").cast("timestamp_ntz").alias("second"), "event_type", "before", "peak", "after", "n")


def stream_last_writes(spark, sf_dir):
    """Each user's last event, from a stream that keeps it as state."""
    before = {name: spark.conf.get(name, None) for name in live_journal.SETTINGS}
    for name, value in live_journal.SETTINGS.items():
        spark.conf.set(name, value)
    try:
        made = _streamed(spark, sf_dir, lambda s: live_journal.last_writes(s.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]), "update")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return select.last_write(made.drop("batch"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def stream_first_seen(spark, sf_dir):
    """The users that a stream of events takes up, each once."""
    made = _streamed(spark, sf_dir, lambda s: live.resumable(s.select("user_id", "ts"), "user_id", "ts", "3650 days"), "append")
    return made.select("user_id")


QUERIES = {
    f.__name__: f
    for f in (
        json_lines_round_trip, csv_round_trip, telemetry_append, manifest_splits, file_digests, record_fingerprints, length_gate, prompt_contracts, prefix_tokens, redacted_props, prompt_hash_list, benchmark_cases,
        selected_cases, no_call_accuracy, nested_training, context_version, full_version, dataset_manifest, run_eligibility, report_row_fields, report_tables, final_selection, stream_seconds, stream_last_writes, stream_first_seen,
    )
}


def _of_form(at: int) -> str:
    return " ".join("WHEN {} THEN {}".format(i, "'" + str(form[at]).replace("'", "''") + "'") for i, form in enumerate(BENCHMARK_FORMS))


_NORMAL = '{"additionalProperties":%s,"properties":{"user":{"type":"integer"}},"required":%s,"type":"object"}'
_MANIFESTS = MANIFESTS.replace("AS STRING", "AS VARCHAR")
_CASES = f"cases AS ({BENCHMARK_ROWS.replace('AS STRING', 'AS VARCHAR')})"


def _locked_sql(most: int) -> str:
    """(doc_id, component) of documents that fit and lie outside the components that locked documents and they form."""
    return f"""fitting AS (SELECT doc_id FROM documents WHERE n_chars <= {most} OR n_chars IS NULL OR doc_id % 11 = 0),
keys AS (SELECT k.doc_id, k.key FROM (SELECT doc_id, 'query:' || md5(trim(text)) AS key FROM documents UNION SELECT doc_id, 'task:' || md5(string_split(text, chr(10))[1]) FROM documents) k JOIN fitting USING (doc_id)),
edges AS (SELECT DISTINCT a.doc_id AS x, b.m AS y FROM keys a JOIN (SELECT key, min(doc_id) AS m FROM keys GROUP BY key) b USING (key)), both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x), joint AS (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY x),
free AS (SELECT doc_id FROM joint JOIN documents USING (doc_id) WHERE (n_chars <= {most} OR n_chars IS NULL) AND component NOT IN (SELECT component FROM joint WHERE doc_id % 11 = 0))"""


SQL = {
    "json_lines_round_trip": """SELECT c_custkey, md5('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS line FROM customer""",
    "csv_round_trip": "SELECT s_suppkey, '' AS missing, s_name FROM supplier",
    "telemetry_append": "SELECT event_id, user_id, event_type FROM events",
    "manifest_splits": """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CAST(row_number() OVER (PARTITION BY s_suppkey % 5 = 0 ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, '{"id":' || s_suppkey || ',"name":"' || s_name || '"}' AS value FROM supplier""",
    "file_digests": "SELECT c_mktsegment AS segment, sha256(string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, CAST(sum(length(c_custkey || '|' || c_name) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1",
    "record_fingerprints": f"""WITH r AS (SELECT event_id AS pos, event_type, CASE event_id % 11 WHEN 0 THEN '{_NORMAL % ("true", '["user"]')}' ELSE '{_NORMAL % ("false", "[]")}' END AS schema FROM events WHERE event_id % 11 < 2)
SELECT pos, sha256(schema) AS fingerprints, sha256('{{"query":"q ' || pos || '","tools":[{{"description":"","name":"' || event_type || '.run","parameters":' || schema || '}}]}}') AS task FROM r""",
    "length_gate": "WITH l AS (SELECT event_id AS pos, CASE event_id % 3 WHEN 0 THEN user_id WHEN 2 THEN user_id * 10 END AS n FROM events) SELECT pos, CASE WHEN n > 500 THEN 'rendered length exceeds max_seq_length' ELSE '' END AS reason, CASE WHEN n > 500 THEN -1 ELSE coalesce(n, -1) END AS length FROM l",
    "prompt_contracts": "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS prompt_contract_version, event_type = 'click' AS legacy FROM events",
    "prefix_tokens": "WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w, turn % 3 + 1 AS n FROM conversations) SELECT conv_id, turn, turn % 4 <> 1 OR (len(w) > n AND w[n + 1] = '#') AS holds FROM w",
    "redacted_props": """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE '{"api_key":"[redacted]","n":' || user_id || ',"where":["<path>"]}' END AS props FROM events""",
    "prompt_hash_list": """WITH p AS (SELECT event_type, event_id, sha256('<tools>' || chr(10) || '[{"name":"' || event_type || '"}]' || chr(10) || '</tools>' || chr(10) || '<|user|>' || chr(10) || user_id || chr(10) || '<|assistant|>' || chr(10)) AS hash FROM events)
SELECT event_type, sha256(string_agg(hash, chr(10) ORDER BY event_id)) AS content_hash, count(*) AS n FROM p GROUP BY 1""",
    "benchmark_cases": f"""WITH {_CASES}, f AS (SELECT event_id, value, event_id % {len(BENCHMARK_FORMS)} AS form FROM cases)
SELECT event_id, CASE WHEN form IN (1, 5, 6) THEN 'irrelevance' WHEN form = 7 THEN 'other' ELSE 'simple_python' END AS category, sha256(value) AS case_hash, true AS supported,
  CASE form WHEN 0 THEN 'q ' || event_id WHEN 1 THEN 'plain' ELSE '' END AS query,
  CASE WHEN form < 2 THEN '[{{"function":{{"name":"f","parameters":{{"additionalProperties":true,"properties":{{"a":{{"type":"integer"}}}},"required":[],"type":"object"}}}},"type":"function"}}]' ELSE '' END AS tools,
  CASE form {_of_form(2)} END AS error FROM f""",
    "selected_cases": f"""WITH {_CASES}, h AS (SELECT value, sha256(value) AS case_hash, CASE WHEN event_id % 8 IN (1, 5, 6) THEN 'irrelevance' ELSE 'simple_python' END AS category FROM cases WHERE event_id % 8 <> 7),
r AS (SELECT category, case_hash, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || case_hash), value) AS rank FROM h) SELECT category, rank, case_hash FROM r WHERE rank <= 50""",
    "no_call_accuracy": "",
    "nested_training": "",
    "context_version": f"""WITH RECURSIVE {_locked_sql(2000)} SELECT doc_id, 'train' AS split, sha256('{{"source_id":"' || doc_id || '"}}') AS place FROM free
UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'validation' ELSE 'test' END, '' FROM documents WHERE doc_id % 11 = 0""",
    "dataset_manifest": "SELECT CASE s_suppkey % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sha256(string_agg(s_suppkey::VARCHAR, chr(10) ORDER BY s_suppkey)) AS id_hash FROM supplier GROUP BY 1",
    "run_eligibility": """SELECT 'run-' || o_orderkey AS run, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderstatus <> 'P' AND o_orderkey % 17 <> 0 AS eligible,
  o_orderkey % 19 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0 AND o_orderpriority = '1-URGENT' AS controlled FROM orders""",
    "report_row_fields": f"""WITH m AS ({_MANIFESTS}), j AS (SELECT o_orderkey, run, manifest::JSON AS m, evaluation::JSON AS e FROM m)
SELECT run, (e->>'$.count')::BIGINT AS count, m->>'$.config.model' AS model, '4bit' AS precision, m->>'$.config.dataset.version' AS dataset_version, (e->>'$.rss_gib')::DOUBLE AS rss_gib, (m->>'$.counts.examples')::BIGINT AS train_examples,
  (m->>'$.config.training.lora_parameters.rank')::INT AS rank, (m->>'$.config.training.num_layers')::INT AS layers, 7::BIGINT AS seed, m->>'$.config.study_role' AS study_role, m->>'$.config.axis' AS axis, m->>'$.kind' AS kind, m->>'$.config.workflow' AS workflow,
  m->>'$.git.commit' AS git_commit, (e->>'$.generation_throughput_tokens_per_second')::DOUBLE AS generation_throughput_tokens_per_second, (e->>'$.task_success')::DOUBLE AS task_success FROM j""",
    "report_tables": """SELECT 'headline-precision-table' AS "table", 'run-' || o_orderkey AS run, '4bit' AS value, 0.5::DOUBLE AS task_success FROM orders WHERE o_orderkey % 6 = 1
UNION ALL SELECT 'data-scaling', 'run-' || o_orderkey, o_custkey::VARCHAR, 0.5::DOUBLE FROM orders WHERE o_orderkey % 6 = 2 UNION ALL SELECT 'model-size-quality-throughput-frontier', 'run-' || o_orderkey, '20.0', 0.5::DOUBLE FROM orders WHERE o_orderkey % 6 = 4""",
    "final_selection": """WITH c AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0),
f AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))),
w AS (SELECT p_partkey FROM c ORDER BY p_size DESC, p_retailprice, p_partkey DESC LIMIT 1),
r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey DESC) AS place FROM f WHERE p_partkey NOT IN (SELECT p_partkey FROM w))
SELECT 0 AS place, 'part-' || p_partkey AS run_id FROM w UNION ALL SELECT CAST(place AS INTEGER), 'part-' || p_partkey FROM r WHERE place <= 2""",
    "stream_seconds": "SELECT date_trunc('second', ts) AS second, event_type, arg_min(value, (ts, value)) AS before, max(value) AS peak, arg_max(value, (ts, value)) AS after, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_last_writes": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
}


def _late_sql() -> dict[str, str]:
    from callmetrics.plans.calls import _PARSED
    from callmetrics.plans.study import _RANKED

    stratified = f"""{_locked_sql(5000)},
keys2 AS (SELECT doc_id, 'query:' || md5(trim(text)) AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM free) UNION SELECT doc_id, 'task:' || md5(string_split(text, chr(10))[1]) FROM documents WHERE doc_id IN (SELECT doc_id FROM free)),
edges2 AS (SELECT DISTINCT a.doc_id AS x, b.m AS y FROM keys2 a JOIN (SELECT key, min(doc_id) AS m FROM keys2 GROUP BY key) b USING (key)), ways2 AS (SELECT x, y FROM edges2 UNION SELECT y, x FROM edges2),
reach2 AS (SELECT x, y FROM ways2 UNION SELECT r.x, b.y FROM reach2 r JOIN ways2 b ON r.y = b.x), comp AS (SELECT x AS doc_id, min(y) AS component FROM reach2 GROUP BY x), {_RANKED},
members AS (SELECT doc_id, component, CASE WHEN doc_id % 7 <= 1 THEN '1' WHEN doc_id % 7 <= 4 THEN '2-4' ELSE '>=5' END AS stratum FROM comp),
counts AS (SELECT stratum, count(*) AS n FROM members GROUP BY 1), exact AS (SELECT stratum, 100 * n / sum(n) OVER () AS exact FROM counts),
based AS (SELECT stratum, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS place FROM exact),
quota AS (SELECT stratum, CAST(base + CASE WHEN place <= 100 - (SELECT sum(base) FROM based) THEN 1 ELSE 0 END AS BIGINT) AS q FROM based),
need AS (SELECT component, count(*) FILTER (WHERE stratum = '1') AS a, count(*) FILTER (WHERE stratum = '2-4') AS b, count(*) FILTER (WHERE stratum = '>=5') AS c FROM members GROUP BY 1),
queue AS (SELECT component, a, b, c, row_number() OVER (ORDER BY rank_key, component) AS pos FROM ranked JOIN need USING (component)),
fold AS (SELECT CAST(0 AS BIGINT) AS pos, coalesce((SELECT q FROM quota WHERE stratum = '1'), 0) AS ra, coalesce((SELECT q FROM quota WHERE stratum = '2-4'), 0) AS rb, coalesce((SELECT q FROM quota WHERE stratum = '>=5'), 0) AS rc, CAST(NULL AS BIGINT) AS component, false AS taken
  UNION ALL SELECT pos, CASE WHEN fits THEN ra - a ELSE ra END, CASE WHEN fits THEN rb - b ELSE rb END, CASE WHEN fits THEN rc - c ELSE rc END, component, fits
  FROM (SELECT q.*, ra, rb, rc, a <= ra AND b <= rb AND c <= rc AS fits FROM fold f JOIN queue q ON q.pos = f.pos + 1))"""
    return {
        "no_call_accuracy": f"WITH {_PARSED} SELECT round(avg((prediction NOT LIKE '%<tool_call>%' AND prediction NOT LIKE '%</tool_call>%')::INT), 9) AS no_call_accuracy FROM base",
        "nested_training": f"WITH RECURSIVE {_DOC_COMP}, {_RANKED}, {_FOLD.format(target=120)} SELECT doc_id, component FROM comp WHERE component IN (SELECT component FROM fold WHERE taken)",
        "full_version": f"WITH RECURSIVE {stratified} SELECT doc_id, 'train' AS split FROM comp WHERE component IN (SELECT component FROM fold WHERE taken) UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'validation' ELSE 'test' END FROM documents WHERE doc_id % 11 = 0",
    }


SQL |= _late_sql()
