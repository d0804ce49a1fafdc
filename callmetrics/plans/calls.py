"""Queries on parsing, scoring, records and rendering, over calls derived from ``events`` by SQL text that Spark and
DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.operators import normalize, parse, render, robustness, score, stats, templates
from callmetrics.session import table, views

_CALL = "'<tool_call>' || chr(10) || '{{\"name\": \"' || {name} || '\", \"arguments\": ' || {arguments} || '}}' || chr(10) || '</tool_call>'"
_GOOD = "'{\"user\": ' || CAST(user_id AS STRING) || '}'"


def _call(name: str = "event_type", arguments: str = _GOOD) -> str:
    return _CALL.format(name=name, arguments=arguments)


_FORMS = (
    _call(),
    _call(arguments="'{\"user\": ' || CAST(user_id + 1 AS STRING) || '}'"),
    "'there is nothing to call'",
    "'<think>well</think>' || " + _call(),
    "'<tool_call>' || chr(10) || '{\"name'",
    _call() + " || " + _call(),
    "'ok ' || " + _call(),
    "'<tool_call>{\"name\": \"x\", </tool_call>'",
    "'<tool_call>[1, 2]</tool_call>'",
    _call(arguments="'5'"),
    "'<tool_call>{\"name\": \"view\", \"arguments\": {}, \"more\": 1}</tool_call>'",
    _call(name="'nothing'"),
    _call(arguments="'{\"user\": \"' || CAST(user_id AS STRING) || '\"}'"),
    _call(arguments="'{}'"),
    _call(arguments="'{\"user\": ' || CAST(user_id AS STRING) || ', \"extra\": true}'"),
    "'  ' || " + _call() + " || '<|im_end|> '",
    _call(arguments="'{\"user\": 1, \"user\": 2}'"),
    _call(name="CASE WHEN event_type = 'view' THEN 'click' ELSE 'view' END"),
    _call(arguments="'{\"user\": ' || CAST(user_id AS STRING) || ', \"note\": \"n\"}'"),
)
_TOOL = '{"name": "\' || event_type || \'", "parameters": {"type": "object", "properties": {"user": {"type": "integer"}, "note": {"type": "string"}}, "required": ["user"], "additionalProperties": false}}'
_OTHER = '{"name": "\' || CASE WHEN event_type = \'view\' THEN \'click\' ELSE \'view\' END || \'", "parameters": {"type": "object", "properties": {"user": {"type": "integer"}}}}'
#: (pos, gold_name, gold_arguments, tools, prediction): every form of output in turn.
PREDICTIONS = f"""SELECT event_id AS pos, event_type AS gold_name, user_id, '{{"user": ' || CAST(user_id AS STRING) || '}}' AS gold_arguments,
  '[{_TOOL}, {_OTHER}]' AS tools,
  CASE event_id % {len(_FORMS)} {' '.join(f'WHEN {i} THEN {form}' for i, form in enumerate(_FORMS))} END AS prediction
FROM events"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql(PREDICTIONS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.compare(parse.parse(predictions(spark, sf_dir)))


def parse_taxonomy(spark, sf_dir):
    return score.primary_counts(parse.parse(predictions(spark, sf_dir))).select(F.col("term").alias("category"), "n")


def parse_rows(spark, sf_dir):
    made = parse.parse(predictions(spark, sf_dir))
    return made.select("pos", F.coalesce("category", F.lit("")).alias("category"), "primary", "name", "json_valid", "tool_valid", "schema_valid")


def leaf_value_match(spark, sf_dir):
    leaves = score.leaf_table(scored(spark, sf_dir))
    both = F.col("gold").isNotNull() & F.col("predicted").isNotNull()
    return leaves.groupBy(F.array_join("path", "/").alias("path")).agg(
        F.count("gold").alias("n_gold"), F.count("predicted").alias("n_predicted"), F.count_if(both).alias("key_matches"), F.count_if("same").alias("value_matches")
    )


def evaluation_metrics(spark, sf_dir):
    made = score.evaluate(scored(spark, sf_dir))
    rates = [c for c in made.columns if c not in ("count", "extra_argument_count")]
    return made.select(F.col("count").alias("n"), "extra_argument_count", *[F.round(c, 9).alias(c) for c in rates])


_NESTED_SCHEMA = '{"type": "object", "properties": {"user": {"type": "integer"}, "place": {"type": "object", "properties": {"city": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}}, "level": {"type": "string", "enum": ["low", "high"]}, "ratio": {"type": "number"}}, "required": ["user", "level"]}'
_NESTED_GOLD = """'{"user": ' || CAST(user_id AS STRING) || ', "place": {"city": " Ulm ", "tags": ["a", "b"]}, "level": "high", "ratio": 2}'"""
#: Arguments of predictions: nested, with blanks around a text, a number as int or float, an enum's case, a longer list.
_NESTED_FORMS = (
    _NESTED_GOLD,
    """'{"user": ' || CAST(user_id AS STRING) || ', "place": {"city": "Ulm", "tags": ["a", "b"]}, "level": "high", "ratio": 2.0}'""",
    """'{"user": ' || CAST(user_id AS STRING) || '.0, "place": {"city": "Ulm", "tags": ["b", "a"]}, "level": " high", "ratio": 2}'""",
    """'{"user": ' || CAST(user_id + 1 AS STRING) || ', "place": {"city": "Ulm", "tags": ["a", "b", "c"], "more": {"x": null}}, "level": "low"}'""",
    """'{"place": {"city": 5}, "level": "none", "ratio": "2"}'""",
)
_NESTED_CALL = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_NESTED_FORMS))
NESTED = f"""SELECT event_id AS pos, user_id, 'go' AS gold_name, {_NESTED_GOLD} AS gold_arguments, '[{{"name": "go", "parameters": {_NESTED_SCHEMA}}}]' AS tools,
  '<tool_call>{{"name": "go", "arguments": ' || CASE event_id % {len(_NESTED_FORMS)} {_NESTED_CALL} END || '}}</tool_call>' AS prediction FROM events"""


def nested_arguments(spark, sf_dir):
    """Scores of calls with nested arguments, lists, an enum and a number that is written as int or float."""
    views(spark, sf_dir, "events")
    made = score.compare(parse.parse(spark.sql(NESTED)))
    return made.select("pos", "schema_valid", "key_matches", "value_matches", "n_predicted", "n_gold", "exact", "task_success", "extra", F.coalesce("task_error", F.lit("")).alias("task_error"))


def task_errors(spark, sf_dir):
    return score.task_error_counts(scored(spark, sf_dir)).select(F.col("term").alias("task_error"), "n")


def row_flags(spark, sf_dir):
    return scored(spark, sf_dir).select("pos", "key_matches", "value_matches", "n_predicted", "n_gold", "tool_accuracy", "exact", "task_success", "extra", F.coalesce("task_error", F.lit("")).alias("task_error"))


# The oracle parses the same texts with DuckDB's own JSON functions.
_PARSED = f"""base AS ({PREDICTIONS.replace("STRING", "VARCHAR")}), t AS (
  SELECT *, trim(prediction, ' ' || chr(10)) AS x,
    (length(prediction) - length(replace(prediction, '<tool_call>', ''))) // 11 AS opened,
    (length(prediction) - length(replace(prediction, '</tool_call>', ''))) // 12 AS closed FROM base
), u AS (
  SELECT *, CASE WHEN x LIKE '%<|im_end|>' THEN trim(left(x, length(x) - 10), ' ' || chr(10)) ELSE x END AS y FROM t
), v AS (
  SELECT *, CASE WHEN opened = 1 AND closed = 1 AND y LIKE '<tool_call>%' AND y LIKE '%</tool_call>' THEN trim(y[12:length(y) - 12], ' ' || chr(10)) END AS payload FROM u
), w AS (
  SELECT *, CASE WHEN json_valid(payload) AND payload NOT LIKE '%"user"%"user"%' THEN payload::JSON END AS j FROM v
), c AS (
  SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j->>'$.name' END AS called, j->'$.arguments' AS args,
    CASE WHEN event_type_other.o IS NULL THEN '' ELSE event_type_other.o END AS other
  FROM w, LATERAL (SELECT CASE WHEN gold_name = 'view' THEN 'click' ELSE 'view' END AS o) event_type_other
), k AS (
  SELECT *, CASE
      WHEN prediction LIKE '%<think>%' OR prediction LIKE '%</think>%' THEN 'thinking_block'
      WHEN opened > 1 OR closed > 1 THEN 'multiple_calls'
      WHEN opened = 0 AND closed = 0 THEN 'no_call'
      WHEN opened <> closed THEN 'partial_boundary'
      WHEN payload IS NULL THEN 'extra_output'
      WHEN j IS NULL THEN 'invalid_json'
      WHEN json_type(j) <> 'OBJECT' THEN 'json_fragment'
      WHEN list_sort(json_keys(j)) <> ['arguments', 'name'] THEN 'invalid_call'
      WHEN json_type(args) <> 'OBJECT' THEN 'non_object_arguments'
      WHEN called NOT IN (gold_name, other) THEN 'unknown_tool'
      WHEN called = gold_name AND NOT list_contains(json_keys(args), 'user') THEN 'schema_invalid'
      WHEN called = gold_name AND len(list_filter(json_keys(args), lambda q: q NOT IN ('user', 'note'))) > 0 THEN 'schema_invalid'
      WHEN json_type(args->'$.user') NOT IN ('BIGINT', 'UBIGINT') THEN 'schema_invalid'
      ELSE '' END AS category FROM c
), p AS (
  SELECT *, category = '' OR category = 'schema_invalid' AS comparable, CASE category WHEN '' THEN 'valid' WHEN 'thinking_block' THEN 'thinking' WHEN 'partial_boundary' THEN 'truncated'
      WHEN 'json_fragment' THEN 'invalid_call' WHEN 'non_object_arguments' THEN 'invalid_call' ELSE category END AS "primary",
    CASE WHEN category IN ('', 'non_object_arguments', 'invalid_call', 'unknown_tool', 'schema_invalid') THEN called ELSE '' END AS name,
    category IN ('', 'json_fragment', 'non_object_arguments', 'invalid_call', 'unknown_tool', 'schema_invalid') AS json_valid,
    category IN ('', 'schema_invalid') AS tool_valid, category = '' AS schema_valid FROM k
), f AS (
  SELECT *, CASE WHEN comparable THEN coalesce(len(json_keys(args)), 0) ELSE 0 END AS n_predicted, 1 AS n_gold,
    CAST(comparable AND list_contains(json_keys(args), 'user') AS INTEGER) AS key_matches,
    CAST(comparable AND coalesce(json_type(args->'$.user') IN ('BIGINT', 'UBIGINT') AND CAST(args->>'$.user' AS VARCHAR) = CAST(user_id AS VARCHAR), false) AS INTEGER) AS value_matches,
    tool_valid AND name = gold_name AS tool_accuracy,
    category IN ('', 'schema_invalid', 'unknown_tool', 'invalid_call') AND json_type(args) = 'OBJECT' AND len(list_filter(json_keys(args), lambda q: q <> 'user')) > 0 AS extra FROM p
), s AS (
  SELECT *, schema_valid AND tool_accuracy AND value_matches = 1 AND n_predicted = 1 AS exact, schema_valid AND tool_accuracy AND value_matches = 1 AS task_success,
    CASE WHEN category = 'partial_boundary' THEN 'truncated_output' WHEN category = 'invalid_json' THEN 'invalid_json' WHEN category = 'unknown_tool' THEN 'nonexistent_tool'
      WHEN NOT comparable THEN 'no_parseable_tool_call_boundary' WHEN name <> gold_name THEN 'wrong_supplied_tool'
      WHEN NOT list_contains(json_keys(args), 'user') THEN 'missing_required_argument'
      WHEN len(list_filter(json_keys(args), lambda q: q NOT IN ('user', 'note'))) > 0 THEN 'extra_hallucinated_argument'
      WHEN category = 'schema_invalid' THEN 'wrong_type' WHEN value_matches < key_matches THEN 'wrong_enum_or_value' ELSE '' END AS task_error FROM f
)"""


def _zero_filled(column: str, terms: tuple[str, ...], named: str) -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    return f"WITH {_PARSED} SELECT v.term AS {named}, count(s.pos) AS n FROM (VALUES {listed}) v(term) LEFT JOIN s ON s.{column} = v.term GROUP BY v.term"


_F1 = "CASE WHEN sum(n_predicted) = 0 AND sum(n_gold) = 0 THEN 1.0 WHEN sum({m}) = 0 THEN 0.0 ELSE 2.0 * (sum({m}) / sum(n_predicted)) * (sum({m}) / sum(n_gold)) / (sum({m}) / sum(n_predicted) + sum({m}) / sum(n_gold)) END"


def micro_f1_by_type(spark, sf_dir):
    """Key and value F1 per gold tool: micro counts, then F1."""
    sums = {n: F.sum(n) for n in ("key_matches", "value_matches", "n_predicted", "n_gold")}
    made = scored(spark, sf_dir).groupBy("gold_name").agg(score.f1(sums["key_matches"], sums["n_predicted"], sums["n_gold"]).alias("key_f1"), score.f1(sums["value_matches"], sums["n_predicted"], sums["n_gold"]).alias("value_f1"))
    return made.select("gold_name", F.round("key_f1", 9).alias("key_f1"), F.round("value_f1", 9).alias("value_f1"))


def prompt_hashes(spark, sf_dir):
    """Prompts and completions of derived records, hashed."""
    views(spark, sf_dir, "events")
    rows = spark.sql("""SELECT event_id, '[{"name":"' || event_type || '"}]' AS tools, event_type, 'user ' || CAST(user_id AS STRING) AS query, '{"user":' || CAST(user_id AS STRING) || '}' AS args FROM events""")
    return rows.select("event_id", render.digest(render.prompt(F.col("tools"), F.col("query"))).alias("prompt_hash"), render.digest(render.completion(F.col("event_type"), F.col("args"))).alias("completion_hash"))


def api_prefixes(spark, sf_dir):
    docs = table(spark, sf_dir, "part")
    return docs.groupBy(normalize.api_prefix(F.concat_ws("..", F.lit(" -"), F.replace("p_type", F.lit(" "), F.lit("_")), F.col("p_brand"))).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def rejection_flow(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    reason = F.when(F.length("text") < 100, "too short").when(F.col("lang") == "es", "language").when(F.length("text") > 5000, "too long")
    return normalize.flow(docs, reason)


def conflict_drop(spark, sf_dir):
    """Documents with equal text under another language or source are all dropped."""
    docs = table(spark, sf_dir, "documents")
    keys = F.array(F.concat(F.lit("text:"), F.md5(F.trim("text").cast("binary"))), F.concat(F.lit("head:"), F.md5(F.substring_index("text", "\n", 1).cast("binary"))))
    bad = normalize.conflicting_ids(docs, "doc_id", keys, F.concat_ws("/", "lang", "source"))
    return docs.join(bad, "doc_id", "left_anti").select("doc_id")


def context_view(spark, sf_dir):
    kept, dropped = normalize.within_context(table(spark, sf_dir, "documents").withColumn("rendered_length", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars"))), 2048)
    side = lambda f, name: f.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum")).select(F.lit(name).alias("side"), "n", "id_sum")
    return side(kept, "kept").unionByName(side(dropped, "dropped"))


def normalized_records(spark, sf_dir):
    """Raw JSON records derived from events, half of them broken in some way, through the whole normaliser."""
    views(spark, sf_dir, "events")
    made = normalize.normalize(spark.sql(RECORDS))
    return made.select("pos", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("function_name", F.lit("")).alias("function_name"), F.coalesce("tool_count", F.lit(0)).alias("tool_count"), F.coalesce(F.array_join("candidate_prefixes", ","), F.lit("")).alias("prefixes"))


_RECORD_TOOL = '{{"name": "\' || event_type || \'.run", "parameters": {parameters}}}'
_OBJECT = '{"type": "object", "properties": {"user": {"type": "integer"}}, "required": ["user"]}'
_LEGACY = '{"user": {"type": "int, optional", "description": "d"}}'


def _record(parameters: str = _OBJECT, query: str = '"q \' || CAST(event_id AS STRING) || \'"', answers: str | None = None, more: str = "") -> str:
    good = '[{"name": "\' || event_type || \'.run", "arguments": {"user": \' || CAST(user_id AS STRING) || \'}}]'
    return f"""'{{"id": "e' || CAST(event_id AS STRING) || '", "query": {query}, "tools": [{_RECORD_TOOL.format(parameters=parameters)}], "answers": {answers or good}{more}}}'"""


#: (record text, reason): forms of records and what the normaliser says of them.
RECORD_FORMS = (
    (_record(), ""),
    (_record(parameters=_LEGACY), ""),
    (_record(query='" "'), "query is missing"),
    (_record(query="null", more=', "prompt": "x"'), "query is missing"),
    (_record(answers="[]"), "exactly one gold answer is required"),
    (_record(answers='[{"name": "other", "arguments": {}}]'), "gold function is not in candidate tools"),
    (_record(answers='[{"name": "\' || event_type || \'.run", "arguments": {"user": "one"}}]'), "gold arguments fail schema: 'one' is not of type 'integer'"),
    (_record(parameters='{"type": "object", "oneOf": []}'), "unsupported schema keyword: oneOf"),
    (_record(parameters='{"user": {"type": "Tuple[int]"}}'), "tuple types are not supported"),
    (_record(answers='[{"name": "\' || event_type || \'.run", "arguments": {}}]'), "gold arguments fail schema: 'user' is a required property"),
    (_record(more=', "rendered_length": "long"'), "rendered_length must be an integer"),
)
RECORDS = f"SELECT event_id AS pos, CASE event_id % {len(RECORD_FORMS)} {' '.join(f'WHEN {i} THEN {text}' for i, (text, _) in enumerate(RECORD_FORMS))} END AS value FROM events"


#: A template with tools, roles, a mark of the assistant's turn and a generation prompt.
TEMPLATE = """{%- if tools -%}
<|im_start|>system
# Tools
<tools>
{%- for tool in tools %}
{{ tool | tojson }}
{%- endfor %}
</tools><|im_end|>
{% endif -%}
{% for message in messages -%}
<|im_start|>{{ message.role }}
{% if message.role == 'assistant' %}<think>

</think>
{% endif %}{{ message.content | trim }}<|im_end|>
{% endfor -%}
{% if add_generation_prompt %}<|im_start|>assistant
{% endif %}"""


def template_prompts(spark, sf_dir):
    """Prompts and completions of events by a chat template, and of their tools alone."""
    rows = table(spark, sf_dir, "events")
    tools = F.array(F.concat(F.lit('{"name":"'), "event_type", F.lit('"}')), F.lit('{"name":"other"}'))
    query = F.concat(F.lit(" user "), F.col("user_id").cast("string"))
    call = render.completion(F.col("event_type"), F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit("}")))
    pair = templates.rendered_pair(TEMPLATE, tools, query, call)
    made = rows.select("event_id", pair.alias("p"), templates.tools_prompt(TEMPLATE, tools, query, F.col("event_type")).alias("alone"))
    hashed = lambda c: render.digest(F.col(c))
    return made.select("event_id", hashed("p.prompt").alias("prompt_hash"), hashed("p.completion").alias("completion_hash"), hashed("alone").alias("tools_hash"), F.coalesce("p.problem", F.lit("")).alias("problem"))


def _suite(spark, sf_dir):
    """The suite's product over given texts: users' turns as templates, system turns as questions without a call."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "role", F.col("text").alias("query"))
    of = lambda role: stats.numbered(turns.where(F.col("role") == role), "key")
    return robustness.cases_of(of("user").select(F.col("row").alias("t"), "query"), of("system").select(F.col("row").alias("i"), "query"))


def robustness_breakdown(spark, sf_dir):
    """The suite over users' turns, with predictions that fail by a rule on the case's number."""
    suite = _suite(spark, sf_dir)
    good = F.lit('<tool_call>{"name": "fixture.target", "arguments": {}}</tool_call>')
    wrong = F.lit('<tool_call>{"name": "fixture.distractor.0", "arguments": {}}</tool_call>')
    text = F.when(F.col("expected_name").isNull(), F.when(F.col("pos") % 4 == 0, good).otherwise("none")).otherwise(F.when(F.col("pos") % 3 == 0, wrong).otherwise(good))
    made = robustness.breakdown(robustness.judge_cases(suite, suite.select("case_id", text.alias("prediction"))))
    return made.select("part", "n", F.round("success", 9).alias("success"))


def case_list_hash(spark, sf_dir):
    """Digests of the suite's ordered lists of cases, by level."""
    from callmetrics.operators.splits import list_hash

    level = F.coalesce(F.col("distractors").cast("string"), F.lit("none"))
    hashed = _suite(spark, sf_dir).select(level.alias("level"), "pos", F.concat_ws(":", "case_id", F.md5(F.col("query").cast("binary"))).alias("case"))
    return list_hash(hashed, "case", "pos", ("level",))


def json_props(spark, sf_dir):
    """Canonical text of ``events.props`` and its one member."""
    from callmetrics.functions.jsontext import canonical_json

    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", canonical_json()(F.col("props")).alias("props"), F.get_json_object("props", "$.k").cast("long").alias("k"))


_REASONS = " ".join("WHEN {} THEN '{}'".format(i, reason.replace("'", "''")) for i, (_, reason) in enumerate(RECORD_FORMS))
_SUITE = """turns AS (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS t FROM conversations),
levels AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 3), (3, 7)) v(a, d)),
suite AS (SELECT t * 4 + a AS pos, 'call-' || CASE WHEN t < 10 THEN '0' ELSE '' END || t || '-' || d AS id, d::VARCHAR AS level, text FROM turns, levels WHERE role = 'user'
  UNION ALL SELECT 4 * (SELECT count(*) FROM turns WHERE role = 'user') + t, 'no-call-' || t, 'none', text FROM turns WHERE role = 'system')"""
QUERIES = {f.__name__: f for f in (parse_taxonomy, parse_rows, leaf_value_match, evaluation_metrics, nested_arguments, task_errors, row_flags, micro_f1_by_type, prompt_hashes, api_prefixes, template_prompts, rejection_flow, conflict_drop, context_view, normalized_records, robustness_breakdown, case_list_hash, json_props)}
SQL = {
    "parse_taxonomy": _zero_filled('"primary"', parse.PRIMARY, "category"),
    "parse_rows": f'WITH {_PARSED} SELECT pos, category, "primary", name, json_valid, tool_valid, schema_valid FROM s',
    "leaf_value_match": f"""WITH {_PARSED}, l AS (
  SELECT 'user' AS path, sum(n_gold) AS n_gold, count(*) FILTER (WHERE comparable AND list_contains(json_keys(args), 'user')) AS n_predicted, sum(key_matches) AS key_matches, sum(value_matches) AS value_matches FROM s
  UNION ALL SELECT k, 0, count(*), 0, 0 FROM (SELECT unnest(json_keys(args)) AS k FROM s WHERE comparable) WHERE k <> 'user' GROUP BY k)
SELECT path, CAST(n_gold AS BIGINT) AS n_gold, CAST(n_predicted AS BIGINT) AS n_predicted, CAST(key_matches AS BIGINT) AS key_matches, CAST(value_matches AS BIGINT) AS value_matches FROM l""",
    "evaluation_metrics": f"""WITH {_PARSED} SELECT count(*) AS n, count_if(extra) AS extra_argument_count, round(avg(tool_accuracy::INT), 9) AS tool_accuracy, round(avg(json_valid::INT), 9) AS json_validity,
  round(avg(schema_valid::INT), 9) AS schema_validity, round({_F1.format(m='key_matches')}, 9) AS argument_key_f1, round({_F1.format(m='value_matches')}, 9) AS argument_value_f1,
  round(avg(exact::INT), 9) AS exact_match, round(avg(task_success::INT), 9) AS task_success, round(avg(extra::INT), 9) AS extra_argument_rate FROM s""",
    "nested_arguments": f"""WITH n AS ({NESTED.replace("AS STRING", "AS VARCHAR")}), a AS (SELECT pos, user_id, (regexp_extract(prediction, '"arguments": (.*)\\}}</tool_call>', 1))::JSON AS p FROM n),
l AS (SELECT *, json_type(p->'$.user') AS tu, json_type(p->'$.place.city') AS tc, json_type(p->'$.place.tags') AS tt, json_type(p->'$.level') AS tl, json_type(p->'$.ratio') AS tr FROM a),
v AS (SELECT *, tu IS NOT NULL AS ku, tc IS NOT NULL AS kc, coalesce(json_array_length(p->'$.place.tags'), 0) AS nt, tl IS NOT NULL AS kl, tr IS NOT NULL AS kr,
  coalesce(tu IN ('UBIGINT', 'BIGINT') AND (p->>'$.user')::BIGINT = user_id, false) AS vu, coalesce(tc = 'VARCHAR' AND trim(p->>'$.place.city') = 'Ulm', false) AS vc,
  coalesce((p->>'$.place.tags[0]') = 'a', false) AS va, coalesce((p->>'$.place.tags[1]') = 'b', false) AS vb, coalesce((p->>'$.level') = 'high', false) AS vl,
  coalesce(tr IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (p->>'$.ratio')::DOUBLE = 2, false) AS vr, json_type(p->'$.place.more') IS NOT NULL AS more FROM l),
c AS (SELECT *, ku::INT + kc::INT + least(nt, 2) + kl::INT + kr::INT AS key_matches, vu::INT + vc::INT + va::INT + vb::INT + vl::INT + vr::INT AS value_matches, ku::INT + kc::INT + nt + kl::INT + kr::INT + more::INT AS n_predicted,
  ku AND tu IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND tc = 'VARCHAR' AND (tl IS NULL OR (p->>'$.level') IN ('low', 'high')) AND coalesce(tr, 'DOUBLE') <> 'VARCHAR' AS schema_valid FROM v)
SELECT pos, schema_valid, key_matches, value_matches, n_predicted, 6 AS n_gold, schema_valid AND value_matches = 6 AND n_predicted = 6 AS exact, schema_valid AND vu AND vl AS task_success, more OR nt > 2 AS extra,
  CASE WHEN NOT ku THEN 'missing_required_argument' WHEN tc <> 'VARCHAR' OR tr = 'VARCHAR' THEN 'wrong_type' WHEN NOT schema_valid OR value_matches < key_matches THEN 'wrong_enum_or_value' ELSE '' END AS task_error FROM c""",
    "task_errors": _zero_filled("task_error", score.TASK_ERRORS, "task_error"),
    "row_flags": f"WITH {_PARSED} SELECT pos, key_matches, value_matches, n_predicted, n_gold, tool_accuracy, exact, task_success, coalesce(extra, false) AS extra, task_error FROM s",
    "micro_f1_by_type": f"WITH {_PARSED} SELECT gold_name, round({_F1.format(m='key_matches')}, 9) AS key_f1, round({_F1.format(m='value_matches')}, 9) AS value_f1 FROM s GROUP BY gold_name",
    "prompt_hashes": """SELECT event_id, sha256('<tools>' || chr(10) || '[{"name":"' || event_type || '"}]' || chr(10) || '</tools>' || chr(10) || '<|user|>' || chr(10) || 'user ' || user_id::VARCHAR || chr(10) || '<|assistant|>' || chr(10)) AS prompt_hash,
  sha256('<tool_call>' || chr(10) || '{"arguments":{"user":' || user_id::VARCHAR || '},"name":"' || event_type || '"}' || chr(10) || '</tool_call>') AS completion_hash FROM events""",
    "template_prompts": """WITH p AS (SELECT event_id, event_type, user_id, '<|im_start|>system' || chr(10) || '# Tools' || chr(10) || '<tools>' || chr(10) || '{"name":"' || event_type || '"}' || chr(10) || '{"name":"other"}' || chr(10) || '</tools><|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || 'user ' || user_id || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) AS prompt FROM events)
SELECT event_id, sha256(prompt) AS prompt_hash, sha256('<tool_call>' || chr(10) || '{"arguments":{"user":' || user_id || '},"name":"' || event_type || '"}' || chr(10) || '</tool_call><|im_end|>' || chr(10)) AS completion_hash, sha256(prompt) AS tools_hash, '' AS problem FROM p""",
    "api_prefixes": r"""SELECT lower(string_split(trim(regexp_replace(' -..' || replace(p_type, ' ', '_') || '..' || p_brand, '[^a-zA-Z0-9]+', '.', 'g'), '.'), '.')[1]) AS prefix, count(*) AS n FROM part GROUP BY 1""",
    "rejection_flow": """WITH r AS (SELECT CASE WHEN length(text) < 100 THEN 'too short' WHEN lang = 'es' THEN 'language' WHEN length(text) > 5000 THEN 'too long' END AS reason FROM documents)
SELECT 'source' AS step, count(*) AS n FROM r UNION ALL SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END, count(*) FROM r GROUP BY 1
UNION ALL SELECT 'rejected:' || reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "conflict_drop": """WITH k AS (SELECT doc_id, 'text:' || trim(text) AS key, lang || '/' || source AS gold FROM documents UNION ALL SELECT doc_id, 'head:' || string_split(text, chr(10))[1], lang || '/' || source FROM documents)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT gold) > 1))""",
    "context_view": """SELECT CASE WHEN doc_id % 7 = 0 OR n_chars <= 2048 THEN 'kept' ELSE 'dropped' END AS side, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents GROUP BY 1""",
    "normalized_records": f"""WITH r AS (SELECT event_id AS pos, event_type, CASE event_id % {len(RECORD_FORMS)} {_REASONS} END AS reason FROM events)
SELECT pos, reason, CASE WHEN reason = '' THEN event_type || '.run' ELSE '' END AS function_name, CASE WHEN reason = '' THEN 1 ELSE 0 END AS tool_count, CASE WHEN reason = '' THEN event_type ELSE '' END AS prefixes FROM r""",
    "robustness_breakdown": f"""WITH {_SUITE}, j AS (SELECT *, CASE WHEN level = 'none' THEN pos % 4 <> 0 ELSE pos % 3 <> 0 END AS s FROM suite)
SELECT 'call' AS part, count(*) AS n, round(avg(s::INT), 9) AS success FROM j WHERE level <> 'none'
UNION ALL SELECT 'call:' || level, count(*), round(avg(s::INT), 9) FROM j WHERE level <> 'none' GROUP BY level UNION ALL SELECT 'no_call', count(*), round(avg(s::INT), 9) FROM j WHERE level = 'none'""",
    "case_list_hash": f"WITH {_SUITE} SELECT level, sha256(string_agg(id || ':' || md5(text), chr(10) ORDER BY pos)) AS content_hash, count(*) AS n FROM suite GROUP BY level",
    "json_props": """SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS props, (props->>'$.k')::BIGINT AS k FROM events""",
}
