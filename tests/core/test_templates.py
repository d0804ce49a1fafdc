import pytest
from pyspark.sql import functions as F

from callmetrics.operators import templates

CHATML = """{%- if tools -%}
<|im_start|>system
# Tools
<tools>
{%- for tool in tools %}
{{ tool | tojson }}
{%- endfor %}
</tools><|im_end|>
{% endif -%}
{% for message in messages %}{{ '<|im_start|>' + message.role + '\\n' }}
{%- if message['role'] == 'assistant' and loop.last %}<think>\\n\\n</think>{{ '\\n' }}{% endif %}{{ message.content | trim }}<|im_end|>{{ '\\n' }}{% endfor %}
{%- if add_generation_prompt %}<|im_start|>assistant{{ '\\n' }}{% endif %}"""


def plain(messages, tools, generate):
    out = ""
    if tools:
        out += "<|im_start|>system\n# Tools\n<tools>" + "".join("\n" + t for t in tools) + "\n</tools><|im_end|>\n"
    for i, (role, content) in enumerate(messages):
        out += f"<|im_start|>{role}\n" + ("<think>\\n\\n</think>\n" if role == "assistant" and i == len(messages) - 1 else "") + content.strip() + "<|im_end|>\n"
    return out + ("<|im_start|>assistant\n" if generate else "")


@pytest.mark.parametrize("generate", [True, False])
def test_chat_template(spark, generate):
    rows = [([("user", " hi "), ("assistant", "a\nb"), ("user", "x")], ['{"name":"f"}', '{"name":"g"}']), ([("user", "q"), ("assistant", "é")], []), ([], ["{}"])]
    frame = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>, t array<string>")
    got = frame.select(templates.render(CHATML, F.col("m"), F.col("t"), generate).alias("x")).collect()
    assert [r.x for r in got] == [plain(m, t, generate) for m, t in rows]


def one(spark, template, **names):
    frame = spark.createDataFrame([([("user", "A"), ("assistant", "B")],)], "m array<struct<role:string,content:string>>")
    return frame.select(templates.render(template, F.col("m"), **names).alias("x")).first().x


def test_language(spark):
    cases = {
        "{{ messages[0].role }}{{ messages[5].role }}": "user",
        "{% for m in messages %}{{ loop.index }}{% if not loop.last %}, {% endif %}{% endfor %}": "1, 2",
        "{% for m in messages %}{% if loop.first %}f{% elif m.role == 'assistant' %}a{% else %}x{% endif %}{% endfor %}": "fa",
        "{% set who = messages[1]['content'] %}{{ who + '!' }}{# gone #}": "B!",
        "{% if missing is defined %}a{% else %}b{% endif %}{% if missing is not defined and messages %}c{% endif %}": "bc",
        "{{ missing | default('d') }}{{ messages | length }}": "d2",
        "{% if 'ss' in messages[1].role or false %}y{% endif %}{{ '  k ' | trim | upper }}": "yK",
        "a  {{- ' b ' -}}  c": "a b c",
        "{% for m in messages %}{% for n in messages %}{{ m.content }}{{ n.content }} {% endfor %}{% endfor %}": "AA AB BA BB ",
        "": "",
        "{{ flag }}{% if flag != 'x' %}no{% endif %}{% if (1 < 2) and 2 >= 2 %}n{% endif %}": "xn",
    }
    for template, want in cases.items():
        assert one(spark, template, flag="x") == want, template


def test_errors():
    for bad in ("{% if a %}", "{% for x %}{% endfor %}", "{{ a | nothing }}", "{{ }}", "{{ a ? b }}", "{% while %}", "{{ a b }}", "{% set a %}", "{{ (a }}", "{{ a is }}"):
        with pytest.raises(templates.TemplateError):
            templates.render(bad, F.lit(None))


def test_pairs(spark):
    call = '<tool_call>\n{"arguments":{},"name":"f"}\n</tool_call>'
    frame = spark.createDataFrame([("hi", call), ("hi", "no call")], "q string, c string")
    made = frame.select(templates.rendered_pair(CHATML.replace(" and loop.last", " and false"), F.array(F.lit("{}")), F.col("q"), F.col("c")).alias("p")).collect()
    prompt = plain([("user", "hi")], ["{}"], True)
    assert (made[0].p.prompt, made[0].p.completion, made[0].p.problem) == (prompt, call + "<|im_end|>\n", None)
    assert made[1].p.prompt is None and "does not contain" in made[1].p.problem
    thinking = frame.limit(1).select(templates.rendered_pair(CHATML, F.array(F.lit("{}")), F.col("q"), F.col("c")).alias("p")).first().p
    assert thinking.prompt == prompt + "<think>\\n\\n</think>\n" and thinking.completion.startswith("<tool_call>")
    unstable = frame.limit(1).select(templates.rendered_pair("{% if add_generation_prompt %}x{% endif %}y", F.array(F.lit("{}")), F.col("q"), F.col("c")).alias("p")).first().p
    assert "stable prefix" in unstable.problem
    asked = frame.limit(1).select(templates.tools_prompt(CHATML, F.array(F.lit("{}")), F.col("q"), F.lit("f")).alias("p")).first().p
    assert asked == thinking.prompt


def test_rendering_runs_no_python(spark):
    import contextlib
    import io

    frame = spark.range(5).select(F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("m"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.select(templates.render(CHATML, F.col("m"))).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
