import re
from collections import Counter

from pyspark.sql import functions as F

from callmetrics.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, lang string, source string, text string, bucket string"


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_counts_against_plain_python(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b c d a b c", "é# ß b\nb\n\nb \nb", "one two\x0bthree\x1c four" * 9, "w " * 3000, "the cat sat on the cat sat the cat sat on"]
    rows = [(i, "en", "s", t, "") for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, SCHEMA).select("doc_id", quality.text_counts(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert [tuple(r.c) for r in got] == [counts(t) for t in texts]


def test_buckets(spark):
    values = [*range(0, 5000), 10**6, 2**40]
    frame = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    rows = frame.select("v", "b", quality.upper_edge(F.col("b").cast("long")).alias("top")).orderBy("v").collect()
    assert all(r.v <= r.top <= r.v * 33 / 32 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_adaptive_verdict(spark):
    clean = " ".join(f"word{i} other" for i in range(40))
    rows = [(i, "en", f"s{i % 2}", clean + f" {i}", "") for i in range(300)]
    rows += [(1000 + i, "en", "s0", " ".join(f"w{k}$$$" for k in range(60)), "") for i in range(5)]
    rows += [(2000 + i, "en", "s1", clean.replace("other", "other#"), "") for i in range(5)]
    rows += [(3000, None, None, clean, ""), (3001, "en", None, None, ""), (3002, "xx", "s9", "short text", "")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(5))
    assert not any(got[2000 + i].kept for i in range(5))  # half a symbol a word where others have none
    assert got[3000].kept and got[3001].base_failed and got[3002].base_failed and len(got) == len(rows)


def test_a_source_with_its_own_manner_is_kept(spark):
    table = " | ".join(f"cell{i}" for i in range(80))
    rows = [(i, "en", "tables", table + f" {i}", "") for i in range(300)] + [(1000 + i, "en", "prose", " ".join(f"w{k}" for k in range(60)), "") for i in range(300)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).where("kept").count()
    assert got == 600


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
