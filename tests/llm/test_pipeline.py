import hashlib
import random

import corpus_pipeline
from callmetrics.llm import bpe
from callmetrics.llm.q_bpe import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(9973)}" for _ in range(n))


def test_stages_and_run(spark, tmp_path):
    passage = prose(999, 60)
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, prose(1), "en", "s0"), (101, prose(2).replace(" ", "  ", 3) + " extra", "en", "s1"), (102, "too short", "en", "s0"), (103, prose(50).replace(" ", "$$$ "), "en", "s0")]
    rows += [(104, prose(60) + "\n" + passage, "en", "s1"), (105, prose(61) + "\n" + passage + "\nend", None, None), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality_rules"]) == {*range(30), 100, 101, 104, 105}
    assert 100 not in seen["line_dedup"] and seen["line_dedup"][105] == prose(61) + "\nend" and seen["line_dedup"][104].endswith(passage)
    assert 101 not in seen["ngram_jaccard"] and set(seen["ngram_jaccard"]) == {*range(30), 104, 105}
    served = [(r.doc_id, r.text) for r in docs.collect()]
    with open(vocabulary_path(), encoding="utf-8") as file:
        coder = bpe.Bpe(file.read())
    want = sorted((i, hashlib.sha256(" ".join(map(str, coder.encode_batch([t])[0])).encode()).hexdigest()) for i, t in served)
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 30


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark, tmp_path):
    names = ("removed", "n_lines", "kept", "_id", "_k", "_key", "_taken", "others", "kept_id", "key", "size", "component_id", "n_words", "c")
    rows = [(i, prose(i), "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names))
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 0
