import random
import re

from callmetrics.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, first string, k1 string"


def plain(docs, least):
    """Every window that an earlier one equals goes, with neighbouring equal lines of fewer words."""
    seqs, first = {}, {}
    for i, text in sorted(docs):
        seqs[i] = [(x.strip(" \t\n\x0b\x0c\r"), len(WORD.findall(x)), k) for k, x in enumerate((text or "").split("\n")) if WORD.search(x)]
    spans = {i: [] for i in seqs}
    for i, lines in seqs.items():
        for a in range(len(lines)):
            total = 0
            for e in range(a, len(lines)):
                total += lines[e][1]
                if total >= least:
                    first.setdefault(tuple(x[0] for x in lines[a : e + 1]), (i, a, e))
                    spans[i].append((a, e))
                    break
    gone = {i: set() for i in seqs}
    for i, found in spans.items():
        lines = seqs[i]
        for a, e in found:
            f, fa, fe = first[tuple(x[0] for x in lines[a : e + 1])]
            if (f, fa) == (i, a):
                continue
            other, lo, hi = seqs[f], a, e
            while lo > 0 and fa - (a - lo) > 0 and lines[lo - 1][0] == other[fa - (a - lo) - 1][0] and sum(x[1] for x in lines[lo - 1 : a]) < least:
                lo -= 1
            while hi + 1 < len(lines) and fe + hi - e + 1 < len(other) and lines[hi + 1][0] == other[fe + hi - e + 1][0] and sum(x[1] for x in lines[e + 1 : hi + 2]) < least:
                hi += 1
            begin = lines[lo][2] if f != i else max(lines[lo][2], other[fe][2] + 1)
            gone[i].update(range(begin, lines[hi][2] + 1))
    return gone


def removed(spark, docs, least):
    frame = spark.createDataFrame([(i, t, "", "") for i, t in docs], SCHEMA).repartition(3)
    return {r.doc_id: r for r in line_dedup.dedup_lines(frame, least).collect()}


def test_against_plain_python(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(14)]
    docs = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 14))]
        docs.append((i, "\n".join(x + rng.choice(("", "", " ", "\n")) for x in lines)))
    got, want = removed(spark, docs, 10), plain(docs, 10)
    assert {i: set(r.removed) for i, r in got.items()} == want
    texts = dict(docs)
    for i, r in got.items():
        assert r.n_lines == len(texts[i].split("\n"))
        assert r.text == ("\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want[i]) if want[i] else texts[i])


def test_long_passage_short_lines_and_extension(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = [(1, f"one\n{passage}\ntail\nend one"), (2, f"two\n{passage}\ntail\nend two"), (3, "tail\nshort"), (4, f"{passage}x"), (5, passage + "\n" + passage)]
    got = removed(spark, docs, 50)
    assert got[1].removed == [] and got[2].text == "two\nend two" and got[3].removed == [] and got[4].removed == [] and got[5].text == ""


def test_nulls_repeats_and_empty(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, passage, "", ""), (3, passage, "", ""), (None, passage, "a", "b")], SCHEMA)
    got = line_dedup.dedup_lines(frame).collect()
    assert len(got) == 5 and [r.text for r in got if r.doc_id == 3] == ["", ""] and [r.text for r in got if r.doc_id is None] == [passage]
    assert [r.text for r in got if r.doc_id == 1] == [None]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a", "x", "y", "z")], "doc_id long, text string, removed string, id string, others string")
    made = line_dedup.dedup_lines(clash).first()
    assert (made.removed, made.id, made.others) == ([], "y", "z")


def test_minima_select_positions(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    text = "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string").select(line_dedup.text_lines(F.col("text")).alias("v"))
    row = frame.select("v", line_dedup.positions(F.col("v"), 50).alias("p")).first()
    a = row.v["a"]
    starts = [i for i in range(400) if sum(row.v["c"][i : i + 50]) >= 50]
    spans = [next(range(i, e) for e in range(i + 1, 401) if sum(row.v["c"][i:e]) >= 50) for i in starts]
    want = sorted({min(s, key=lambda j: (a[j], j)) for s in spans})
    assert sorted(row.p) == want and len(want) < len(starts) / 2


def test_an_id_with_two_texts_and_a_long_repeat(spark):
    passage = "\n".join(f"line {i} of a passage with some words" for i in range(3000))
    rows = [(1, passage), (2, "own start\n" + passage + "\nown end"), (2, "another text of the same id"), (3, passage + "\n" + passage)]
    got = sorted((r.doc_id, r.n_lines, len(r.removed), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3000, 0, passage), (2, 1, 0, "another text of the same id"), (2, 3002, 3000, "own start\nown end"), (3, 6000, 6000, "")]
