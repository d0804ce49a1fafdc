import random
import re

import pytest

from callmetrics.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, like):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(jaccard.LOWER_TABLE))
        sets[i] = {tuple(w[k : k + like.n]) for k in range(len(w) - like.n + 1)} if len(w) >= like.n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= like.percent * len(x | y):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice((1, 2, 3, 5, 9, 12, 30, 80, 300)))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice((1, 1, 2, 4, 9))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), rng.choice((" ", "\n", "\t ")).join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "b"), (904, "B"), (905, "b\x1cb")]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1000), (5, 80, 1000), (2, 60, 3)])
def test_against_brute_force(spark, n, percent, block):
    like = jaccard.Similarity(n, percent)
    rows = corpus(n)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, size string").repartition(3)
    got = {r.doc_id: (r.size, r.component_id) for r in jaccard.near_components(frame, like, block_rows=block).collect()}
    assert got == brute(rows, like)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_truncated_and_appended_copies(spark, n, percent):
    like = jaccard.Similarity(n, percent)
    rng = random.Random(percent)
    texts = []
    for at in range(40):
        size = rng.choice((40, 100, 150, 400))
        base = [f"w{at}x{rng.randrange(10**9)}" for _ in range(size)]
        more = round(size * (1 - percent / 100) * rng.uniform(0.55, 0.95))
        texts += [base] * rng.choice((1, 1, 30))
        texts.append(base[:-more] if at % 3 == 0 else base + [f"new{at}x{k}" for k in range(more)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.size, r.component_id) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()}
    want = brute(rows, like)
    assert len({c for _, c in want.values()}) < 60
    assert got == want


def test_repeated_rows_nulls_and_empty(spark):
    like = jaccard.Similarity(3, 90)
    rows = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (3, "ONE two three four"), (None, "alone here now")]
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), like).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3)]
    assert jaccard.near_components(spark.createDataFrame([], "doc_id long, text string"), like).count() == 0


def test_bounds_never_exceed_what_similar_sets_share():
    for n in range(1, 700):
        for percent in (60, 80, 90, 100):
            like = jaccard.Similarity(3, percent)
            assert like.overlap(n) <= like.overlap_of_smaller(n) <= n
            assert 1 <= like.lead_as_member(n) <= like.lead_as_query(n) <= n


@pytest.mark.parametrize("block", [7, 1000])
def test_a_family_over_many_groups_and_blocks(spark, block):
    like = jaccard.Similarity(3, 90)
    rng = random.Random(block)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4, 7))):
            copy[rng.randrange(len(copy))] = f"new{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.size, r.component_id) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), like, block_rows=block).collect()}
    want = brute(rows, like)
    assert 1 < len({c for _, c in want.values()}) < 60
    assert got == want


def test_null_and_shared_ids(spark):
    like = jaccard.Similarity(2, 60)
    rows = [(None, "a b c d e f g h"), (5, "a b c d e f g x"), (7, "k l m n o p q r"), (7, "s t u v w x y z"), (9, "s t u v w x y !")]
    got = sorted(((r.doc_id or -1), r.component_id) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), like).collect())
    assert got == [(-1, 5), (5, 5), (7, 7), (7, 7), (9, 7)]
