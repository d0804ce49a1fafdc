import random

from callmetrics.llm.graph import components


def union(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_against_union_find(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(220)]
    pairs = [(a, b) for a, b in chain + star + loose + chain[:5] if a != b]
    rng.shuffle(pairs)
    frame = spark.createDataFrame(pairs + [(5, 5), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in components(frame).collect()} == union(pairs)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
