from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from callmetrics.llm import mixing

SCHEMA = "doc_id long, source string, text string, target string"


def by_steps(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by dealing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return target
        rest = left - sum(target[s] for s in full)
        deal = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if deal[s] > repeats * sizes[s]]
        if not over:
            return target | deal
        for s in over:
            target[s] = repeats * sizes[s]
            full.add(s)


def mixed(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    return mixing.per_document(mixing.mix(frame, **more)).collect()


def test_targets_and_taken(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, "w " * (i % 50), "x") for i in range(400)] + [(1000, "s1", "long " * 5000, None), (None, "s2", "a b", None), (7, "s0", None, None)]
    for ranges in (20, 5000):
        got = mixed(spark, rows, rows_per_range=ranges)
        assert len(got) == len(rows)
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
        want = by_steps(sizes)
        budget = int(1.5 * sum(sizes.values()))
        most = max(r.size for r in got)
        for s in sizes:
            assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1.5 * most
        assert sum(taken.values()) == budget
        assert sum(r.taken not in (0, r.size, 2 * r.size) for r in got) <= 1  # only the document at the budget is cut


def test_the_queue_decides(spark):
    """Against a queue in plain Python: whole documents by finish time until the budget ends."""
    rows = [(i, f"s{i % 4}", "w " * (1 + i * 7 % 31), "") for i in range(200)] + [(900, "s3", "w " * 700, "")]
    servings = mixing.mix(spark.createDataFrame(rows, SCHEMA), rows_per_range=9).collect()
    by_source, size = defaultdict(list), defaultdict(int)
    for i, source, text, _ in rows:
        by_source[source].append((next(r.key for r in servings if r.doc_id == i), i, len(text.split())))
        size[source] += len(text.split())
    target, line = by_steps(size), []
    for source, docs in by_source.items():
        done = 0
        for epoch in (0, 1):
            for key, i, n in sorted(docs):
                done += n
                line.append((done / target[source], source, key, i, epoch, n))
    left, want = int(1.5 * sum(size.values())), {}
    for _, _, _, i, epoch, n in sorted(line):
        want[i, epoch] = min(n, left)
        left -= want[i, epoch]
    assert {(r.doc_id, r.epoch): r.taken for r in servings} == want


def test_reruns_agree_and_repeated_rows(spark):
    rows = [(i % 5, "a", "x y z", "") for i in range(50)] + [(i, "b", "q " * i, "") for i in range(30)]
    key = lambda r: tuple(map(str, r))
    first = sorted(mixed(spark, rows), key=key)
    assert first == sorted(mixed(spark, rows[::-1]), key=key)
    assert sum(r.size for r in first if r.source == "a") == 150 and len(first) == 80


def test_order_is_by_finish_time(spark):
    rows = [(i, f"s{i % 3}", "w " * (1 + i % 9), "") for i in range(90)]
    got = sorted((r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), rows_per_range=10).collect() if r.taken), key=lambda r: r.before)
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert [r.before for r in got] == [sum(x.taken for x in got[:i]) for i in range(len(got))]


def test_empty(spark):
    assert mixed(spark, []) == []
    assert [r.taken for r in mixed(spark, [(1, "a", "", ""), (2, None, None, "")])] == [0, 0]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 1000), min_size=1))
def test_dealing_ends_at_the_budget(sizes):
    assert abs(sum(by_steps(sizes).values()) - 1.5 * sum(sizes.values())) < 1e-6
