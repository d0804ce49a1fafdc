import random

import numpy as np
import pytest

from callmetrics.operators import allocate, splits


def plain_first_fit(sizes, target):
    taken, room = [], target
    for i, s in enumerate(sizes):
        if s <= room:
            taken.append(i)
            room -= s
    return taken, room


def test_tables_are_the_fold_and_compose():
    rng = random.Random(1)
    for n, target in ((0, 5), (10, 30), (700, 400), (2_000, 90)):
        sizes = [rng.choice((1, 1, 2, 5, 40)) for _ in range(n)]
        table = allocate.exit_rooms([np.array(sizes[:3], np.int32), np.array(sizes[3:], np.int32)], target)
        assert table.tolist() == [plain_first_fit(sizes, room)[1] for room in range(target + 1)]
        halves = [allocate.exit_rooms([np.array(part, np.int32)], target) for part in (sizes[: n // 2], sizes[n // 2 :])]
        assert halves[1][halves[0]].tolist() == table.tolist()


@pytest.mark.parametrize(("seed", "parts", "target"), [(1, 1, 50), (2, 9, 333), (3, 150, 700), (4, 7, 1)])
def test_first_fit_over_parts(spark, seed, parts, target):
    rng = random.Random(seed)
    sizes = [rng.choice((1, 2, 3, 10, 60)) for _ in range(400)]
    ranked = spark.createDataFrame([(f"g{i}", s, f"{i:05d}") for i, s in enumerate(sizes)], "g string, size long, rank_key string").repartition(3)
    taken, room = plain_first_fit(sizes, target)
    got = splits.first_fit(ranked, target, "g", parts).collect()
    assert sorted(r.g for r in got) == sorted(f"g{i}" for i in taken) and {r.total for r in got} == {target - room}


def test_first_fit_without_groups(spark):
    ranked = spark.createDataFrame([("a", 9, "k")], "g string, size long, rank_key string")
    assert splits.first_fit(ranked, 0, "g").count() == splits.first_fit(ranked, 5, "g").count() == splits.first_fit(ranked.limit(0), 5, "g").count() == 0


def plain_quotas(needs, names, rooms):
    rooms = {n: list(rooms[n]) for n in names}
    made = {}
    for i, need in enumerate(needs):
        fit = [n for n in names if all(x <= r for x, r in zip(need, rooms[n]))]
        if fit:
            name = min(fit, key=lambda n: (sum(rooms[n]), n))
            made[i] = name
            rooms[name] = [r - x for r, x in zip(rooms[name], need)]
    return made, rooms


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 12), (3, 40), (4, 40), (5, 25)])
def test_quotas_over_parts(spark, seed, parts):
    rng = random.Random(seed)
    kinds = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (1, 1, 0), (0, 3, 2), (9, 0, 1)]
    needs = [rng.choices(kinds, (20, 20, 10, 5, 3, 2, 1))[0] for _ in range(600)]
    rooms = {"test": [rng.randrange(90), 70, 40], "validation": [60, 20, rng.randrange(60)], "extra": [0, 11, 5]}
    frame = spark.createDataFrame([(i, f"{i:05d}", *n) for i, n in enumerate(needs)], "g long, rank_key string, a int, b int, c int").repartition(4)
    got, left = allocate.by_quota(frame, "g", ["a", "b", "c"], rooms, parts)
    want, room = plain_quotas(needs, sorted(rooms), rooms)
    assert {r.g: r.split for r in got.collect()} == want and left == room


def test_parts_settled_by_their_sums():
    names = ["a", "b"]
    assert allocate.leaves([([5, 0], [1, 0])], names, [[10, 4], [20, 9]]) == [[5, 4], [20, 9]]
    assert allocate.leaves([([15, 0], [1, 0])], names, [[10, 4], [20, 9]]) is None  # room runs short
    assert allocate.leaves([([5, 0], [1, 0])], names, [[0, 4], [20, 9]]) == [[0, 4], [15, 9]]  # closed for the pattern
    assert allocate.leaves([([0, 8], [0, 1])], names, [[10, 0], [9, 9]]) == [[10, 0], [9, 1]]
    assert allocate.leaves([([12, 0], [1, 0])], names, [[0, 9], [20, 0]]) is None  # the order turns


def test_sums_settle_long_runs(spark, monkeypatch):
    """Only parts near the ends of a quota are folded by themselves."""
    asked, leaves = [], allocate.leaves

    def counted(*args):
        asked.append(leaves(*args))
        return asked[-1]

    monkeypatch.setattr(allocate, "leaves", counted)
    frame = spark.range(4_000).selectExpr("id as g", "format_string('%05d', id) as rank_key", "int(id % 3 = 0) a", "int(id % 3 = 1) b", "int(id % 3 = 2) c")
    rooms = {"test": [300, 300, 300], "validation": [200, 200, 200]}
    got, left = allocate.by_quota(frame, "g", ["a", "b", "c"], rooms, 80)
    assert got.count() == 1_500 and sum(map(sum, left.values())) == 0
    assert sum(a is None for a in asked) <= 4 and len(asked) < 40
