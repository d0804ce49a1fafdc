import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callmetrics.operators import splits


def union(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for i, keys in rows:
        for k in keys or []:
            a, b = root(i), root(first.setdefault(k, i))
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def keyed(seed, n=120, keys=70):
    rng = random.Random(seed)
    return [(i, [f"k{rng.randrange(keys)}" for _ in range(rng.choice((0, 1, 1, 2)))]) for i in range(n)]


SCHEMA = "id long, keys array<string>"


def rank(ids, seed=42):
    return hashlib.sha256(f"{seed}:".encode() + "\n".join(sorted(map(str, ids))).encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_whatever_the_order(spark, seed):
    rows = keyed(seed) + [(1000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(60)]
    want = union(rows)
    for part in (rows, rows[::-1]):
        frame = spark.createDataFrame(part, SCHEMA).repartition(3)
        assert {r.id: r.component for r in splits.components(frame, "id", F.col("keys")).collect()} == want


def groups_of(rows):
    groups = {}
    for i, c in union(rows).items():
        groups.setdefault(c, []).append(i)
    return sorted(groups.values(), key=rank)


def test_ranks_and_first_fit(spark):
    rows = keyed(5)
    members = splits.components(spark.createDataFrame(rows, SCHEMA), "id", F.col("keys"))
    ranked = splits.group_ranks(members, "id")
    assert [r.component for r in ranked.orderBy("rank_key").collect()] == [min(g) for g in groups_of(rows)]
    for target in (0, 1, 7, 40):
        taken, total = [], 0
        for g in groups_of(rows):
            if total + len(g) <= target:
                taken.append(min(g))
                total += len(g)
            if total == target:
                break
        got = splits.first_fit(ranked, target)
        assert sorted(r.component for r in got.collect()) == sorted(taken)
    big = spark.createDataFrame([(i, ["x"] if i < 10 else [f"y{i}"]) for i in range(13)], SCHEMA)
    ranked = splits.group_ranks(splits.components(big, "id", F.col("keys")), "id")
    with pytest.raises(splits.AllocationError):
        splits.require_exact(splits.first_fit(ranked, 5), 5, "test split").collect()
    assert splits.require_exact(splits.first_fit(ranked, 3), 3, "test split").count() == 3


def test_sequential_splits(spark):
    rows = [(i, [f"k{i // 2}"]) for i in range(20)]
    ranked = splits.group_ranks(splits.components(spark.createDataFrame(rows, SCHEMA), "id", F.col("keys")), "id")
    got = splits.sequential(ranked, {"train": 12, "test": 4})
    assert Counter(r.split for r in got.collect()) == {"train": 6, "test": 2}


def test_quotas(spark):
    frame = spark.createDataFrame([("1", 10), ("2-4", 10), (">=5", 10)], "stratum string, n long")
    assert [r.quota for r in splits.quotas(frame, 7).orderBy("stratum").collect()] == [3, 2, 2]
    assert sum(r.quota for r in splits.quotas(frame, 30).collect()) == 30


def test_stratified_against_plain_python(spark):
    rows = keyed(9, 200, 150)
    strata = {i: splits.STRATA[i % 3] for i, _ in rows}
    members = splits.components(spark.createDataFrame(rows, SCHEMA), "id", F.col("keys")).withColumn("stratum", F.element_at(F.array(*map(F.lit, splits.STRATA)), (F.col("id") % 3 + 1).cast("int")))
    targets = {"validation": 30, "test": 45}
    counts = Counter(strata.values())
    room = {}
    for name, t in targets.items():
        exact = {s: t * n / len(rows) for s, n in counts.items()}
        base = {s: int(v) for s, v in exact.items()}
        for s in sorted(exact, key=lambda s: (-(exact[s] - base[s]), s))[: t - sum(base.values())]:
            base[s] += 1
        room[name] = base
    want = {}
    for g in groups_of(rows):
        need = Counter(strata[i] for i in g)
        fit = [n for n in targets if all(need[s] <= room[n][s] for s in need)]
        if fit:
            name = min(fit, key=lambda n: (sum(room[n].values()), n))
            want[min(g)] = name
            for s in need:
                room[name][s] -= need[s]
    got = {r.component: r.split for r in splits.stratified(members, "id", targets).collect()}
    assert got == want
    made = members.join(splits.stratified(members, "id", targets), "component")
    assert all(r.ok for r in splits.checks(made, "id", targets).collect()) and splits.leaking(made).count() == 0


def test_exclusions_are_transitive_or_not(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"])], SCHEMA)
    locked = spark.createDataFrame([(9, ["a"])], SCHEMA)
    assert [r.id for r in splits.without_locked_components(rows, locked, "id", F.col("keys")).collect()] == [4]
    assert [r.id for r in splits.without_shared_keys(rows, locked, "id", F.col("keys")).orderBy("id").collect()] == [3, 4]


def test_ood_split_returns_what_whole_components_give(spark, tmp_path):
    """6,000 suppliers, of whose keys few are free: no components add up to 20 rows, which the query's SQL doesn't ask for."""
    import duckdb

    from callmetrics.plans import study

    rows = spark.createDataFrame([(i, [f"k{i // 3}"]) for i in range(30)], SCHEMA)
    assert splits.schema_ood_test(rows, rows.where("id < 3"), "id", F.col("keys"), 7, strict=False).count() == 6
    spark.range(6000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
        want = sorted(duck.execute(study.SQL["ood_split"]).fetchall())
    assert len(want) == 19 and sorted(map(tuple, study.ood_split(spark, str(tmp_path)).collect())) == want


def test_ood_and_nested_subset(spark):
    rows = spark.createDataFrame([(i, [f"k{i // 3}"]) for i in range(30)], SCHEMA)
    locked = rows.where("id < 3")
    got = [r.id for r in splits.schema_ood_test(rows, locked, "id", F.col("keys"), 6).collect()]
    assert len(got) == 6 and len({i // 3 for i in got}) == 2 and min(got) >= 3
    with pytest.raises(splits.AllocationError):
        splits.schema_ood_test(rows, locked, "id", F.col("keys"), 7).count()
    members = splits.components(rows, "id", F.col("keys"))
    assert splits.nested_subset(members, "id", 30).count() == 30 and splits.nested_subset(members, "id", 9).count() == 9
    with pytest.raises(splits.AllocationError):
        splits.nested_subset(members, "id", 0)


def test_nested_allocation(spark):
    schema = "id long, q string, prefix string, tools int, rendered_length int"
    rows = spark.createDataFrame([(i, f"q{i if i % 10 else i - 1 if i else 0}", f"p{i}", 1 + i % 6, 256 if i < 200 else 1024) for i in range(260)], schema)
    sizes = {"ood": 10, "validation": 12, "test": 18, "core": 80, "smoke": 20, "full": 120}
    made = splits.nested_allocation(rows, "id", F.array(F.concat(F.lit("query:"), "q")), F.array(F.concat(F.lit("prefix:"), "prefix")), F.col("tools"), sizes)
    held = {}
    for r in made.collect():
        held.setdefault((r.version, r.split), set()).add(r.id)
    assert len(held["schema_ood", "test"]) == 10 and len(held["core", "train"]) == 80 and len(held["full", "train"]) == 120
    assert held["smoke", "train"] <= held["core", "train"] <= held["full", "train"]
    assert all(i < 200 for i in held["core", "train"] | held["core", "test"] | held["schema_ood", "test"])
    assert not held["full", "train"] & (held["core", "validation"] | held["core", "test"] | held["schema_ood", "test"])


def test_hashes_and_lists(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "p int, v string")
    assert splits.list_hash(rows, "v", "p").first().content_hash == hashlib.sha256(b"a\nb\nc").hexdigest()
    other = spark.createDataFrame([(1, "a"), (2, "x")], "p int, v string")
    assert sorted(r["at"] for r in splits.same_lists(rows, other, "v", "p").collect()) == [2, 3]
    with pytest.raises(splits.AllocationError):
        splits.top_per_group(rows.withColumn("g", F.lit("x")), "g", "v", 4)
    queue = [r.v for r in splits.audit_queue(rows, "v", 2).orderBy("rank").collect()]
    assert queue == sorted("abc", key=lambda v: hashlib.sha256(f"42:{v}".encode()).hexdigest())[:2]
