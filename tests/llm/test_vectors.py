import numpy as np

from callmetrics.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, cid string, m string"


def rows_of(x, start=0):
    return [(start + i, [float(v) for v in np.float32(r)], "", "") for i, r in enumerate(x)]


def brute(rows, least=0.95):
    x = vectors.unit([r[1] for r in rows])
    near = x @ x.T >= least
    ids = [r[0] for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return {ids[i]: (int(near[i].sum()) - 1, ids[root(i)]) for i in range(len(rows))}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 16)) * 0.12, rng.normal(size=(300, 16)), np.repeat(base[:1], 40, 0)])
    rows = rows_of(x)
    want = brute(rows)
    for index in (vectors.Index(shard_rows=120, block_rows=10_000, nearly=0.6), vectors.Index(shard_rows=300, block_rows=70, nearly=0.6)):
        got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), index=index)
        found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
        links = sum(n for n, _ in want.values())
        assert sum(min(found[i][0], want[i][0]) for i in want) >= 0.98 * links
        assert all(found[i][0] <= want[i][0] for i in want)
        assert sum(found[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
        assert vectors.audit_recall(spark.createDataFrame(rows, SCHEMA), got) >= 0.95


def test_a_hot_group_over_many_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2400, 64))
    x[::3] = rng.normal(size=64) + rng.normal(size=(800, 64)) * 0.15
    rows = rows_of(x)
    want = brute(rows)
    assert min(want[i][0] for i in range(0, 2400, 3)) > 700
    for index in (vectors.Index(shard_rows=40), vectors.Index(shard_rows=40, block_rows=300)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), index=index).collect()}
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
        assert all(got[i][1] == want[i][1] for i in want)


def test_clusters_by_levels(spark, monkeypatch):
    """Three clusters a level: large shards part again and again, a hot group stays whole, links are still all found."""
    rng = np.random.default_rng(7)
    centers = np.repeat(rng.normal(size=(6, 24)), 4, 0) + 0.6 * rng.normal(size=(24, 24))
    x = np.repeat(centers, 60, 0) + 0.25 * rng.normal(size=(1440, 24))
    x = np.concatenate([x, centers[5] + 0.1 * rng.normal(size=(500, 24))])
    rows = rows_of(x)
    want = brute(rows)
    sizes, plain = [], vectors.by_levels

    def watched(members, least, index):
        before = members.groupBy("shard").count().collect()
        made = plain(members, least, index)
        after = made.groupBy("shard").count().collect()
        homes = made.where("home = shard").count()
        sizes.append((len(before), len(after), max(r["count"] for r in after), homes))
        return made

    monkeypatch.setattr(vectors, "by_levels", watched)
    index = vectors.Index(shard_rows=60, most_clusters=3, sample=700)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), index=index).collect()}
    before, after, largest, homes = sizes[0]
    assert before <= 3 and after > 9 and homes == len(rows) and 500 <= largest < 1000
    assert len(got) == len(rows) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "", ""), (2, [2.0, 0.0], "", ""), (3, None, "", ""), (4, [], "", ""), (5, [0.0, 0.0], "", ""), (6, [nan, 1.0], "", ""), (7, [inf, 1.0], "", ""), (8, [None, 1.0], "", ""), (9, [1.0, 0.0, 0.0], "", ""), (9, [1.0, 0.0, 0.0], "", ""), (None, [1.0, 0.0], "", "")]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 9)], (9, 1, 9, True), (9, 1, 9, True)]
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_vector_is_reached():
    x = vectors.unit(np.concatenate([np.random.default_rng(0).normal(size=(30, 8)) * 0.01 + c for c in np.eye(8)[:5]]))
    lists = vectors.build_graph(x, vectors.Index(candidates=10, degree=4))
    seen, fresh = set(), [vectors.medoid(x)]
    while fresh:
        i = fresh.pop()
        if i not in seen:
            seen.add(i)
            fresh += lists[i].tolist()
    assert len(seen) == len(x)


def test_planted_links_just_over_the_bar(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    rows, n = [], 0
    for _ in range(12):  # several clusters, each with pairs whose cosine is 0.950 to 0.960
        center = rng.normal(size=32)
        for _ in range(60):
            x = center + 0.8 * rng.normal(size=32)
            x /= np.linalg.norm(x)
            side = rng.normal(size=32)
            side -= (side @ x) * x
            cosine = rng.uniform(0.9501, 0.96)
            y = cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
            rows += [(n, x.tolist()), (n + 1, y.tolist())]
            n += 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.near_duplicates(frame, index=vectors.Index(shard_rows=120))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.95).sum(1) - 1
    got = np.array([r.n_links for r in found.orderBy("vec_id").collect()])
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum() and true.sum() >= n
    assert vectors.audit_recall(frame, found) >= 0.99
    alone = spark.createDataFrame([(i, np.eye(32)[i].tolist()) for i in range(9)], frame.schema)
    assert vectors.audit_recall(alone, vectors.near_duplicates(alone)) is None


def test_vectors_without_structure_are_in_few_shards(spark, monkeypatch):
    """Unstructured vectors with planted links just over the bar: few copies in the input's own type, links counted at both ends."""
    rng = np.random.default_rng(21)
    x = vectors.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=(600, 64))
    side = vectors.unit(side - (side * x[:600]).sum(1, keepdims=True) * x[:600])
    cosine = rng.uniform(0.9501, 0.956, (600, 1))
    x = np.concatenate([x, cosine * x[:600] + np.sqrt(1 - cosine**2) * side])
    rows = rows_of(x)
    want = brute(rows)
    seen, plain = [], vectors.by_levels

    def watched(members, least, index):
        made = plain(members, least, index)
        seen.append((made.count(), dict(made.dtypes)["vector"]))
        return made

    monkeypatch.setattr(vectors, "by_levels", watched)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), index=vectors.Index(shard_rows=100)).collect()}
    members, kind = seen[0]
    assert members < 5 * len(rows) and kind == "array<float>"
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)
    assert sum(n for n, _ in got.values()) % 2 == 0


def test_a_margin_of_half_a_link_loses_none():
    """Links along the line between two centers, the worst direction: one end is always within half their length."""
    rng = np.random.default_rng(4)
    centers = vectors.unit(rng.normal(size=(12, 6)))
    x = vectors.unit(rng.normal(size=(4000, 6)))
    toward = centers[rng.integers(0, 12, 4000)] - centers[(x @ centers.T).argmax(1)]
    side = toward - (toward * x).sum(1, keepdims=True) * x
    some = np.linalg.norm(side, axis=1) > 1e-9
    x, side = x[some], vectors.unit(side[some])
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * side
    region = np.arange(12)
    half = vectors.margin_of(x, centers, 0.95, vectors.Index(nearly=9.0))
    (home_x, in_x), (home_y, in_y) = (vectors.placed_in(v, centers, region, half) for v in (x, y))
    assert sum(a != b for a, b in zip(home_x, home_y, strict=True)) > 500
    assert all(a in v or b in u for a, b, u, v in zip(home_x, home_y, in_x, in_y, strict=True))
    assert vectors.margin_of(x, centers, 0.95, vectors.Index()) <= half


def test_searches_from_their_own_place_are_exact():
    rng = np.random.default_rng(9)
    x = vectors.unit(np.repeat(rng.normal(size=(80, 32)), 10, 0) + 0.2 * rng.normal(size=(800, 32)))
    lists = vectors.build_graph(x, vectors.Index())
    hit = np.zeros((800, 800), dtype=bool)
    for i, j in vectors.range_search(x, lists, np.arange(800), x, 0.95, 12):
        hit[i, j] = True
    assert (hit == (x @ x.T >= 0.95)).all() and hit.sum() > 2000
