"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors form classes first. Centroids of a spherical k-means, fitted on a bounded sample, cut the classes into
clusters, and clusters whose centroids lie within the angle of a link form one region, so that a dense group is never
cut by its clusters. A class is at home in the region of its nearest cluster and a guest in every region with a cluster
whose bisecting plane with the nearest one is within a margin of it, however many. The ends of a link that lie on two
sides of a plane are together no farther from it than they are apart along its normal, so one of them is within half of
that: a margin of half a link's length loses no link, and the margin taken is what 999 of 1,000 probe links of the bare
length need on the sample, in random directions and in those between its vectors, if that is less. A region that is still
large is cut in the same way by centroids of its own, level by level. On every region's shard a graph is built: each
vector's nearest candidates and some far ones are pruned robustly (a candidate goes when a chosen neighbour is nearer
to it by a factor than the vector is), edges are made mutual and what the shard's medoid can't reach is tied to its
nearest reached vector. The adjacency lists of a class from all its shards are united: a shard hands each edge on to
the other shards that hold both ends. Every class is then a query in its home shard: a greedy search, from its own
place in the graph or from the medoid of a block that lacks it, keeps a short list of the best and expands whatever it
meets in range, so that it returns the whole range and not a fixed number; a query that met ``dense`` of them is
compared with the whole block instead. Cosines are computed in double precision from the vectors themselves, which
verifies every link. ``audit_recall`` compares a bounded set of queries with brute force over all vectors, in blocks.

A shard of more than ``block_rows`` members at home, or four times as many with guests, is cut into blocks with a graph
each; a task takes two blocks, and the queries of each search the other. A link belongs to one shard, the smaller of its ends' homes where each end is a guest
of the other's, and is counted there for both ends, whichever found it. Links leave a task as counts and a spanning
forest, never as pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths don't link; equal vectors link; a null vec_id counts as a row
whose id is never the smallest; repeated rows are equal vectors; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.common import cut, discard, small_or_not, stored
from callmetrics.llm.graph import components


@dataclass(frozen=True)
class Index:
    """Parameters of the graph index. ``sample`` bounds the rows that the centroids are fitted on."""

    shard_rows: int = 1_500
    block_rows: int = 4_000
    most_clusters: int = 1_024  # of one level
    levels: int = 4
    sample: int = 20_000
    nearly: float | None = None  # greatest distance of a guest from the bisecting plane; None: measured on the sample
    dense: int = 64  # vectors in range from which a query is compared with its whole block
    degree: int = 16
    candidates: int = 48
    alpha: float = 1.2
    keep: int = 12  # length of the greedy search's short list
    seed: int = 5


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def regions(centroids: np.ndarray, least: float) -> np.ndarray:
    """The region of each cluster: the smallest cluster that a chain of centroids with cosines >= least leads to."""
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    c = centroids / np.where(norms > 0, norms, 1)
    near = c @ c.T >= least
    region = np.full(len(c), -1)
    for i in range(len(c)):
        fresh = np.array([i]) if region[i] < 0 else np.zeros(0, dtype=np.int64)
        while len(fresh):
            region[fresh] = i
            fresh = np.nonzero(near[fresh].any(0) & (region < 0))[0]
    return region


def forest_of(hit: np.ndarray, asked: np.ndarray, held: np.ndarray) -> dict[int, int]:
    """The smallest id in the component of every id with a hit; rows have the ids ``asked``, columns ``held``."""
    place = {c: j for j, c in enumerate(held.tolist())}
    same = np.array([place.get(c, -1) for c in asked.tolist()], dtype=np.int64)
    row_of = np.full(len(held), -1)
    row_of[same[same >= 0]] = np.nonzero(same >= 0)[0]
    waiting, unmet = hit.any(1), np.ones(len(held), dtype=bool)
    root: dict[int, int] = {}
    for i in np.nonzero(waiting)[0].tolist():
        if not waiting[i]:
            continue
        fresh, found = np.array([i]), []
        while len(fresh):
            waiting[fresh] = False
            found.append(asked[fresh])
            cols = hit[fresh].any(0)
            cols[same[fresh][same[fresh] >= 0]] = True
            cols = np.nonzero(cols & unmet)[0]
            unmet[cols] = False
            found.append(held[cols])
            back = hit[:, cols].any(1)
            back[row_of[cols][row_of[cols] >= 0]] = True
            fresh = np.nonzero(back & waiting)[0]
        ids = np.unique(np.concatenate(found)).tolist()
        root.update(dict.fromkeys(ids, ids[0]))
    return root


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, index: Index) -> list[np.ndarray]:
    """Mutual adjacency lists of unit vectors, all of which the medoid reaches."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    rng = np.random.default_rng(index.seed)
    single = x.astype(np.float32)  # distances that choose edges; links are verified in double precision
    near = min(index.candidates, n - 1)
    far = rng.integers(0, n, (n, index.degree))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, n, 512):
        apart = np.maximum(0, 2 - 2 * (single[low : low + 512] @ single.T))
        rows = np.arange(len(apart))
        apart[rows, low + rows] = np.inf
        pool = np.concatenate([np.argpartition(apart, near - 1, axis=1)[:, :near], far[low : low + 512]], axis=1)
        gap = np.take_along_axis(apart, pool, 1)
        order = np.argsort(gap, axis=1, kind="stable")
        pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
        held = single[pool]
        among = np.maximum(0, 2 - 2 * (held @ held.transpose(0, 2, 1)))
        alive = np.isfinite(gap)
        for _ in range(index.degree):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            chosen = pool[rows, first]
            edges.append((low + rows[some], chosen[some]))
            alive[rows, first] = False
            alive &= ~(index.alpha * among[rows, first] <= gap)
            alive &= pool != chosen[:, None]
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    lists = np.split(b, np.searchsorted(a, np.arange(1, n)))
    start = medoid(x)
    reached = np.zeros(n, dtype=bool)

    def reach(fresh: list[int]) -> None:
        while fresh:
            reached[fresh] = True
            after = np.unique(np.concatenate([lists[i] for i in fresh]))
            fresh = after[~reached[after]].tolist()

    reach([start])
    while not reached.all():
        outside = np.nonzero(~reached)[0][:512]
        inside = np.nonzero(reached)[0]
        block = single[outside] @ single[inside].T
        at = int(block.max(1).argmax())
        i, j = int(outside[at]), int(inside[block[at].argmax()])
        lists[i], lists[j] = np.append(lists[i], j), np.append(lists[j], i)
        reach([i])
    return lists


def range_search(x: np.ndarray, lists: list[np.ndarray], entries: np.ndarray, queries: np.ndarray, least: float, keep: int, width: int = 4, dense: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, numbers of base vectors), pairs with cosine >= least that the searches met. A search starts at
    its entry; its list holds the best ``keep`` and, being ``dense`` longer, all that is in range."""
    n, deepest = len(x), max((len(v) for v in lists), default=0)
    links = np.full((n + 1, max(deepest, 1)), n)
    for i, v in enumerate(lists):
        links[i, : len(v)] = v
    for low in range(0, len(queries), 256):
        q = queries[low : low + 256]
        seen = np.zeros((len(q), n + 1), dtype=bool)
        seen[:, n] = True
        ids = np.full((len(q), keep + dense), n)
        score = np.full(ids.shape, -np.inf)
        fresh = np.zeros(ids.shape, dtype=bool)  # not expanded
        whole = np.zeros(len(q), dtype=bool)
        every = np.arange(len(q))
        ids[:, 0], fresh[:, 0] = entries[low : low + 256], True
        score[:, 0] = np.einsum("ij,ij->i", q, x[ids[:, 0]])
        seen[every, ids[:, 0]] = True
        active = every
        while len(active):
            mine = score[active]
            bar = -np.partition(-mine, keep - 1, axis=1)[:, keep - 1]
            mine = np.where(fresh[active], mine, -np.inf)
            best = np.argpartition(-mine, width - 1, axis=1)[:, :width]
            value = np.take_along_axis(mine, best, 1)
            worth = (value > -np.inf) & ((value >= bar[:, None]) | (value >= least))
            some = worth.any(1)
            active, best, worth = active[some], best[some], worth[some]
            if not len(active):
                break
            row, col = np.nonzero(worth)
            fresh[active[row], best[row, col]] = False
            at = ids[active[row], best[row, col]]
            met, who = links[at].ravel(), np.repeat(active[row], links.shape[1])
            new = ~seen[who, met]
            pairs = np.unique(who[new] * (n + 1) + met[new])
            if not len(pairs):
                continue
            who, what = pairs // (n + 1), pairs % (n + 1)
            seen[who, what] = True
            value = np.einsum("ij,ij->i", q[who], x[what])
            lines, first, count = np.unique(who, return_index=True, return_counts=True)
            place = np.repeat(np.arange(len(lines)), count), np.arange(len(who)) - np.repeat(first, count)
            more_ids, more = np.full((len(lines), count.max()), n), np.full((len(lines), count.max()), -np.inf)
            more_ids[place], more[place] = what, value
            all_ids, all_scores = np.concatenate([ids[lines], more_ids], axis=1), np.concatenate([score[lines], more], axis=1)
            all_fresh = np.concatenate([fresh[lines], np.isfinite(more)], axis=1)
            top = np.argpartition(-all_scores, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[lines], score[lines], fresh[lines] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_scores, all_fresh))
            whole[lines] = (score[lines] >= least).sum(1) >= dense
            active = active[~whole[active]]
        row, col = np.nonzero((score >= least) & ~whole[:, None])
        yield low + row, ids[row, col]
        if whole.any():
            row, col = np.nonzero(q[whole] @ x.T >= least)
            yield low + every[whole][row], col


def behind(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the nearest unit center, and the distances from its bisecting planes with all centers."""
    near = x @ centers.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(1e-18, 2 - 2 * (centers @ centers.T)))
    return home, (near[np.arange(len(x)), home][:, None] - near) / apart[home]


def margin_of(sample: np.ndarray, centers: np.ndarray, least: float, index: Index, share: float = 0.999, probes: int = 4_000) -> float:
    """The distance from a bisecting plane within which one end of a link lies: half a link's length always, and less
    if that is so for ``share`` of probes with the cosine ``least``, both of those in random directions and of those
    in directions between vectors of the sample, which keep to the space that the vectors fill."""
    half = float(np.sqrt(max(0.0, 2 - 2 * least))) / 2
    if index.nearly is not None or len(sample) < 2:
        return half if index.nearly is None else min(index.nearly, half)
    rng = np.random.default_rng(index.seed)
    x = sample[rng.integers(0, len(sample), probes)]
    needs = []
    for aim in (rng.normal(size=x.shape), sample[rng.integers(0, len(sample), probes)] - sample[rng.integers(0, len(sample), probes)]):
        side = aim - (aim * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(side, axis=1)
        apart = length > 1e-6  # equal vectors give no direction
        if not apart.any():
            continue
        a = x[apart]
        b = least * a + np.sqrt(1 - least**2) * side[apart] / length[apart, None]
        (home_a, from_a), (home_b, from_b) = behind(a, centers), behind(b, centers)
        rows = np.arange(len(a))
        needs.append(float(np.quantile(np.minimum(from_a[rows, home_b], from_b[rows, home_a]), share)))
    return min(half, max(needs, default=half))


def fitted_clusters(sample: np.ndarray, rows: int, least: float, index: Index) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids, their regions and the guests' margin, fitted on a sample of ``rows`` vectors."""
    centers = fit_centroids(sample, int(min(index.most_clusters, max(1, -(-rows // index.shard_rows)))), index.seed)
    return centers, regions(centers, least), margin_of(sample, centers, least, index)


def placed_in(x: np.ndarray, centers: np.ndarray, region: np.ndarray, margin: float | np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Of unit vectors: the region of the nearest center, and all regions with a center whose plane is within ``margin``
    (one number, or one a vector)."""
    homes, near = [], []
    margins = np.broadcast_to(margin, len(x))
    for low in range(0, len(x), 2_000):
        home, far = behind(x[low : low + 2_000], centers)
        row, col = np.nonzero(far <= margins[low : low + 2_000, None])
        pairs = np.unique(row * len(centers) + region[col])
        homes += region[home].tolist()
        near += [v.tolist() for v in np.split(pairs % len(centers), np.searchsorted(pairs // len(centers), np.arange(1, len(home))))]
    return homes, near


def by_levels(members: DataFrame, least: float, index: Index) -> DataFrame:
    """``members`` (cid, m, vector, home, shards, shard) with every shard of more than twice ``shard_rows`` members at
    home cut into clusters of its own, level by level, so that shards stay small however many vectors there are.

    A shard's centroids are fitted in one task on about ``sample`` of its members and carried to all of them, dealt
    over tasks of about ``sample`` rows. Guests search elsewhere, so of a link only the guest's own distance counts, and
    its margin is doubled. A shard that its own clusters don't part (a dense group is one region) stays whole; so does
    what is left after ``levels``. Blocks cover such a shard in full. Only vectors of shards that are cut are stored
    again, for the next level; the others keep their ids and shards.
    """
    rows = members.select("cid", "vector", "shard", (F.col("home") == F.col("shard")).alias("own"))
    names = rows.columns
    kind = dict(rows.dtypes)["vector"]
    settled: list[DataFrame] = []
    written: list[DataFrame] = []

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cid")
        x = unit(frame["vector"])
        centers, region, margin = fitted_clusters(x, int(frame["rows"].iloc[0]), least, index)
        held = np.bincount(np.concatenate(placed_in(x, centers, region, margin)[1]))
        parts = 2 * int((held**2).sum()) < len(x) ** 2  # the comparisons that are left
        made = [(int(frame["shard"].iloc[0]), int(frame["rows"].iloc[0]), centers.tolist(), region.tolist(), margin)] if parts else []
        return pd.DataFrame(made, columns=["shard", "rows", "centers", "region", "margin"])

    def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=[*names, "leaf"], dtype=object)
        centers = np.array([np.asarray(c) for c in right["centers"].iloc[0]])
        margin = float(right["margin"].iloc[0])
        home, near = placed_in(unit(left["vector"]), centers, np.asarray(right["region"].iloc[0]), np.where(left["own"], margin, 2 * margin))
        made = left[names].assign(first=home, leaf=near).explode("leaf")
        made["own"] = made["own"] & (made["first"] == made["leaf"])
        return made.drop(columns="first")

    for _ in range(index.levels):
        counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("at_home"))
        large = cut(counts.where(F.col("at_home") > 2 * index.shard_rows).select("shard", "rows"))
        if not large.count():
            break
        chance = F.lit(1_000_000) * F.least(F.lit(1.0), F.lit(index.sample) / F.col("rows"))
        picked = rows.join(small_or_not(large), "shard").where(F.pmod(F.xxhash64(F.lit(index.seed + 1), "cid"), F.lit(1_000_000)) < chance)
        fitted = cut(picked.select("cid", "shard", "rows", "vector").groupBy("shard").applyInPandas(fit, "shard long, rows long, centers array<array<double>>, region array<int>, margin double"))
        if not fitted.count():
            break
        deals = F.ceil(F.col("rows") / index.sample).cast("int")
        parted = cut(fitted.select("shard", deals.alias("deals")))
        left = rows.join(small_or_not(parted), "shard").withColumn("deal", F.pmod("cid", "deals").cast("int")).groupBy("shard", "deal")
        right = fitted.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).groupBy("shard", "deal")
        dealt = left.cogroup(right).applyInPandas(deal, f"cid long, vector {kind}, shard long, own boolean, leaf long")
        settled.append(rows.join(small_or_not(parted), "shard", "left_anti").select("cid", "shard", "own"))
        rows = stored(dealt.select("cid", "vector", F.xxhash64("shard", "leaf").alias("shard"), "own"), "vector-members")
        written.append(rows)
    if not written:
        return members
    for part in settled:
        rows = rows.select("cid", "shard", "own").unionByName(part)
    owners = cut(rows.groupBy("cid").agg(F.max(F.when(F.col("own"), F.col("shard"))).alias("home"), F.collect_set("shard").alias("shards")))
    discard(*written)
    once = members.where("home = shard").select("cid", "m", "vector")
    return once.join(owners, "cid").withColumn("shard", F.explode("shards"))


def placed_classes(classes: DataFrame, least: float, index: Index) -> DataFrame:
    """Stored ``classes`` (cid, vector and others) with the shard they are at home in and all their shards."""
    n = classes.count()
    share = min(1.0, index.sample / max(n, 1))
    chosen = classes.where(F.pmod(F.xxhash64(F.lit(index.seed), "cid"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))).orderBy("cid").limit(index.sample)
    rows = chosen.select("vector").collect()  # at most index.sample rows
    length = len(rows[0]["vector"]) if rows else 0
    held = unit([r["vector"] for r in rows if len(r["vector"]) == length]) if rows else np.zeros((0, 1))
    fitted = fitted_clusters(held, n, least, index) if rows else (np.zeros((1, 1)), np.zeros(1, dtype=np.int64), 0.0)
    shared = classes.sparkSession.sparkContext.broadcast(fitted)  # most_clusters rows at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers, region, margin = shared.value
        for batch in batches:
            fits = batch["vector"].map(len) == centers.shape[1]
            homes = [-len(v) for v in batch["vector"]]
            shards = [[h] for h in homes]
            at = np.nonzero(fits)[0].tolist()
            if at:
                for i, home, near in zip(at, *placed_in(unit(batch["vector"][fits]), centers, region, margin), strict=True):
                    homes[i], shards[i] = home, near
            yield batch.assign(home=homes, shards=shards)

    schema = ", ".join(f"{name} {kind}" for name, kind in classes.dtypes)
    return stored(classes.mapInPandas(assign, f"{schema}, home long, shards array<long>"), "vector-placed")


def link_classes(placed: DataFrame, least: float, index: Index) -> tuple[DataFrame, DataFrame]:
    """From placed classes (cid, m, vector, home, shards): counts (cid, found), vectors linked directly, and forest edges
    (a, b)."""
    members = by_levels(placed.select("cid", "m", "vector", "home", "shards").withColumn("shard", F.explode("shards")), least, index)
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("home") == F.col("shard")).alias("at_home"))
    parts = F.ceil(F.greatest("at_home", F.col("rows") / 4) / index.block_rows).cast("int")
    counted = cut(sizes.select("shard", parts.alias("blocks")))
    blocks = small_or_not(counted)
    many = {r["shard"]: r["blocks"] for r in counted.where("blocks > 1").collect()}  # fewer than members / block_rows

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row to every pair of its block with a block of its shard, itself included."""
        cells = rows.join(blocks, "shard")
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return cells.select("shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *[c for c in rows.columns if c != "shard"])

    block_of = F.pmod("cid", "blocks").cast("int").alias("block")
    pairs = dealt(members.join(blocks, "shard").select("shard", block_of, "cid", "m", "vector", "home", "shards"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["low"].iloc[0] != frame["high"].iloc[0]:
            return pd.DataFrame([], columns=["shard", "block", "ids", "counts", "near"], dtype=object)
        frame = frame.sort_values("cid")
        ids = frame["cid"].to_numpy()
        lists = build_graph(unit(frame["vector"]), index)
        a, b = np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.concatenate(lists)
        row = np.repeat(np.arange(len(ids)), [len(v) for v in frame["shards"]])
        shard, row = np.unique(np.stack([np.concatenate(list(frame["shards"])), row]), axis=1)
        made = []
        for rows in np.split(row, np.nonzero(np.diff(shard))[0] + 1):  # of each shard that shares rows
            target = int(shard[0])
            shard = shard[len(rows) :]
            block = ids[rows] % many.get(target, 1)
            for part in np.unique(block).tolist():
                both = rows[block == part]
                place = np.full(len(ids), -1)
                place[both] = np.arange(len(both))
                kept = (place[a] >= 0) & (place[b] >= 0)
                if kept.any():  # edges whose two ends that block holds: ids, edges an id, their ends as places in ids
                    counts = np.bincount(place[a[kept]], minlength=len(both))
                    some = counts > 0  # edges are mutual, so every end has its own
                    place[both] = np.cumsum(some) - 1
                    made.append((target, part, ids[both[some]], counts[some], place[b[kept]]))
        return pd.DataFrame(made, columns=["shard", "block", "ids", "counts", "near"])

    edges = dealt(pairs.groupBy("shard", "low", "high").applyInPandas(build, "shard long, block int, ids array<long>, counts array<int>, near array<int>"))

    def search(frame: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"cid": [], "found": [], "root": []}, dtype="int64")
        frame = frame.sort_values("cid").reset_index(drop=True)
        shard, low, high = (int(frame[c].iloc[0]) for c in ("shard", "low", "high"))
        ids, weight, block, homes = (frame[c].to_numpy() for c in ("cid", "m", "block", "home"))
        x = unit(frame["vector"])
        asked = np.nonzero(homes == shard)[0]
        row_of = np.full(len(ids), -1)
        row_of[asked] = np.arange(len(asked))
        hit = np.zeros((len(asked), len(ids)), dtype=bool)
        for base, query in {(low, high), (high, low)}:
            cols, rows = np.nonzero(block == base)[0], np.nonzero((block == query) & (homes == shard))[0]
            if not len(cols) or not len(rows):
                continue
            united = [np.zeros(0, dtype=np.int64)]
            here = lists[lists["block"] == base]
            for held, counts, near in zip(here["ids"], here["counts"], here["near"], strict=True):
                at = np.searchsorted(ids[cols], held)
                united.append(np.repeat(at, counts) * len(cols) + at[near])
            pairs = np.unique(np.concatenate(united))
            near = np.split(pairs % len(cols), np.searchsorted(pairs // len(cols), np.arange(1, len(cols))))
            entries = np.searchsorted(cols, rows) if base == query else np.full(len(rows), medoid(x[cols]))
            for i, j in range_search(x[cols], near, entries, x[rows], least, index.keep, dense=index.dense):
                hit[row_of[rows[i]], cols[j]] = True
        both = hit[:, asked]  # a link found from either end is a link of both
        hit[:, asked] = both | both.T
        hit[np.arange(len(asked)), asked] = False
        held = [set(v.tolist()) for v in frame["shards"]]
        for home in np.unique(homes[homes < shard]).tolist():  # links that belong to the guest's home
            meet = np.array([home in held[i] for i in asked.tolist()], dtype=bool)
            hit[np.ix_(meet, homes == home)] = False
        found = np.zeros(len(ids), dtype=np.int64)
        guests = homes != shard
        for i in range(0, len(asked), 256):
            some = hit[i : i + 256]
            found[asked[i : i + 256]] = some @ weight
            found[guests] += weight[asked[i : i + 256]] @ some[:, guests]
        root = forest_of(hit, ids[asked], ids)
        count = dict(zip(ids.tolist(), found.tolist(), strict=True))
        return pd.DataFrame([(c, count[c], r) for c, r in root.items()], columns=["cid", "found", "root"]).astype("int64")

    keys = ("shard", "low", "high")
    links = cut(pairs.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(search, "cid long, found long, root long"))
    return links.groupBy("cid").agg(F.sum("found").alias("found")), links.select(F.col("cid").alias("a"), F.col("root").alias("b"))


def near_duplicates(vectors: DataFrame, least: float = 0.95, index: Index | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for vectors (vec_id, embedding)."""
    index = index or Index()
    good = usable(F.col("embedding"))
    key = F.when(good, F.md5(F.array_join(F.transform("embedding", lambda x: (x + 0.0).cast("string")), ",").cast("binary")))
    keyed = vectors.select("vec_id", "embedding", key.alias("key"))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    grouped = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("embedding").cast(kind).alias("vector"))
    classes = stored(grouped.withColumn("cid", F.xxhash64("key")), "vector-classes")
    placed = placed_classes(classes, least, index)
    discard(classes)
    counts, forest = link_classes(placed, least, index)
    roots = components(forest).withColumnRenamed("node", "cid")
    rooted = placed.select("cid", "key", "rep", "m").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(counts, "cid", "left")
    rooted = cut(rooted)
    discard(placed)
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select(F.col("key"), (F.col("m") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id"))
    linked = keyed.where("key is not null").select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, found: DataFrame, least: float = 0.95, queries: int = 400, seed: int = 3) -> float | None:
    """Share of the true links of about ``queries`` vectors, chosen by a hash of their ids, that ``found`` counts; None if
    these have no link, since nothing was measured then."""
    good = vectors.where(usable(F.col("embedding")))
    n = max(1, good.count())
    picked = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, queries / n)))
    rows = good.where(picked).select("vec_id", "embedding").limit(4 * queries).collect()
    if not rows:
        return None
    length = len(rows[0]["embedding"])
    rows = [r for r in rows if len(r["embedding"]) == length]
    shared = vectors.sparkSession.sparkContext.broadcast(([r["vec_id"] for r in rows], unit([r["embedding"] for r in rows])))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            batch = batch[[len(v) == q.shape[1] for v in batch["embedding"]]]
            if len(batch):
                yield pd.DataFrame({"vec_id": ids, "true": (unit(batch["embedding"]) @ q.T >= least).sum(0)})

    true = good.select("embedding").mapInPandas(brute, "vec_id long, true long").groupBy("vec_id").agg((F.sum("true") - 1).alias("true"))
    both = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return both[1] / both[0] if both[0] else None
