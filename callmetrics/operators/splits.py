"""Leakage-free splits: components of rows that share keys, hash ranks, quotas and exact allocation.

Rows stay on the executors throughout. Components come from min-label hops along row-key edges, whose minima combine
before each shuffle. Allocation is an ordered fold over (rank, sizes) of components, which ``allocate`` deals over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.operators import allocate
from callmetrics.operators.storage import cut

STRATA = ("1", "2-4", ">=5")


class AllocationError(ValueError):
    """A target that complete groups cannot meet exactly."""


def stratum(count: Column) -> Column:
    return F.when(count <= 1, STRATA[0]).when(count <= 4, STRATA[1]).otherwise(STRATA[2])


def components(rows: DataFrame, row_id: str, keys: Column, most_rounds: int = 100) -> DataFrame:
    """(row_id, component): rows linked by any shared key get one component, its smallest row id.

    Each round takes the smallest label over a row's keys and then hops to that label's own label, so chains halve.
    """
    edges = cut(rows.select(F.col(row_id).alias("row"), F.explode_outer(F.array_distinct(keys)).alias("key")).distinct())
    labels = cut(edges.groupBy("row").agg(F.first("row").alias("label")))
    linked = edges.where("key is not null")
    for _ in range(most_rounds):
        per_key = linked.join(labels, "row").groupBy("key").agg(F.min("label").alias("low"))
        per_row = linked.join(per_key, "key").groupBy("row").agg(F.min("low").alias("low"))
        lower = labels.join(per_row, "row", "left").select("row", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = labels.select(F.col("row").alias("label"), F.col("label").alias("next"))
        hopped = cut(lower.join(jump, "label", "left").select("row", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = hopped.select("row", "label")
        if hopped.where("label != old").isEmpty():
            return labels.select(F.col("row").alias(row_id), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def duplicate_keys(query_key: Column, task: Column) -> Column:
    return F.array(F.concat(F.lit("query:"), query_key), F.concat(F.lit("task:"), task))


def schema_keys(prefixes: Column, fingerprints: Column) -> Column:
    named = lambda kind: lambda x: F.concat(F.lit(kind), x)
    return F.concat(F.transform(prefixes, named("prefix:")), F.transform(fingerprints, named("fingerprint:")))


# -- ranks ----------------------------------------------------------------------------------------------------------


def row_rank_key(row_id: Column, seed: int = 42) -> Column:
    """Digest by which rows are ordered, whatever order they came in."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"), 256)


def group_ranks(members: DataFrame, row_id: str, group: str = "component", seed: int = 42) -> DataFrame:
    """(group, size, ids, rank_key): ids of a group in order, and the digest of their list that ranks the group."""
    ids = F.array_sort(F.collect_list(F.col(row_id).cast("string")))
    made = members.groupBy(group).agg(ids.alias("ids"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.array_join("ids", "\n")).cast("binary"), 256)
    return made.select(group, F.size("ids").alias("size"), "ids", key.alias("rank_key"))


def top_per_group(rows: DataFrame, group: str, row_id: str, k: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """The first k rows by rank key of each group, with ``rank``; too small a group is an error if ``strict``."""
    order = Window.partitionBy(group).orderBy(row_rank_key(F.col(row_id), seed), F.col(row_id))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if strict:
        short = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k).limit(1).collect()
        if short:
            raise AllocationError(f"{short[0][group]} has {short[0]['n']} rows, {k} are asked for")
    return ranked


def audit_queue(rows: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows by rank key, with ``rank``: a top-n that never sorts all rows in one place."""
    key = row_rank_key(F.col(row_id), seed)
    first = rows.withColumn("rank_key", key).orderBy("rank_key", row_id).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("rank_key", row_id)))


# -- exact allocation -----------------------------------------------------------------------------------------------


def first_fit(ranked: DataFrame, target: int, group: str = "component", parts: int | None = None) -> DataFrame:
    """Groups taken in rank order whenever they still fit into ``target`` rows; ``total`` is what they hold.

    A group that is too large is passed over and later ones are tried, so this is a fold and no prefix sum; ranges of
    groups are folded by tasks and composed.
    """
    if target <= 0:
        return ranked.select(F.lit(0).cast("long").alias("total"), group).limit(0)
    return allocate.first_fit(ranked, target, group, parts)


def require_exact(taken: DataFrame, target: int, what: str) -> DataFrame:
    total = taken.agg(F.max("total")).first()[0] or 0
    if total != target:
        raise AllocationError(f"cannot allocate {what} of {target}: complete groups give {total}")
    return taken.drop("total")


def quotas(counts: DataFrame, target: int) -> DataFrame:
    """(stratum, n, quota): ``target`` dealt in proportion to ``n`` by largest remainders, ties by stratum name."""
    everything = Window.partitionBy()
    exact = F.lit(target) * F.col("n") / F.sum("n").over(everything)
    floored = counts.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    order = Window.orderBy((F.col("exact") - F.col("base")).desc(), F.col("stratum"))
    left = F.lit(target) - F.sum("base").over(everything)
    placed = floored.withColumn("place", F.row_number().over(order)).withColumn("left", left)
    return placed.select("stratum", "n", (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def stratified(members: DataFrame, row_id: str, targets: dict[str, int], seed: int = 42, parts: int | None = None) -> DataFrame:
    """(component, split): groups in rank order go to the fitting split with the least room left, all quotas are met.

    ``members`` has row_id, component and stratum. Ranges of groups are folded by tasks, each from the rooms it meets.
    """
    counts = members.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    rooms = {}
    for name, target in targets.items():
        dealt = {r["stratum"]: r["quota"] for r in quotas(counts, target).collect()}
        rooms[name] = [dealt.get(s, 0) for s in STRATA]
    columns = [f"s{i}" for i in range(len(STRATA))]
    sizes = members.groupBy("component").agg(*[F.sum(F.when(F.col("stratum") == s, 1).otherwise(0)).alias(c) for s, c in zip(STRATA, columns)])
    ranked = group_ranks(members, row_id, seed=seed).select("component", "rank_key").join(sizes, "component")
    chosen, left = allocate.by_quota(ranked, "component", columns, rooms, parts)
    if any(n for room in left.values() for n in room):
        raise AllocationError("cannot allocate strict stratified splits without duplicate leakage")
    return chosen


def sequential(ranked: DataFrame, targets: dict[str, int], group: str = "component") -> DataFrame:
    """(group, split): splits are filled one after another, each trying all groups that are still free in rank order."""
    done, free = None, ranked
    for name, target in targets.items():
        taken = cut(require_exact(first_fit(free, target, group), target, f"strict {name} split"))
        named = taken.withColumn("split", F.lit(name))
        done = named if done is None else done.unionByName(named)
        free = free.join(taken, group, "left_anti")
    return done


# -- exclusion ------------------------------------------------------------------------------------------------------


def without_locked_components(rows: DataFrame, locked: DataFrame, row_id: str, keys: Column) -> DataFrame:
    """Rows outside every component that a locked row belongs to."""
    both = rows.withColumn("_locked", F.lit(False)).unionByName(locked.withColumn("_locked", F.lit(True)), allowMissingColumns=True)
    numbered = both.withColumn("_node", F.concat(F.when(F.col("_locked"), "l:").otherwise("r:"), F.col(row_id).cast("string")))
    found = components(numbered, "_node", keys)
    blocked = found.where("_node like 'l:%'").select("component").distinct()
    free = found.join(blocked, "component", "left_anti").select(F.expr("substring(_node, 3)").alias("_free"))
    return rows.join(free, F.col(row_id).cast("string") == F.col("_free"), "left_semi")


def without_shared_keys(rows: DataFrame, locked: DataFrame, row_id: str, keys: Column) -> DataFrame:
    """Rows that share no key with a locked row; unlike components, sharing isn't passed on."""
    taken = locked.select(F.explode(keys).alias("key")).distinct()
    hit = rows.select(row_id, F.explode(keys).alias("key")).join(taken, "key", "left_semi").select(row_id).distinct()
    return rows.join(hit, row_id, "left_anti")


def sharing(test: DataFrame, others: DataFrame, row_id: str, keys: Column) -> DataFrame:
    """(row_id): test rows that share a key with any other row."""
    taken = others.select(F.explode(keys).alias("key")).distinct()
    return test.select(row_id, F.explode(keys).alias("key")).join(taken, "key", "left_semi").select(row_id).distinct()


def require_disjoint(test: DataFrame, others: DataFrame, row_id: str, keys: Column) -> DataFrame:
    """``test`` itself; an error naming its first rows if it shares a key with the others."""
    found = [r[0] for r in sharing(test, others, row_id, keys).orderBy(row_id).limit(5).collect()]
    if found:
        raise AllocationError(f"schema-OOD test overlaps train or validation: {found}")
    return test


def schema_ood_test(rows: DataFrame, locked: DataFrame, row_id: str, keys: Column, target: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """``target`` rows, whole schema components that no locked row touches, first fit in rank order; components that
    don't give exactly as many are an error if ``strict``, else the rows that they give are returned."""
    candidates = rows.join(locked.select(row_id), row_id, "left_anti")
    free = without_locked_components(candidates, locked, row_id, keys) if locked.take(1) else candidates
    found = components(free, row_id, keys)
    taken = first_fit(group_ranks(found, row_id, seed=seed), target)
    if strict:
        taken = require_exact(taken, target, "strict schema-OOD test")
    return free.join(found.join(taken, "component", "left_semi").select(row_id), row_id, "left_semi")


def nested_subset(members: DataFrame, row_id: str, target: int, seed: int = 42) -> DataFrame:
    """``target`` rows of ``members`` (row_id, component): all of them, or whole components first fit in rank order."""
    if members.count() == target:
        return members
    if target == 0:
        raise AllocationError("cannot build nested training subset of 0")
    taken = require_exact(first_fit(group_ranks(members, row_id, seed=seed), target), target, "nested training subset")
    return members.join(taken, "component", "left_semi")


def nested_allocation(rows: DataFrame, row_id: str, keys: Column, schema: Column, count: Column, sizes: dict[str, int], length: str = "rendered_length", short: int = 512, long: int = 2048, seed: int = 42) -> DataFrame:
    """(row_id, version, split) of the frozen versions.

    ``sizes``: ood, validation, test, core, full, and any smaller training views. The schema-OOD test comes first; the
    IID pool leaves out its duplicates and schema neighbours; validation and test are stratified; the core training set
    and its views come from what is left; ``full`` keeps the core and is filled up from rows of the longer context.
    """
    fits = lambda most: F.col(length).isNull() | (F.col(length) <= most)
    shorter, longer = rows.where(fits(short)), rows.where(fits(long))
    nothing = rows.limit(0)
    ood = cut(schema_ood_test(shorter, nothing, row_id, schema, sizes["ood"], seed))
    pool = cut(without_shared_keys(without_locked_components(shorter, ood, row_id, keys), ood, row_id, schema))
    grouped = pool.join(components(pool, row_id, keys), row_id).withColumn("stratum", stratum(count))
    split = stratified(grouped, row_id, {"validation": sizes["validation"], "test": sizes["test"]}, seed)
    locked = cut(grouped.join(split, "component").select(*rows.columns, "split"))
    rest = cut(without_locked_components(pool, locked.drop("split"), row_id, keys))
    core = cut(nested_subset(components(rest, row_id, keys), row_id, sizes["core"], seed))
    versions = [ood.select(row_id, F.lit("schema_ood").alias("version"), F.lit("test").alias("split"))]
    views = {name: n for name, n in sizes.items() if name not in ("ood", "validation", "test", "core", "full")}
    trains = {"core": core} | {name: nested_subset(core, row_id, n, seed) for name, n in views.items()}
    if "full" in sizes:
        taken = ood.select(*rows.columns).unionByName(locked.select(*rows.columns)).unionByName(rows.join(core, row_id, "left_semi").select(*rows.columns))
        spare = without_shared_keys(without_locked_components(longer, taken, row_id, keys), ood, row_id, schema)
        extension = nested_subset(components(spare, row_id, keys), row_id, sizes["full"] - sizes["core"], seed)
        trains["full"] = core.unionByName(extension)
    for name, train in trains.items():
        versions.append(train.select(row_id, F.lit(name).alias("version"), F.lit("train").alias("split")))
        versions.append(locked.select(row_id, F.lit(name).alias("version"), "split"))
    made = versions[0]
    for more in versions[1:]:
        made = made.unionByName(more)
    return made


def context_view(rows: DataFrame, locked: DataFrame, row_id: str, keys: Column, length: str, most: int) -> DataFrame:
    """(row_id, split, place) of a version for a longer context: ``locked`` (columns of ``rows`` and ``split``) stays as
    it is, train is every row that fits and lies outside the locked components, in the order of the digests of its id."""
    fits = rows.where(F.col(length).isNull() | (F.col(length) <= most))
    free = without_locked_components(fits, locked.drop("split"), row_id, keys)
    record = F.to_json(F.struct(F.col(row_id).cast("string").alias("source_id")))
    train = free.select(row_id, F.lit("train").alias("split"), F.sha2(record.cast("binary"), 256).alias("place"))
    return train.unionByName(locked.select(row_id, "split", F.lit(None).cast("string").alias("place")))


def full_allocation(rows: DataFrame, locked: DataFrame, row_id: str, keys: Column, count: Column, target: int, length: str, most: int = 2048, seed: int = 42) -> DataFrame:
    """(row_id, split): a stratified train split of ``target`` rows from those that fit and lie outside the locked
    components, and ``locked`` (columns of ``rows`` and ``split``) as it is."""
    fits = rows.where(F.col(length).isNull() | (F.col(length) <= most))
    free = cut(without_locked_components(fits, locked.drop("split"), row_id, keys))
    grouped = free.join(components(free, row_id, keys), row_id).withColumn("stratum", stratum(count))
    train = grouped.join(stratified(grouped, row_id, {"train": target}, seed), "component")
    return train.select(row_id, "split").unionByName(locked.select(row_id, "split"))


# -- checks ---------------------------------------------------------------------------------------------------------


def list_hash(rows: DataFrame, value: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of the values joined by line ends in the given order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    joined = F.array_join(F.transform(held, lambda x: x["v"]), "\n")
    return rows.groupBy(*by).agg(F.sha2(joined.cast("binary"), 256).alias("content_hash"), F.count(F.lit(1)).alias("n"))


def leaking(splits: DataFrame, group: str = "component") -> DataFrame:
    """Groups that stand in more than one split."""
    found = splits.groupBy(group).agg(F.min("split").alias("low"), F.max("split").alias("high"))
    return found.where("low != high").select(group)


def checks(splits: DataFrame, row_id: str, sizes: dict[str, int]) -> DataFrame:
    """(check, ok, detail): split sizes, unique ids and component leakage of (row_id, component, split)."""
    spark = splits.sparkSession
    wanted = spark.createDataFrame(list(sizes.items()), "split string, want int")
    sized = wanted.join(splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "full")
    size_rows = sized.select(F.concat(F.lit("size:"), "split").alias("check"), F.col("want").eqNullSafe(F.coalesce("n", F.lit(0)).cast("int")).alias("ok"), F.concat_ws("/", F.coalesce("n", F.lit(0)).cast("string"), F.col("want").cast("string")).alias("detail"))
    twice = splits.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n"))
    leaks = leaking(splits).agg(F.count(F.lit(1)).alias("n"))
    named = lambda name, frame: frame.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail"))
    return size_rows.unionByName(named("unique_ids", twice)).unionByName(named("component_leakage", leaks))


def lock_checks(splits: DataFrame, row_id: str, hashes: DataFrame, nested: dict[str, DataFrame], locked: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(check, ok, detail) of (row_id, split) against what was locked: the list hash of each split is the stored one of
    ``hashes`` (split, want); the locked splits of every version in ``nested`` are the same, and its train is larger."""
    made = list_hash(splits, row_id, row_id, ("split",)).join(hashes, "split", "full")
    checked = made.select(F.concat(F.lit("hash:"), "split").alias("check"), F.col("content_hash").eqNullSafe(F.col("want")).alias("ok"), F.coalesce("content_hash", F.lit("")).alias("detail"))
    for name, version in sorted(nested.items()):
        for kind, ours, theirs in (("locks", splits.where(F.col("split").isin(*locked)), version.where(F.col("split").isin(*locked))), ("train", splits.where("split = 'train'"), version.where("split = 'train'"))):
            a, b = ours.select(row_id, "split", F.lit(1).alias("a")), theirs.select(row_id, "split", F.lit(1).alias("b"))
            both = a.join(b, [row_id, "split"], "full" if kind == "locks" else "left")
            strange = both.where("a is null or b is null").agg(F.count(F.lit(1)).alias("n"))
            checked = checked.unionByName(strange.select(F.lit(f"nested_{kind}:{name}").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail")))
    return checked


def same_lists(left: DataFrame, right: DataFrame, value: str, position: str) -> DataFrame:
    """Positions at which two ordered lists differ, either side missing included; none if the lists are equal."""
    a = left.select(F.col(position).alias("at"), F.col(value).alias("left"))
    b = right.select(F.col(position).alias("at"), F.col(value).alias("right"))
    return a.join(b, "at", "full").where(~F.col("left").eqNullSafe(F.col("right")))
