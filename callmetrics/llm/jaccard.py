"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word n-grams, hashed. Documents with equal sets form classes and are joined once.
Classes that are likely similar, those with the same three smallest n-grams and a size of the same band, are
partitioned into groups of about ``block_rows`` at most. Links are then sought from the inside out, and whatever is
linked already counts as one group from then on:

1. Every group of two classes or more is opened: its texts meet and are compared exactly, on n-grams of words rather
   than hashes, after a bound by the union of the group's n-grams.
2. One class of each component found so far asks the largest group among those that hold two of its smallest n-grams.
   That is no more than a few meetings a component, and it draws the fragments of a large family of near copies
   together before anything meets more widely.
3. The components are now the groups. The token-group matrix has a row for each group and each n-gram in the union of
   its members' leading n-grams, with the sizes of the members that have it. N-grams that only one group has can open
   nothing and drop out, which takes a family's own n-grams away at once. How many leading n-grams two groups share
   bounds what any of their members can share; only pairs that reach the bound are opened, the smaller group asking
   the larger, and their texts are compared exactly.

Leading n-grams are the first of a set in an order that puts rare ones first, by counts over the whole corpus that are
kept in a fixed number of counters. By the prefix principle, sets x and y, y not larger, whose overlap reaches the
threshold t share at least k of x's first |x| - ceil(t|x|) + k and y's first |y| - ceil(2t/(1+t) |y|) + k n-grams; k
grows slowly with the size, so that chance matches open no group. Nothing is capped: the third step alone finds a link
between any two groups that have one, whatever the first two found.

A task opens a block of about ``block_rows`` members for about ``block_rows`` queries; links leave it as a spanning
forest, not as pairs. Components of forests are found by :mod:`callmetrics.llm.graph`.

Defined results: a text with fewer than n words has one n-gram, all its words; a text without words, and null, has an
empty set, links with nothing and is its own component; a null document id takes part and its row's component may be
null if no other document belongs to it; an id that stands for several texts takes part with each; repeated rows are
copies of one another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.common import BLANKS, LOWER, UPPER, cut, discard, let, row_key, small_or_not, stored, tidy
from callmetrics.llm.graph import components

COUNTERS_LOG2, CHUNKS = 20, 16
#: Smallest n-grams that make a group, and those by which a component looks for a large group to ask.
GROUP_KEYS, HUB_KEYS = 3, 6
BLANK_RUN = r"[\x20\x09-\x0D]+"
LOWER_TABLE = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Similarity:
    """n words to an n-gram and the least Jaccard similarity in percent."""

    n: int = 5
    percent: int = 80

    def overlap(self, size):
        """Least overlap of a set of this size with a set that is not larger."""
        return -(-self.percent * size // 100)

    def overlap_of_smaller(self, size):
        """Least overlap of a set of this size with a set that is not smaller."""
        return -(-2 * self.percent * size // (100 + self.percent))

    @staticmethod
    def matches(size):
        """Leading n-grams that two similar sets have to share, the smaller having this size."""
        return 1 + size // 64

    def lead_as_query(self, size):
        return min(size, size - self.overlap(size) + self.matches(size))

    def lead_as_member(self, size):
        return min(size, size - self.overlap_of_smaller(size) + self.matches(size))


def gram_hashes(text: Column, n: int) -> Column:
    """The distinct n-grams of a text as sorted 64-bit hashes."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    found = F.array_remove(F.split(low, BLANK_RUN), "")

    def grams(w: Column) -> Column:
        each = F.transform(F.slice(w, n, F.size(w)), lambda x, i: F.xxhash64(*[F.get(w, i + k) for k in range(n - 1)], x))
        few = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lit("all"), F.array_join(w, " "))))
        return F.when(F.size(w) >= n, each).otherwise(few)

    return F.sort_array(F.array_distinct(let(found, grams)))


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.offsets), np.asarray(column.values)


def corpus_counts(documents: DataFrame, n: int) -> np.ndarray:
    """How many documents have n-grams of each counter: a fixed-size table over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS_LOG2, dtype=np.int64)
        for batch in batches:
            _, values = _offsets(batch.column(0))
            total += np.bincount((values.view(np.uint64) >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64), minlength=len(total))
        if total.any():
            parts = [zlib.compress(part.tobytes(), 1) for part in np.split(total, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks added up within a partition."""
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch["chunk"], batch["counts"], strict=True):
                counts = np.frombuffer(zlib.decompress(part), dtype=np.int64)
                totals[chunk] = totals[chunk] + counts if chunk in totals else counts
        if totals:
            yield pd.DataFrame({"chunk": list(totals), "counts": [zlib.compress(t.tobytes(), 1) for t in totals.values()]})

    schema = "chunk int, counts binary"
    each = documents.select(gram_hashes(F.col("text"), n).alias("grams")).mapInArrow(count, schema)
    rows = each.repartition(CHUNKS, "chunk").mapInPandas(summed, schema).collect()  # 16 rows of 65,536 counters
    whole = np.zeros(1 << COUNTERS_LOG2, dtype=np.int64)
    for row in rows:
        part = np.frombuffer(zlib.decompress(bytes(row["counts"])), dtype=np.int64)
        whole[row["chunk"] * len(part) : (row["chunk"] + 1) * len(part)] += part
    return whole


def leading(documents: DataFrame, counts: np.ndarray, like: Similarity) -> DataFrame:
    """Rows (doc_id, _k1, _k2, size, k1, k2, grp, keys, lead): hashes of id and text, set size and digest, group, smallest n-grams, and leading n-grams, rare first."""
    shared = documents.sparkSession.sparkContext.broadcast(counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64))  # a million counters
    log_t = np.log(100 / like.percent)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ends, values = _offsets(batch.column(5))
            rank = table[(values.view(np.uint64) >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)]
            groups = np.zeros(batch.num_rows, dtype=np.int64)
            leads, keys = [], []
            for i in range(batch.num_rows):
                grams = values[ends[i] : ends[i + 1]]
                size = len(grams)
                keys.append(grams[:HUB_KEYS])
                if not size:
                    leads.append(grams)
                    continue
                order = np.lexsort((grams, rank[ends[i] : ends[i + 1]]))
                leads.append(grams[order[: like.lead_as_query(size)]])
                groups[i] = hash((*grams[:GROUP_KEYS].tolist(), int(np.log(size) / log_t))) & 0x7FFFFFFFFFFFFFFF
            sizes = pa.array(np.diff(ends).astype(np.int64))
            same = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*same[:3], sizes, *same[3:], pa.array(groups), lists(keys), lists(leads)], names=["doc_id", "_k1", "_k2", "size", "k1", "k2", "grp", "keys", "lead"])

    grams = documents.select("doc_id", *row_key("doc_id", "text"), gram_hashes(F.col("text"), like.n).alias("grams"))
    keyed = grams.select("doc_id", "_k1", "_k2", F.xxhash64("grams").alias("k1"), F.xxhash64(F.lit(1), "grams").alias("k2"), "grams")
    return keyed.mapInArrow(lead, "doc_id long, _k1 long, _k2 long, size long, k1 long, k2 long, grp long, keys array<long>, lead array<long>")


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)


def word_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct n-grams of texts as sorted numbers: equal n-grams of words, and only they, get equal numbers."""
    number: dict[str, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in text.translate(LOWER_TABLE).strip(BLANKS).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w] for text in texts]
    grams: dict[bytes, int] = {}
    out = []
    base = len(number) + 1
    small = n * np.log2(base) < 62
    for row in rows:
        w = np.array(row, dtype=np.int64) + 1
        if not len(w):
            out.append(w)
        elif len(w) < n or not small:
            full = [row] if len(w) < n else [row[i : i + n] for i in range(len(row) - n + 1)]
            out.append(np.unique([-1 - grams.setdefault(np.array(g, dtype=np.int64).tobytes(), len(grams)) for g in full]))
        else:
            key = np.zeros(len(w) - n + 1, dtype=np.int64)
            for k in range(n):
                key = key * base + w[k : len(w) - n + 1 + k]
            out.append(np.unique(key))
    return out


def open_block(ids: list[int], texts: list[str], member: list[bool], like: Similarity) -> list[tuple[int, int]]:
    """Links as a forest (id, root). Rows are members and queries; queries meet members, and where there are only
    members these meet each other. Rows with the same id are known to be linked."""
    sets = word_sets(texts, like.n)
    sizes = np.array([len(s) for s in sets])
    held = [i for i, m in enumerate(member) if m and sizes[i]]
    if not held:
        return []
    inside = all(member)
    flat = np.concatenate([sets[i] for i in held])
    owner = np.repeat(np.arange(len(held)), sizes[held])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    union, first = np.unique(flat, return_index=True)
    count = np.diff(np.append(first, len(flat)))
    held_ids = np.array([ids[i] for i in held])
    held_sizes = sizes[held]
    forest = _Forest()
    for i, grams in enumerate(sets):
        if not len(grams) or (member[i] and not inside):
            continue
        at = np.minimum(np.searchsorted(union, grams), len(union) - 1)
        at = at[union[at] == grams]
        # the bound over the group's union, without what only the query itself brings in
        if (count[at] > (1 if inside else 0)).sum() < like.overlap(len(grams)):
            continue
        begin, span = first[at], count[at]
        hits = np.repeat(begin - np.append(0, np.cumsum(span)[:-1]), span) + np.arange(span.sum())
        shared = np.bincount(owner[hits], minlength=len(held))
        linked = 100 * shared >= like.percent * (len(grams) + held_sizes - shared)
        for other in np.unique(held_ids[linked]).tolist():
            forest.join(ids[i], other)
    return [(x, forest.root(x)) for x in list(forest.up)]


def _open_all(rows: DataFrame, like: Similarity) -> DataFrame:
    """Links (a, b) of blocks: rows (root, block, part, member, text), a block and part being opened in one task."""
    ordered = rows.repartition(F.col("block"), F.col("part")).sortWithinPartitions("block", "part", "root")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, texts, member = None, [], [], []

        def done() -> pd.DataFrame:
            return pd.DataFrame(open_block(ids, texts, member, like), columns=["a", "b"]).astype("int64")

        for batch in batches:
            for root, block, part, is_member, text in zip(batch["root"], batch["block"], batch["part"], batch["member"], batch["text"], strict=True):
                if (block, part) != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, texts, member = (block, part), [], [], []
                ids.append(int(root))
                texts.append(text)
                member.append(bool(is_member))
        if len(ids) > 1:
            yield done()

    return ordered.select("root", "block", "part", "member", "text").mapInPandas(run, "a long, b long")


def _meet(asks: DataFrame, members: DataFrame, block_rows: int) -> DataFrame:
    """Rows (cid, root, block, part, member) of queries ``asks`` and ``members`` (both cid, root, block): a block is
    opened in parts of about ``block_rows`` queries."""
    parts = asks.groupBy("block").agg(F.expr(f"cast((count(1) + {block_rows - 1}) div {block_rows} as int)").alias("parts"))
    held = members.join(parts, "block").select("cid", "root", "block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(True).alias("member"))
    asked = asks.join(parts, "block").select("cid", "root", "block", F.expr("cast(pmod(xxhash64(cid), parts) as int)").alias("part"), F.lit(False).alias("member"))
    return held.unionByName(asked)


@dataclass(frozen=True)
class Joined:
    """``documents`` (doc_id, _k1, _k2, size, k1, k2), ``classes`` (size, k1, k2, rep, root) of distinct non-empty sets."""

    documents: DataFrame
    classes: DataFrame


def join(documents: DataFrame, like: Similarity, block_rows: int = 1_000) -> Joined:
    """Classes of equal sets with the root class of their component."""
    lead = stored(leading(documents, corpus_counts(documents, like.n), like), "jaccard-lead")
    # a class goes by one of its texts, named by id and hash, since ids may be null or stand for several texts
    first = [F.first(c).alias(c) for c in ("grp", "keys", "lead")]
    same = lead.where("size > 0").groupBy("size", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("_k1", "_k2")).alias("text"), *first)
    classes = stored(same.withColumn("cid", F.xxhash64("k1", "k2", "size")), "jaccard-classes")
    keys = cut(lead.select("doc_id", "_k1", "_k2", "size", "k1", "k2"))
    discard(lead)
    del lead, same
    tidy(documents.sparkSession)
    named = classes.select("cid", "text._k1", "text._k2")
    whole = documents.select(*row_key("doc_id", "text"), "text")

    def with_texts(placed: DataFrame) -> DataFrame:
        wanted = small_or_not(cut(named.join(placed.select("cid").distinct(), "cid")))
        texts = whole.join(wanted, ["_k1", "_k2"]).select("cid", "text")
        return placed.join(texts.dropDuplicates(["cid"]), "cid")

    # 1. inside the groups
    rows = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    blocked = f"xxhash64(grp, pmod(xxhash64(cid), (rows + {block_rows - 1}) div {block_rows}))"
    home = cut(classes.join(rows, "grp").select("cid", "rep", "size", "k1", "k2", "keys", F.expr(blocked).alias("block"), "rows"))
    shared = home.where("rows > 1").select("cid", F.col("cid").alias("root"), "block", F.lit(0).alias("part"), F.lit(True).alias("member"))
    links = _open_all(with_texts(shared), like)
    rooted = cut(home.drop("rows").join(links.select(F.col("a").alias("cid"), F.col("b").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    del home, rows, shared, links
    tidy(documents.sparkSession)
    # 2. one class of each component asks the largest group among those that hold smallest n-grams of its own
    holders = rooted.select(F.explode("keys").alias("key"), "block", "size").groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    hubs = holders.groupBy("key").agg(F.max(F.struct("n", "block", "least", "most")).alias("hub"), F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("key", "hub.*")
    speakers = rooted.where("cid = root").select("cid", "block", "size", F.explode("keys").alias("key"))
    near = speakers.withColumnRenamed("block", "own").join(hubs, "key").where(f"own != block and 100 * size >= {like.percent} * least and 100 * most >= {like.percent} * size")
    asks = cut(near.groupBy("cid", "block").agg(F.count(F.lit(1)).alias("common"), F.max("size").alias("size")).where("common >= least(2, size)").select("cid", F.col("cid").alias("root"), "block"))
    links = _open_all(with_texts(cut(_meet(asks, rooted.select("cid", "root", "block"), block_rows))), like)
    rooted = cut(_moved(rooted.drop("keys", "block"), components(links)))
    del holders, hubs, speakers, near, asks, links
    tidy(documents.sparkSession)
    # 3. components are the groups of the matrix; those that share enough leading n-grams are opened
    as_member = F.expr(f"least(size, size - ({2 * like.percent} * size + {99 + like.percent}) div {100 + like.percent} + 1 + size div 64)")
    each = classes.select("cid", "size", "lead").join(rooted.select("cid", "root"), "cid").select("root", "size", as_member.alias("brought"), F.posexplode("lead").alias("place", "gram"))
    each = each.select("gram", "root", F.expr("2 * size + if(place < brought, 1, 0)").alias("held"))
    live = each.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram")
    matrix = each.join(live, "gram").groupBy("gram", "root").agg(F.min(F.expr("held div 2")).alias("least"), F.max(F.expr("held div 2")).alias("most"), F.max(F.expr("held % 2")).alias("member"))
    matrix = cut(matrix)
    del each, live
    tidy(documents.sparkSession)
    other = matrix.select("gram", *[F.col(c).alias(f"other_{c}") for c in ("root", "least", "most", "member")])
    sizes = f"100 * most >= {like.percent} * other_least and 100 * other_most >= {like.percent} * least"
    met = matrix.join(other, "gram").where(f"root < other_root and member + other_member > 0 and {sizes}")
    pairs = met.groupBy("root", "other_root").agg(F.count(F.lit(1)).alias("held"), F.greatest(F.min("least"), F.min("other_least")).alias("size"))
    pairs = cut(pairs.where(f"held >= 1 + (({like.percent} * size + 99) div 100) div 64").select("root", "other_root"))
    del matrix, other, met
    tidy(documents.sparkSession)
    counts = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.join(counts, "root").join(counts.select(F.col("root").alias("other_root"), F.col("n").alias("other_n")), "other_root")
    larger = F.expr("n >= other_n")
    ends = cut(sized.select(F.when(larger, F.col("root")).otherwise(F.col("other_root")).alias("to"), F.when(larger, F.col("other_root")).otherwise(F.col("root")).alias("root"), F.greatest("n", "other_n").alias("n")))
    held = ends.select("to", "n").distinct().join(rooted.select("cid", F.col("root").alias("to")), "to")
    held = held.select("cid", F.col("to").alias("root"), F.expr(f"xxhash64(to, pmod(xxhash64(cid), (n + {block_rows - 1}) div {block_rows}))").alias("block"))
    asks = ends.join(rooted.select("cid", "root"), "root").select("cid", "root", "to", F.explode(F.expr(f"sequence(0, (n + {block_rows - 1}) div {block_rows} - 1)")).alias("at"))
    asks = asks.select("cid", "root", F.xxhash64("to", "at").alias("block"))
    links = _open_all(with_texts(cut(_meet(asks, held, block_rows))), like)
    found = components(links)
    del held, asks, ends, sized, links
    tidy(documents.sparkSession)
    rooted = cut(_moved(rooted, found))
    discard(classes)
    return Joined(keys, rooted)


def _moved(rooted: DataFrame, found: DataFrame) -> DataFrame:
    """``rooted`` with roots replaced by the roots of their components in ``found`` (node, root)."""
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return rooted.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def near_components(documents: DataFrame, like: Similarity, block_rows: int = 1_000, named: bool = False) -> DataFrame:
    """Rows (doc_id, size, component_id): set size, and the smallest doc_id reachable by links, itself included; with
    ``named`` also the hashes ``_k1`` and ``_k2`` of id and text."""
    made = join(documents, like, block_rows)
    others = ["_k1", "_k2"] if named else []
    smallest = made.classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = made.classes.join(smallest, "root").select("size", "k1", "k2", "component_id")
    linked = made.documents.where("size > 0").join(of_class, ["size", "k1", "k2"]).select("doc_id", "size", "component_id", *others)
    return linked.unionByName(made.documents.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"), *others))
