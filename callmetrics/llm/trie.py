"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns (role, text); the root is the empty one. Its members are the conversations
that start with it and its owner is the smallest member. Who owns a node owns all that lies below it on its own path,
so each conversation owns a suffix of its path, or nothing where an equal or longer copy has a smaller id, and a node
is named by owner and depth.

That makes sums over subtrees sums over members: all occurrences at and below a node, less the nodes' own tokens, are
for each member the tokens between the node's depth and the depth at which its own suffix begins. Windows mark the
owned nodes, a conversation's first owned depth follows, and one group-by over the prefixes adds everything up.

Prefixes are 128-bit keys: the exclusive or of hashes of (depth, turn). It is cumulative, so a long conversation is
dealt over tasks in stretches of ``stretch`` turns whose keys are combined afterwards. A prefix that many share is
marked in ``salts`` parts first and then among the parts' firsts; counts and sums combine before they are shuffled.
The digest of the conversations that end at a node is made from lists of at most ``LIST`` ids, streamed in order.

Defined results: null roles and texts are empty; rows that tie on turn are ordered by the digest of role and text;
repeated rows are repeated turns; rows without a conversation id are left out; a conversation may have no turns and
is then a member of the root alone; an empty table gives no nodes; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import cut
from callmetrics.llm.mixing import range_starts, running_before
from callmetrics.llm.turns import digest_in_order, named_turns, turn_digest, turn_order

#: Conversation ids of one stretch of numbers, the most that one list of ids holds.
LIST = 256
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
KEY = ["k1", "k2"]


def placed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars) of each turn, places from 0 in the order of the conversation.

    Turns are range-sorted by conversation and turn, so that a very long conversation lies in many ranges; a place is
    the number of turns in earlier ranges of the conversation and of earlier ones in its own.
    """
    turns = named_turns(rows).select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("chars"))
    dealt = cut(turns.repartitionByRange(*turn_order()).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1)))
    starts = range_starts(dealt, ["conv_id"], "part", "one")
    placed = running_before(dealt, starts, ["conv_id", "part"], turn_order()[1:], "one", "place")
    return placed.select("conv_id", "place", "digest", "chars")


def paths(convs: DataFrame, turns: DataFrame, stretch: int = 1024) -> DataFrame:
    """A row for each conversation and depth on its path, the root included: (conv_id, depth, n_turns, k1, k2, e1, e2,
    before): the prefix's key, what its last turn added to it, and the tokens of the turns before that one; ``after``
    counts that one too. ``turns`` are (conv_id, place, digest, chars), places of a conversation from 0 without gaps."""
    hashed = lambda *salt: F.xxhash64(*salt, F.col("depth"), F.col("digest"))
    steps = turns.select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), "digest", "chars").select(
        "conv_id", "depth", "chars", hashed().alias("e1"), hashed(F.lit(7)).alias("e2"), F.floor(F.col("depth") / stretch).alias("stretch")
    )
    inner = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = [F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"), F.sum("chars").alias("s"), F.count(F.lit(1)).alias("n")]
    totals = steps.groupBy("conv_id", "stretch").agg(*summed)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    based = totals.select(
        "conv_id", "stretch", none(F.bit_xor("s1").over(earlier)).alias("b1"), none(F.bit_xor("s2").over(earlier)).alias("b2"),
        none(F.sum("s").over(earlier)).alias("b"), F.sum("n").over(whole).alias("n_turns"),
    )
    running = steps.select("*", F.bit_xor("e1").over(inner).alias("r1"), F.bit_xor("e2").over(inner).alias("r2"), F.sum("chars").over(inner).alias("r"))
    below = running.join(based, ["conv_id", "stretch"]).select(
        "conv_id", "depth", "n_turns", F.col("r1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("k2"), "e1", "e2",
        (F.col("r") + F.col("b") - F.col("chars")).alias("before"), (F.col("r") + F.col("b")).alias("after"),
    )
    zero = F.lit(0).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    root = convs.join(sizes, "conv_id", "left").select(
        "conv_id", zero.alias("depth"), none(F.col("n_turns")).alias("n_turns"), *[zero.alias(c) for c in ("k1", "k2", "e1", "e2", "before", "after")]
    )
    return root.unionByName(below)


def owned_nodes(members: DataFrame, salts: int) -> DataFrame:
    """The rows of the smallest member of each prefix, with ``deepest``, the most turns that a member has."""
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)))
    part = Window.partitionBy(*KEY, "salt")
    first = dealt.select("*", F.row_number().over(part.orderBy("conv_id")).alias("at"), F.max("n_turns").over(part).alias("deep")).where("at = 1")
    whole = Window.partitionBy(*KEY)
    marked = first.withColumn("at", F.row_number().over(whole.orderBy("conv_id"))).withColumn("deepest", F.max("deep").over(whole))
    return marked.where("at = 1").drop("at", "deep", "salt")


def prefix_trie(convs: DataFrame, turns: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the prefix's key (k1, k2).

    ``convs`` holds every conversation once, ``turns`` their turns as :func:`placed_turns` gives them; a token is a code
    point of a turn's text. ``salts`` is the number of parts that a prefix is marked in, as a rule the number of shuffle
    partitions.
    """
    salts = salts or int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = cut(paths(convs, turns))
    owned = owned_nodes(members, salts)
    leaf = F.max(F.when(F.col("deepest") == F.col("depth"), 1).otherwise(0))
    entries = cut(
        owned.groupBy("conv_id").agg(
            F.min("depth").alias("entry"), F.min("before").alias("unowned"), leaf.alias("leaf"),
            F.min_by(F.struct(F.col("k1").bitwiseXOR(F.col("e1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("k2")), "depth").alias("above"),
        )
    )
    everything = members.where("depth = n_turns").select("conv_id", F.col("after").alias("total"))
    held = everything.join(entries, "conv_id", "left").select("conv_id", "entry", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("unowned", "total").alias("unowned"))
    child = F.when((F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 >= F.col("entry")), 1).otherwise(0)
    saved = F.greatest(F.lit(0).cast("long"), F.col("unowned") - F.col("before"))
    nodes = cut(
        members.join(held, "conv_id").groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
            F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        )
    )
    owner = nodes.select(*KEY, F.col("conv_id").alias("parent"))
    entered = entries.where("entry > 0").select("conv_id", "entry", "above.k1", "above.k2").join(owner, KEY).select("conv_id", "entry", "parent")
    ended = members.where("depth = n_turns").select(*KEY, "conv_id", F.floor(F.col("conv_id") / LIST).alias("list"))
    lists = ended.groupBy(*KEY, "list").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = digest_in_order(lists, KEY, ["list"], "ids", ",", "ends_sha256")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("entry"), F.col("parent")).otherwise(F.col("conv_id"))
    return nodes.join(entered, "conv_id", "left").join(ends, KEY, "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), *KEY,
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text) as it is."""
    turns = cut(placed_turns(rows))
    return prefix_trie(turns.select("conv_id").distinct(), turns)
