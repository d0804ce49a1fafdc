import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from callmetrics.llm import q_trie, trie
from callmetrics.llm.turns import digest_in_order

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(paths):
    """paths: conv_id -> list of (role, text)."""
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    made = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        childless = [k for k in below if not any(o[: len(k)] == k and len(o) == len(k) + 1 for o in nodes)]
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == len(key)))
        children = sum(1 for k in below if len(k) == len(key) + 1)
        made.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(made, key=repr)


def collected(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def in_order(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            held.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role or "", text or "")))
    return {c: [t for _, t in sorted(turns)] for c, turns in held.items()}


def random_rows(seed, convs=40, most=9):
    rng = random.Random(seed)
    return [(c - 5, t, rng.choice(("user", "assistant")), rng.choice(("a", "bc", "déf"))) for c in range(convs) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_tries(spark, seed):
    rows = random_rows(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert collected(trie.conversation_trie(frame)) == plain_trie(in_order(rows))


def test_long_conversations_in_stretches(spark):
    rows = [(c, t, "user", "same") for c in (3, 7) for t in range(50)] + [(5, t, "user", "same" if t < 30 else "other") for t in range(33)]
    turns = trie.placed_turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert trie.paths(turns.select("conv_id").distinct(), turns, stretch=4).where("depth = n_turns and conv_id != 5").select("k1", "k2").distinct().count() == 1
    assert collected(trie.prefix_trie(turns.select("conv_id").distinct(), turns, salts=3)) == plain_trie(in_order(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, 0, "", "a"), (2, 0, None, "a"),
        (None, 0, "user", "x"), (4, 2, "user", ""), (5, 2, "user", None), (6, 1, "a", "bc"), (7, 1, "ab", "c"), (8, 0, "user", "long " * 20_000),
    ]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = collected(trie.conversation_trie(frame))
    assert got == plain_trie(in_order(rows))
    assert sum(1 for g in got if g[0] in (6, 7) and g[1] == 1) == 2  # role and text are kept apart


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rebuilt_conversations(spark):
    rows = random_rows(4, 330, 8) + [(400 + i, 0, "user", "only") for i in range(30)]
    rows = [r for r in rows if r[0] != 200]  # a head that is not there
    own = in_order(rows)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(c / 100) * 100
        paths[c] = own.get(c - head, [])[:h] + turns[h:]
    assert any(not p for p in paths.values())
    turns = trie.placed_turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert collected(trie.prefix_trie(*q_trie.rebuilt(turns))) == plain_trie(paths)


def test_digests_of_long_lists(spark):
    rows = spark.range(5_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("p"))
    got = {r.k: r.d for r in digest_in_order(rows.repartition(4), ["k"], ["o"], "p", ",", "d").collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(5_000) if i % 2 == k).encode()).hexdigest() for k in (0, 1)}
