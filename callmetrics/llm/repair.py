"""Conversation structure repair: faults, and the cheapest edits that give roles ``(s?(ua)+)?``, least audit string first.

Faults, the first that holds of each turn: *blank* (no character but blanks), *duplicate* (role and text seen earlier in
the conversation), *truncated* (its last such character is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant
2, Delete 3 (the only edit of a blank or duplicate turn), Insert an empty user or assistant turn 2; a truncated turn
that is not deleted adds 1.

The audit string of the edits' initials is split into macro edits, a run of inserts and the edit of one turn:
``I*[DKR]``. These codes are prefix-free, so of two ways that have gone through the same turns neither string begins the
other, and a comparison is settled by the strings up to the last turn or else by the last code. A layer of the dynamic
programme therefore keeps, for each state of the role machine, a cost, the *rank* of its string among the layer's and a
parent pointer; strings are read off the pointers afterwards.

Turns are range-sorted by conversation and numbered; numbers fall into blocks of ``2 ** BLOCK_BITS``, and the turns of a
conversation in one block are a segment. For a segment the programme runs from every state in which it can be entered
(the first one's is known) and gives a matrix of costs and ranks; a conversation's matrices are composed in order, and
then each segment, now with its entry and its exit, is run once more for its edits. So a conversation of any length is
dealt over tasks, and a task holds a block at a time and one conversation's matrices.

Defined results: null roles and texts are what ``if_null`` says; rows that tie on turn are ordered by the digest of role
and text; a repeated row is a duplicate of the first; rows without a conversation id are left out; a role that begins
with none of s, u, a can't be kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import WORD, cut, stored
from callmetrics.llm.turns import named_turns, turn_digest, turn_order

BLOCK_BITS = 12
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
FAULTS = ("", "blank", "duplicate", "truncated")
#: States of the role machine: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What may be inserted or reroled in each state, and inserts that lead to an accepted end.
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Longer runs come back to a state that a shorter one has reached.
LONGEST_RUN = 2
#: More than any real cost, for states that are not reached.
NEVER = 1 << 62


def _moves(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """For each state to reach the (state before, cost, code) that lead there through a turn."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    broken = BROKEN if fault == "truncated" else 0
    for before in range(4):
        state = before
        for run in range(LONGEST_RUN + 1):
            ways = [(state, DELETE, "D")]
            if fault in ("", "truncated"):
                ways.append((FREE[state], REROLE + broken, "R"))
                if (state, initial) in STEP:
                    ways.append((STEP[state, initial], KEEP + broken, "K"))
            for to, cost, edit in ways:
                way = (run * INSERT + cost, "I" * run + edit)
                best[before, to] = min(best.get((before, to), way), way)
            state = FREE[state]
    return [[(b, *way) for (b, t), way in best.items() if t == to] for to in range(4)]


INITIALS = ("s", "u", "a", "")
#: By 4 * initial + fault, as `kind` numbers them.
MOVES = [_moves(i, f) for i in INITIALS for f in FAULTS]


def run_layers(kinds: list[int], entry: int, pointers: list | None = None) -> tuple[list[int], list[int]]:
    """(costs, ranks) of the four states after the turns ``kinds`` from state ``entry``. ``pointers``, if given, gets for
    each turn and state the state before and the code."""
    costs, ranks = [NEVER] * 4, [0] * 4
    costs[entry] = 0
    for kind in kinds:
        ways: list[tuple | None] = []
        for moves in MOVES[kind]:
            open_ways = [(costs[b] + cost, ranks[b], code, b) for b, cost, code in moves if costs[b] < NEVER]
            ways.append(min(open_ways) if open_ways else None)
        order = sorted((w[1], w[2], to) for to, w in enumerate(ways) if w)
        costs, ranks = [w[0] if w else NEVER for w in ways], [0] * 4
        for rank, (_, _, to) in enumerate(order):
            ranks[to] = rank
        if pointers is not None:
            pointers.append([(w[3], w[2]) if w else None for w in ways])
    return costs, ranks


def codes_of(kinds: list[int], entry: int, last: int) -> list[str]:
    """The macro edits of the best way through ``kinds`` from ``entry`` to ``last``, read off the parent pointers."""
    pointers: list = []
    run_layers(kinds, entry, pointers)
    codes, state = [], last
    for layer in reversed(pointers):
        state, code = layer[state]
        codes.append(code)
    return codes[::-1]


def compose(matrices: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, (entry, last) of each segment, inserts at the end) of a conversation from its segments' costs and ranks, 16
    numbers each by 4 * entry + last."""
    costs, ranks, back = [0, NEVER, NEVER, NEVER], [0] * 4, []
    for cost, rank in matrices:
        ways = []
        for to in range(4):
            open_ways = [(costs[e] + cost[4 * e + to], ranks[e], rank[4 * e + to], e) for e in range(4) if costs[e] < NEVER and cost[4 * e + to] < NEVER]
            ways.append(min(open_ways) if open_ways else None)
        order = sorted((w[1], w[2], to) for to, w in enumerate(ways) if w)
        costs, ranks = [w[0] if w else NEVER for w in ways], [0] * 4
        for place, (_, _, to) in enumerate(order):
            ranks[to] = place
        back.append([w[3] if w else None for w in ways])
    total, _, run, state = min((costs[s] + INSERT * len(ENDS[s]), ranks[s], ENDS[s], s) for s in range(4) if costs[s] < NEVER)
    chosen = []
    for layer in reversed(back):
        chosen.append((layer[state], state))
        state = layer[state]
    return total, chosen[::-1], run


# -- faults ---------------------------------------------------------------------------------------------------------


def numbered_turns(rows: DataFrame, if_null: str = "") -> DataFrame:
    """(conv_id, turn, role, text, digest, at, block): turns in order, ``at`` rising along each conversation and without
    gaps inside a block; a stored table."""
    turns = named_turns(rows, if_null)
    digested = turns.withColumn("digest", turn_digest(F.col("role"), F.col("text")))
    lined_up = digested.repartitionByRange(*turn_order()).sortWithinPartitions(*turn_order())
    numbered = lined_up.withColumn("at", F.monotonically_increasing_id())
    return stored(numbered.withColumn("block", F.shiftright("at", BLOCK_BITS)), "repair-turns")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, block, at, turn, initial, fault) of numbered turns. First places of equal turns combine before the
    shuffle, and only turns that occur twice are joined."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    keyed = turns.select("conv_id", "block", "at", "turn", "digest", F.substring("role", 1, 1).alias("initial"), F.regexp_like("text", F.lit(WORD)).alias("worded"), last.alias("last"))
    seen = keyed.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = (
        F.when(~F.col("worded"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    )
    return keyed.join(seen, ["conv_id", "digest"], "left").select("conv_id", "block", "at", "turn", "initial", fault.alias("fault"))


# -- edits ----------------------------------------------------------------------------------------------------------


def _segments(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """((conv_id, block), rows of ``columns``) of batches in order, whatever batch a segment's rows are in."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", *columns)))

    for key, group in groupby(rows(), key=lambda r: r[:2]):
        yield key, [r[2:] for r in group]


def _in_batches(rows: Iterator[tuple], schema: str, names: list[str], size: int = 2_000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [kinds[part.split(" ")[1]] for part in schema.split(", ")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names=names)

    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield batch()
            kept = []
    if kept:
        yield batch()


def _mapped(frame: DataFrame, make, schema: str) -> DataFrame:
    names = [part.split(" ")[0] for part in schema.split(", ")]
    return frame.mapInArrow(lambda batches: _in_batches(make(batches), schema, names), schema)


def kinds(judged: DataFrame) -> DataFrame:
    """(conv_id, block, at, kind): what the programme has to know of a turn."""
    number = lambda column, values: F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(values) if v], F.lit(values.index("")))
    kind = (4 * number("initial", INITIALS) + number("fault", FAULTS)).cast("int")
    return judged.select("conv_id", "block", "at", kind.alias("kind"))


def segments(kinded: DataFrame) -> DataFrame:
    """(conv_id, block, first, kinds, costs, ranks, illegal): each segment's turns and, by 4 * entry + exit, what its best
    ways cost and how their strings rank; ``illegal`` counts neighbours that may not follow each other."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, block), rows in _segments(batches, "at", "kind"):
            held = [k for _, k in rows]
            runs = [run_layers(held, entry) for entry in range(4)]
            illegal = sum(not follows(a, b) for a, b in zip(held, held[1:]))
            yield conv, block, rows[0][0], held, [c for costs, _ in runs for c in costs], [r for _, ranks in runs for r in ranks], illegal

    lined_up = kinded.repartition("block").sortWithinPartitions("at")
    return _mapped(lined_up, made, "conv_id long, block long, first long, kinds array<int>, costs array<long>, ranks array<int>, illegal long")


def follows(kind: int, after: int) -> bool:
    return (INITIALS[kind // 4] + INITIALS[after // 4]) in ("su", "ua", "au")


def plans(made: DataFrame) -> DataFrame:
    """(conv_id, block, entry, last, cost, illegal, tail): the states between which each segment runs; of the whole
    conversation its cost and illegal neighbours, each counted at one segment, and the inserts at its end, named at its
    last one. One conversation's matrices are held at a time, a row for 2 ** BLOCK_BITS turns."""

    def ways(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        columns = ("conv_id", "block", "costs", "ranks", "illegal", "head", "end")
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns)))
        for conv, group in groupby(rows, key=lambda r: r[0]):
            held = list(group)
            cost, states, run = compose([(s[2], s[3]) for s in held])
            for i, (segment, (entry, last)) in enumerate(zip(held, states)):
                edge = i > 0 and not follows(held[i - 1][6], segment[5])
                final = i == len(held) - 1
                yield conv, segment[1], entry, last, cost if final else 0, segment[4] + edge, run if final else ""

    ends = [F.element_at("kinds", 1).alias("head"), F.element_at("kinds", -1).alias("end")]
    by_conv = made.select("conv_id", "block", "costs", "ranks", "illegal", *ends).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return _mapped(by_conv, ways, "conv_id long, block long, entry int, last int, cost long, illegal long, tail string")


def edits(made: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, block, first, cost, illegal, tail, codes, places, n): each segment's macro edits, the place among the
    segment's items at which each begins, and the number of items."""
    kept = ["conv_id", "block", "first", "cost", "illegal", "tail"]

    def read_off(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for *row, held, entry, last in zip(*(batch.column(c).to_pylist() for c in (*kept, "kinds", "entry", "last"))):
                codes = codes_of(held, entry, last)
                places, n = [], 0
                for code in codes:
                    places.append(n)
                    n += len(code) - code.count("D")
                yield *row, codes, places, n

    both = made.select("conv_id", "block", "first", "kinds").join(planned, ["conv_id", "block"])
    return _mapped(both, read_off, "conv_id long, block long, first long, cost long, illegal long, tail string, codes array<string>, places array<long>, n long")


def repair(rows: DataFrame, if_null: str = "") -> tuple[DataFrame, DataFrame]:
    """(repaired, audits): the repaired turns (conv_id, place, role, text, edit), edit being K, R or I, and a row for each
    conversation with turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    turns = numbered_turns(rows, if_null)
    judged = cut(faults(turns))
    made = cut(segments(kinds(judged)))
    edited = cut(edits(made, plans(made)))
    count = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    found = judged.groupBy("conv_id").agg(span.alias("gaps"), *map(count, FAULTS[1:]))
    parts = F.array_sort(F.collect_list(F.struct("block", F.concat(F.array_join("codes", ""), "tail").alias("audit"))))
    audits = edited.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    # a segment's items follow those of the segments before it; an odd number of items begins with a system turn
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    items = F.col("n") + F.length("tail")
    based = edited.select(
        "conv_id", "block", "first", "codes", "places", "n", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
        (F.sum(items).over(Window.partitionBy("conv_id")) % 2).alias("lead"),
    )
    each = based.select("conv_id", "first", "lead", "base", F.posexplode(F.arrays_zip("codes", "places")).alias("i", "e")).select(
        "conv_id", "lead", (F.col("first") + F.col("i")).alias("at"), F.col("e.codes").alias("code"), (F.col("base") + F.col("e.places")).alias("place")
    )
    role_at = lambda place: F.when((place - F.col("lead")) % 2 == 0, "user").otherwise("assistant")
    runs = each.where("code like 'I%'").select("conv_id", "lead", "place", (F.length("code") - 1).alias("n"))
    tails = based.where("tail != ''").select("conv_id", "lead", (F.col("base") + F.col("n")).alias("place"), F.length("tail").alias("n"))
    spots = runs.unionByName(tails).select("conv_id", "lead", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place"))
    inserted = spots.select("conv_id", "place", role_at(F.col("place")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    put = (F.col("place") + F.length("code") - 1).alias("place")
    left = each.where("code not like '%D'").select("at", "lead", put, F.right(F.col("code"), F.lit(1)).alias("edit"))
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(role_at(F.col("place"))).alias("role")
    kept = turns.select("conv_id", "at", "role", "text").join(left, "at").select("conv_id", "place", role, "text", "edit")
    return kept.unionByName(inserted), found.join(audits, "conv_id")
