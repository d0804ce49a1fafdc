"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served up to ``repeats`` times over. A serving's virtual
finish time is the cumulative size of its source divided by the source's target, so at time 1 every source has served
its target. All servings are range-sorted by finish time and the order is truncated at the total budget. Documents are
served whole: only the one at which the budget ends gives part of its words. A source's words in the mix come within
about a document of its target, since the order interleaves the sources by their targets.

Cumulative sums never gather a source in one task: documents fall into ranges of the shuffle key, servings into ranges
of finish time, the ranges' sums are added up in two levels, and only the rows of one range are sorted together. Ranges
grow in number with the rows, so that one holds about ``rows_per_range`` of them.

Targets: sources by code point, null last, weigh ``weights`` in turn; ``share`` times all sizes is dealt by weight;
no target exceeds ``repeats`` times its source's size, what lies above is dealt again by weight among the others. The
level at which that ends is found by one ordered pass over the sources instead of repeated dealing.

Defined results: a null text has size 0 and is never taken; empty tables give no rows; repeated rows are documents of
their own and take neighbouring places in the order; null document ids are ordered as an empty string; a source whose
documents are all empty has target 0. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import WORD, cut

#: First hex digits of the digest that are read as the shuffle key, a number below 2 ** 52 that a double holds.
KEY_DIGITS = 13


def text_size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A document's place in the shuffled order of its source."""
    parts = (F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, KEY_DIGITS), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Per source: ``source``, ``source_size``, ``weight``, ``target``; one row for each distinct source."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighted = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place))
    level = F.lit(repeats) * F.col("source_size") / F.col("weight")
    ranked = weighted.withColumn("level", level).withColumn("at", F.row_number().over(Window.orderBy("level", F.col("source").asc_nulls_last())))
    ordered, everything = Window.orderBy("at"), Window.partitionBy()
    filled = F.coalesce(F.sum(repeats * F.col("source_size")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = ranked.select("*", ((share * F.sum("source_size").over(everything) - filled) / left).alias("tried"))
    water = F.min(F.when(F.col("tried") <= F.col("level"), F.struct("at", "tried"))).over(everything)["tried"]
    held = tried.select("*", water.alias("water"))
    full = (repeats * F.col("source_size")).cast("double")
    return held.select("source", "source_size", "weight", F.coalesce(F.least(full, F.col("water") * F.col("weight")), full).alias("target"))


def running_before(rows: DataFrame, starts: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: a range's start from ``starts`` (its ``_start`` by ``keys``) and the sum of earlier ``value`` in it."""
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(starts, keys).withColumn(name, F.col("_within") + F.col("_start")).drop("_within", "_start")


def range_starts(rows: DataFrame, group: list[str], at: str, value: str, together: int = 1024) -> DataFrame:
    """``_start`` for each range ``at`` of a group: the sum of ``value`` over the ranges before it, added up over
    stretches of ranges first and within each stretch then, so that no task holds all ranges of a group."""
    sums = rows.groupBy(*group, at).agg(F.sum(value).alias("_sum")).withColumn("_stretch", F.floor(F.col(at) / together))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy(*group, "_stretch").agg(F.sum("_sum").alias("_sum"))
    based = stretches.select(*group, "_stretch", F.coalesce(F.sum("_sum").over(earlier(*group).orderBy("_stretch")), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_sum").over(earlier(*group, "_stretch").orderBy(at)), F.lit(0))
    return sums.withColumn("_within", within).join(based, [*group, "_stretch"]).select(*group, at, (F.col("_base") + F.col("_within")).alias("_start"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    rows_per_range: int = 2_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document and serving.

    Columns: ``row`` (a number for each input row), doc_id, ``key`` (place in the shuffled order), source, ``epoch``, size, source_size, target, ``start`` and
    ``finish`` (virtual times), ``before`` (words earlier in the mix), ``taken`` (words of this serving in the mix), and
    the columns ``keep``, whose names must be none of these.
    """
    key = shuffle_key(F.col("doc_id"), F.col("text"), seed)
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # not null, to be joined on
    sized = cut(documents.select("doc_id", "source", text_size(F.col("text")).alias("size"), key.alias("key"), queue.alias("queue"), *keep))
    ranges = max(1, sized.count() // rows_per_range)
    width = -(-(16**KEY_DIGITS) // ranges)
    dealt = sized.withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.floor(F.col("key") / width).cast("long"))
    targets = source_targets(sized, weights, share, repeats)
    named = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("queue"), "source_size", "target")
    starts = cut(range_starts(dealt, ["queue"], "range", "size").join(named, "queue"))
    waiting = running_before(dealt, starts, ["queue", "range"], [F.col("key"), F.col("doc_id"), F.col("size")], "size", "done")
    copies = waiting.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    begun = copies.withColumn("begun", F.col("epoch") * F.col("source_size") + F.col("done"))
    timed = begun.withColumn("finish", F.when(F.col("target") > 0, (F.col("begun") + F.col("size")) / F.col("target")))
    # the order of all servings is sorted within ranges of finish time; without a finish time there are no words
    slot = F.coalesce(F.floor(F.col("finish") * (ranges * repeats)), F.lit(-1))
    placed = timed.withColumn("slot", slot.cast("long"))
    order = [F.col("finish"), F.col("queue"), F.col("key"), F.col("doc_id"), F.col("epoch"), F.col("size")]
    lined_up = running_before(placed, range_starts(placed, [], "slot", "size"), ["slot"], order, "size", "before")
    total = starts.select("queue", "source_size").distinct().agg(F.floor(share * F.sum("source_size")).cast("long").alias("budget"))
    left = F.col("budget") - F.col("before")
    return lined_up.crossJoin(F.broadcast(total)).select(  # total is one row
        "row", "doc_id", "key", "source", "epoch", "size", "source_size", "target", (F.col("begun") / F.col("target")).alias("start"), "finish", "before", *keep,
        F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)).alias("taken"),
    )


def per_document(mixed: DataFrame) -> DataFrame:
    """The servings of each input row added up."""
    first = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    return mixed.groupBy("row").agg(*first, F.sum("taken").alias("taken")).drop("row")
