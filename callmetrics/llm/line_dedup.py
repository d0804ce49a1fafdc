"""Line deduplication by winnowing over line hashes.

Lines with words are hashed in order. A window is the shortest stretch of lines from a line on that holds at least
``min_words`` words, so a long line is a window of its own and windows depend on nothing outside them: every run of
equal lines of that many words, wherever it stands, contains equal windows. Of every window the position of its
smallest line hash is selected, the first of equal ones, and neighbouring windows mostly select the same one. Equal
windows select equal lines, so a run that occurs twice has a fingerprint in common: only positions whose fingerprint
occurs twice are joined at all, the others are given up before their windows are ever formed.

A selected position carries the line hashes around it. From those, the windows that selected it are compared as
wholes, so that a common short line cannot stand in for a longer repeat. A match with the first occurrence in
(doc_id, line) order is extended both ways, line by line, while lines stay equal. What stands outside all windows of a
run holds fewer than ``min_words`` words on either side, so just those neighbouring line hashes are looked at. The runs
of later occurrences are merged and deleted. Every deleted line keeps an earlier copy.

Defined results: a null text stays null and has no lines; empty texts and lines without words are left as they are; a
text may become empty; rows equal in id and text are one occurrence and are treated alike; a null doc_id orders before
all others; an id that stands for several texts has its texts treated apart; a run that overlaps its own first
occurrence loses only what lies after that; an empty table gives no rows; texts of any length are read whole; other
columns pass through as they are, save that columns named ``n_lines`` or ``removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import BLANKS, WORD, cut, discard, let, row_key, small_or_not, split_by, stored


def _count_until(counts: Column, least: int) -> Column:
    """How many leading counts it takes to reach ``least``; 0 if all don't."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k"))
    step = lambda acc, y: F.when(acc["sum"] >= least, acc).otherwise(F.struct((acc["sum"] + y).alias("sum"), (acc["k"] + 1).alias("k")))
    return F.aggregate(counts, start, step, lambda acc: F.when(acc["sum"] >= least, acc["k"]).otherwise(0))


def _count_below(counts: Column, least: int) -> Column:
    """How many leading counts stay below ``least`` together."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k"))
    step = lambda acc, y: F.struct((acc["sum"] + y).alias("sum"), (acc["k"] + F.when(acc["sum"] + y < least, 1).otherwise(0)).alias("k"))
    return F.aggregate(counts, start, step, lambda acc: acc["k"])


def text_lines(text: Column) -> Column:
    """Lines with words as parallel arrays: two hashes ``a`` and ``b``, place in the text ``line``, words ``c``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("t"), F.regexp_count(x, F.lit(WORD)).alias("c"), i.alias("line")))
    real = F.filter(numbered, lambda x: x["c"] > 0)

    def arrays(x: Column) -> Column:
        return F.struct(
            F.transform(x, lambda y: F.xxhash64(y["t"])).alias("a"),
            F.transform(x, lambda y: F.xxhash64(F.lit(7), y["t"])).alias("b"),
            F.transform(x, lambda y: y["line"]).alias("line"),
            F.transform(x, lambda y: y["c"]).alias("c"),
        )

    return let(real, arrays)


def _starts(v: Column, low: Column, high: Column, min_words: int) -> Column:
    """Windows that start at the lines ``low`` to ``high`` of the arrays ``v``: structs of start ``i``, lines ``k`` and
    the selected position ``p``."""

    def window(i: Column) -> Column:
        k = _count_until(F.slice(v["c"], i + 1, F.lit(min_words)), min_words)  # a line has a word, so min_words lines suffice
        return F.struct(i.alias("i"), k.alias("k"))

    def selected(w: Column) -> Column:
        own = F.slice(v["a"], w["i"] + 1, w["k"])
        place = let(own, lambda x: F.array_position(x, F.array_min(x)).cast("int"))
        return F.struct(w["i"].alias("i"), w["k"].alias("k"), (w["i"] + place - 1).alias("p"))

    found = F.filter(F.transform(F.sequence(low, high), window), lambda w: w["k"] > 0)
    return F.transform(found, selected)


def positions(v: Column, min_words: int) -> Column:
    """The distinct positions that the windows of a text select."""
    n = F.size(v["a"])
    return F.when(n > 0, F.array_distinct(F.transform(_starts(v, F.lit(0), n - 1, min_words), lambda w: w["p"])))


def around(v: Column, p: Column, min_words: int) -> Column:
    """A selected position with its surroundings: the arrays of ``v`` cut to the lines that windows over ``p`` and
    their neighbours can reach, and ``p`` counted in them."""
    reach = F.lit(min_words)
    begin = F.greatest(p + 1 - 2 * reach, F.lit(1))
    left = _count_below(F.reverse(F.slice(v["c"], begin, F.least(p, 2 * reach))), 2 * min_words)
    after = F.slice(v["c"], p + 2, 2 * reach)
    inner = let(_count_until(F.slice(after, F.lit(1), reach), min_words), lambda k: F.when(k > 0, k).otherwise(F.size(after)))
    right = let(inner, lambda k: k + _count_below(F.slice(after, k + 1, reach), min_words))
    return let(F.struct(left.alias("l"), right.alias("r")), lambda x: F.struct(
        *[F.slice(v[c], p + 1 - x["l"], x["l"] + 1 + x["r"]).alias(c) for c in ("a", "b", "line", "c")], x["l"].alias("p"),
    ))


def anchored_windows(v: Column, min_words: int) -> Column:
    """The windows that selected the position ``v["p"]`` of surroundings, each with what its extension needs."""
    reach = F.lit(min_words)
    a, b, c, line = v["a"], v["b"], v["c"], v["line"]

    def described(w: Column) -> Column:
        i, e = w["i"], w["i"] + w["k"] - 1
        after = F.slice(a, e + 2, _count_below(F.slice(c, e + 2, reach), min_words))
        begin = F.greatest(i + 1 - reach, F.lit(1))
        before = F.reverse(F.slice(a, begin, F.least(i, reach)))
        near = _count_below(F.reverse(F.slice(c, begin, F.least(i, reach))), min_words)
        return F.struct(
            F.xxhash64(F.slice(a, i + 1, w["k"])).alias("k1"),
            F.xxhash64(F.slice(b, i + 1, w["k"])).alias("k2"),
            F.get(line, i).alias("first"),
            F.get(line, e).alias("last"),
            F.slice(before, F.lit(1), near).alias("before"),
            F.reverse(F.slice(line, F.greatest(i + 1 - near, F.lit(1)), near)).alias("before_at"),
            after.alias("after"),
            F.slice(line, e + 2, F.size(after)).alias("after_at"),
        )

    own = F.filter(_starts(v, F.greatest(v["p"] + 1 - reach, F.lit(0)), v["p"], min_words), lambda w: w["p"] == v["p"])
    return F.transform(own, described)


def _common(x: Column, y: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]) & z["x"].isNotNull())
    return let(F.array_position(same, False).cast("int"), lambda p: F.when(p > 0, p - 1).otherwise(F.size(same)))


def repeated_lines(documents: DataFrame, min_words: int) -> DataFrame:
    """Rows (_k1, _k2, removed) for documents (doc_id, text): the sorted line numbers, from 0, that are later copies."""
    lines = stored(documents.select(*row_key("doc_id", "text"), "doc_id", text_lines(F.col("text")).alias("v")), "lines")
    selected = lines.select("_k1", "_k2", "doc_id", "v", F.explode(positions(F.col("v"), min_words)).alias("p"))
    fingerprint = F.get(F.col("v")["a"], F.col("p")).alias("fingerprint")
    twice = cut(selected.select(fingerprint).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"))
    placed = selected.select("_k1", "_k2", "doc_id", fingerprint, around(F.col("v"), F.col("p"), min_words).alias("v"))
    kept = placed.join(small_or_not(twice), "fingerprint")
    windows = stored(kept.select("_k1", "_k2", "doc_id", "fingerprint", F.explode(anchored_windows(F.col("v"), min_words)).alias("w")).select("_k1", "_k2", "doc_id", "fingerprint", "w.*"), "line-windows")
    place = F.struct("doc_id", "_k1", "_k2", "first", "last", "before", "after")
    grouped = windows.groupBy("fingerprint", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("f"))
    firsts = cut(grouped.where("n > 1").drop("n"))
    met = windows.join(firsts, ["fingerprint", "k1", "k2"])
    own = (F.col("_k1") == F.col("f._k1")) & (F.col("_k2") == F.col("f._k2"))
    later = met.where(~(own & (F.col("first") == F.col("f.first"))))
    left, right = _common(F.col("before"), F.col("f.before")), _common(F.col("after"), F.col("f.after"))
    begin = F.when(left > 0, F.get(F.col("before_at"), left - 1)).otherwise(F.col("first"))
    end = F.when(right > 0, F.get(F.col("after_at"), right - 1)).otherwise(F.col("last"))
    runs = later.select("_k1", "_k2", F.when(own, F.greatest(begin, F.col("f.last") + 1)).otherwise(begin).alias("begin"), end.alias("end")).where("begin <= end").distinct()
    # runs of one text that touch are merged before they are gathered
    in_order = Window.partitionBy("_k1", "_k2").orderBy("begin", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", F.when(before >= F.col("begin") - 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order))
    merged = islands.groupBy("_k1", "_k2", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    found = cut(merged.groupBy("_k1", "_k2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "end"))), lambda x: F.sequence(x["begin"], x["end"]))).alias("removed")))
    discard(lines, windows)
    return found


def dedup_lines(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """``documents`` with later repeated runs deleted from ``text``; ``n_lines`` (lines before) and ``removed`` (their
    numbers, from 0) are added."""
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "removed")]
    packed = documents.select(*row_key("doc_id", "text"), "doc_id", "text", F.struct(F.lit(1), *others).alias("others"))  # no name of theirs is in the way
    found = repeated_lines(documents.select("doc_id", "text"), min_words)
    touched, untouched = split_by(packed, found)
    lines = F.split(F.col("text"), "\n")
    # a line without words within a run goes with the run
    cleaned = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n"))

    def shown(rows: DataFrame, text: Column, removed: Column) -> DataFrame:
        n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines")
        return rows.select("doc_id", *[F.col("others").getField(c).alias(c) for c in others], text.alias("text"), n_lines, removed.alias("removed"))

    whole = shown(untouched, F.col("text"), F.array().cast("array<int>"))
    return shown(touched.join(found, ["_k1", "_k2"]), cleaned, F.col("removed")).unionByName(whole)
