"""Quality rules: fixed base rules, and thresholds that adapt to language and source.

Every document gets counts of words, characters, symbols, repeated lines and repeated word windows. The counts become
whole-number rates. For each language and source and each rate, a quantile sketch is a log-linear histogram: values
below 64 have a bucket each, larger ones 32 buckets per power of two, so a quantile is at most one part in 32 above
the true one. Sketches merge by adding counts: those of the sources of a language make the language's, those of the
languages the whole corpus's.

No cutoff is fixed; a group's own sketch sets it. The fence of a rate is a high quantile of the group (``LEVELS``) and a
margin of ``spread`` times the distance of that quantile from the median. Narrow groups shrink towards wider ones: the
corpus's fence counts as ``weight`` more documents of each language, the language's as ``weight`` more of each source.
A document is refused where it exceeds the fence by more than chance: its count among n words or lines may exceed the
expected n * fence by ``errors`` standard errors of a Poisson count and by ``errors`` squared, so that a short text or
one with a symbol or two is not refused for it. Documents that fail the base rules don't enter the sketches. The filter
joins documents to the fences of their group.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups of their
own; repeated rows count as often as they occur; an empty table gives no rows; texts of any length are counted whole;
a column of ``keep`` with the name of an added one is replaced by it; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import BLANKS, cut, let, words

SYMBOLS = "#*$%&|<>"
#: The quantile, out of 1000, up to which a rate is ordinary in any group: repetition may be rare and still ordinary,
#: symbols and long words are ordinary only if common. And what a rate counts, among what.
LEVELS = {"symbols": 900, "dup_lines": 995, "repeats": 995, "word_length": 900}
RATES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more among the words ``w``."""

    def covered(sorted_windows: Column) -> Column:
        """Sorted (window, place): places of windows equal to a neighbour; each covers three words, shared ones count once."""
        twin = lambda x, j: F.when(x["g"].eqNullSafe(F.get(sorted_windows, j + 1)["g"]) | x["g"].eqNullSafe(F.get(sorted_windows, j - 1)["g"]), x["i"])
        places = F.array_sort(F.filter(F.transform(sorted_windows, twin), lambda i: i.isNotNull()))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def counted(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, covered))

    windows = F.transform(F.slice(w, 3, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), x))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, counted))


def text_counts(text: Column) -> Column:
    """A struct of the counts named in ``COUNTS``, all long."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeats"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dups"))

    def gathered(w: Column, x: Column) -> Column:
        named = {
            "n_words": w["n"],
            "word_chars": F.length(F.translate(full, BLANKS, "")),
            "n_symbols": F.length(full) - F.length(F.translate(full, SYMBOLS, "")),
            "n_lines": x["n"],
            "n_dup_lines": x["dups"],
            "n_repeat_words": w["repeats"],
        }
        return F.struct(*[named[c].cast("long").alias(c) for c in COUNTS])

    return let(let(words(text), of_words), lambda w: let(let(lines, of_lines), lambda x: gathered(w, x)))


def rates() -> dict[str, Column]:
    """Whole rates out of 1000."""
    return {name: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long") for name, (a, b) in RATES.items()}


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number from 0."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return let(shift, lambda e: 32 * e + F.floor(value / F.pow(F.lit(2), e)).cast("int"))


def upper_edge(at: Column) -> Column:
    """The largest value in a bucket."""
    e = F.greatest(F.floor(at / 32).cast("int") - 1, F.lit(0))
    return let(e, lambda s: ((at - 32 * s + 1) * F.pow(F.lit(2), s) - 1).cast("long"))


def sketches(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, rate, bucket, n): one mergeable histogram for each group and rate."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rate"), bucket(value).alias("bucket")) for name, value in rates().items()])
    each = counted.select(*keys, F.explode(pairs).alias("one"))
    return each.groupBy(*keys, F.col("one.rate").alias("rate"), F.col("one.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """Rows (keys, rate, rows, fence): a high quantile + spread * its distance from the median, read off the sketch."""
    group = Window.partitionBy(*keys, "rate")
    run = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("rows", F.sum("n").over(group))
    levels = F.create_map(*[x for name, level in LEVELS.items() for x in (F.lit(name), F.lit(level))])
    quantile = lambda level: F.min(F.when(1000 * F.col("upto") >= level * F.col("rows"), F.col("bucket")))
    read = run.groupBy(*keys, "rate").agg(F.first("rows").alias("rows"), quantile(F.lit(500)).alias("mid"), quantile(F.element_at(levels, F.col("rate"))).alias("high"))
    mid, high = upper_edge(F.col("mid")), upper_edge(F.col("high"))
    return read.select(*keys, "rate", "rows", (high + spread * (high - mid)).alias("fence"))


def bounds(sketch: DataFrame, spread: int, weight: int) -> DataFrame:
    """One row per language and source: the fence of each rate, narrow groups shrunk towards wider ones."""
    own = fences(sketch, ["lang", "source"], spread)
    lang = fences(merged(sketch, ["lang"]), ["lang"], spread).select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.col("rows").alias("lang_rows"), F.col("fence").alias("lang_fence"))
    every = fences(merged(sketch, []), [], spread).select(F.col("rate").alias("r"), F.col("fence").alias("all_fence"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r"))).drop("r", "l").join(every, F.col("rate") == F.col("r")).drop("r")
    of_lang = joined.withColumn("lang_fence", F.expr(f"(lang_rows * lang_fence + {weight} * all_fence) div (lang_rows + {weight})"))
    shrunk = of_lang.select("lang", "source", "rate", F.expr(f"(rows * fence + {weight} * lang_fence) div (rows + {weight})").alias("bound"))
    return shrunk.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == name, F.col("bound"))).alias(f"most_{name}") for name in LEVELS])


def judge(documents: DataFrame, spread: int = 1, weight: int = 200, errors: int = 3, min_words: int = 50, max_repeat_percent: int = 50, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang, source, the counts, ``base_failed``, the fences (``most_<rate>``) and ``kept``."""
    added = {"lang", "source", *COUNTS, "base_failed", "kept", *[f"most_{name}" for name in LEVELS]}
    rest = [c for c in keep if c not in added]
    made = documents.select(F.struct(F.lit(1), *rest).alias("row"), "lang", "source", text_counts(F.col("text")).alias("c")).select("row", "lang", "source", "c.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = cut(made.withColumn("base_failed", failed))
    sketch = cut(sketches(counted.where(~F.col("base_failed")), ["lang", "source"]))
    limits = cut(bounds(sketch, spread, weight)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = counted.join(limits, same, "left").drop("_lang", "_source")

    def inside(count: str, among: str, most: str) -> Column:
        expected = F.col(most) * F.col(among)  # in thousandths
        return 1000.0 * F.col(count) <= expected + 1000.0 * (errors * errors + errors * F.sqrt(expected / 1000.0))

    verdict = F.lit(True)
    for name, (count, among) in RATES.items():
        verdict = verdict & inside(count, among, f"most_{name}")
    shown = [F.col("row").getField(c).alias(c) for c in rest]
    others = [c for c in joined.columns if c != "row"]
    return joined.select(*shown, *others, (~F.col("base_failed") & F.coalesce(verdict, F.lit(False))).alias("kept"))
