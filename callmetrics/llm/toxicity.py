"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled rest are documents drawn from all that may be learnt from,
labelled or not, without a look at labels: a blend of both classes in a known proportion, the class prior, which the
labels of the learning fold tell. The risk of a linear classifier g with the logistic loss l is

    prior * mean_P l(g) + max(0, mean_U l(-g) - prior * mean_P l(-g))

whose second term estimates the risk on clean text; where a batch drives it below 0 the step goes the other way, so
that the classifier cannot win by memorising the positives. Several numpy classifiers are trained on bootstraps of
the rows and their logits averaged. Features are the presence of words and of their beginnings of 4 and 6 letters,
which catch inflected forms; taken are those whose document share among positives exceeds that among unlabelled rows
by a factor and by a number of standard errors, a beginning only if it says more than each whole word. Copies in the sample count once. Documents are scored by DataFrame
functions alone.

Fitting uses a bounded sample: about ``most_positive`` labelled and ``most_unlabelled`` unlabelled documents, chosen by
a hash of the id; scoring covers every document and whole texts.

Defined results: null and empty texts have no words and get the score of the intercept; labels that are null count as
unlabelled; a document labelled twice is toxic if any label says so; without positives every score is 0; repeated
rows are scored each; an empty table gives no rows; other columns pass through as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import let, stored

LETTERS = r"\p{L}+"


#: Kinds of features: whole words, and beginnings of so many letters.
KINDS = (0, 4, 6)


@dataclass(frozen=True)
class Model:
    words: tuple[tuple[int, str], ...]  # (kind, text)
    weights: tuple[float, ...]
    bias: float
    prior: float


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document belongs to the fold that learning may not see; null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))


def text_features(found: Column, kind: int) -> Column:
    """Features of one kind of an array of words, with repeats."""
    return found if not kind else F.transform(found, lambda w: F.substring(w, 1, kind))


def risk(xp: np.ndarray, wp: np.ndarray, xu: np.ndarray, wu: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """The risk on positives, prior * mean_P l(g), its slope, the estimated risk on clean text, mean_U l(-g) - prior *
    mean_P l(-g), and its slope; the whole risk takes no less than 0 for the latter. Rows have weights of sum 1."""
    gp, gu = np.clip(xp @ w, -30, 30), np.clip(xu @ w, -30, 30)
    hit_p, hit_u = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    of_positive = prior * (wp @ np.log1p(np.exp(-gp)))
    clean = wu @ np.log1p(np.exp(gu)) - prior * (wp @ np.log1p(np.exp(gp)))
    return of_positive, -prior * ((wp * (1 - hit_p)) @ xp), clean, (wu * hit_u) @ xu - prior * ((wp * hit_p) @ xp)


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = 1_500, rate: float = 0.05, decay: float = 3e-5) -> np.ndarray:
    """Weights, intercept last, of one classifier; rows are 0/1 feature vectors with a trailing 1.

    Equal rows are one weighted row, and a classifier sees its own bootstrap of the weights, so a step is a few small
    matrix products over all rows (Adam on the whole risk).
    """
    rng = np.random.default_rng(seed)
    xp, np_ = np.unique(positive, axis=0, return_counts=True)
    xu, nu = np.unique(unlabelled, axis=0, return_counts=True)
    wp, wu = rng.poisson(np_).astype(float), rng.poisson(nu).astype(float)
    wp, wu = (w / w.sum() if w.sum() else n / n.sum() for w, n in ((wp, np_), (wu, nu)))
    w = np.zeros(positive.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, steps + 1):
        _, slope_positive, clean, slope_clean = risk(xp, wp, xu, wu, prior, w)
        slope = -slope_clean if clean < 0 else slope_clean + slope_positive
        slope = slope + decay * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w = w - rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    return w


def fit(
    documents: DataFrame,
    labels: DataFrame,
    most_positive: int = 4_000,
    most_unlabelled: int = 16_000,
    most_words: int = 400,
    least_documents: int = 3,
    least_factor: float = 3.0,
    least_errors: float = 2.0,
    classifiers: int = 3,
) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic), both without the held-out fold already."""
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not toxic:
        return Model((), (), -math.inf, 0.0)
    prior = min(max(toxic / n, 1e-6), 1 - 1e-6)
    # ids of the positives are few by their bound and broadcast, so that no text moves but those of the sample;
    # a row may serve as a positive and, by another hash, as an unlabelled one
    chosen = lambda salt, share: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, share)))
    confirmed = known.where((F.col("toxic") == 1) & chosen("positive", most_positive / toxic)).select(F.col("doc_id").alias("id"))
    texts = documents.select("doc_id", "text")
    drawn = chosen("unlabelled", most_unlabelled / max(1, texts.count()))
    marked = texts.join(F.broadcast(confirmed), F.col("doc_id") == F.col("id"), "left").select("text", F.col("id").isNotNull().alias("p"), drawn.alias("u"))
    found = marked.where("p or u").select("p", "u", F.array_sort(F.array_distinct(text_words(F.col("text")))).alias("words"))
    copies = found.groupBy(F.md5(F.array_join("words", " ").cast("binary")).alias("key")).agg(F.max("p").alias("p"), F.max("u").alias("u"), F.first("words").alias("words"))
    sample = stored(copies, "toxicity-sample")
    n_p, n_u = (x or 0 for x in sample.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first())
    if not n_p or not n_u:
        return Model((), (), -math.inf, prior)
    named = lambda k: lambda w: F.struct(F.lit(k).alias("kind"), w.alias("word"))
    each = F.concat(*[F.transform(F.array_distinct(text_features(F.col("words"), k)), named(k)) for k in KINDS])
    counts = sample.select("p", "u", F.explode(each).alias("f")).groupBy("f.kind", "f.word").agg(F.sum(F.col("p").cast("int")).alias("in_p"), F.sum(F.col("u").cast("int")).alias("in_u"))
    share_p, share_u = F.col("in_p") / n_p, F.col("in_u") / n_u
    gap = (share_p - share_u) / F.sqrt((share_p * (1 - share_p) + 1 / n_p) / n_p + (share_u * (1 - share_u) + 1 / n_u) / n_u)
    apart = share_p >= least_factor * share_u
    over = counts.where((F.col("in_p") >= least_documents) & apart & (gap >= least_errors)).select("kind", "word", "in_p", "in_u", gap.alias("gap"))
    # of features that begin alike and stand in as many documents, the shortest kind of word says it all
    alike = Window.partitionBy(F.substring("word", 1, min(filter(None, KINDS))), "in_p", "in_u").orderBy("kind", "word")
    top = over.withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    words = tuple((r["kind"], r["word"]) for r in top.orderBy(F.desc("gap"), "kind", "word").limit(most_words).collect())
    if not words:
        return Model((), (), math.log(prior / (1 - prior)), prior)
    rows = sample.select("key", "p", "u", *[_present(F.col("words"), words, k).alias(f"k{k}") for k in KINDS]).orderBy("key").collect()
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words) + 1))
    x[:, -1] = 1
    for r, row in enumerate(rows):
        x[r, [place[k, w] for k in KINDS for w in row[f"k{k}"]]] = 1
    p, u = x[[r["p"] for r in rows]], x[[r["u"] for r in rows]]
    w = np.mean([learn(p, u, prior, seed) for seed in range(classifiers)], axis=0)
    return Model(words, tuple(map(float, w[:-1])), float(w[-1]), prior)


def _present(found: Column, words: tuple[tuple[int, str], ...], kind: int) -> Column:
    """Model words of one kind among a text's words, in the model's order, once each."""
    return F.array_intersect(F.array(*[F.lit(w) for k, w in words if k == kind]).cast("array<string>"), text_features(found, kind))


def score(text: Column, model: Model) -> Column:
    """Probability of the toxic class, 0 to 1."""
    if not model.words:
        return F.lit(0.0 if model.bias == -math.inf else 1 / (1 + math.exp(-model.bias)))

    def added(found: Column) -> Column:
        logit = F.lit(model.bias)
        for kind in KINDS:
            own = [F.lit(x) for (k, word), weight in zip(model.words, model.weights, strict=True) if k == kind for x in (word, weight)]
            if own:
                table = F.create_map(*own)
                logit = F.aggregate(_present(found, model.words, kind), logit, _plus(table))
        return logit

    def _plus(table: Column):
        return lambda acc, w: acc + F.element_at(table, w)

    logit = let(text_words(text), added)
    return 1 / (1 + F.exp(-logit))
