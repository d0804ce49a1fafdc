import random

from pyspark.sql import functions as F

from callmetrics.llm import toxicity


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            text[3], text[20] = rng.choice(("vilewordA", "meanly", "grubbish")), rng.choice(("grubbery", "vileword", "meanly."))
        docs.append((i, " ".join(text), "x"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_leakage(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    y = spark.createDataFrame(labels + [(0, 1), (2, None)], "doc_id long, toxic int")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(d.where(~out), y.where(~out))
    scored = {r.doc_id: r.s for r in d.where(out).select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    hits = [(s >= 0.7) == (i % 8 == 0) for i, s in scored.items()]
    assert sum(hits) / len(hits) > 0.95 and all(0 <= s <= 1 for s in scored.values())
    flipped = spark.createDataFrame([(i, 1 - t) for i, t in labels], "doc_id long, toxic int")
    mixed = y.where(~out).unionByName(flipped.where(out)).where(~out)
    assert toxicity.fit(d.where(~out), mixed) == model


def test_odd_inputs(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(d, none)
    assert [r.s for r in d.select(toxicity.score(F.col("text"), model).alias("s")).collect()] == [0.0] * 4
    some = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, some)
    assert all(0 <= r.s <= 1 for r in d.select(toxicity.score(F.col("text"), model).alias("s")).collect())


def test_risk_and_its_slopes():
    import numpy as np

    rng = np.random.default_rng(1)
    xp, xu = rng.integers(0, 2, (6, 4)).astype(float), rng.integers(0, 2, (9, 4)).astype(float)
    wp, wu, w, prior = np.full(6, 1 / 6), np.full(9, 1 / 9), rng.normal(size=4), 0.3
    loss = lambda g: np.log(1 + np.exp(-g))
    positive, slope_p, clean, slope_c = toxicity.risk(xp, wp, xu, wu, prior, w)
    assert abs(positive - prior * np.mean([loss(x @ w) for x in xp])) < 1e-12
    assert abs(clean - (np.mean([loss(-(x @ w)) for x in xu]) - prior * np.mean([loss(-(x @ w)) for x in xp]))) < 1e-12
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        up, down = (toxicity.risk(xp, wp, xu, wu, prior, w + s * step) for s in (1, -1))
        assert abs((up[0] - down[0]) / 2e-6 - slope_p[k]) < 1e-6 and abs((up[2] - down[2]) / 2e-6 - slope_c[k]) < 1e-6


def test_unlabelled_documents_are_learnt_from(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    positives = spark.createDataFrame([x for x in labels if x[1]], "doc_id long, toxic int")
    only = toxicity.fit(d, positives.unionByName(spark.createDataFrame([(10**6 + i, 0) for i in range(400)], "doc_id long, toxic int")))
    assert only.words  # the clean labels name no document: whatever tells toxic text apart comes from unlabelled ones
    got = {r.doc_id: r.s for r in d.select("doc_id", toxicity.score(F.col("text"), only).alias("s")).collect()}
    assert sum((s >= 0.5) == (i % 8 == 0) for i, s in got.items()) / len(got) > 0.95
