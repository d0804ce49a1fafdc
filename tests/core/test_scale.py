"""Resampling, skylines, streaks and order statistics that are dealt over tasks, against plain versions."""

import contextlib
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.operators import ranks, redraw, resample, select, skyline, stats, telemetry


def plan_of(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


# -- slots ----------------------------------------------------------------------------------------------------------


def test_slot_words_are_those_of_md5():
    for seed, draw, start, end in ((42, 0, 0, 12_345), (42, 199, 0, 700), (-7, 12, 990_000, 1_010_001), (3, 1_000, 123_450_000, 123_450_003)):
        want = [int(hashlib.md5(f"{seed}:{draw}:{slot}".encode()).hexdigest()[:8], 16) for slot in range(start, end)]
        assert redraw.slot_words(seed, draw, start, end).tolist() == want
    for places in ([0], [65535], [0, 0, 3, 255, 300], [5, 5, 60_000]):
        assert redraw.unpacked(redraw.packed(np.array(places, np.int32))).tolist() == places


def test_draws_over_blocks_and_sets_of_draws(spark):
    """Rows of two blocks, draws of two sets, a null value; the given rows are computed once and pairs are no rows."""
    n, samples, seen = 66_000, 66, spark.sparkContext.accumulator(0)

    @F.udf("long")
    def value(i):
        seen.add(1)
        return None if i % 11 == 0 else i % 5

    frame = spark.range(0, n, 1, 3).select((F.col("id") * 3).alias("i"), value("id").alias("v"))
    statistic = {"s": F.sum(F.col("v") * F.col("times")), "t": F.sum("times"), "k": F.sum(F.when(F.col("v").isNull(), F.col("times")))}
    got = {r.draw: (r.s, r.t, r.k) for r in stats.draws(frame, "i", samples, statistic).collect()}
    assert seen.value == n and sorted(got) == list(range(samples))
    for draw in (0, 63, 64, 65):
        rows = [int(hashlib.md5(f"42:{draw}:{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]
        assert got[draw] == (sum(r % 5 for r in rows if r % 11), n, sum(r % 11 == 0 for r in rows))


# -- Poisson weights ------------------------------------------------------------------------------------------------


def test_weights_are_poisson_and_independent():
    rng = np.random.default_rng(1)
    made = resample.weights(rng.integers(0, 2**32, 3_000), rng.integers(0, 2**32, 3_000), 400)
    share = np.bincount(made.ravel(), minlength=8)[:6] / made.size
    assert np.abs(share - [0.36788, 0.36788, 0.18394, 0.06131, 0.01533, 0.00307]).max() < 0.002
    assert abs(made.mean() - 1) < 0.01 and abs(made.var() - 1) < 0.02
    assert np.abs(np.corrcoef(made[:, :40].T) - np.eye(40)).max() < 0.1 and np.abs(np.corrcoef(made[:40]) - np.eye(40)).max() < 0.25


def test_sums_do_not_hang_on_partitions(spark):
    frame = spark.createDataFrame([(i, float(i % 5)) for i in range(700)], "i long, v double")
    one, many = (resample.poisson_sums(f, "i", ("v",), 50).orderBy("draw").collect() for f in (frame.coalesce(1), frame.repartition(13)))
    assert one == many and len(one) == 50
    plan = plan_of(resample.poisson_sums(frame, "i", ("v",), 50))
    assert "Join" not in plan and "Generate" not in plan


def test_intervals(spark):
    rng = random.Random(4)
    values = [rng.gauss(10, 3) for _ in range(900)]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = stats.mean_interval(frame, "i", "v", 2_000).first()
    mean, se = np.mean(values), np.std(values) / 30
    assert abs((got.high - got.low) / 2 / (1.96 * se) - 1) < 0.1 and abs((got.high + got.low) / 2 - mean) < se / 4
    tuned = frame.withColumn("v", F.col("v") + 1)
    delta = stats.paired_mean_interval(frame, tuned, "i", "v", 100).first()
    assert delta.low == pytest.approx(1) and delta.high == pytest.approx(1)
    counts = spark.createDataFrame([(i, int(i % 3 > 0), 1, 1) for i in range(300)], "i int, m int, p int, g int")
    f1 = stats.f1_interval(counts, "i", ("m", "p", "g"), 500).first()
    assert 0.55 < f1.low < 2 / 3 < f1.high < 0.8
    better = counts.withColumn("m", F.lit(1))
    both = stats.paired_f1_interval(counts, better, "i", ("m", "p", "g"), 500).first()
    assert both.low == pytest.approx(1 - f1.high) and both.high == pytest.approx(1 - f1.low, abs=0.01)
    for bad in (lambda: stats.mean_interval(frame.limit(0), "i", "v", 5), lambda: stats.mean_interval(frame, "i", "v", 0), lambda: stats.paired_mean_interval(frame, frame.limit(3), "i", "v", 5)):
        with pytest.raises(stats.SeriesError):
            bad()


def test_null_ids_and_values(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, None), (3, 4.0)], "i long, v double")
    made = resample.poisson_sums(frame, "i", ("v",), 20).collect()
    assert len(made) == 20 and all(r.weight >= 0 for r in made)
    assert resample.poisson_sums(frame.limit(0), "i", ("v",), 20).count() == 0


# -- skylines -------------------------------------------------------------------------------------------------------


def plain_front(points):
    return {p for p in points if not any(all(a >= b for a, b in zip(q, p)) and q != p for q in points)}


@pytest.mark.parametrize(("seed", "dims", "spread"), [(1, 2, 30), (2, 3, 12), (3, 4, 6), (4, 1, 50)])
def test_fronts(spark, seed, dims, spread):
    rng = random.Random(seed)
    points = {tuple(float(rng.randrange(spread)) for _ in range(dims)) for _ in range(500)} | {(float("-inf"),) * dims}
    names = [f"v{i}" for i in range(dims)]
    frame = spark.createDataFrame(list(points), ", ".join(f"{n} double" for n in names)).repartition(5)
    made = skyline.front(frame, names)
    assert {tuple(r) for r in made.collect()} == plain_front(points)
    assert skyline.front(frame.limit(0), names).count() == 0


def test_fronts_of_many_blocks(spark, monkeypatch):
    """Points of which hardly any is dominated stay in blocks that are compared pair by pair."""
    monkeypatch.setattr(skyline, "BLOCK", 64)
    rng = random.Random(7)
    points = {(float(i), float(1_000 - i + rng.randrange(3)), float(rng.randrange(5))) for i in range(700)}
    frame = spark.createDataFrame(list(points), "a double, b double, c double")
    assert {tuple(r) for r in skyline.front(frame, ["a", "b", "c"]).collect()} == plain_front(points)


def test_skyline_plan_has_no_nested_loop(spark):
    rows = spark.range(1_000).select("id", (F.col("id") % 37).alias("q"), (F.col("id") % 91).alias("m"))
    made = select.skyline(rows, "id", ["q"], ["m"])
    assert "NestedLoop" not in plan_of(made) and "Cartesian" not in plan_of(made)
    want = plain_front({(float(i % 37), -float(i % 91)) for i in range(1_000)})
    assert {r.id for r in made.collect()} == {i for i in range(1_000) if (float(i % 37), -float(i % 91)) in want}


# -- streaks --------------------------------------------------------------------------------------------------------


def plain_streak(flags):
    now = best = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


@pytest.fixture
def uncoalesced(spark):
    """Small inputs keep their ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streaks_across_ranges(spark, uncoalesced):
    rng = random.Random(2)
    groups = {"hot": [rng.random() < 0.9 for _ in range(2_000)], "all": [True] * 300, "none": [False] * 5, None: [True, True, False], "long": [i % 400 > 0 for i in range(1_200)]}
    rows = [(g, t, f or (None if t % 2 else False)) for g, flags in groups.items() for t, f in enumerate(flags)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, t int, f boolean").repartition(6)
    parts = telemetry.run_summaries(frame, F.col("f"), ["t"], ("g",))
    assert parts.where("g = 'hot'").count() > 1  # one group lies in several ranges
    got = {r.g: (r.longest, r.has_streak) for r in telemetry.streaks(frame, F.col("f"), ["t"], ("g",)).collect()}
    assert got == {g: (plain_streak(flags), plain_streak(flags) >= 3) for g, flags in groups.items()}
    whole = telemetry.streaks(frame.where("g = 'long'"), F.col("f"), ["t"]).first()
    assert whole.longest == 399
    assert telemetry.streaks(frame.limit(0), F.col("f"), ["t"], ("g",)).count() == 0


# -- order statistics -----------------------------------------------------------------------------------------------


def test_brackets(spark, monkeypatch):
    """Sketched brackets, brackets that miss, and groups without a sketch give the same values."""
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3_000)] + [("b", float(rng.randrange(4))) for _ in range(2_000)] + [("c", 5.0), ("d", None), (None, 1.5)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "p50": 0.5, "p99": 0.99, "high": 1.0}
    values = {}
    for g, v in rows:
        values.setdefault(g, []).extend([] if v is None else [v])
    want = {g: [sorted(v)[int(s * (len(v) - 1))] if v else 0.0 for s in shares.values()] for g, v in values.items()}
    for small, accuracy in ((100_000, 20_000), (100, 500), (100, 20)):
        monkeypatch.setattr(ranks, "SMALL", small)
        monkeypatch.setattr(ranks, "ACCURACY", accuracy)
        got = {r.g: [r[s] for s in shares] for r in stats.percentiles(frame, "v", shares, ("g",)).collect()}
        assert got == want, (small, accuracy)
    real = F.percentile_approx
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda value, points, accuracy: real(value, [0.3] * len(points), accuracy))
    got = {r.g: [r[s] for s in shares] for r in stats.percentiles(frame, "v", shares, ("g",)).collect()}
    assert got == want


def test_percentiles_sort_no_rows(spark):
    frame = spark.range(10_000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = plan_of(stats.percentiles(frame, "v", {"p": 0.5}, ("g",)))
    assert "rangepartitioning" not in plan


def test_end_quartiles_by_rank(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(g, rng.randrange(30), i, rng.random()) for g in ("a", "b", None) for i in range({"a": 900, "b": 41, None: 3}[g])]
    frame = spark.createDataFrame(rows, "g string, t int, i int, v double").repartition(4)
    want = {}
    for g in ("a", "b", None):
        held = [v for _, _, v in sorted((t, i, v) for k, t, i, v in rows if k == g)]
        part = max(1, len(held) // 4)
        want[g] = (sum(held[:part]) / part, sum(held[-part:]) / part)
    for small in (100_000, 50):
        monkeypatch.setattr(ranks, "SMALL", small)
        got = {r.g: (r.first_quartile, r.last_quartile) for r in stats.end_quartiles(frame, "v", ["t", "i"], ("g",)).collect()}
        assert got == {g: pytest.approx(w) for g, w in want.items()}
    tied = spark.createDataFrame([(1, 0.0), (1, 10.0), (2, 3.0), (2, 5.0)], "t int, v double")
    whole = stats.end_quartiles(tied, "v", ["t"]).first()
    assert (whole.first_quartile, whole.last_quartile) == (5.0, 4.0)  # rows that tie at the edge count in part
    text = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0), ("w", 0.5)], "t string, v double")
    assert tuple(stats.end_quartiles(text, "v", ["t"]).first()) == (0.5, 3.0)
