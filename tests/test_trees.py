"""Tree learners, fold fits and expanding isotonic calibration against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import folds_fit, isotone, trees


def frame(spark, n=4_000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rnd.random(), rnd.choice([None, 1.0, 2.0, float("nan"), float("inf")]), rnd.gauss(0, 1)
        y = int(rnd.random() < 1 / (1 + math.exp(-(3 * a - 1.5 + (1 if b is None else 0) + c * (a > 0.5)))))
        rows.append((k, a, b, c, y, k % 40))
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int, g int")


def exhaustive(rows, min_rows, l2):
    """Best first split of a logistic model by trying every feature, value and side of the missing ones."""
    p = sum(r.y for r in rows) / len(rows)
    g, h = [p - r.y for r in rows], p * (1 - p)
    strength = lambda s, n: s * s / (n * h + l2)
    best = None
    for f in ("a", "b", "c"):
        x = [None if getattr(r, f) is None or not math.isfinite(getattr(r, f)) else getattr(r, f) for r in rows]
        for cut in sorted({round(v, 12) for v in x if v is not None})[:-1] + [max(v for v in x if v is not None)]:
            for missing_left in (False, True):
                left = [gi for gi, v in zip(g, x) if (missing_left if v is None else v <= cut + 1e-12)]
                n = len(left)
                if n >= min_rows and len(rows) - n >= min_rows:
                    gain = strength(sum(left), n) + strength(sum(g) - sum(left), len(rows) - n) - strength(sum(g), len(rows))
                    if best is None or gain > best + 1e-9:
                        best = gain
    return best


def test_first_split_equals_exhaustive_search(spark):
    d = frame(spark, 600).withColumns({"a": F.round("a", 2), "c": F.round("c", 1)})
    bins = trees.quantile_bins(d, ["a", "b", "c"])
    assert [len(e) for e in bins.edges] == [d.select(c).where(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e300").distinct().count() - 1 for c in ("a", "b", "c")]
    model = trees.boost(trees.chunks(d, bins, F.col("y")), bins, trees.Logistic(), 1, 0.1, trees.Shape(leaves=2, min_rows=20, l2=0.8))
    assert model.trees[0].gain[0] == pytest.approx(exhaustive(d.collect(), 20, 0.8), rel=1e-4)


def test_boosting_is_the_same_for_any_partitions_and_learns(spark):
    d = frame(spark)
    out = []
    for parts in (1, 7):
        bins = trees.quantile_bins(d, ["a", "b", "c"])
        data = trees.chunks(d.repartition(parts), bins, F.col("y"), valid=F.col("k") % 4 == 0)
        out.append(trees.boost(data, bins, trees.Logistic(), 20, 0.2, trees.Shape(leaves=6, min_rows=30, l2=0.5), patience=8))
    assert [t.__dict__ for t in out[0].trees] == [t.__dict__ for t in out[1].trees]
    assert out[0].history[-1] > out[0].history[0] + 0.03
    rows = d.select("a", "b", "c", out[0].margin().alias("m")).collect()
    x = out[0].bins.code(np.array([[np.nan if v is None or not math.isfinite(v) else v for v in (r.a, r.b, r.c)] for r in rows]))
    assert [r.m for r in rows] == pytest.approx((out[0].start + sum(t.predict(x) for t in out[0].trees)).tolist())
    assert out[0].importance()["a"] > 0
    shape = out[0].trees[0]
    assert sum(f < 0 for f in shape.feature) <= 6


def test_leaves_are_split_in_order_of_gain(spark):
    d = frame(spark)
    bins = trees.quantile_bins(d, ["a", "b", "c"])
    data = trees.chunks(d, bins, F.col("y"))
    big = trees.boost(data, bins, trees.Logistic(), 1, 0.1, trees.Shape(leaves=8, min_rows=30)).trees[0]
    in_order = lambda t: [g for _, g, f in sorted(zip(t.left, t.gain, t.feature)) if f >= 0]
    gains = in_order(big)
    assert all(g <= max(gains[:k]) for k, g in enumerate(gains) if k)
    for leaves in range(2, 8):
        t = trees.boost(data, bins, trees.Logistic(), 1, 0.1, trees.Shape(leaves=leaves, min_rows=30)).trees[0]
        assert in_order(t) == gains[: leaves - 1]


def loop_lambdas(s, y, top, norm):
    """Gradients of one group, pair by pair."""
    n = len(s)
    order = sorted(range(n), key=lambda i: (-s[i], i))
    gain = [2.0**v - 1 for v in y]
    best = sum(g / math.log2(k + 2) for k, g in enumerate(sorted(gain, reverse=True)[:top]))
    g, h, total = [0.0] * n, [0.0] * n, 0.0
    for a in range(min(top, n)):
        for b in range(a + 1, n):
            i, j = order[a], order[b]
            if y[i] == y[j] or not best:
                continue
            hi, lo = (i, j) if y[i] > y[j] else (j, i)
            delta = abs(gain[i] - gain[j]) * abs(1 / math.log2(a + 2) - 1 / math.log2(b + 2)) / best
            if norm and max(s) != min(s):
                delta /= 0.01 + abs(s[i] - s[j])
            p = 1 / (1 + math.exp(s[hi] - s[lo]))
            g[hi] -= p * delta
            g[lo] += p * delta
            h[i] += p * (1 - p) * delta
            h[j] += p * (1 - p) * delta
            total += 2 * p * delta
    scale = math.log2(1 + total) / total if norm and total else 1.0
    return [v * scale for v in g], [v * scale for v in h]


@pytest.mark.parametrize("norm", [False, True])
def test_lambdas_equal_a_loop_over_pairs(norm):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 12, 40):
        s, y = np.round(rng.normal(size=(6, n)), 1), rng.integers(0, 5, (6, n)).astype(float)
        s[0], y[1] = 0.0, 2.0
        got = trees.LambdaRank(top=8, norm=norm).lambdas(s, y)
        for k in range(6):
            want = loop_lambdas(s[k].tolist(), y[k].tolist(), 8, norm)
            assert got[0][k].tolist() == pytest.approx(want[0], abs=1e-12) and got[1][k].tolist() == pytest.approx(want[1], abs=1e-12)


def test_ranking_beats_regression_on_the_grade(spark):
    rnd = random.Random(5)
    rows = []
    for date in range(240):
        level = rnd.gauss(0, 3)  # moves all grades' features of a date, which says nothing about their order
        for k in range(12):
            quality = rnd.random()
            rows.append((date, k, quality + 0.25 * rnd.gauss(0, 1) + level, quality + 0.4 * rnd.gauss(0, 1), min(4, int(5 * quality))))
    d = spark.createDataFrame(rows, "date int, symbol int, u double, v double, grade int")
    bins = trees.quantile_bins(d, ["u", "v"])
    data = trees.chunks(d, bins, F.col("grade"), valid=F.col("date") >= 180, groups=["date"], ties=["symbol"])
    rank = trees.boost(data, bins, trees.LambdaRank(k=3), 60, 0.1, trees.Shape(leaves=9, depth=3, min_rows=12, l2=12, l1=2), patience=20)
    plain = trees.boost(data, bins, trees.Squared(), 60, 0.1, trees.Shape(leaves=9, depth=3, min_rows=12), patience=20)
    objective = trees.LambdaRank(k=3)
    measure = lambda m: trees.total(data, lambda c: objective.measure(c, trees.margins(c, m.trees)), np.zeros(2))
    ours, theirs = measure(rank), measure(plain)
    assert ours[1] == theirs[1] == 60 and ours[0] / 60 >= theirs[0] / 60 - 1e-9
    assert max(rank.history) == pytest.approx(ours[0] / 60)
    assert data.map(lambda c: len(c.starts)).sum() == 240


def test_extra_trees_are_seeded_and_bounded_by_their_fold(spark):
    d = frame(spark)
    bins = trees.quantile_bins(d, ["a", "b", "c"])
    made = [trees.extra_trees(trees.chunks(d.repartition(p), bins, F.col("y"), order=F.col("k")), bins, 6, 4, 20, limits=[1_000, 4_000]) for p in (1, 5)]
    assert [t.__dict__ for t in made[0].trees] == [t.__dict__ for t in made[1].trees]
    early = trees.extra_trees(trees.chunks(d.where("k < 1000"), bins, F.col("y"), order=F.col("k")), bins, 6, 4, 20, limits=[1_000])
    assert [t.__dict__ for t in early.trees] == [t.__dict__ for t in made[0].trees[:6]]
    assert len({tuple(t.cut) for t in made[0].trees}) > 6
    p = d.select("y", made[0].probability(F.lit(1)).alias("p")).collect()
    assert 0 <= min(r.p for r in p) and max(r.p for r in p) <= 1
    up = [r.p for r in p if r.y]
    assert sum(up) / len(up) > sum(r.p for r in p) / len(p) + 0.02
    for tree in made[0].trees:  # every leaf holds enough rows of its fold
        assert len(tree.feature) >= 3


def plain_newton(x, y, c):
    """One fold by plain Newton steps on scaled features."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    pen, g = np.diag([0.0] + [1.0] * x.shape[1]), np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ g))
        g = g - np.linalg.solve(c * (z.T * (w * p * (1 - p))) @ z + pen, c * z.T @ (w * (p - y)) + pen @ g)
    return z, g


def test_all_folds_equal_separate_fits(spark):
    d = frame(spark).withColumn("big", F.col("c") * 3 + 1000).withColumn("flat", F.lit(5.0))
    features, limits = ["a", "b", "big", "flat"], [200.0, 900.0, 900.0, 4_000.0, 0.0]
    model = folds_fit.fit_folds(folds_fit.row_blocks(d.repartition(5), features, F.col("y"), F.col("k")), features, limits)
    rows = sorted(d.collect(), key=lambda r: r.k)
    x = np.array([[0.0 if v is None or not math.isfinite(v) else v for v in (r.a, r.b, r.big, r.flat)] for r in rows])
    y = np.array([r.y for r in rows], dtype=float)
    for fold, limit in enumerate(limits[:4]):
        n = int(limit)
        z, g = plain_newton(x[:n], y[:n], 0.45)
        assert np.allclose(model.beta[fold, 0] + x[:n] @ model.beta[fold, 1:], z @ g, atol=1e-6)
        assert model.rows[fold] == n and model.gradient[fold] < 1e-6
    assert np.isnan(model.beta[4]).all()
    got = d.where("k < 50").select("k", model.probability(F.lit(3)).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx((1 / (1 + np.exp(-(model.beta[3, 0] + x[[r.k for r in got]] @ model.beta[3, 1:])))).tolist())


def plain_isotonic(points):
    """Max-min of interval means at the known scores."""
    scores = sorted({p[0] for p in points})
    n, t = ([sum(v for s, v in rows if s == x) for x in scores] for rows in ([(s, 1) for s, _ in points], points))
    mean = lambda a, b: sum(t[a : b + 1]) / sum(n[a : b + 1])
    k = range(len(scores))
    table = {(a, b): mean(a, b) for a in k for b in k if a <= b}
    return scores, [max(min(table[a, b] for b in k if b >= i) for a in k if a <= i) for i in k]


@pytest.mark.parametrize("ranges", [1, 7])
def test_expanding_isotonic_equals_refits(spark, ranges):
    rnd = random.Random(9)
    rows = [(f"2020-{1 + k // 60:02d}-{1 + k // 20 % 3 * 9:02d}", f"s{k % 20}", None if k % 17 == 0 else round(rnd.random() * 3, 1) / 3, None if k % 13 == 0 else int(rnd.random() < 0.5)) for k in range(400)]
    d = spark.createDataFrame(rows, "date string, symbol string, prob double, y int").withColumn("date", F.to_date("date")).withColumn("day", F.lit(1)).withColumn("n", F.lit(1))
    got = {(str(r.date), r.symbol, r.prob): r.calibrated for r in isotone.expanding_isotonic(d, "prob", "y", 60, ranges=ranges).collect()}
    assert len(got) == len({r[:3] for r in rows})
    fits = {}
    for date in {r[0] for r in rows}:
        before = [(p, y) for t, _, p, y in rows if t < date and p is not None and y is not None]
        fits[date] = plain_isotonic(before) if len(before) >= 60 else None
    for date, symbol, prob, _ in rows:
        want = prob if prob is None or fits[date] is None else float(np.interp(prob, *fits[date]))
        assert got[date, symbol, prob] == (None if want is None else pytest.approx(want, abs=1e-12)), (date, symbol, prob)


def test_nothing_to_learn(spark):
    d = frame(spark, 40).limit(0)
    bins = trees.quantile_bins(d, ["a", "b"])
    model = trees.boost(trees.chunks(d, bins, F.col("y")), bins, trees.Logistic(), 3, 0.1, trees.Shape())
    assert model.trees == [] and d.select(model.margin()).count() == 0
    assert isotone.expanding_isotonic(d.withColumn("date", F.current_date()), "a", "y").count() == 0
    one = frame(spark, 40).withColumn("y", F.lit(1))
    data = trees.chunks(one, bins, F.col("y"))
    assert trees.boost(data, bins, trees.Logistic(), 2, 0.1, trees.Shape(min_rows=5)).trees == []
