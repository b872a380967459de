"""Sizes of the learning steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe import catalog
from tideframe.operators import learn


@pytest.mark.parametrize("name", ["ml07_ridge_and_forest", "ml23_feature_importance"])
def test_forests_have_the_source_size(spark, monkeypatch, name):
    trees = []
    for kind in ("RandomForestClassifier", "RandomForestRegressor"):
        monkeypatch.setattr(learn, kind, lambda make=getattr(learn, kind), **k: trees.append(k["numTrees"]) or make(**k))
    assert catalog.load()[name].run(spark, "/root/testdata/sf0.001").count() > 0
    assert trees == [60]


def test_window_components_equal_those_of_explicit_windows(spark):
    rnd = random.Random(3)
    rows = [(s, k, rnd.gauss(0, 1) + (0.8 * k % 3), rnd.gauss(0, 2)) for s, m in (("a", 60), ("b", 35), ("c", 4), ("d", 5)) for k in range(m)]
    d = spark.createDataFrame(rows, "symbol string, date int, x double, y double")
    n, k = 5, 3
    _, components = learn.window_components(d, ["x", "y"], n, k, F.col("date") <= 40)
    series = {s: sorted((r[1:] for r in rows if r[0] == s)) for s in "abcd"}
    window = {(s, v[i][0]): np.array([c for r in v[i - n + 1 : i + 1] for c in r[1:]]) for s, v in series.items() for i in range(n - 1, len(v))}
    train = np.array([w for (s, date), w in window.items() if date <= 40])
    values, vectors = np.linalg.eigh(np.cov(train.T, bias=True))
    for got, want in zip(components, vectors[:, ::-1].T):
        assert abs(got @ want) == pytest.approx(1, abs=1e-9)
    out = learn.embed(d, ["x", "y"], n, components)
    assert out.columns == ["symbol", "date", "x", "y", "embedding"] and out.count() == len(window)
    for r in out.collect():
        assert r.embedding == pytest.approx((components @ window[r.symbol, r.date]).tolist())
    assert learn.embed(d.limit(0), ["x", "y"], n, learn.window_components(d.limit(0), ["x", "y"], n, k, F.lit(True))[1]).count() == 0
