"""Regularised logistic models of many expanding folds at once: Newton steps with the fold as a key.

A fold learns from the rows whose order is below its limit.  One pass gives the moments of all folds: sums
between neighbouring limits, added up from the first.  Then every Newton step is one pass in which each row adds
its gradient and second derivatives to all folds that hold it; what comes back is one small system per fold.
A walk forward with a hundred refits costs as many passes as one fit.

The loss of a fold is half the squared coefficients plus ``c`` times the weighted log losses, on features
scaled to mean 0 and deviation 1 of the fold's rows; balanced weights are rows / (2 rows of the class).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.operators import trees
from tideframe.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def row_blocks(df: DataFrame, features: list[str], label: Column, order: Column) -> RDD:
    """(order, label, features with 1 in front) matrices of the labelled rows; missing features are 0."""
    rows = df.select(order.cast("double").alias("__o"), label.cast("double").alias("__y"), F.array(*[F.coalesce(trees.finite(f), F.lit(0.0)) for f in features]).alias("__x")).where("__o IS NOT NULL AND __y IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1)]
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (*columns, x)], ["o", "y", "x"])

    def read(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.frombuffer(r.o)
        return o, np.frombuffer(r.y), np.concatenate([np.ones((len(o), 1)), np.frombuffer(r.x).reshape(len(o), -1)], axis=1)

    return staged(rows.mapInArrow(cut, "o binary, y binary, x binary")).rdd.map(read).persist(StorageLevel.MEMORY_AND_DISK)


def moments(limits: np.ndarray, block: tuple) -> np.ndarray:
    """(intervals between limits, [positive rows, sums, sums of squares]); column 0 of the features counts rows."""
    o, y, x = block
    at = np.searchsorted(limits, o, side="right")
    out = np.zeros((len(limits) + 1, 1 + 2 * x.shape[1]))
    np.add.at(out, at, np.concatenate([y[:, None], x, x * x], axis=1))
    return out


def steps(limits: np.ndarray, weights: np.ndarray, beta: np.ndarray, block: tuple) -> np.ndarray:
    """(folds, [loss, gradient, second derivatives]) of a block, for raw features."""
    o, y, x = block
    d = x.shape[1]
    out = np.zeros((len(limits), 1 + d + d * d))
    per = max(1, 4_000_000 // (len(limits) * d))
    for lo in range(0, len(o), per):
        ob, yb, xb = o[lo : lo + per], y[lo : lo + per], x[lo : lo + per]
        w = np.where(ob[:, None] < limits, np.where(yb[:, None] > 0.5, weights[:, 1], weights[:, 0]), 0.0)
        z = xb @ beta.T
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        out[:, 0] += (w * (np.logaddexp(0, z) - yb[:, None] * z)).sum(axis=0)
        out[:, 1 : 1 + d] += (w * (p - yb[:, None])).T @ xb
        out[:, 1 + d :] += np.einsum("nf,nd,ne->fde", w * p * (1 - p), xb, xb, optimize=True).reshape(len(limits), -1)
    return out


@dataclass
class FoldModels:
    """Coefficients by fold (intercept first, raw features), with the rows and the largest gradient of each fit."""

    features: list[str]
    limits: list[float]
    beta: np.ndarray
    rows: np.ndarray
    gradient: np.ndarray

    def probability(self, fold: Column) -> Column:
        """Probability by the model of the row's fold; NaN where that fold had only one class."""
        beta = self.beta

        @F.arrow_udf("double")
        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for batch, folds in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                own = beta[folds.to_numpy(zero_copy_only=False).astype(np.int64)]
                yield pa.array(1 / (1 + np.exp(-(own[:, 0] + (own[:, 1:] * x).sum(axis=1)))))

        return score(F.array(*[F.coalesce(trees.finite(f), F.lit(0.0)) for f in self.features]), fold)


def fit_folds(data: RDD, features: list[str], limits: list[float], c: float = 0.45, balanced: bool = True, rounds: int = 60) -> FoldModels:
    """Models of all folds; a fold with rows of one class has coefficients NaN."""
    d, folds = len(features) + 1, len(limits)
    if not folds or data.isEmpty():
        return FoldModels(features, limits, np.full((folds, d), np.nan), np.zeros(folds), np.zeros(folds))
    ordered = np.unique(np.array(limits, dtype=np.float64))
    sums = np.cumsum(trees.total(data, partial(moments, ordered), np.zeros((len(ordered) + 1, 1 + 2 * d))), axis=0)[np.searchsorted(ordered, limits)]
    n, ones = sums[:, 1], sums[:, 0]
    mean = sums[:, 2 : 1 + d] / np.maximum(n, 1)[:, None]
    deviation = np.sqrt(np.maximum(sums[:, 2 + d :] / np.maximum(n, 1)[:, None] - mean**2, 0))
    deviation[deviation < 1e-12] = 1.0
    weights = np.stack([n / (2 * np.maximum(n - ones, 1)), n / (2 * np.maximum(ones, 1))], axis=1) if balanced else np.ones((folds, 2))
    ok = (ones > 0) & (ones < n)
    # scaled features are T x raw features with 1 in front
    t = np.zeros((folds, d, d))
    t[:, 0, 0] = 1
    t[:, 1:, 0] = -mean / deviation
    t[:, np.arange(1, d), np.arange(1, d)] = 1 / deviation
    penalty = np.ones(d)
    penalty[0] = 0
    gamma, step, last = np.zeros((folds, d)), np.zeros((folds, d)), np.full(folds, np.inf)
    at = np.array(limits, dtype=np.float64)
    for _ in range(rounds):
        raw = trees.total(data, partial(steps, at, weights, np.einsum("fa,fab->fb", gamma, t)), np.zeros((folds, 1 + d + d * d)))
        loss = c * raw[:, 0] + (gamma**2 * penalty).sum(axis=1) / 2
        g = c * np.einsum("fab,fb->fa", t, raw[:, 1 : 1 + d]) + gamma * penalty
        worse = ok & (loss > last + 1e-9 * np.abs(last))
        if not worse.any() and np.abs(g[ok]).max(initial=0) < 1e-8:
            break
        h = c * np.einsum("fab,fbc,fdc->fad", t, raw[:, 1 + d :].reshape(folds, d, d), t) + np.diag(penalty) + 1e-12 * np.eye(d)
        new = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        # a fold whose loss rose goes back half of its last step
        gamma = np.where(worse[:, None], gamma - step / 2, gamma + new)
        step = np.where(worse[:, None], step / 2, new)
        last = np.where(worse, last, loss)
    beta = np.einsum("fa,fab->fb", gamma, t)
    beta[~ok] = np.nan
    return FoldModels(features, limits, beta, n, np.where(ok, np.abs(g).max(axis=1), np.nan))
