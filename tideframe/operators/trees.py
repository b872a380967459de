"""Tree models whose levels are aggregates over all rows: histogram boosting, learning to rank, extremely randomised trees.

Features are cut into at most 255 bins once.  Rows are written as chunks (arrays of bins, label, weight and
group bounds), and every level of a tree is one pass over the chunks that returns one histogram per
open node: rows, gradient and second derivative per (feature, bin).  A histogram's size depends on nodes, features
and bins only, never on rows; gradients are summed in fixed point, so a model is the same for every
number of partitions.  The driver holds trees and the sums of one level, no rows.

Boosted trees grow leaf by leaf in order of gain.  All open nodes are looked at in one pass, so a tree costs as many
passes as it has levels.  Missing values have a bin of their own and go to the side with the higher gain.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.operators import pooled
from tideframe.session import staged

# functions sent to executors carry their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, MISSING = 255, 255
#: Unit of gradient sums: sums of up to 2 ** 39 rows of weighted gradients up to 1 fit 64 bits.
FIXED = 2.0**24
CHUNK_ROWS = 50_000
#: Rounds after which the margins of all rows are stored anew.
REBASE = 16


@dataclass
class Bins:
    """Upper bounds of the bins of each feature; a value beyond the last one is in one bin more."""

    features: list[str]
    edges: list[np.ndarray]

    def code(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.where(np.isnan(x[:, k]), MISSING, np.searchsorted(edges, x[:, k]))
        return out


def finite(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def vector(features: list[str]) -> Column:
    return F.array(*[finite(f) for f in features])


def quantile_bins(df: DataFrame, features: list[str], bins: int = BINS) -> Bins:
    """Bounds at every distinct value of a feature with few of them, else at exact quantiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("f"), finite(name).alias("v")) for k, name in enumerate(features)])).alias("r")).select("r.*").where("v IS NOT NULL")
    values = staged(long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")))
    # at most ``bins`` values or quantiles per feature reach the driver
    distinct = dict(values.groupBy("f").count().collect())
    few, many = [f for f, n in distinct.items() if n <= bins], [f for f, n in distinct.items() if n > bins]
    found = values.where(F.col("f").isin(few)).select("f", "v").collect() if few else []
    if many:
        found += pooled.exact_quantiles(long.where(F.col("f").isin(many)), ["f"], "v", [i / bins for i in range(1, bins)]).select("f", "value").collect()
    edges = [np.unique([v for f, v in found if f == k]) for k in range(len(features))]
    return Bins(features, [e[:-1] if k in few else e for k, e in enumerate(edges)])


@dataclass
class Chunk:
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    valid: np.ndarray
    starts: np.ndarray
    order: np.ndarray
    margin: np.ndarray

    def moved(self, trees: list[Tree]) -> Chunk:
        return Chunk(self.x, self.y, self.weight, self.valid, self.starts, self.order, margins(self, trees))


SCHEMA = "x binary, y binary, weight binary, valid binary, starts binary, order binary"


def chunks(df: DataFrame, bins: Bins, label: Column, weight: Column | None = None, valid: Column | None = None, groups: list[str] = (), ties: list[str] = (), order: Column | None = None) -> RDD:
    """Rows of ``df`` with a label as chunks.  ``groups`` (rankings) are never cut; ``valid`` rows only measure;
    ``order`` is the position that limits the training rows of a fold."""
    rows = df.select(*groups, *ties, vector(bins.features).alias("__x"), label.cast("double").alias("__y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w"),
                     F.coalesce(F.lit(False) if valid is None else valid, F.lit(False)).alias("__v"), (F.lit(0.0) if order is None else order.cast("double")).alias("__o")).where("__y IS NOT NULL")
    if groups:
        rows = rows.repartition(*groups).sortWithinPartitions(*groups, *ties)
    rows = rows.select(F.xxhash64(*groups).alias("__g") if groups else F.lit(0).cast("long").alias("__g"), "__x", "__y", "__w", "__v", "__o")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def whole(parts: list[tuple]) -> pa.RecordBatch:
            g, x, y, w, v, o = (np.concatenate(c) for c in zip(*parts))
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])).astype(np.int64) if groups else np.zeros(1, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (x, y, w, v, starts, o)], ["x", "y", "weight", "valid", "starts", "order"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = bins.code(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))
            g, (y, w, o) = batch.column(0).to_numpy(), (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3, 5))
            v = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            held.append((g, x, y, w, v, o))
            if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
                last = g[-1]
                tail = int(np.searchsorted(np.cumsum((g != last)[::-1]), 1)) if groups else 0
                if not groups or tail < n:
                    k = n - tail
                    held[-1] = tuple(a[:k] for a in (g, x, y, w, v, o))
                    yield whole(held)
                    held = [tuple(a[k:] for a in (g, x, y, w, v, o))] if tail else []
        if held:
            yield whole(held)

    table = staged(rows.mapInArrow(cut, SCHEMA))

    def read(r) -> Chunk:
        y = np.frombuffer(r.y)
        return Chunk(np.frombuffer(r.x, np.uint8).reshape(len(y), -1), y, np.frombuffer(r.weight), np.frombuffer(r.valid, bool), np.frombuffer(r.starts, np.int64), np.frombuffer(r.order), np.zeros(len(y)))

    return table.rdd.map(read).persist(StorageLevel.MEMORY_AND_DISK)


def total(rdd: RDD, f: Callable, zero: np.ndarray):
    """Sum of ``f(chunk)`` over all chunks; in two steps where there are many partitions."""
    sums = rdd.mapPartitions(lambda part: [added([f(c) for c in part], zero)])
    return sums.treeReduce(lambda a, b: a + b) if rdd.getNumPartitions() > 64 else sums.fold(zero, lambda a, b: a + b)


def added(parts: list, zero):
    out = zero
    for p in parts:
        out = out + p
    return out


# --- trees -------------------------------------------------------------------------------

@dataclass
class Tree:
    """Node 0 is the root; ``feature`` is -1 at leaves; bins up to ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float = 0.0) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node], self.right[node], self.gain[node] = feature, cut, missing_left, left, left + 1, gain
        for _ in range(2):
            for column, blank in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                column.append(blank)
        return left, left + 1

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, missing_left, left, right = (np.array(c) for c in (self.feature, self.cut, self.missing_left, self.left, self.right))
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            bins = x[rows, feature[node]]
            at[rows] = np.where(np.where(bins == MISSING, missing_left[node], bins <= cut[node]), left[node], right[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(x)]


def margins(chunk: Chunk, trees: list[Tree]) -> np.ndarray:
    out = chunk.margin
    for tree in trees:
        out = out + tree.predict(chunk.x)
    return out


# --- objectives --------------------------------------------------------------------------

class Logistic:
    def gradient(self, c: Chunk, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-m))
        return p - c.y, p * (1 - p)

    def measure(self, c: Chunk, m: np.ndarray) -> np.ndarray:
        """Sum of minus the log loss, and rows."""
        v = c.valid
        return np.array([-(np.logaddexp(0, m[v]) - c.y[v] * m[v]).sum(), v.sum()])

    def start(self, mean: float) -> float:
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))


class Squared:
    def gradient(self, c: Chunk, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m - c.y, np.ones(len(m))

    def measure(self, c: Chunk, m: np.ndarray) -> np.ndarray:
        return np.array([-((m - c.y)[c.valid] ** 2).sum(), c.valid.sum()])

    def start(self, mean: float) -> float:
        return mean


class LambdaRank:
    """Pairwise gradients of a group's order, each weighted by the change of NDCG when the two change places.

    Pairs have one row among the first ``top`` places.  Ties of the score keep the order of the rows.  With
    ``norm`` a pair counts less the further its scores are apart, and a group's gradients are scaled by their sum."""

    def __init__(self, k: int = 5, top: int = 30, norm: bool = True):
        self.k, self.top, self.norm = k, top, norm

    def groups(self, c: Chunk, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Row numbers of the groups, as matrices of groups of one size."""
        ends = np.append(c.starts[1:], len(c.y))
        take = rows[c.starts]
        starts, sizes = c.starts[take], (ends - c.starts)[take]
        for n in np.unique(sizes):
            first = starts[sizes == n]
            per = max(1, 2_000_000 // (int(n) * min(int(n), self.top)))
            for lo in range(0, len(first), per):
                yield first[lo : lo + per, None] + np.arange(n)

    def gradient(self, c: Chunk, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = np.zeros(len(m)), np.zeros(len(m))
        for rows in self.groups(c, ~c.valid):
            g[rows], h[rows] = self.lambdas(m[rows], c.y[rows])
        return g, h

    def lambdas(self, s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of groups of one size: scores and grades of shape (groups, rows)."""
        groups, n = s.shape
        g, h = np.zeros((groups, n)), np.zeros((groups, n))
        if n < 2:
            return g, h
        order = np.argsort(-s, axis=1, kind="stable")
        s, y = np.take_along_axis(s, order, 1), np.take_along_axis(y, order, 1)
        gain, discount = 2.0**y - 1, 1 / np.log2(np.arange(n) + 2)
        best = (np.sort(gain, axis=1)[:, ::-1][:, : self.top] * discount[: self.top]).sum(axis=1)
        t = min(self.top, n)
        up, down = slice(0, t), slice(0, n)
        pair = (np.arange(t)[:, None] < np.arange(n)) & (y[:, up, None] != y[:, None, down])
        delta = np.abs(gain[:, up, None] - gain[:, None, down]) * np.abs(discount[up, None] - discount[None, down]) / np.where(best > 0, best, 1)[:, None, None]
        sign = np.sign(y[:, up, None] - y[:, None, down])  # 1 where the row placed higher has the higher grade
        apart = sign * (s[:, up, None] - s[:, None, down])
        if self.norm:
            spread = s[:, :1] != s[:, -1:]
            delta = np.where(spread[:, :, None], delta / (0.01 + np.abs(apart)), delta)
        p = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
        lam, hess = np.where(pair, p * delta, 0.0), np.where(pair, p * (1 - p) * delta, 0.0)
        moved = np.zeros((groups, n))
        moved[:, :t] -= (sign * lam).sum(axis=2)
        moved += (sign * lam).sum(axis=1)
        second = np.zeros((groups, n))
        second[:, :t] += hess.sum(axis=2)
        second += hess.sum(axis=1)
        if self.norm:
            sums = 2 * lam.sum(axis=(1, 2))
            scale = np.where(sums > 0, np.log2(1 + sums) / np.where(sums > 0, sums, 1), 1.0)[:, None]
            moved, second = moved * scale, second * scale
        np.put_along_axis(g, order, moved, 1)
        np.put_along_axis(h, order, second, 1)
        return g, h

    def measure(self, c: Chunk, m: np.ndarray) -> np.ndarray:
        """Sum of NDCG at ``k`` over the groups that measure, and their number."""
        out = np.zeros(2)
        for rows in self.groups(c, c.valid):
            s, gain = m[rows], 2.0 ** c.y[rows] - 1
            discount = 1 / np.log2(np.arange(min(self.k, s.shape[1])) + 2)
            got = np.take_along_axis(gain, np.argsort(-s, axis=1, kind="stable"), 1)[:, : self.k] @ discount
            best = np.sort(gain, axis=1)[:, ::-1][:, : self.k] @ discount
            out += [np.where(best > 0, got / np.where(best > 0, best, 1), 1.0).sum(), len(rows)]
        return out

    def start(self, mean: float) -> float:
        return 0.0


# --- growing -----------------------------------------------------------------------------

def histograms(chunk: Chunk, trees: list[Tree], objective, tree: Tree, nodes: list[int]) -> np.ndarray:
    """(nodes, features, bins, [rows, gradient, second]) of the open nodes."""
    width = chunk.x.shape[1]
    m = margins(chunk, trees)
    g, h = objective.gradient(chunk, m)
    local = np.full(len(tree.feature), -1)
    local[nodes] = np.arange(len(nodes))
    at = local[tree.nodes_of(chunk.x)]
    rows = np.flatnonzero((at >= 0) & ~chunk.valid)
    cell = (((at[rows, None] * width) + np.arange(width)) * 256 + chunk.x[rows]).ravel()
    size = len(nodes) * width * 256
    fixed = lambda v: np.bincount(cell, weights=np.repeat(np.rint(v[rows] * chunk.weight[rows] * FIXED), width), minlength=size).astype(np.int64)
    return np.stack([np.bincount(cell, minlength=size), fixed(g), fixed(h)], axis=-1).reshape(len(nodes), width, 256, 3)


@dataclass
class Shape:
    """Limits of a tree."""

    leaves: int = 31
    depth: int = 99
    min_rows: int = 20
    l2: float = 1.0
    l1: float = 0.0
    min_second: float = 1e-3

    def strength(self, g, h):
        return np.maximum(np.abs(g) - self.l1, 0) ** 2 / (h + self.l2 + 1e-12)

    def value(self, g: float, h: float) -> float:
        return -float(np.sign(g) * max(abs(g) - self.l1, 0) / (h + self.l2 + 1e-12))


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: tuple[float, float]
    right: tuple[float, float]


def best_split(hist: np.ndarray, shape: Shape, allowed: np.ndarray) -> Split | None:
    """Best cut of a node from its (features, bins, 3) histogram; of equal gains the lowest feature, then cut."""
    n, g, h = hist[..., 0], hist[..., 1] / FIXED, hist[..., 2] / FIXED
    whole = n[0].sum(), g[0].sum(), h[0].sum()
    best = None
    for missing_left in (False, True):
        sums = [np.cumsum(v[:, :BINS], axis=1) + (v[:, MISSING:] if missing_left else 0) for v in (n, g, h)]
        rest = [w - s for w, s in zip(whole, sums)]
        gain = shape.strength(sums[1], sums[2]) + shape.strength(rest[1], rest[2]) - shape.strength(whole[1], whole[2])
        ok = (sums[0] >= shape.min_rows) & (rest[0] >= shape.min_rows) & (sums[2] >= shape.min_second) & (rest[2] >= shape.min_second) & allowed[:, None]
        gain = np.where(ok, gain, -np.inf)
        at = int(gain.argmax())
        f, cut = divmod(at, BINS)
        if gain[f, cut] > 1e-12 and (best is None or gain[f, cut] > best.gain + 1e-12):
            best = Split(float(gain[f, cut]), f, cut, missing_left, (float(sums[1][f, cut]), float(sums[2][f, cut])), (float(rest[1][f, cut]), float(rest[2][f, cut])))
            if not n[f, MISSING]:  # unseen missing values go with the larger side
                best.missing_left = bool(sums[0][f, cut] >= rest[0][f, cut])
    return best


def grow(passes: Callable[[Tree, list[int]], np.ndarray], shape: Shape, allowed: np.ndarray, rate: float) -> Tree:
    """A tree whose leaves are split in order of gain.  ``passes(tree, nodes)`` are histograms of nodes of a tree that
    is split ahead of the order: all known splits are in it, and those never chosen are dropped at the end."""
    ahead, splits, level = Tree(), {}, {0: 0}
    open_nodes, sums = [0], {}
    while True:
        if open_nodes:
            for node, hist in zip(open_nodes, passes(ahead, open_nodes)):
                sums.setdefault(node, (float(hist[0, :, 1].sum() / FIXED), float(hist[0, :, 2].sum() / FIXED)))
                splits[node] = best_split(hist, shape, allowed) if level[node] < shape.depth else None
                if splits[node]:
                    s = splits[node]
                    for child, of in zip(ahead.split(node, s.feature, s.cut, s.missing_left, s.gain), (s.left, s.right)):
                        level[child], sums[child] = level[node] + 1, of
        chosen, heap, needs = [], [(-splits[0].gain, 0)] if splits[0] else [], False
        while heap and len(chosen) + 1 < shape.leaves:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            for child in (ahead.left[node], ahead.right[node]):
                if level[child] >= shape.depth:
                    splits[child] = None
                elif child not in splits:
                    needs |= len(chosen) + 1 < shape.leaves
                    continue
                if splits[child]:
                    heapq.heappush(heap, (-splits[child].gain, child))
        if not needs:
            break
        open_nodes = [c for n in splits if splits[n] for c in (ahead.left[n], ahead.right[n]) if c not in splits]
    out, at = Tree(), {0: 0}
    for node in chosen:
        s = splits[node]
        at[ahead.left[node]], at[ahead.right[node]] = out.split(at[node], s.feature, s.cut, s.missing_left, s.gain)
    for node, k in at.items():
        out.value[k] = rate * shape.value(*sums[node])
    return out


@dataclass
class Ensemble:
    """A fitted model: the margin of a row is ``start`` and the values of its leaves."""

    bins: Bins
    trees: list[Tree]
    start: float
    history: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        """Margin of each row, missing features as missing."""
        bins, trees, start = self.bins, self.trees, self.start

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = bins.code(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
                yield pa.array(sum((t.predict(x) for t in trees), np.full(len(x), start)))

        return score(vector(self.bins.features))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def importance(self) -> dict[str, float]:
        out = dict.fromkeys(self.bins.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    out[self.bins.features[f]] += g
        return out


def mixed(*numbers: int) -> float:
    """A hash of whole numbers in [0, 1)."""
    x = 0x9E3779B97F4A7C15
    for n in numbers:
        x = (x ^ (n & (2**64 - 1))) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 29) * 0x94D049BB133111EB % 2**64
    return (x >> 11) / 2**53


def drawn(count: int, of: int, *seed: int) -> np.ndarray:
    """Mask of ``count`` of ``of`` features, drawn by hash."""
    order = sorted(range(of), key=lambda k: mixed(*seed, k))
    mask = np.zeros(of, dtype=bool)
    mask[order[:count]] = True
    return mask


def boost(data: RDD, bins: Bins, objective, rounds: int, rate: float, shape: Shape, columns: float = 1.0, patience: int | None = None, seed: int = 42) -> Ensemble:
    """Boosted trees; with ``patience`` stops once the measure of the valid rows has not risen for so many rounds and
    keeps the trees up to its best round."""
    width = len(bins.features)
    y = total(data, lambda c: np.array([(c.y * c.weight)[~c.valid].sum(), c.weight[~c.valid].sum()]), np.zeros(2))
    out = Ensemble(bins, [], objective.start(float(y[0] / y[1])) if y[1] else 0.0)
    first, root = out.start, Tree()
    root.value = [first]
    base, best, stored = data.map(lambda c: c.moved([root])).persist(StorageLevel.MEMORY_AND_DISK), (-np.inf, 0), 0
    try:
        for k in range(rounds + 1):
            recent = out.trees[stored:]
            if patience is not None:
                m = total(base, partial(measured, recent, objective), np.zeros(2))
                out.history.append(float(m[0] / m[1]) if m[1] else 0.0)
                if out.history[-1] > best[0] + 1e-9:
                    best = (out.history[-1], k)
                if k - best[1] >= patience or k == rounds:
                    out.trees = out.trees[: best[1]]
                    break
            if k == rounds:
                break
            if len(recent) >= REBASE:
                done = [root, *out.trees]
                moved = data.map(lambda c, done=done: c.moved(done)).persist(StorageLevel.MEMORY_AND_DISK)
                base.unpersist()
                base, stored, recent = moved, len(out.trees), []
            allowed = drawn(max(1, int(np.ceil(columns * width))), width, seed, k)
            passes = lambda tree, nodes: total(base, partial(histograms_of, recent, objective, tree, nodes), np.zeros((len(nodes), width, 256, 3), dtype=np.int64))  # noqa: E731, B023
            tree = grow(passes, shape, allowed, rate)
            if len(tree.feature) == 1 and patience is None:
                break
            out.trees.append(tree)
    finally:
        base.unpersist()
    return out


def histograms_of(trees: list[Tree], objective, tree: Tree, nodes: list[int], chunk: Chunk) -> np.ndarray:
    return histograms(chunk, trees, objective, tree, nodes)


def measured(trees: list[Tree], objective, chunk: Chunk) -> np.ndarray:
    return objective.measure(chunk, margins(chunk, trees))


def lambda_gradients(df: DataFrame, score: str, grade: str, keys: tuple[str, ...] = ("date",), tie: str = "symbol", objective: LambdaRank | None = None) -> DataFrame:
    """Pairwise gradient and second derivative of every row of each group at the given scores."""
    objective = objective or LambdaRank()
    rows = df.where(F.col(score).isNotNull() & F.col(grade).isNotNull()).select(*keys, tie, F.col(score).cast("double").alias("s"), F.col(grade).cast("double").alias("y"))

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by(tie)
        g, h = objective.lambdas(*(table.column(c).to_numpy()[None, :] for c in ("s", "y")))
        return table.select([*keys, tie]).append_column("gradient", pa.array(g[0])).append_column("second", pa.array(h[0]))

    fields = rows.select(*keys, tie).schema
    return rows.groupBy(*keys).applyInArrow(of, fields.add("gradient", "double").add("second", "double"))


# --- extremely randomised trees ------------------------------------------------------------

@dataclass
class Forest:
    """Averaged trees; tree k learns from rows with order below ``limits[k // per_fold]`` (all without limits)."""

    bins: Bins
    trees: list[Tree]
    per_fold: int

    def probability(self, fold: Column | None = None) -> Column:
        """Mean leaf value of all trees, or of those of the row's fold."""
        bins, trees, per = self.bins, self.trees, self.per_fold

        @F.arrow_udf("double")
        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for batch, folds in batches:
                x = bins.code(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
                of, out = folds.to_numpy(zero_copy_only=False), np.full(len(x), np.nan)
                for f in np.unique(of):
                    rows = np.flatnonzero(of == f)
                    own = trees[int(f) * per : (int(f) + 1) * per]
                    out[rows] = sum((t.predict(x[rows]) for t in own), np.zeros(len(rows))) / per
                yield pa.array(out)

        return score(vector(self.bins.features), F.lit(0) if fold is None else fold)


def node_rows(chunk: Chunk, tree: Tree, nodes: list[int], limit: float) -> Iterator[np.ndarray]:
    at = tree.nodes_of(chunk.x)
    at[chunk.valid | (chunk.order >= limit)] = -1
    for node in nodes:
        yield np.flatnonzero(at == node)


def node_ranges(work: list, width: int, chunk: Chunk) -> np.ndarray:
    """(open nodes, features, [lowest bin, minus the highest bin]); missing values apart."""
    out = []
    for tree, nodes, limit in work:
        for rows in node_rows(chunk, tree, nodes, limit):
            x = chunk.x[rows].astype(np.int64)
            known = x != MISSING
            out.append(np.stack([np.where(known, x, 256).min(axis=0, initial=256), np.where(known, -x, 1).min(axis=0, initial=1)], axis=-1))
    return np.array(out).reshape(-1, width, 2)


def cut_counts(work: list, cuts: np.ndarray, chunk: Chunk) -> np.ndarray:
    """(open nodes, features + 1, [zeros, ones]) left of each node's cut of every feature; the last entry is the whole node."""
    out, k = [], 0
    for tree, nodes, limit in work:
        for rows in node_rows(chunk, tree, nodes, limit):
            left, y = np.concatenate([chunk.x[rows] <= cuts[k], np.ones((len(rows), 1), bool)], axis=1), chunk.y[rows] > 0.5
            out.append(np.stack([left[~y].sum(axis=0), left[y].sum(axis=0)], axis=-1))
            k += 1
    return np.array(out, dtype=np.int64).reshape(-1, cuts.shape[1] + 1, 2)


def lowest(data: RDD, f: Callable) -> np.ndarray:
    """Element-wise least ``f(chunk)`` over all chunks."""
    return data.map(f).treeReduce(np.minimum) if data.getNumPartitions() > 64 else data.map(f).reduce(np.minimum)


def extra_trees(data: RDD, bins: Bins, trees: int = 18, depth: int = 5, min_rows: int = 32, balanced: bool = True, limits: list[float] | None = None, seed: int = 42) -> Forest:
    """Trees with one cut per (node, feature), drawn by hash between the node's lowest and highest value; of sqrt(features) that
    can be cut the one with the purest sides is taken.  All trees of all folds grow together: a level is one pass for
    the ranges and one that scores all cuts."""
    width, try_ = len(bins.features), max(1, int(np.sqrt(len(bins.features))))
    bounds = [float("inf")] if limits is None else [float(v) for v in limits]
    grown = [Tree() for _ in range(trees * len(bounds))]
    limit = [bounds[k // trees] for k in range(len(grown))]
    open_nodes = [[0] for _ in grown]
    weights: dict[float, tuple[float, float]] = {}
    if data.isEmpty():
        return Forest(bins, grown, trees)
    for level in range(depth + 1):
        work = [(t, nodes, lim) for t, nodes, lim in zip(grown, open_nodes, limit) if nodes]
        if not work:
            break
        of = [(k, node) for k, nodes in enumerate(open_nodes) for node in nodes]
        ranges = lowest(data, partial(node_ranges, work, width))
        cuts = np.zeros((len(of), width), dtype=np.int64)
        for row, (k, node) in enumerate(of):
            for f in range(width):
                low, high = int(ranges[row, f, 0]), int(-ranges[row, f, 1])
                cuts[row, f] = random_cut(bins.edges[f], low, high, mixed(seed, k, node, f, level)) if low < high else -1
        counts = total(data, partial(cut_counts, work, cuts), np.zeros((len(of), width + 1, 2), dtype=np.int64))
        following = [[] for _ in grown]
        for row, (k, node) in enumerate(of):
            zeros, ones = (int(v) for v in counts[row, width])
            if level == 0 and limit[k] not in weights:
                n = zeros + ones
                weights[limit[k]] = (n / (2 * max(zeros, 1)), n / (2 * max(ones, 1))) if balanced else (1.0, 1.0)
            w = np.array(weights[limit[k]])
            whole = counts[row, width] * w
            grown[k].value[node] = float(whole[1] / whole.sum()) if whole.sum() else 0.5
            can = [f for f in sorted(range(width), key=lambda f: mixed(seed + 1, k, node, f)) if cuts[row, f] >= 0]
            if level == depth or not zeros or not ones:
                continue
            found = []
            for f in can:
                left = counts[row, f]
                right = counts[row, width] - left
                if min(left.sum(), right.sum()) >= min_rows:
                    sides = [s * w for s in (left, right)]
                    found.append((sum(s.sum() - (s**2).sum() / s.sum() for s in sides), f))
                if len(found) == try_:
                    break
            if found:
                _, f = min(found)
                following[k] += grown[k].split(node, f, int(cuts[row, f]), False)
        open_nodes = following
    return Forest(bins, grown, trees)


def random_cut(edges: np.ndarray, low: int, high: int, u: float) -> int:
    """Bin up to which rows go left, for a value drawn evenly between bins ``low`` < ``high``."""
    lo, hi = edges[low], edges[min(high, len(edges) - 1)]
    return min(max(int(np.searchsorted(edges, lo + u * (hi - lo), side="right")) - 1, low), high - 1)
