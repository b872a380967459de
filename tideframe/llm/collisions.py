"""Near-duplicate vectors by cosine, found by collision counting on one-dimensional projections.

The method as named counts, for every pair, the projections in whose sorted order the pair lies
within one window.  Windows wide enough for a near pair hold a large share of all vectors, so their
pairs would grow with the square of the table.  Here the projections do two jobs:

* ends: of ``m`` random directions each keeps its sorted upper end only, the vectors at or above
  ``cut``.  A pair at the threshold cosine shares an end with known probability, and a pair of
  unrelated vectors hardly ever.  ``cut`` is set from the number of vectors so that an end holds
  about ``end_size`` of them, and ``m`` so that a pair at the threshold misses all common ends with
  probability at most ``miss``.
* windows: within an end, ``windows`` further projections are compared; every query's window takes
  in the vectors within ``width`` of it, collisions are counted per pair, and pairs that reach the
  count which a pair at the threshold fails with probability ``miss`` are verified by their cosine in
  double precision.

Projections of unit vectors on Gaussian directions are exactly bivariate normal over the choice of
directions, so both numbers are calibrated by formula, whatever the data.  With ``end_size`` at the
square root of the rows, projecting and comparing both grow as the rows to the power 1.5.

Equal vectors are one class with a size.  A pair is counted in the first end it shares.  Ends with
more than ``block`` vectors are cut into blocks, and each pair of blocks is a group of its own, so no
task holds an end whole.  A group hands on one row per vector: its links and one connection.
Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths don't link; rows with null id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideframe.llm.graphs import components, forest
from tideframe.llm.words import bounded_batches
from tideframe.session import staged


def upper(x: np.ndarray | float) -> np.ndarray:
    """P(N(0,1) >= x)."""
    return 0.5 * np.vectorize(math.erfc)(np.asarray(x) / math.sqrt(2))


class Plan:
    """Numbers calibrated for pairs at cosine ``threshold`` among ``rows`` vectors."""

    def __init__(self, rows: int, threshold: float, miss: float = 1e-4, end_size: int | None = None, windows: int = 32, width: float = 0.6, block: int = 1024, seed: int = 11):
        self.threshold, self.windows, self.width, self.block, self.seed = threshold, windows, width, block, seed
        share = min(0.1, (end_size or max(300, math.isqrt(rows))) / max(rows, 1))
        lo, hi = 0.0, 40.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if float(upper(mid)) > share else (lo, mid)
        self.cut = lo
        x = np.linspace(lo, lo + 10, 4_001)
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        both = float(np.trapezoid(density * upper((lo - threshold * x) / math.sqrt(1 - threshold**2)), x))
        self.ends = math.ceil(math.log(miss) / math.log1p(-both))
        inside = 1 - 2 * float(upper(width / math.sqrt(2 - 2 * threshold)))
        fails, self.least = 0.0, 0
        while True:  # the largest count that a pair at the threshold fails with probability miss at most
            fails += math.comb(windows, self.least) * inside**self.least * (1 - inside) ** (windows - self.least)
            if fails > miss:
                break
            self.least += 1

    def directions(self, dim: int, which: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim, which]).standard_normal((dim, self.windows if which else self.ends))


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in the batch, matrix) for each vector length."""
    column = batch.column("embedding")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = values[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
        # each vector times a power of 2, which changes no cosine: squares of very large or small components stay finite
        yield at, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def collide(x: np.ndarray, y: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose projections (one byte each) lie within ``width`` at least ``least`` times."""
    count = np.zeros((len(x), len(y)), dtype=np.uint8)
    for a, b in zip(x.T, y.T):
        a, b = a[:, None], b[None, :]
        count += np.maximum(a, b) - np.minimum(a, b) <= width
    return np.nonzero(count >= least)


def group_links(rows: dict[str, np.ndarray], plan: Plan, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: class, its links there, and a forest (a, b) of its links."""
    rep, size, x, ends, side = rows["rep"], rows["size"], rows["x"], rows["ends"], rows["side"]
    scale = 127 / 6  # projections beyond 6 are clipped together; a pair there collides, which verification undoes
    bytes_ = np.clip(np.rint(units(x) @ plan.directions(x.shape[1], 1) * scale) + 127, 0, 254).astype(np.uint8)
    width = math.ceil(plan.width * scale) + 1
    length = np.sqrt((x * x).sum(axis=1))
    earlier = np.zeros((len(x), (end + 7) // 8), dtype=np.uint8)
    for k, own in enumerate(ends):
        own = own[own < end]
        np.bitwise_or.at(earlier[k], own >> 3, np.left_shift(np.uint8(1), (own & 7).astype(np.uint8)))
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = np.zeros(len(x), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    within = not len(second)
    for lo in range(0, len(first), 256):
        left = first[lo : lo + 256]
        right = first[lo:] if within else second
        i, j = collide(bytes_[left], bytes_[right], plan.least, width)
        if within:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 50_000):
            a, b = left[i[k : k + 50_000]], right[j[k : k + 50_000]]
            near = (x[a] * x[b]).sum(axis=1) / (length[a] * length[b]) >= plan.threshold
            a, b = a[near], b[near]
            found.append((rep[a], rep[b]))
            new = ~(earlier[a] & earlier[b]).any(axis=1)
            np.add.at(links, a[new], size[b[new]])
            np.add.at(links, b[new], size[a[new]])
    linked = links > 0
    if not found:
        return rep[linked], links[linked], rep[:0], rep[:0]
    return rep[linked], links[linked], *forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-4, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """One row per id: id, n_links, component_id, kept (it is the smallest id of its component)."""
    spark = bounded_batches(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    classes = staged(rows.where(fine).groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    plan = Plan(classes.count(), threshold, miss, **options)
    shared = spark.sparkContext.broadcast(plan)  # a few numbers

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in arrays(batch):
                dim = x.shape[1]
                for lo in range(0, len(at), 1_000):
                    full = (units(x[lo : lo + 1_000]) @ plan.directions(dim, 0) >= plan.cut).sum(axis=0)
                    held[dim] = held.get(dim, 0) + full
        for dim, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), dim, dtype=np.int64)), pa.array(np.arange(len(counts))), pa.array(counts.astype(np.int64))], ["dim", "end", "n"])

    # at most one number per direction and vector length
    crowded = classes.mapInArrow(tally, "dim long, end long, n long").groupBy("dim", "end").agg(F.sum("n").alias("n")).where(F.col("n") > plan.block)
    cuts = crowded.select("dim", "end", F.ceil(F.col("n") / plan.block).cast("int").alias("blocks"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in arrays(batch):
                dim = x.shape[1]
                directions = plan.directions(dim, 0)
                for lo in range(0, len(at), 500):
                    own = at[lo : lo + 500]
                    row, end = np.nonzero(units(x[lo : lo + 500]) @ directions >= plan.cut)
                    counts = np.bincount(row, minlength=len(own))
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(end.astype(np.int32)))
                    take = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim, dtype=np.int64)), pa.array(end), batch.column("rep").take(take), batch.column("size").take(take), batch.column("embedding").take(take), ends.take(pa.array(row))], ["dim", "end", "rep", "size", "embedding", "ends"])

    kind = classes.schema["embedding"].dataType.simpleString()
    routed = classes.mapInArrow(route, f"dim long, end long, rep long, size long, embedding {kind}, ends array<int>")
    dealt = routed.join(F.broadcast(cuts), ["dim", "end"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep", "end"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "end", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "size", "embedding", "ends")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key, held = None, []
        out: list[tuple[np.ndarray, ...]] = []

        def close() -> None:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                (_, x), = arrays(whole)
                rows = {c: whole.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "size", "side")}
                ends = [np.asarray(e, dtype=np.int64) for e in whole.column("ends").to_pylist()]
                if key[2] == key[3] or rows["side"].any() and not rows["side"].all():
                    out.append(group_links(rows | {"x": x, "ends": ends}, plan, key[1]))
                held.clear()

        def result() -> pa.RecordBatch:
            rep, links, a, b = (np.concatenate(c) if out else np.array([], dtype=np.int64) for c in (zip(*out) if out else [()] * 4))
            none = [None] * len(a)
            return pa.RecordBatch.from_arrays([pa.array([*rep.tolist(), *a.tolist()], type=pa.int64()), pa.array([*links.tolist(), *none], type=pa.int64()), pa.array([*[None] * len(rep), *b.tolist()], type=pa.int64())], ["rep", "links", "to"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "end", "low", "high")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                now = tuple(keys[lo].tolist())
                if now != key:
                    close()
                    key = now
                held.append(batch.slice(lo, hi - lo))
            if len(out) > 200:
                yield result()
                out.clear()
        close()
        yield result()

    keys = ["dim", "end", "low", "high"]
    found = staged(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link, "rep long, links long, to long"))
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("others"))
    roots = components(found.where("`to` is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    ranks = classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(F.col("embedding").alias("e"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    joined = rows.withColumn("fine", fine).join(ranks, F.col("fine") & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
