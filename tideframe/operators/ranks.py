"""Ranks of a value within its own trailing or expanding frame, without a list per row.

How many earlier values lie below a value is a dominance count.  A run of a series is kept as sorted blocks
of 1, 2, 4, ... rows; any stretch of rows before a row is a union of such blocks, one per size, and a binary
search in each adds up the count.  A frame of n rows is the difference of two stretches.  So a row costs the square of the
logarithm of its run, whatever the frame, and memory is linear.

A long series is cut into runs by position.  A trailing frame of n rows needs the n rows before its run, which
come along as a halo.  An expanding frame adds, for each earlier run, a binary search in that run's
sorted values.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = 8_192


def prefix_counts(values: np.ndarray, stops: np.ndarray, side: str) -> np.ndarray:
    """For row i the number of known values among the first ``stops[i]`` rows that are below (``left``) or not above
    (``right``) row i's; unknown values are NaN."""
    m = len(values)
    out = np.zeros(m, dtype=np.int64)
    if not m:
        return out
    known = ~np.isnan(values)
    order = np.unique(values[known])
    rank = np.where(known, np.searchsorted(order, np.where(known, values, 0)), len(order))  # unknown ones sort last
    levels = max(int(m - 1).bit_length(), 1)
    padded = np.full(1 << levels, len(order), dtype=np.int64)
    padded[:m] = rank
    width = len(order) + 1
    wanted = np.where(known, rank, 0)
    for level in range(levels + 1):
        size = 1 << level
        rows = np.flatnonzero(known & (stops & size != 0))
        if not len(rows):
            continue
        blocks = np.sort(padded.reshape(-1, size), axis=1) + (np.arange(len(padded) // size) * width)[:, None]
        block = (stops[rows] >> (level + 1)) << 1  # the block that ends the stretch at this size
        out[rows] += np.searchsorted(blocks.ravel(), block * width + wanted[rows], side=side) - block * size
    return out


def frame_counts(values: np.ndarray, n: int | None, current: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(below, not above, known) values of each row's frame: the last ``n`` rows (all without ``n``), the row included or not."""
    at = np.arange(len(values))
    stop = at + int(current)
    start = np.maximum(stop - n, 0) if n else np.zeros_like(at)
    below, upto = (prefix_counts(values, stop, s) - prefix_counts(values, start, s) for s in ("left", "right"))
    seen = np.concatenate([[0], np.cumsum(~np.isnan(values))])
    return below, upto, seen[stop] - seen[start]


def ranked(df: DataFrame, columns: dict[str, tuple[str, int | None, bool]], keys: tuple[str, ...] = (), order: str = "date", run: int = RUN) -> DataFrame:
    """Adds ``<name>_below``, ``<name>_upto`` and ``<name>_known`` for every name -> (column, frame rows or None, row included).

    (keys, order) identify a row.  A series needs one row number per (keys, order); runs are worked on apart."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    sources = list(dict.fromkeys(c for c, _, _ in columns.values()))
    base = df.select(*keys, order, *[F.col(c).cast("double").alias(f"__{c}") for c in sources]).withColumn("__p", F.row_number().over(w) - 1)
    halo = max([n or 0 for _, n, _ in columns.values()] + [0]) + 1
    width = max(run, halo)
    own = F.floor(F.col("__p") / width)
    ahead = F.when(F.pmod(F.col("__p"), F.lit(width)) >= width - halo, F.array(own, own + 1)).otherwise(F.array(own))
    runs = base.withColumn("__run", F.explode(ahead)).withColumn("__home", F.col("__run") == own)
    named = [f"{name}_{part}" for name in columns for part in ("below", "upto", "known")]
    out_schema = df.select(*keys, order).schema
    for c in named:
        out_schema = out_schema.add(c, "long")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__p")
        home = left.column("__home").to_numpy(zero_copy_only=False)
        got = []
        for column, n, current in columns.values():
            v = left.column(f"__{column}").to_numpy(zero_copy_only=False).astype(np.float64)
            if n is None:
                v = v[home]
            below, upto, known = frame_counts(v, n, current)
            if n is None:
                mine = ~np.isnan(v)
                for name, data in zip(right.column("name").to_pylist(), right.column("data").to_pylist()):
                    if name == column:
                        earlier = np.frombuffer(data)
                        below[mine] += np.searchsorted(earlier, v[mine], "left")
                        upto[mine] += np.searchsorted(earlier, v[mine], "right")
                        known += len(earlier)
                got += [below, upto, known]
            else:
                got += [below[home], upto[home], known[home]]
        rows = left.filter(pa.array(home)).select([*keys, order])
        for name, values in zip(named, got):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    def sort(table: pa.Table) -> pa.Table:
        rows = []
        for column in dict.fromkeys(c for c, n, _ in columns.values() if n is None):
            v = np.sort(table.column(f"__{column}").to_numpy(zero_copy_only=False).astype(np.float64))
            rows.append((column, v[~np.isnan(v)].tobytes()))
        head = pa.concat_tables([table.slice(0, 1).select([*keys, "__run"])] * len(rows)) if rows else table.slice(0, 0).select([*keys, "__run"])
        return head.append_column("name", pa.array([r[0] for r in rows], pa.string())).append_column("data", pa.array([r[1] for r in rows], pa.binary()))

    sort_schema = runs.select(*keys, "__run").schema.add("name", "string").add("data", "binary")
    if any(n is None for _, n, _ in columns.values()):
        spans = runs.where("__home").groupBy(*keys, "__run").applyInArrow(sort, sort_schema)
        last = runs.groupBy(*[F.col(k).alias(f"__key_{k}") for k in keys]).agg(F.max(F.when(F.col("__home"), F.col("__run"))).alias("__last"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        # one row per pair of runs of a series
        earlier = spans.join(last, same).where("__run < __last").withColumn("__run", F.explode(F.sequence(F.col("__run") + 1, F.col("__last")))).select(*keys, "__run", "name", "data")
    else:
        earlier = df.sparkSession.createDataFrame([], sort_schema)
    counted = runs.groupBy(*keys, "__run").cogroup(earlier.groupBy(*keys, "__run")).applyInArrow(count, out_schema)
    return df.join(counted, [*keys, order])


def percentile_rank(name: str, column: str, min_periods: int):
    """Average-tie percent rank of the row's value in a frame that holds it."""
    below, upto, known = (F.col(f"{name}_{p}") for p in ("below", "upto", "known"))
    return F.when(F.col(column).isNotNull() & (known >= min_periods), (below + (upto - below + 1) / 2) / known)


def share_not_above(name: str, column: str, min_periods: int):
    """Share of the frame's values that are not above the row's."""
    return F.when(F.col(column).isNotNull() & (F.col(f"{name}_known") >= min_periods), F.col(f"{name}_upto") / F.col(f"{name}_known"))
