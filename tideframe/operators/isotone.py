"""Isotonic calibration refitted at every date from all earlier rows, without refitting from the start.

An isotonic fit is the slope of the greatest convex minorant of the cumulative sums in order of score: runs of pooled
blocks with rising means.  Minorants merge: pooling the blocks of neighbouring score ranges, in order, gives the blocks
of their union.  So scores are cut into ranges of about equal counts; each range carries its sums per
distinct score from date to date and pools only on dates that add to it; a date's calibrator is the pooled
sequence of its ranges' blocks, which are few.  Blocks are exact sums, so every calibrator equals a fit from scratch.

Between two blocks a score is interpolated linearly, beyond the first and the last one it is clipped.  Dates whose
earlier rows are fewer than ``min_rows`` or of one class keep the raw score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGES = 64


def pooled_blocks(low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks (lowest score, highest score, rows, sum) with rising means, from blocks in ascending order of score."""
    out: list[list] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), s.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:  # the mean before is not below
            last = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = last[1], out[-1][2] + last[2], out[-1][3] + last[3]
    return tuple(np.array(c, dtype=np.float64) for c in zip(*out)) if out else tuple(np.zeros(0) for _ in range(4))


def calibrated(x: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Values of scores under the blocks of a fit."""
    return np.interp(x, np.stack([low, high], axis=1).ravel(), np.repeat(s / n, 2))


ARROW_BLOCKS = pa.schema([("day", pa.int64()), ("rng", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.float64()), ("s", pa.float64())])


def range_blocks(points: DataFrame) -> DataFrame:
    """(day, rng, low, high, n, s): blocks of each range from its points up to and with each day on which it got points.

    ``points``: (day, rng, x, n, s), one row per (day, x)."""

    def carry(table: pa.Table) -> pa.Table:
        rng = table.column("rng")[0].as_py()
        day, x, n, s = (table.column(c).to_numpy() for c in ("day", "x", "n", "s"))
        scores, at = np.unique(x, return_inverse=True)
        counts, sums, out = np.zeros(len(scores)), np.zeros(len(scores)), []
        order = np.argsort(day, kind="stable")
        days, starts = np.unique(day[order], return_index=True)
        for d, lo, hi in zip(days.tolist(), starts, [*starts[1:], len(order)]):
            rows = order[lo:hi]
            np.add.at(counts, at[rows], n[rows])
            np.add.at(sums, at[rows], s[rows])
            seen = counts > 0
            blocks = pooled_blocks(scores[seen], scores[seen], counts[seen], sums[seen])
            out.append(pa.Table.from_arrays([pa.array(np.full(len(blocks[0]), v)) for v in (d, rng)] + [pa.array(b) for b in blocks], schema=ARROW_BLOCKS))
        return pa.concat_tables(out)

    return points.groupBy("rng").applyInArrow(carry, "day long, rng long, low double, high double, n double, s double")


def expanding_isotonic(df: DataFrame, prob: str, label: str, min_rows: int = 260, date: str = "date", out: str = "calibrated", ranges: int = RANGES) -> DataFrame:
    """Adds ``out``: the isotonic value of ``prob`` by all labelled rows of earlier dates; null where ``prob`` is."""
    d = df.withColumn("__day", F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    y = F.col(label).cast("double")
    points = staged(d.where(F.col(prob).isNotNull() & y.isNotNull() & F.col("__day").isNotNull()).groupBy(F.col("__day").alias("day"), F.col(prob).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s")))
    # any cut gives the same fit: approximate quantiles do
    cuts = points.agg(F.percentile_approx("x", F.array(*[F.lit(k / ranges) for k in range(1, ranges + 1)]), F.lit(ranges * 50)).alias("cuts"))
    points = staged(points.join(cuts).withColumn("rng", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("x"))), F.lit(0)).cast("long")).drop("cuts"))
    blocks = staged(range_blocks(points))
    # on a test day a range is as it was on its last day before: spans of days, one row per change of a range
    days = d.where("__day IS NOT NULL").select(F.col("__day").alias("test_day")).distinct()
    changes = points.select("rng", "day").distinct()
    last = days.join(changes, F.col("day") < F.col("test_day")).groupBy("test_day", "rng").agg(F.max("day").alias("day"))
    known = last.join(blocks, ["rng", "day"]).select(F.col("test_day").alias("__day"), "rng", "low", "high", "n", "s")
    wanted = d.where(F.col(prob).isNotNull() & F.col("__day").isNotNull()).select("__day", F.col(prob).cast("double").alias("__x")).distinct()

    def fit(left: pa.Table, right: pa.Table) -> pa.Table:
        x = left.column("__x").to_numpy()
        value = x
        if right.num_rows:
            low, high, n, s = (right.column(c).to_numpy() for c in ("low", "high", "n", "s"))
            if n.sum() >= min_rows and 0 < s.sum() < n.sum():
                order = np.argsort(low, kind="stable")
                value = calibrated(x, *pooled_blocks(low[order], high[order], n[order], s[order]))
        return pa.Table.from_arrays([left.column("__day"), left.column("__x"), pa.array(value, pa.float64())], ["__day", "__x", "__value"])

    values = wanted.groupBy("__day").cogroup(known.groupBy("__day")).applyInArrow(fit, "__day long, __x double, __value double")
    return d.withColumn("__x", F.col(prob).cast("double")).join(values.withColumnRenamed("__value", out), ["__day", "__x"], "left").drop("__day", "__x")
