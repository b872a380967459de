"""Threshold sweeps as cumulative histograms.

A row counts for every threshold at or below its score.  Instead of multiplying rows by
the grid, each row goes to the bin of the largest threshold it reaches; one map-side
combined aggregate leaves |grid| + 1 rows per group and a suffix sum over those bins gives
the totals "score >= threshold" for the whole grid.  Work is linear in the rows whatever
the grid size.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col


def reached(score, grid) -> Column:
    """Index (1-based) of the largest grid value <= score, 0 when none.  ``grid``: list or array column."""
    g = F.array(*[F.lit(float(x)) for x in sorted(grid)]) if isinstance(grid, list) else col(grid)
    s = col(score)
    return F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.filter(g, lambda x: x <= s)))


def sweep(df: DataFrame, by: list[str], score: str, grid, measures: dict[str, Column]) -> DataFrame:
    """Per group and threshold: every measure summed over rows with score >= threshold, and
    ``<measure>_all`` summed over all rows of the group.  ``grid`` is a list, or the name of a
    sorted array column that is constant inside the group (its own grid per fold)."""
    fixed = isinstance(grid, list)
    own = [] if fixed else [F.first(grid).alias("__grid")]
    bins = df.select(*by, reached(score, grid).alias("__b"), *([] if fixed else [grid]), *[col(m).alias(k) for k, m in measures.items()]).groupBy(*by, "__b").agg(
        *[F.sum(k).alias(k) for k in measures], *own)
    # At most |grid| + 1 rows per group remain; the grid itself gives one row per threshold even for empty bins.
    parts = bins.groupBy(*by).agg(F.collect_list(F.struct("__b", *measures)).alias("__p"), *([] if fixed else [F.first("__grid").alias("__grid")]))
    g = F.array(*[F.lit(float(x)) for x in sorted(grid)]) if fixed else F.col("__grid")
    long = parts.select(*by, "__p", F.posexplode(g).alias("__i", "threshold"))
    add = lambda k, cond: F.aggregate(F.filter("__p", cond), F.lit(0.0), lambda s, p: s + F.coalesce(p[k].cast("double"), F.lit(0.0)))
    return long.select(*by, "threshold", *[add(k, lambda p: p["__b"] > F.col("__i")).alias(k) for k in measures],
                       *[add(k, lambda p: F.lit(True)).alias(f"{k}_all") for k in measures])


def confusion(label, extra: dict[str, Column] | None = None) -> dict[str, Column]:
    """Measures for ``sweep``: ``n`` rows and ``tp`` positives at or above the threshold."""
    return {"n": F.lit(1.0), "tp": col(label).cast("double"), **(extra or {})}


def over_grid(df: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Every row once per combination of a literal parameter grid (fixed size, known at plan
    time).  Meant for date-level tables, where objectives need the ordered rows; row-level
    counts use ``sweep`` instead."""
    out = df
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
