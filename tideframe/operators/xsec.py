"""Cross-sectional operators: one date (or date and group) at a time.

Windows partitioned by date hold one row per entity of the universe.  ``day_stats``
is the alternative for very wide universes: a map-side combined aggregate per date
that is joined back.  Its moments are a few numbers per date; its exact percentiles keep
the values of a date in the task that sums it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideframe.functions.scalar import clip, col, ratio


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("date",)))


def z(x, w: WindowSpec, population: bool = False, fill: float | None = 0.0) -> Column:
    """(x - mean) / std inside the window; a constant or single-row group gives ``fill``."""
    x = col(x)
    std = (F.stddev_pop if population else F.stddev_samp)(x).over(w)
    out = ratio(x - F.avg(x).over(w), std)
    return out if fill is None else F.coalesce(out, F.lit(fill))


def day_stats(df: DataFrame, cols: list[str], keys=("date",)) -> DataFrame:
    """mean, std, count, 1% and 99% of each column per date (one row per date)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"), F.count(c).alias(f"{c}__n"),
                 F.percentile(c, 0.01).alias(f"{c}__lo"), F.percentile(c, 0.99).alias(f"{c}__hi")]
    return df.groupBy(*keys).agg(*aggs)


def winsorized_z(df: DataFrame, cols: list[str], min_group: int | None = 20, prefix: str = "z_") -> DataFrame:
    """Per-date z-scores after clipping to the 1% and 99% quantiles.

    ``min_group`` clips only dates with at least that many values, None clips every date.
    Quantiles, means and deviations of all columns share one partitioning by date, so the
    panel below is computed once; whole-partition frames are evaluated once per date.
    """
    w = by_date()
    q = {c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).over(w) for c in cols}
    out = df.withColumns({f"__q_{c}": q[c] for c in cols} | ({f"__n_{c}": F.count(c).over(w) for c in cols} if min_group is not None else {}))
    clipped = {}
    for c in cols:
        inside = F.least(F.greatest(F.col(c), F.col(f"__q_{c}")[0]), F.col(f"__q_{c}")[1])
        keep = F.lit(True) if min_group is None else F.col(f"__n_{c}") >= min_group
        clipped[f"__c_{c}"] = F.when(F.col(c).isNotNull() & keep, inside).otherwise(F.col(c))
    out = out.withColumns(clipped)
    out = out.withColumns({f"{prefix}{c}": z(f"__c_{c}", w) for c in cols})
    return out.drop(*[f"__{k}_{c}" for c in cols for k in "qnc"])


def grouped_z(x, group: str, min_names: int = 3) -> Column:
    """z inside (date, group) when the group has enough names, else inside the date."""
    x = col(x)
    g = by_date("date", group)
    return F.when(F.count(x).over(g) >= min_names, z(x, g)).otherwise(z(x, by_date()))


def first_come_rank(x, w_keys=("date",), tie: str = "symbol", descending: bool = True) -> Column:
    order = F.desc_nulls_last(x) if descending else F.asc_nulls_last(x)
    return F.row_number().over(Window.partitionBy(*w_keys).orderBy(order, tie))


def pct_rank(x, keys=("date",)) -> Column:
    """Average-tie rank over the count of present values; null for null."""
    x = col(x)
    lo = F.rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(x)))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (lo + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def grade_floor(pct) -> Column:
    """Label 0..4 as floor(pct * 5); missing counts as 0."""
    return F.least(F.lit(4), F.floor(F.coalesce(col(pct), F.lit(0.0)) * 5)).cast("int")


def grade_ceil(pct) -> Column:
    """Label 0..4 as ceil(pct * 5) - 1; missing stays missing."""
    return clip(F.ceil(col(pct) * 5) - 1, 0, 4).cast("int")


def inverted_score(pct, lower_is_better: bool) -> Column:
    """Percent rank on a 0..100 scale, turned round when low values are good."""
    p = col(pct) * 100
    return clip(101 - p if lower_is_better else p, 0, 100)


def score_context(df: DataFrame, score: str, group: str = "grp", prefix: str = "score", tie: str = "symbol") -> DataFrame:
    """Rank, group size, rank share (1 = leader), z, gap to the leader and spread inside (date, group)."""
    g = by_date("date", group)
    s = F.col(score)
    n = F.count(F.lit(1)).over(g)
    rank = F.when(s.isNotNull(), first_come_rank(s, ("date", group), tie))
    return df.withColumns({
        f"{prefix}_rank": rank, f"{prefix}_size": n,
        f"{prefix}_rank_pct": F.coalesce(1 - ratio(rank - 1, n - 1), F.lit(1.0)),
        f"{prefix}_z": z(s, g), f"{prefix}_gap": F.coalesce(F.max(s).over(g) - s, F.lit(0.0)),
        f"{prefix}_std": F.coalesce(F.stddev_samp(s).over(g), F.lit(0.0)),
    })


def min_names(df: DataFrame, n: int, keys=("date",)) -> DataFrame:
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("__n") >= n).drop("__n")
