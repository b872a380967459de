"""Ordered statistics of large pools (whole panels) without sorting a pool in one task.

Every function works on (value, count) pairs after a map-side combine, cuts the value axis
of each group into ranges of roughly equal weight (``percentile_approx`` splits), runs the
window inside (group, range) and adds the totals of the ranges below.  Heavy ties collapse
to one row before any ordering, so neither a hot group nor a hot value lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import ratio
from tideframe.session import checkpointed

RANGES = 64


def value_counts(df: DataFrame, by: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (group, distinct value) with summed measures; null values are dropped."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v"))
            .agg(*[F.sum(m).alias(k) for k, m in measures.items()]))


def running(counts: DataFrame, by: list[str], measures: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``<m>_below`` (sum of m over smaller values) and ``<m>_all`` (group total) to the
    output of ``value_counts``.

    The counts and their cut into ranges are staged: the approximate splits may come out slightly
    different when recomputed, and both branches below must see the same ranges (the totals are
    exact for any ranges).  It also keeps the panel below from being computed once per branch.
    """
    counts = checkpointed(counts)
    probs = [i / ranges for i in range(1, ranges)]
    splits = counts.groupBy(*by).agg(F.percentile_approx("v", F.array(*[F.lit(p) for p in probs]), F.lit(ranges * 50)).alias("__s"))
    cut = checkpointed((counts.join(splits, by) if by else counts.join(splits)).withColumn(
        "__b", F.size(F.filter("__s", lambda s: s < F.col("v")))).drop("__s"))
    # One row per (group, range): at most ``ranges`` rows per group.
    part = cut.groupBy(*by, "__b").agg(*[F.sum(m).alias(f"__p_{m}") for m in measures])
    w_all = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w_run = w_all.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "__b", *[F.coalesce(F.sum(f"__p_{m}").over(w_run), F.lit(0)).alias(f"__o_{m}") for m in measures],
                       *[F.sum(f"__p_{m}").over(w_all).alias(f"{m}_all") for m in measures])
    inner = Window.partitionBy(*by, "__b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(part, [*by, "__b"])
    return out.withColumns({f"{m}_below": F.coalesce(F.sum(m).over(inner), F.lit(0)) + F.col(f"__o_{m}") for m in measures}).drop(
        "__b", *[f"__o_{m}" for m in measures])


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles per group: group, q, value."""
    r = running(value_counts(df, by, value, {"n": F.lit(1)}), by, ["n"])
    r = r.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    pos = (F.col("n_all") - 1) * F.col("q")
    holds = lambda p: (F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n"))
    lo, hi = F.floor(pos), F.ceil(pos)
    hit = r.withColumn("pos", pos).filter(holds(lo) | holds(hi))
    g = hit.groupBy(*by, "q").agg(F.max(F.when(holds(lo), F.col("v"))).alias("__a"), F.max(F.when(holds(hi), F.col("v"))).alias("__z"),
                                  F.max(pos - F.floor(pos)).alias("__f"))
    return g.select(*by, "q", (F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__f")).alias("value"))


def class_counts(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Rows and positives per (group, score), below it and in all."""
    y = F.col(label)
    return running(value_counts(df.filter(y.isNotNull()), by, score, {"n": F.lit(1), "pos": y.cast("long")}), by, ["n", "pos"])


def auc_of_counts() -> Column:
    """Aggregate over ``class_counts``: ROC-AUC by average ranks; null when a class is missing."""
    p, n = F.max("pos_all").cast("double"), (F.max("n_all") - F.max("pos_all")).cast("double")
    return ratio(F.sum(F.col("pos") * (F.col("n_below") + (F.col("n") + 1) / 2)) - p * (p + 1) / 2, p * n)


def precision_of_counts() -> Column:
    """Aggregate over ``class_counts``: average precision over distinct score thresholds."""
    tp, seen = F.col("pos_all") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    return ratio(F.sum(F.col("pos") * tp / seen), F.max("pos_all"))


def roc_auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Exact ROC-AUC by average ranks; null when a class is missing."""
    return class_counts(df, by, score, label).groupBy(*by).agg(auc_of_counts().alias("auc"))


def average_precision(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Exact average precision over distinct score thresholds."""
    return class_counts(df, by, score, label).groupBy(*by).agg(precision_of_counts().alias("ap"))


def discrimination(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Both of the above from one set of counts: auc and ap."""
    return class_counts(df, by, score, label).groupBy(*by).agg(auc_of_counts().alias("auc"), precision_of_counts().alias("ap"))


def mean_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average-tie rank (1-based) and share of every distinct value in the pool."""
    r = running(value_counts(df, by, value, {"n": F.lit(1)}), by, ["n"])
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    return r.select(*by, F.col("v").alias(value), rank.alias("rank"), (rank / F.col("n_all")).alias("rank_pct"))


def row_ranks(df: DataFrame, by: list[str], value: str, date: str = "date", entity: str = "symbol", out: str = "rank") -> DataFrame:
    """First-come rank (1-based) of every row of the pool by (value, date, entity), and ``pool`` rows.

    Three levels: counts per value in ranges, dates inside a value, entities inside (value, date);
    a value that holds a large share of the pool is split by its dates.
    """
    known = df.filter(F.col(value).isNotNull())
    per_day = checkpointed(known.groupBy(*by, F.col(value).alias("v"), date).agg(F.count(F.lit(1)).alias("__c")))
    levels = running(per_day.groupBy(*by, "v").agg(F.sum("__c").alias("n")), by, ["n"])
    w = Window.partitionBy(*by, "v").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.join(levels, [*by, "v"]).select(*by, F.col("v").alias(value), date, (F.col("n_below") + F.coalesce(F.sum("__c").over(w), F.lit(0))).alias("__o"), F.col("n_all").alias("pool"))
    inner = Window.partitionBy(*by, value, date).orderBy(entity)
    return known.join(days, [*by, value, date]).withColumn(out, F.col("__o") + F.row_number().over(inner)).drop("__o")


def with_halo(df: DataFrame, pos: str, width: int, halo: int) -> DataFrame:
    """Cut a long series into chunks of ``width`` positions, each preceded by the last ``halo``
    positions of the chunk before; ``home`` marks the rows a chunk owns.

    Trailing RANGE frames of at most ``halo`` positions over (chunk, pos) are then exact, and
    an arbitrarily long single series runs in as many tasks as it has chunks.
    """
    b = F.floor(F.col(pos) / width)
    copies = F.when(F.pmod(F.col(pos), F.lit(width)) >= width - halo, F.array(b, b + 1)).otherwise(F.array(b))
    return df.withColumn("chunk", F.explode(copies)).withColumn("home", F.col("chunk") == b)
