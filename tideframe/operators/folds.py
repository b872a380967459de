"""Order-dependent operators as window expressions wherever the recursion has a closed form;
the two genuinely greedy ones fold a short array per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import col


def ema(df: DataFrame, value: str, span: int, out: str, keys: tuple[str, ...] = ("symbol",), order: str = "date",
        min_periods: int = 1) -> DataFrame:
    """Exponential mean y[t] = a x[t] + (1-a) y[t-1], y[0] = x[0], a = 2 / (span + 1).

    Rows are cut into chunks so long that (1-a)^chunk is below double precision; inside a chunk
    the mean is a scaled running sum, and only the end value of the chunk before still matters.
    Two windows on one partitioning replace the row-by-row recursion.  Values must be present.
    """
    a = 2.0 / (span + 1.0)
    q = 1.0 - a
    m = max(2, math.ceil(46.0 / -math.log(q)))
    w = Window.partitionBy(*keys).orderBy(order)
    pos = F.col("__pos")
    d = df.withColumn("__pos", F.row_number().over(w) - 1)
    d = d.withColumns({"__c": F.floor(pos / m), "__j": pos % m})
    x = F.when(pos == 0, F.col(value)).otherwise(F.col(value) * a)
    run = Window.partitionBy(*keys, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.pow(F.lit(q), F.col("__j")) * F.sum(x * F.pow(F.lit(q), -F.col("__j"))).over(run))
    end = F.last(F.when(F.col("__j") == m - 1, F.col("__in")), ignorenulls=True).over(w.rowsBetween(-m, -1))
    y = F.col("__in") + F.pow(F.lit(q), F.col("__j") + 1) * F.coalesce(end, F.lit(0.0))
    return d.withColumn(out, F.when(pos >= min_periods - 1, y)).drop("__pos", "__c", "__j", "__in")


def hysteresis(df: DataFrame, score: str, watch: float, derisk: float, cash: float, out: str = "state",
               keys: tuple[str, ...] = (), order: str = "date", slack: float = 5.0) -> DataFrame:
    """Normal / Watch / De-risk / Cash with holding bands.

    Cash holds while the score stays at or above derisk - slack, De-risk while it stays at or
    above watch - slack.  "Held since" is a comparison of last positions: Cash is on when the
    last entry is later than the last drop below its band, De-risk likewise with Cash rows as
    further resets, so no row depends on the computed state of another.
    """
    part = keys or (F.lit(0),)
    w = Window.partitionBy(*part).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(F.col(score), F.lit(0.0))
    last = lambda cond: F.coalesce(F.max(F.when(cond, F.col("__p"))).over(run), F.lit(0))
    d = df.withColumn("__p", F.row_number().over(w))
    d = d.withColumn("__cash", last(v >= cash) > last(v < derisk - slack))
    d = d.withColumn("__de", last((v >= derisk) & ~F.col("__cash")) > F.greatest(last(v < watch - slack), last(F.col("__cash"))))
    state = F.when(F.col("__cash"), "Cash").when(F.col("__de"), "De-risk").when(v >= watch, "Watch").otherwise("Normal")
    return d.withColumn(out, state).drop("__p", "__cash", "__de")


def runs(df: DataFrame, label: str, keys: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """Contiguous runs of one label: start, end, label, days."""
    part = keys or (F.lit(0),)
    w = Window.partitionBy(*part).orderBy(order)
    d = df.filter(F.col(label).isNotNull())
    new = F.coalesce((F.col(label) != F.lag(label).over(w)), F.lit(True)).cast("int")
    d = d.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__run").agg(F.min(order).alias("start_date"), F.max(order).alias("end_date"), F.first(label).alias(label),
                                         F.count(F.lit(1)).alias("days")).drop("__run")


def rising_edges(df: DataFrame, flag: str, keys: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """Rows on which the flag turns on; ``pos`` is the row position of the key's series."""
    part = keys or (F.lit(0),)
    w = Window.partitionBy(*part).orderBy(order)
    on = F.coalesce(F.col(flag).cast("int"), F.lit(0)) == 1
    d = df.withColumns({"pos": F.row_number().over(w) - 1, "__prev": F.coalesce(F.lag(flag).over(w).cast("int"), F.lit(0))})
    return d.filter(on & (F.col("__prev") == 0)).drop("__prev")


def episode_starts(df: DataFrame, flag: str, min_gap: int, keys: tuple[str, ...] = (), order: str = "date", by_rows: bool = False) -> DataFrame:
    """Rising edges at least ``min_gap`` days (or rows) after the last accepted one.

    The gap runs from the last ACCEPTED edge, which is greedy: the edges of a key (a short list)
    are folded, the rows are not.
    """
    e = rising_edges(df, flag, keys, order)
    at = F.col("pos") if by_rows else F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))
    group = e.groupBy(*keys) if keys else e.groupBy(F.lit(0).alias("__k"))
    arr = group.agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("t"), F.col(order).alias("d"), "pos"))).alias("__e"))
    zero = F.slice("__e", 1, 0)
    # try_element_at is null on an empty list, so the first edge is always taken.
    take = lambda acc, x: F.coalesce(x["t"] - F.try_element_at(acc, F.lit(-1))["t"] >= min_gap, F.lit(True))
    safe = lambda acc, x: F.when(take(acc, x), F.array_append(acc, x)).otherwise(acc)
    got = arr.select(*keys, F.explode(F.aggregate("__e", zero, safe)).alias("__s"))
    return got.select(*keys, F.col("__s.d").alias(order), F.col("__s.pos").alias("pos"))


def episodes_with_warning(df: DataFrame, flag: str, warning: str, score: str, lookback_days: int, order: str = "date") -> DataFrame:
    """Rising edges of a date-level flag with the warnings of the days before: detected, first
    warning, lead in days, largest earlier score."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))).rangeBetween(-lookback_days, 0)
    d = df.withColumns({"first_warning": F.min(F.when(F.col(warning), F.col(order))).over(w), "max_score": F.max(score).over(w)})
    e = rising_edges(d, flag, (), order)
    return e.select(F.col(order).alias("episode_date"), F.col("first_warning").isNotNull().alias("detected"), "first_warning",
                    F.datediff(order, "first_warning").alias("lead_days"), "max_score")


def obv(df: DataFrame, out: str = "obv", keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """Running sum of volume signed by the direction of the close."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__v", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))
    return d.withColumn(out, F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__v")


def refit_marks(df: DataFrame, step: int, regime: str | None = None, order: str = "date", start: int = 0) -> DataFrame:
    """Rows of a date-level series on which a threshold is refitted: every ``step`` rows since the
    last refit, and whenever the regime flips.  ``fit`` numbers the refits.

    A regime flip restarts the count, so refits fall on multiples of ``step`` from the start of
    each run of one regime.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    d = df.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") >= start)
    flip = (F.coalesce(F.col(regime) != F.lag(regime).over(w), F.lit(True)) if regime else F.col("pos") == start)
    d = d.withColumn("__flip", flip)
    base = F.max(F.when(F.col("__flip"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("refit", (F.col("pos") - base) % step == 0)
    return d.withColumn("fit", F.sum(F.col("refit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__flip")
