"""Point-in-time joins: as-of, as-of with tolerance, snapshots, validity intervals.

The ordered step never sees the left rows themselves, only the distinct (key, date)
needles and one right row per (key, date), and it orders them month by month: what goes from one
month to the next is one row per (key, month).  The left rows are matched by the equi-join
at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_keys(left: DataFrame, right: DataFrame, on: str = "date", by: tuple[str, ...] = (), right_on: str | None = None,
              tolerance_days: int | None = None) -> DataFrame:
    """Distinct (by, on) of the left with ``__r``, the latest right row at or before ``on``; of right rows with one
    (by, date) the greatest by their columns in order.

    Two levels: the last right row so far within each (by, month), and for needles before the first right row of
    their month the last row of the months before, from a table of one row per (by, month).  So a side
    without a key, or with a hot one, is spread over its months."""
    right_on = right_on or on
    keep = [c for c in right.columns if c not in by]
    hay = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("__t")).agg(F.max(F.struct(*keep)).alias("__v")).withColumn("__side", F.lit(0))
    needles = left.select(*by, F.col(on).alias("__t")).where("__t IS NOT NULL").distinct().withColumn("__side", F.lit(1))
    both = hay.unionByName(needles, allowMissingColumns=True).withColumn("__m", F.trunc("__t", "month"))
    # The right side sorts first on equal dates, so equality matches.
    w = Window.partitionBy(*by, "__m").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("__in", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    months = both.groupBy(*by, "__m").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__last"))
    carry = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__m").alias("__month"), F.last("__last", ignorenulls=True).over(carry).alias("__before"))
    same = F.col("__m") == F.col("__month")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    hit = hit.join(months, same).select(*by, "__t", F.coalesce("__in", "__before").alias("__r"))
    if tolerance_days is not None:
        hit = hit.withColumn("__r", F.when(F.datediff("__t", F.col(f"__r.{right_on}")) <= tolerance_days, F.col("__r")))
    return hit.select(*by, F.col("__t").alias(on), "__r")


def asof_join(left: DataFrame, right: DataFrame, on: str = "date", by: tuple[str, ...] = (), right_on: str | None = None,
              tolerance_days: int | None = None, matched: str | None = None) -> DataFrame:
    """Left rows with the columns of the latest right row at or before their date (equality
    included), null beyond the tolerance.  ``matched`` names a column for the matched date."""
    right_on = right_on or on
    hit = asof_keys(left, right, on, by, right_on, tolerance_days)
    vals = [c for c in right.columns if c not in by and c != right_on]
    cols = [F.col(f"__r.{c}").alias(c) for c in vals] + ([F.col(f"__r.{right_on}").alias(matched)] if matched else [])
    return left.join(hit.select(*by, on, *cols), [*by, on], "left")


def snapshot_join(dates: DataFrame, snapshots: DataFrame, key: str, on: str = "date") -> DataFrame:
    """(key, date) rows expanded to every row of the key's latest snapshot at or before the date."""
    stamps = snapshots.select(key, F.col(on).alias("snapshot_date")).distinct()
    d = asof_join(dates, stamps.withColumn("__s", F.col("snapshot_date")), on, (key,), "snapshot_date").withColumnRenamed("__s", "snapshot_date")
    return d.join(snapshots.withColumnRenamed(on, "snapshot_date"), [key, "snapshot_date"])


def validity(snapshots: DataFrame, key: str, on: str = "date") -> DataFrame:
    """Distinct snapshot dates per key as half-open intervals [valid_from, valid_to)."""
    w = Window.partitionBy(key).orderBy(on)
    return snapshots.select(key, on).distinct().select(key, F.col(on).alias("valid_from"), F.lead(on).over(w).alias("valid_to"))


def interval_join(left: DataFrame, intervals: DataFrame, by: tuple[str, ...], on: str = "date", start: str = "valid_from",
                  end: str = "valid_to", closed: bool = False) -> DataFrame:
    """Left rows inside [start, end) (``closed``: [start, end]); a null end is open.

    Intervals are cut into calendar months, so the join is an equi-join on (keys, month) and
    the range test only filters inside a month.
    """
    bounds = left.agg(F.min(on).alias("__lo"), F.max(on).alias("__hi"))
    first = F.greatest(F.trunc(start, "month"), F.trunc("__lo", "month"))
    last = F.trunc(F.least(F.coalesce(F.col(end), F.col("__hi")), F.col("__hi")), "month")
    cut = (intervals.join(bounds).filter(first <= last)
           .withColumn("__m", F.explode(F.sequence(first, last, F.expr("interval 1 month")))).drop("__lo", "__hi"))
    upper = F.col(end).isNull() | (F.col(on) <= F.col(end) if closed else F.col(on) < F.col(end))
    return (left.withColumn("__m", F.trunc(on, "month")).join(cut, [*by, "__m"])
            .filter((F.col(on) >= F.col(start)) & upper).drop("__m"))
