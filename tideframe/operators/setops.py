"""Set operations on selections and key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col


def overlap_rate(a, b, k) -> Column:
    return F.size(F.array_intersect(col(a), col(b))) / k


def turnover(now, before) -> Column:
    """Symmetric difference over union; 1.0 when there was no earlier selection."""
    a, b = col(now), F.coalesce(col(before), F.array().cast("array<string>"))
    diff = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.when(F.size(b) == 0, F.lit(1.0)).otherwise(diff / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def selections(picks: DataFrame, rank: str = "rn", symbol: str = "symbol", keys=("date",)) -> DataFrame:
    """One row per date with the selected symbols in rank order (k rows per date at most)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(rank, symbol))), lambda s: s[symbol])
    return picks.groupBy(*keys).agg(ordered.alias("selected"))


def first_occurrence(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key by an explicit order (stacked lists: priority, then position)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def work_list(df: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Distinct symbols, the one seen last first."""
    return df.groupBy(symbol).agg(F.max(date).alias("last_date")).orderBy(F.desc("last_date"), symbol)
