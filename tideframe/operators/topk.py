"""Top-k, last-n and best-row selection. ``row_number() <= k`` is limited per map task
before the shuffle, so a hot group ships k rows per task at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col, ratio


def top_k(df: DataFrame, score: str, k: int, keys=("date",), tie: str = "symbol", ascending: bool = False, rank: str = "rn") -> DataFrame:
    order = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    w = Window.partitionBy(*keys).orderBy(order, tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def last_rows(df: DataFrame, n: int, keys=("symbol",), order: str = "date", rank: str = "rn") -> DataFrame:
    """The n latest rows per key, numbered from the end (1 = last)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def at_back(x, k: int, rank: str = "rn") -> Column:
    """Aggregate: value of the k-th row from the end."""
    return F.max(F.when(F.col(rank) == k, col(x)))


def tail(x, n: int, rank: str = "rn") -> Column:
    """The value when the row is among the last n, else null (for use inside aggregates)."""
    return F.when(F.col(rank) <= n, col(x))


def sessions_return(x, n: int, rank: str = "rn") -> Column:
    """close[-1] / close[-n] - 1 in percent: spans n - 1 steps and needs more than n rows."""
    return F.when(F.max(rank) > n, (ratio(at_back(x, 1, rank), at_back(x, n, rank)) - 1) * 100)


def leaders_then_top(df: DataFrame, score: str, group: str, k: int, tie: str = "symbol") -> DataFrame:
    """Per date: the leader of each group competes for k places; when there are fewer than k
    leaders the whole date competes."""
    g = Window.partitionBy("date", group).orderBy(F.desc_nulls_last(score), tie)
    lead = df.withColumn("__lead", F.row_number().over(g) == 1)
    lead = lead.withColumn("__n", F.sum(F.col("__lead").cast("int")).over(Window.partitionBy("date")))
    pool = lead.filter(F.col("__lead") | (F.col("__n") < k)).drop("__lead", "__n")
    return top_k(pool, score, k, tie=tie)


def latest_batch(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the last date of the table."""
    return df.join(df.agg(F.max(date).alias(date)), date, "left_semi")


def latest_per_key(df: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """Last row per key as one aggregate: combined map-side, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def best_rows(df: DataFrame, objective, keys: list[str], tie: list[str]) -> DataFrame:
    """Row with the largest objective per key; ties go to the smallest ``tie`` columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(col(objective)), *tie)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
