"""Panel shaping: calendars, fills, week and month ends, bars, wide and long forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import col, finite


def friday(d) -> Column:
    """Label of the Saturday-to-Friday week that holds the date."""
    return F.date_add(F.date_trunc("week", F.date_add(col(d), 2)).cast("date"), 4)


def period(d, frequency: str) -> Column:
    return {"W": friday, "M": lambda x: F.trunc(col(x), "month"), "Y": lambda x: F.trunc(col(x), "year"),
            "D": col}[frequency](d)


def rebalance_dates(df: DataFrame, frequency: str = "W", date: str = "date") -> DataFrame:
    """Last existing date of each period; one row per period."""
    return (df.groupBy(period(date, frequency).alias("__p")).agg(F.max(date).alias(date)).select(date))


def at_rebalance(df: DataFrame, frequency: str = "W", date: str = "date") -> DataFrame:
    """Rows of the last existing date of each period (the list of dates is one row per period)."""
    return df.join(rebalance_dates(df.select(date), frequency, date), date, "left_semi")


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with their position, 0-based: one row per day."""
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    return df.select(date).distinct().select(date, (F.row_number().over(w) - 1).alias("pos"))


def on_calendar(df: DataFrame, value: str, entity: str = "symbol", limit: int | None = 5) -> DataFrame:
    """Every entity on every date of the merged calendar, gaps filled at most ``limit`` rows.

    The spine is entities x dates, the size of the filled panel itself: each entity row
    carries the array of calendar dates (one element per day) and is exploded.
    """
    days = df.agg(F.array_sort(F.collect_set("date")).alias("days"))
    spine = df.select(entity).distinct().join(days).select(entity, F.explode("days").alias("date"))
    full = spine.join(df.select(entity, "date", value), [entity, "date"], "left")
    w = R.by_entity(entity)
    return full.withColumn(f"raw_{value}", F.col(value)).withColumn(value, R.padded(value, w, limit))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key by ``order``; row_number <= 1 is pre-limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def resample_bars(bars: DataFrame, frequency: str = "W") -> DataFrame:
    """Weekly or monthly bars stamped with the last traded date of the period."""
    d = F.col("date")
    return (bars.groupBy("symbol", period("date", frequency).alias("__p")).agg(
        F.max("date").alias("date"), F.min_by("open", d).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", d).alias("close"), F.sum("volume").alias("volume")).drop("__p"))


def normalize_bars(df: DataFrame, names=("Open", "High", "Low", "Close", "Volume"), date: str = "Date") -> DataFrame:
    """Known columns only, numeric, lower-cased, rows without a close dropped, time zone stripped."""
    have = [c for c in names if c in df.columns]
    rest = [c for c in ("symbol",) if c in df.columns]
    return df.select(F.to_date(date).alias("date"), *rest, *[finite(F.col(c).try_cast("double")).alias(c.lower()) for c in have]).filter(
        F.col("close").isNotNull() & F.col("date").isNotNull())


def to_wide(df: DataFrame, value: str, symbols: list[str], entity: str = "symbol") -> DataFrame:
    """date x entity matrix; the column list is given, so no pass collects it."""
    return df.groupBy("date").pivot(entity, symbols).agg(F.first(value))


def to_long(wide: DataFrame, value: str, entity: str = "symbol") -> DataFrame:
    cols = [c for c in wide.columns if c != "date"]
    return wide.unpivot(["date"], cols, entity, value).filter(F.col(value).isNotNull())


def next_trade_date(cal: DataFrame, steps: int) -> DataFrame:
    """date -> date ``steps`` positions later, the last date when the calendar ends."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    last = F.max("date").over(Window.partitionBy(F.lit(0)))
    return cal.select("date", F.coalesce(F.lead("date", steps).over(w), last).alias("next_date"))
