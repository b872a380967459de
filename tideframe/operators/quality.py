"""Cleaning, coverage and eligibility filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import col, finite, number
from tideframe.operators import panel as P


def coerce_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c).cast("string")) for c in cols if c in df.columns})


def nullify(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and infinities to null."""
    return df.withColumns({c: finite(c) for c in cols})


def fill_from_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Target columns from the first present alternates."""
    return df.withColumns({t: first_present(df, [t, *names], None) for t, names in aliases.items()})


def first_present(df: DataFrame, names: list[str], default) -> Column:
    """First non-null of the columns that exist, else the default."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def quality_rows(df: DataFrame, label: str, start: str, count_col: str, min_count: int, group: str, min_group: int) -> DataFrame:
    """Start date, holdings count and label present, then (date, group) sizes."""
    d = df.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col(count_col) >= min_count) & F.col(label).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("date", group))
    return d.withColumn("__n", n).filter(F.col("__n") >= min_group).drop("__n")


def covered(prices: DataFrame, start: str, min_share: float) -> DataFrame:
    """Prices of symbols present on at least ``min_share`` of the calendar from ``start``."""
    since = prices.filter((F.col("date") >= F.lit(start).cast("date")) & F.col("close").isNotNull())
    days = since.agg(F.count_distinct("date").alias("__days"))
    have = since.groupBy("symbol").agg(F.count_distinct("date").alias("__n")).join(days)
    return prices.join(have.filter(F.col("__n") / F.col("__days") >= min_share).select("symbol"), "symbol", "left_semi")


def long_lived(prices: DataFrame, first_by: str, start: str, min_obs: int) -> DataFrame:
    """symbol, first_price_date, price_obs of symbols old and dense enough."""
    g = prices.filter(F.col("close").isNotNull()).groupBy("symbol").agg(
        F.min("date").alias("first_price_date"), F.count_if(F.col("date") >= F.lit(start).cast("date")).alias("price_obs"))
    return g.filter((F.col("first_price_date") <= F.lit(first_by).cast("date")) & (F.col("price_obs") >= min_obs))


def coverage(required: DataFrame, prices: DataFrame, start: str, min_rows: int, late_days: int = 120) -> DataFrame:
    """Rows, span and a repair flag for every required symbol."""
    g = prices.filter(F.col("close").isNotNull()).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    out = required.join(g, "symbol", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    late = F.col("start_date") > F.date_add(F.lit(start).cast("date"), late_days)
    return out.withColumns({"exists": F.col("rows") > 0, "needs_repair": (F.col("rows") < min_rows) | F.col("start_date").isNull() | F.coalesce(late, F.lit(False))})


def valid_feature_dates(prices: DataFrame, benchmark: DataFrame, min_history: int = 260, ahead: int = 20, targets: bool = True) -> DataFrame:
    """(date, symbol) whose calendar position leaves enough history and enough future, both prices present."""
    cal = P.calendar(prices.select("date"))
    n = cal.agg(F.count(F.lit(1)).alias("__n"))
    cal = cal.join(n).filter(F.col("pos") >= min_history)
    if targets:
        cal = cal.filter(F.col("pos") + ahead < F.col("__n"))
    b = benchmark.filter(F.col("close").isNotNull()).select("date")
    return prices.filter(F.col("close").isNotNull()).join(cal.select("date"), "date", "left_semi").join(b, "date", "left_semi")


def covered_columns(df: DataFrame, cols: list[str], min_share: float) -> list[str]:
    """Names of numeric columns with enough non-null values, best covered first: one aggregate, one row to the driver."""
    row = df.agg(*[F.avg(finite(c).isNotNull().cast("double")).alias(c) for c in cols]).first()
    return sorted((c for c in cols if (row[c] or 0.0) >= min_share), key=lambda c: -row[c])


def column_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """name, share of usable values."""
    row = df.agg(*[F.avg(finite(c).isNotNull().cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "name", "share")


def impute_median(df: DataFrame, cols: list[str], keys=("date",)) -> DataFrame:
    """null -> median of the group -> 0; medians are aggregated and joined back."""
    m = df.groupBy(*keys).agg(*[F.median(c).alias(f"__m_{c}") for c in cols])
    return df.join(m, list(keys), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(0.0)) for c in cols}).drop(*[f"__m_{c}" for c in cols])


def impute_expanding(df: DataFrame, cols: list[str], keys: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """null -> mean of the rows so far -> 0, on a date-level or per-entity series."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w), F.lit(0.0)) for c in cols})


def feature_columns(columns: list[str], suffixes: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), names: tuple[str, ...] = (),
                    forbidden: tuple[str, ...] = ("forward_", "realized_", "target_", "label_", "future_")) -> list[str]:
    """Column names by pattern; forward-looking names are never features."""
    ok = lambda c: c in names or c.endswith(suffixes) or (bool(prefixes) and c.startswith(prefixes))
    return [c for c in columns if ok(c) and not c.startswith(forbidden)]


def from_first_known(df: DataFrame, regime: DataFrame, column: str = "regime", unknown: str = "unknown") -> DataFrame:
    """Rows from the first date on which the regime is known (one scalar row joined)."""
    known = regime.filter(F.col(column).isNotNull() & (F.lower(column) != unknown)).agg(F.min("date").alias("__first"))
    return df.join(known).filter(F.col("date") >= F.col("__first")).drop("__first")
