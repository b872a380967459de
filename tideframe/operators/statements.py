"""Report availability and financial-statement shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col, ratio
from tideframe.functions.text import amount

# Report kind, first usable month and day, fiscal-year shift.
REPORT_DATES = [("annual", 4, 1, -1), ("q1", 5, 16, 0), ("half", 8, 16, 0), ("q3", 11, 16, 0)]
FILING_LAG_DAYS = 45


def report_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """available, kind, fiscal: four rows per year from three years before the first date."""
    span = dates.agg(F.explode(F.sequence(F.year(F.min(date)) - 3, F.year(F.max(date)))).alias("y"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(s).alias("s")) for k, m, d, s in REPORT_DATES]))
    return span.select("y", kinds.alias("k")).select(F.make_date("y", "k.m", "k.d").alias("available"), F.col("k.kind").alias("kind"), (F.col("y") + F.col("k.s")).alias("fiscal"))


def available_rows(df: DataFrame, asof: Column, period: str = "period", filing: str = "filing") -> DataFrame:
    """Statements usable at ``asof``: filing date, or period end plus the filing lag."""
    d = df.withColumn("available", F.coalesce(F.col(filing), F.date_add(period, FILING_LAG_DAYS)))
    return d.filter(F.col("available") <= asof)


def accounts_to_metrics(rows: DataFrame, aliases: dict[str, list[str]], keys: list[str], pos: str = "pos") -> DataFrame:
    """Account rows to one column per metric; the first alias with an amount wins, then the first row."""
    name = F.lower(F.regexp_replace("account", r"[\s_()-]+", ""))
    rows = rows.withColumns({"__n": name, "__v": amount("amount")}).filter(F.col("__v").isNotNull())
    aggs = []
    for metric, names in aliases.items():
        rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("__n"))
        hit = rank > 0
        aggs.append(F.min_by(F.when(hit, F.col("__v")), F.when(hit, F.struct(rank, F.col(pos)))).alias(metric))
    return rows.groupBy(*keys).agg(*aggs)


def with_year_ago(df: DataFrame, cols: list[str], key: str = "symbol", order: str = "available") -> DataFrame:
    """Values four statements back, else one back."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{c}_prior": F.coalesce(F.lag(c, 4).over(w), F.lag(c, 1).over(w)) for c in cols})


def growth_pct(now, before) -> Column:
    return ratio(col(now) - col(before), F.abs(col(before))) * 100


def prior_report(df: DataFrame, keys=("symbol",), year: str = "fiscal", kind: str = "kind", values: tuple[str, ...] = ("revenue",)) -> DataFrame:
    """The same report of the year before, else that year's annual report."""
    prev = df.select(*keys, (F.col(year) + 1).alias(year), kind, *[F.col(v).alias(f"__s_{v}") for v in values])
    annual = df.filter(F.col(kind) == "annual").select(*keys, (F.col(year) + 1).alias(year), *[F.col(v).alias(f"__a_{v}") for v in values])
    out = df.join(prev, [*keys, year, kind], "left").join(annual, [*keys, year], "left")
    return out.withColumns({f"{v}_prior": F.coalesce(f"__s_{v}", f"__a_{v}") for v in values}).drop(
        *[f"__{k}_{v}" for v in values for k in "sa"])


def derived_fundamentals(df: DataFrame) -> DataFrame:
    """Profitability, margins, leverage, free cash flow, growth and net cash of statements that carry
    revenue, net_income, gross_profit, operating_income, equity, assets, liabilities, cash,
    operating_cashflow, capex, market_cap, revenue_prior and net_income_prior.

    A figure whose parts are unknown or whose divisor is zero is null; unknown capex counts as none in
    free cash flow, unknown cash and liabilities as none in net cash.  Growth here keeps the sign of
    its base, unlike ``growth_pct``."""
    zero = F.lit(0.0)
    return df.withColumns({
        "return_on_equity": ratio("net_income", "equity"), "return_on_assets": ratio("net_income", "assets"), "debt_to_equity": ratio("liabilities", "equity") * 100,
        "profit_margins": ratio("net_income", "revenue"), "operating_margins": ratio("operating_income", "revenue"), "gross_margins": ratio("gross_profit", "revenue"),
        "free_cashflow": F.col("operating_cashflow") - F.abs(F.coalesce("capex", zero)),
        "revenue_growth": ratio("revenue", "revenue_prior") - 1, "earnings_growth": ratio("net_income", "net_income_prior") - 1,
        "net_cash_to_market_cap": ratio(F.coalesce("cash", zero) - F.coalesce("liabilities", zero), "market_cap") * 100})
