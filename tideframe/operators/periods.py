"""Period evaluation of selections: per-date portfolio rows and performance summaries.

Rows of a strategy are one per rebalance date, so windows over a strategy are short; the
asset rows below are reduced by row_number <= k, which is limited before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import col, ratio
from tideframe.operators import aggregates as G, panel as P, setops as O, xsec as S


def topk_periods(df: DataFrame, score: str, k: int, ret: str, benchmark: str | None = None, keys=("date",), tie: str = "symbol", min_names: bool = True) -> DataFrame:
    """Per date: portfolio, benchmark, excess and universe return, hit, selected symbols.
    Dates with fewer than k complete names drop out."""
    d = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    b = F.col(benchmark) if benchmark else F.avg(ret).over(Window.partitionBy(*keys))
    d = d.withColumn("__b", b)
    if benchmark:
        d = d.filter(F.col("__b").isNotNull())
    r = d.withColumns({"rn": S.first_come_rank(score, keys, tie), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    if min_names:
        r = r.filter(F.col("__n") >= k)
    top = F.col("rn") <= k
    picked = F.array_sort(F.collect_list(F.when(top, F.struct("rn", tie))))
    g = r.groupBy(*keys).agg(F.avg(F.when(top, F.col(ret))).alias("portfolio_return"), F.avg(F.when(top, F.col("__b"))).alias("benchmark_return"),
                             F.avg(ret).alias("universe_return"), F.count(F.lit(1)).alias("names"), picked.alias("__s"))
    return g.withColumns({"excess_return": F.col("portfolio_return") - F.col("benchmark_return"), "selected": F.array_join(F.transform("__s", lambda s: s[tie]), ",")}).withColumn(
        "hit", (F.col("excess_return") > 0).cast("int")).drop("__s")


def with_flat_rows(periods: DataFrame, dates: DataFrame, cols: list[str]) -> DataFrame:
    """Every rebalance date; dates without a selection get zero returns and invested = 0."""
    d = dates.join(periods.withColumn("invested", F.lit(1)), "date", "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols} | {"invested": F.coalesce("invested", F.lit(0))})


def performance(df: DataFrame, by: list[str], ret: str, per_year: float, benchmark: str | None = None, invested: str | None = None, calendar_years: bool = False, end: str | None = None) -> DataFrame:
    """Cumulative return, CAGR, volatility, Sharpe, Sortino, Calmar, maximum drawdown, hit rates,
    coverage per strategy.  CAGR counts periods, or calendar years when asked."""
    r = F.coalesce(F.col(ret), F.lit(0.0))
    part = [F.col(c) for c in by] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("date")
    d = df.withColumns({"__r": r, "__b": F.coalesce(F.col(benchmark), F.lit(0.0)) if benchmark else F.lit(0.0), "__i": F.col(invested).cast("int") if invested else F.lit(1), "__e": R.equity(r, w)})
    d = d.withColumn("__dd", F.col("__e") / F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    live = F.col("__i") == 1
    g = (d.groupBy(*by) if by else d.groupBy()).agg(
        F.count(F.lit(1)).alias("periods"), F.sum("__i").alias("invested_periods"), F.min("date").alias("start_date"), F.max(end or "date").alias("end_date"),
        F.product(1 + F.col("__r")).alias("__total"), (F.product(1 + F.col("__b")) - 1).alias("benchmark_return"), F.avg("__r").alias("avg_return"), F.stddev_samp("__r").alias("__sd"),
        F.sqrt(F.avg(F.pow(F.least(F.col("__r"), F.lit(0.0)), 2))).alias("__down"), F.min("__dd").alias("MDD"),
        F.avg(F.when(live, (F.round("__r", 12) > 0).cast("double"))).alias("hit_positive"), F.avg(F.when(live, (F.round(F.col("__r") - F.col("__b"), 12) > 0).cast("double"))).alias("hit_excess"),
        F.avg(F.when(live, F.col("__r") - F.col("__b"))).alias("avg_excess"))
    years = F.greatest(F.datediff("end_date", "start_date") / 365.25, F.lit(1e-9)) if calendar_years else F.col("periods") / per_year
    root = F.lit(float(per_year)) ** 0.5
    g = g.withColumns({"cumulative_return": F.col("__total") - 1, "CAGR": F.when(F.col("__total") > 0, F.pow("__total", 1 / years) - 1), "ann_vol": F.col("__sd") * root,
                       "Sharpe": ratio("avg_return", "__sd") * root, "Sortino": ratio("avg_return", "__down") * root, "coverage": F.col("invested_periods") / F.col("periods")})
    return g.withColumn("Calmar", F.when(F.col("MDD") < 0, ratio("CAGR", F.abs("MDD")))).drop("__total", "__sd", "__down")


def evaluate_scores(df: DataFrame, scores: list[str], ks: list[int], ret: str) -> DataFrame:
    """Period returns for every score column and k; every score is ranked once."""
    long = df.select("date", "symbol", ret, F.explode(F.array(*[F.struct(F.lit(s).alias("score_col"), F.col(s).cast("double").alias("score")) for s in scores])).alias("s")).select(
        "date", "symbol", ret, "s.*").filter(F.col("score").isNotNull() & F.col(ret).isNotNull())
    uni = long.groupBy("date", "score_col").agg(F.avg(ret).alias("universe_return"), F.count(F.lit(1)).alias("names"))
    r = long.withColumn("rn", S.first_come_rank("score", ("date", "score_col"))).filter(F.col("rn") <= max(ks))
    top = r.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rn") <= F.col("top_k"))
    g = top.groupBy("date", "score_col", "top_k").agg(F.avg(ret).alias("portfolio_return"))
    return g.join(uni, ["date", "score_col"]).filter(F.col("names") >= F.col("top_k"))


def net_of_cost(periods: DataFrame, cost_bps: float) -> DataFrame:
    """Turnover against the selection of the period before, its cost and the net return."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = periods.withColumn("__s", F.split("selected", ","))
    d = d.withColumn("turnover", O.turnover("__s", F.lag("__s").over(w)))
    d = d.withColumn("cost", F.col("turnover") * cost_bps / 10000.0)
    return d.withColumn("net_return", F.col("portfolio_return") - F.col("cost")).drop("__s")


def eligible(df: DataFrame, high: str, regime_off: Column, safe: Column, k: int) -> DataFrame:
    """Regime-aware universe of a date: confident names, else safe names, else all; outside
    risk-off the safe names drop out when at least three others remain."""
    w = Window.partitionBy("date")
    n_high, n_safe = F.sum(F.col(high).cast("int")).over(w), F.sum(safe.cast("int")).over(w)
    use = F.when(n_high > 0, F.col(high).cast("int") == 1).when(n_safe > 0, safe).otherwise(F.lit(True))
    d = df.withColumn("__safe", safe).withColumn("__use", use).filter("__use")
    others = F.sum((~F.col("__safe")).cast("int")).over(w)
    return d.withColumn("__o", others).filter(regime_off | ~F.col("__safe") | (F.col("__o") < max(3, min(k, 3)))).drop("__safe", "__use", "__o")


BLOCKED = {"none": [], "cash": ["Cash"], "derisk_cash": ["De-risk", "Cash"]}


def risk_gate(prob, stage, threshold, mode: str) -> Column:
    """Invested when the risk probability is below the threshold and the stage is not blocked."""
    ok = F.coalesce(col(prob), F.lit(0.0)) < threshold
    blocked = BLOCKED[mode]
    return ok & ~F.coalesce(col(stage), F.lit("Normal")).isin(blocked) if blocked else ok


def gated(df: DataFrame, invested: Column, ret: str = "portfolio_return") -> DataFrame:
    return df.withColumns({"invested": invested.cast("int"), "strategy_return": F.when(invested, F.col(ret)).otherwise(0.0)})


def threshold_grid(df: DataFrame, score: str, thresholds: list[float], ret: str, per_year: float, benchmark: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Performance of investing only when the score reaches each threshold (date-level rows)."""
    from tideframe.operators.sweep import over_grid
    g = over_grid(df, {"threshold": [float(x) for x in thresholds]})
    g = gated(g, F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)), ret)
    return performance(g, [*by, "threshold"], "strategy_return", per_year, benchmark, "invested")


def entry_objective() -> Column:
    return F.coalesce("Sharpe", F.lit(-99.0)) + 1.2 * F.coalesce("hit_excess", F.lit(0.0)) - 0.35 * F.abs("MDD")


def normalize_trades(sources: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Trade tables of different shape as one schema; a missing exit date is 7 days (1W) or 31 days later."""
    out = None
    for df, m in sources:
        hold = F.when(F.lit(m["horizon"]) == "1W", 7).otherwise(31)
        x = df.select(F.col("date"), (F.col(m["exit_date"]) if m.get("exit_date") else F.date_add("date", hold)).alias("exit_date"), F.lit(m["strategy"]).alias("strategy"), F.lit(m["phase"]).alias("phase"),
                      F.lit(m["horizon"]).alias("horizon"), F.lit(m["top_k"]).alias("top_k"), F.col(m["ret"]).alias("portfolio_return"), F.col(m["benchmark"]).alias("benchmark_return"),
                      (F.col(m["ret"]) - F.col(m["benchmark"])).alias("excess_return"), F.col("selected"))
        out = x if out is None else out.unionByName(x)
    return out


def pick_evaluation(df: DataFrame, score: str, ret: str, is_safe: Column, is_risk: Column, k: int) -> DataFrame:
    """Per date: picked, safe, risk and ideal means, overlap with the ideal picks, beat flags."""
    d = df.withColumns({"__safe": is_safe, "__risk": is_risk})
    w = Window.partitionBy("date", "__safe")
    d = d.withColumns({"__p": F.row_number().over(w.orderBy(F.desc_nulls_last(score), "symbol")), "__a": F.row_number().over(w.orderBy(F.desc_nulls_last(ret), "symbol"))})
    s = F.col("__safe")
    p, a = s & (F.col("__p") <= k), s & (F.col("__a") <= k)
    m = lambda c: F.avg(F.when(c, F.col(ret)))
    g = d.groupBy("date").agg(m(p).alias("picked"), m(s).alias("safe_mean"), m(F.col("__risk")).alias("risk_mean"), m(a).alias("ideal"), (F.count_if(p & a) / k).alias("overlap"),
                              F.max((p & a & (F.col("__p") == 1) & (F.col("__a") == 1)).cast("int")).alias("top1_exact"), F.max((p & (F.col("__a") == 1)).cast("int")).alias("best_in_picks"),
                              F.count_if(s).alias("__s"), F.count_if(F.col("__risk")).alias("__r"))
    g = g.filter((F.col("__s") > 0) & (F.col("__r") > 0)).drop("__s", "__r")
    return g.withColumns({"beat_risk": (F.col("picked") > F.col("risk_mean")).cast("int"), "beat_safe": (F.col("picked") > F.col("safe_mean")).cast("int")})


def allocation_returns(alloc: DataFrame, ret: str, segments=("risk", "safe", "cash")) -> DataFrame:
    """Per date: weighted return, number of positions and weight per segment."""
    w = F.col("weight")
    return alloc.groupBy("date").agg(F.sum(w * F.coalesce(F.col(ret), F.lit(0.0))).alias("portfolio_return"), F.count(F.lit(1)).alias("n_positions"),
                                     *[F.sum(F.when(F.col("segment") == s, w).otherwise(0.0)).alias(f"{s}_weight") for s in segments])
