"""Leadership panel of funds from their constituents, and its rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, ladder, ratio, tanh_score, weighted_sum
from tideframe.operators import aggregates as G, asof as A, panel as P, xsec as S
from tideframe.session import checkpointed

MIN_HISTORY, AHEAD = 260, 20
COMPONENT_COLUMNS = [
    "weighted_HP", "median_HP", "HP90_share", "weighted_component_RS_20D", "weighted_component_RS_60D", "median_component_RS_20D", "RS_positive_share",
    "MA60_breadth", "MA200_breadth", "median_component_return_20D", "median_component_return_60D", "mean_minus_median_return_20D",
    "top20_component_return_mean", "bottom20_component_return_mean", "holding_count", "effective_N", "top5_weight_share", "top10_weight_share",
    "top5_return_contribution_share"]


def price_windows(prices: DataFrame, entity: str = "symbol", fill_limit: int = 5) -> DataFrame:
    """Returns, averages and highs of every symbol on the merged calendar, short gaps filled."""
    w = R.by_entity(entity)
    p = P.on_calendar(prices, "close", entity, fill_limit)
    return p.withColumns({f"ret{n}": R.step_return("close", n, w) for n in (5, 20, 60, 120)} | {
        "ma60": R.mean("close", 60, w, 45), "ma200": R.mean("close", 200, w, 150), "high252": R.high("close", 252, w, 180),
        "fwd5": R.forward_return("close", 5, w), "fwd20": R.forward_return("close", 20, w)})


def fund_rows(funds: DataFrame, benchmark: DataFrame, frequency: str = "W", targets: bool = True) -> DataFrame:
    """Price features and forward targets per rebalance date and fund.

    ``funds``: date, symbol, grp, close; ``benchmark``: date, close (one series).
    """
    dims = funds.select("symbol", "grp").distinct()
    f = price_windows(funds.select("date", "symbol", "close"))
    b = price_windows(benchmark.select("date", "close").withColumn("symbol", F.lit("benchmark"))).select(
        "date", F.col("close").alias("b_close"), *[F.col(c).alias(f"b_{c}") for c in ("ret5", "ret20", "ret60", "ret120", "fwd5", "fwd20")])
    w = R.by_entity()
    j = f.join(b, "date").withColumns({"pos": F.row_number().over(w) - 1, "days": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "lr": R.log_ratio("close", "b_close")})
    j = j.withColumn("RS_slope_20D", R.slope("lr", "pos", 20, w))
    ok = (F.col("pos") >= MIN_HISTORY) & F.col("raw_close").isNotNull() & F.col("b_close").isNotNull()
    if targets:
        ok = ok & (F.col("pos") + AHEAD < F.col("days"))
    j = P.at_rebalance(j, frequency).filter(ok).join(dims, "symbol")
    return j.select("date", F.col("symbol").alias("etf"), "grp", *[F.col(f"ret{n}").alias(f"ETF_return_{n}D") for n in (5, 20, 60, 120)],
                    *[(F.col(f"ret{n}") - F.col(f"b_ret{n}")).alias(f"ETF_RS_{n}D") for n in (20, 60, 120)], "RS_slope_20D", "b_ret20", "b_ret60",
                    *[F.col(f"fwd{n}").alias(f"forward_{n}D_return") for n in (5, 20)], *[F.col(f"b_fwd{n}").alias(f"benchmark_forward_{n}D_return") for n in (5, 20)],
                    *[(F.col(f"fwd{n}") - F.col(f"b_fwd{n}")).alias(f"forward_{n}D_excess") for n in (5, 20)])


def component_features(dates: DataFrame, holdings: DataFrame, components: DataFrame) -> DataFrame:
    """Constituent features per (date, etf) from the snapshot valid on the date.

    ``dates``: date, etf, b_ret20, b_ret60; ``components``: ``price_windows`` keyed by component.
    One interval join, one price join, two ranks inside (date, etf), one aggregate.
    """
    known = components.select("component").distinct()
    h = holdings.join(known, "component", "left_semi").groupBy("date", "etf", "component").agg(F.sum("weight").alias("w"))
    h = h.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("date", "etf")))
    d = A.snapshot_join(dates, h, "etf").join(components, ["date", "component"], "left")
    d = d.withColumns({"hp": ratio("close", "high252"), "rs20": F.col("ret20") - F.col("b_ret20"), "rs60": F.col("ret60") - F.col("b_ret60"),
                       "gain": F.when(F.col("ret20").isNotNull(), F.greatest(F.col("w") * F.col("ret20"), F.lit(0.0)))})
    g = Window.partitionBy("date", "etf")
    rank = lambda c, up: F.row_number().over(g.orderBy(F.asc_nulls_last(c) if up else F.desc_nulls_last(c), "component"))
    d = d.withColumns({"__n": F.count(F.lit(1)).over(g), "__hi": rank("ret20", False), "__lo": rank("ret20", True), "__w": rank("w", False), "__g": rank("gain", False)})
    tail = G.tail_size(F.col("__n"))
    top = lambda c, r, k: F.sum(F.when(F.col(r) <= k, F.col(c)))
    above = lambda m: G.weighted_share(F.col("close") > F.col(m), F.col("close").isNotNull() & F.col(m).isNotNull(), "w")
    return d.groupBy("date", "etf").agg(
        G.weighted_mean("hp", "w").alias("weighted_HP"), F.median("hp").alias("median_HP"), G.weighted_share(F.col("hp") >= 0.9, F.col("hp").isNotNull(), "w").alias("HP90_share"),
        G.weighted_mean("rs20", "w").alias("weighted_component_RS_20D"), G.weighted_mean("rs60", "w").alias("weighted_component_RS_60D"), F.median("rs20").alias("median_component_RS_20D"),
        G.weighted_share(F.col("rs20") > 0, F.col("rs20").isNotNull(), "w").alias("RS_positive_share"), above("ma60").alias("MA60_breadth"), above("ma200").alias("MA200_breadth"),
        F.median("ret20").alias("median_component_return_20D"), F.median("ret60").alias("median_component_return_60D"), (F.avg("ret20") - F.median("ret20")).alias("mean_minus_median_return_20D"),
        G.tail_mean("ret20", tail, "__hi").alias("top20_component_return_mean"), G.tail_mean("ret20", tail, "__lo").alias("bottom20_component_return_mean"),
        F.count(F.lit(1)).alias("holding_count"), G.effective_number("w").alias("effective_N"), top("w", "__w", 5).alias("top5_weight_share"), top("w", "__w", 10).alias("top10_weight_share"),
        F.coalesce(ratio(top("gain", "__g", 5), F.sum("gain")), F.lit(0.0)).alias("top5_return_contribution_share"))


def leadership_panel(funds: DataFrame, benchmark: DataFrame, holdings: DataFrame, component_prices: DataFrame, frequency: str = "W", targets: bool = True) -> DataFrame:
    """Price, constituent and concentration features with forward targets per (date, etf).

    Each input is read several times (calendar, spine, values), so the aggregated panels are
    staged once; the facts below them are scanned once each.
    """
    funds, benchmark, holdings, component_prices = (checkpointed(x) for x in (funds, benchmark, holdings, component_prices))
    rows = checkpointed(fund_rows(funds, benchmark, frequency, targets))
    comp = price_windows(component_prices).withColumnRenamed("symbol", "component")
    f = component_features(rows.select("date", "etf", "b_ret20", "b_ret60"), holdings, comp)
    out = rows.join(f, ["date", "etf"], "left").withColumn("holding_count", F.coalesce("holding_count", F.lit(0)))
    return holding_logic(out)


def holding_logic(df: DataFrame) -> DataFrame:
    """Concentration class and changes over 20 feature ROWS of the fund."""
    w = R.by_entity("etf")
    n, e = F.coalesce("holding_count", F.lit(0)), F.col("effective_N")
    return df.withColumns({"HP_change_20D": R.difference("weighted_HP", 20, w), "Breadth_change_20D": R.difference("MA60_breadth", 20, w),
                           "holding_logic": ladder([(n <= 5, "concentrated"), (e < 8, "concentrated"), (e >= 20, "diversified")], "mid")})


RULE_INPUTS = ["ETF_RS_20D", "ETF_RS_60D", "ETF_RS_120D", "weighted_HP", "HP_change_20D", "HP90_share", "weighted_component_RS_20D", "weighted_component_RS_60D",
               "median_component_RS_20D", "MA60_breadth", "MA200_breadth", "RS_positive_share", "Breadth_change_20D", "top5_weight_share", "top5_return_contribution_share"]
# Weights of the first rule model (sub-scores over z columns, then per holding class).
SUB_SCORES = {
    "ETF_RS_Score": {"z_ETF_RS_20D": 0.4, "z_ETF_RS_60D": 0.4, "z_ETF_RS_120D": 0.2},
    "HP_Score": {"z_weighted_HP": 0.5, "z_HP_change_20D": 0.3, "z_HP90_share": 0.2},
    "Component_Momentum_Score": {"z_weighted_component_RS_20D": 0.4, "z_weighted_component_RS_60D": 0.4, "z_median_component_RS_20D": 0.2},
    "Breadth_Score": {"z_MA60_breadth": 0.35, "z_MA200_breadth": 0.25, "z_RS_positive_share": 0.25, "z_Breadth_change_20D": 0.15},
    "Concentration_Penalty": {"z_top5_weight_share": 1.0, "z_top5_return_contribution_share": 1.0}}
CLASS_SCORES = {
    "concentrated": {"ETF_RS_Score": 0.45, "Component_Momentum_Score": 0.30, "HP_Score": 0.20, "z_RS_positive_share": 0.05},
    "diversified": {"ETF_RS_Score": 0.30, "Component_Momentum_Score": 0.25, "HP_Score": 0.20, "Breadth_Score": 0.20, "Concentration_Penalty": -0.05},
    "mid": {"ETF_RS_Score": 0.35, "Component_Momentum_Score": 0.25, "HP_Score": 0.20, "Adjusted_Breadth_Score": 0.15, "Concentration_Penalty": -0.05}}


def rule_scores(df: DataFrame) -> DataFrame:
    """First rule model: sub-scores, reliability-blended breadth, score by holding class, rank."""
    d = S.winsorized_z(df, RULE_INPUTS)
    d = d.withColumns({k: weighted_sum(v) for k, v in SUB_SCORES.items()})
    rel = F.coalesce(clip(ratio("effective_N", F.col("effective_N") + 20.0), 0, 1), F.lit(0.0))
    d = d.withColumn("Adjusted_Breadth_Score", rel * F.col("Breadth_Score") + (1 - rel) * F.col("ETF_RS_Score"))
    kind = F.col("holding_logic")
    final = F.when(kind == "concentrated", weighted_sum(CLASS_SCORES["concentrated"])).when(kind == "diversified", weighted_sum(CLASS_SCORES["diversified"])).otherwise(weighted_sum(CLASS_SCORES["mid"]))
    d = d.withColumn("Final_Rule_Score", F.round(final, 10))
    return d.withColumns({"Final_Rule_Score_0_100": tanh_score("Final_Rule_Score"), "rule_rank": S.first_come_rank("Final_Rule_Score", ("date",), "etf")})


# Weights of the 5-day and 20-day rules, second and third model.
RULE_5D_V2 = {"ETF_RS_20D": 0.24, "RS_slope_20D": 0.14, "weighted_component_RS_20D": 0.22, "median_component_RS_20D": 0.12, "RS_positive_share": 0.12,
              "Breadth_change_20D": 0.08, "median_component_return_20D": 0.08, "top5_return_contribution_share": -0.06}
RULE_5D_V3 = {"ETF_RS_20D": 0.28, "RS_slope_20D": 0.16, "weighted_component_RS_20D": 0.22, "median_component_RS_20D": 0.12, "RS_positive_share": 0.12,
              "Breadth_change_20D": 0.06, "median_component_return_20D": 0.06, "top5_return_contribution_share": -0.04}
RULE_20D_V2 = {"ETF_RS_20D": 0.14, "ETF_RS_60D": 0.18, "ETF_RS_120D": 0.12, "RS_slope_20D": 0.08, "weighted_component_RS_60D": 0.12, "weighted_component_RS_20D": 0.08,
               "RS_positive_share": 0.08, "MA60_breadth": 0.08, "MA200_breadth": 0.06, "HP90_share": 0.06, "HP_change_20D": 0.04, "top5_return_contribution_share": -0.04}
RULE_20D_V3 = {**RULE_20D_V2, "weighted_component_RS_60D": 0.10}


def horizon_rules(df: DataFrame, five: dict, twenty: dict, group: str | None = None) -> DataFrame:
    """5-day and 20-day rule scores over winsorised z (no group) or grouped z (with group)."""
    cols = sorted(set(five) | set(twenty))
    if group is None:
        d = S.winsorized_z(df, cols, None)
    else:
        d = df.withColumns({f"z_{c}": S.grouped_z(c, group) for c in cols})
    named = lambda ws: weighted_sum({f"z_{c}": w for c, w in ws.items()})
    return d.withColumns({"rule_5d_score": F.round(named(five), 10), "rule_20d_score": F.round(named(twenty), 10)}).drop(*[f"z_{c}" for c in cols])


# Long-history leadership rule.
LONG_HISTORY = {"excess_20": 0.24, "excess_60": 0.24, "excess_120": 0.14, "rs_slope_20": 0.12, "high_proximity_252": 0.10, "above_ma60": 0.06, "above_ma200": 0.06, "vol_20": -0.04}
LONG_SAFE = {"ret_20": 0.20, "ret_60": 0.20, "ret_120": 0.12, "high_proximity_252": 0.12, "above_ma60": 0.08, "above_ma200": 0.08, "vol_20": -0.10, "drawdown_60": -0.10}


def asset_features(prices: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Returns, volatility, drawdowns, trend flags and benchmark-relative columns per (date, symbol)."""
    w = R.by_entity()
    p = prices.withColumn("r1", R.step_return("close", 1, w))
    cols = {f"ret_{n}": R.step_return("close", n, w) for n in (5, 20, 60, 120, 252)} | {
        "vol_20": R.annual_vol("r1", 20, w), "vol_60": R.annual_vol("r1", 60, w), "drawdown_60": R.drawdown("close", 60, w), "drawdown_252": R.drawdown("close", 252, w),
        "high_proximity_252": ratio("close", R.high("close", 252, w, 60)),
        "above_ma60": F.coalesce(F.col("close") > R.mean("close", 60, w, 30), F.lit(False)).cast("double"),
        "above_ma200": F.coalesce(F.col("close") > R.mean("close", 200, w, 100), F.lit(False)).cast("double")}
    if benchmark is not None:
        p = p.join(benchmark.select("date", F.col("close").alias("bench")), "date").withColumns({"lr": R.log_ratio("close", "bench"), "pos": F.row_number().over(w)})
        cols |= {f"excess_{n}": R.step_return("close", n, w) - R.step_return("bench", n, w) for n in (20, 60, 120)} | {
            "rs_slope_20": R.slope("lr", "pos", 20, w), "rs_slope_60": R.slope("lr", "pos", 60, w)}
    return p.withColumns(cols)


def rule_over_z(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """Weighted sum of per-date winsorised z-scores."""
    d = S.winsorized_z(df, list(weights), None)
    return d.withColumn(out, F.round(weighted_sum({f"z_{c}": w for c, w in weights.items()}), 10)).drop(*[f"z_{c}" for c in weights])


def blends(df: DataFrame, rule: str, model: str, shares: list[float], keys=("date",)) -> DataFrame:
    """Mixes of the cross-sectional population z of rule and model scores."""
    w = Window.partitionBy(*keys)
    zr, zm = S.z(rule, w, population=True), S.z(model, w, population=True)
    return df.withColumns({f"blend_rule{round(s * 100)}": s * zr + (1 - s) * zm for s in shares})
