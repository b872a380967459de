"""Date-level risk vector: stress components, axes, archetype and phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, ladder, ratio, total
from tideframe.operators import analogs as A
from tideframe.operators.asof import asof_join
from tideframe.session import staged


def phase(score) -> Column:
    s = col(score)
    return ladder([(s >= 70, "Crisis"), (s >= 55, "Risk-Off"), (s >= 40, "Warning"), (s >= 25, "Fragile")], "Normal")


def dominant(cols: list[str], none: str = "none") -> Column:
    """Name of the largest column, the first on ties; ``none`` when all are null."""
    top = F.greatest(*cols)
    out = F.when(top.isNull(), none)
    for c in cols:
        out = out.when(F.col(c) == top, c)
    return out


# Component and axis weights of the risk vector.
COMPONENTS = {
    "liquidity_credit_stress": {"HY_OAS_shock_score": 0.26, "IG_OAS_shock_score": 0.16, "HYG_IEF_shock_score": 0.20, "MOVE_shock_score": 0.18, "credit_score": 0.20},
    "equity_breakdown_stress": {"SP500_shock_score": 0.22, "NASDAQ100_shock_score": 0.25, "SOX_shock_score": 0.24, "RUSSELL2000_shock_score": 0.14, "equity_score": 0.15},
    "volatility_stress": {"VIX_shock_score": 0.34, "VXN_shock_score": 0.30, "MOVE_shock_score": 0.20, "volatility_score": 0.16},
    "fx_external_stress": {"DXY_shock_score": 0.25, "USDKRW_shock_score": 0.30, "USDJPY_shock_score": 0.14, "USDCNH_shock_score": 0.20, "fx_score": 0.15, "COPPER_GOLD_shock_score": 0.10},
    "cyclical_china_stress": {"COPPER_shock_score": 0.22, "COPPER_GOLD_shock_score": 0.20, "CSI300_shock_score": 0.20, "HANGSENG_TECH_shock_score": 0.18, "cyclical_score": 0.20},
    "inflation_supply_stress": {"WTI_shock_score": 0.65, "supply_shock_score": 0.35},
    "hedge_demand": {"GOLD_shock_score": 0.55, "hedge_bid_score": 0.45},
    "rai_appetite_stress": {"RAI_shock_score": 0.38, "RAI_fear_score": 0.22, "RAI_collapse_score": 0.25, "RAI_overheat_score": 0.15},
    "universe_breadth_stress": {"ETF_breadth_shock_score": 0.48, "ETF_below_60ma_pct": 0.20, "ETF_below_20ma_pct": 0.14, "ETF_20d_loss_pct": 0.14, "ETF_20d_large_loss_pct": 0.04}}
SAFE_ROTATION = {"SAFE_ROTATION_shock_score": 0.70, "hedge_demand": 0.30}
MODEL_SCORES = {"peak_fragility": "peak_fragility_score_0_100", "analog_history_risk": "analog_risk_score_0_100", "correction_pressure": "correction_pressure_score_0_100"}
AXES = {
    "liquidity_axis_x": {"liquidity_credit_stress": 0.42, "fx_external_stress": 0.28, "volatility_stress": 0.20, "inflation_supply_stress": 0.10, "rai_appetite_stress": 0.10},
    "market_breakdown_axis_y": {"equity_breakdown_stress": 0.36, "volatility_stress": 0.20, "cyclical_china_stress": 0.15, "universe_breadth_stress": 0.14, "rai_appetite_stress": 0.08,
                                "peak_fragility": 0.10, "analog_history_risk": 0.07, "correction_pressure": 0.08},
    "external_supply_axis_z": {"fx_external_stress": 0.36, "cyclical_china_stress": 0.26, "inflation_supply_stress": 0.22, "hedge_demand": 0.10, "safe_rotation_stress": 0.10}}
COMPOSITE = {"liquidity_axis_x": 0.25, "market_breakdown_axis_y": 0.25, "external_supply_axis_z": 0.16, "risk_off_score": 0.20, "peak_fragility": 0.10, "analog_history_risk": 0.08,
             "correction_pressure": 0.06, "rai_appetite_stress": 0.07, "universe_breadth_stress": 0.08}
VECTOR = [*COMPONENTS, "safe_rotation_stress", *MODEL_SCORES]


def plain_sum(df: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted sum of the existing columns, null as 0, on 0..100 (weights are not rescaled)."""
    return clip(total([F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items() if c in df.columns] or [F.lit(0.0)]), 0, 100)


def archetype() -> Column:
    """Name of the state of the vector; thresholds are fixed values."""
    x, y, z = (F.col(c) for c in AXES)
    v = {k: F.col(k) for k in VECTOR}
    peak, credit, fx, vol = v["peak_fragility"], v["liquidity_credit_stress"], v["fx_external_stress"], v["volatility_stress"]
    eq, supply, cyc, corr = v["equity_breakdown_stress"], v["inflation_supply_stress"], v["cyclical_china_stress"], v["correction_pressure"]
    rai, breadth = v["rai_appetite_stress"], v["universe_breadth_stress"]
    return ladder([
        ((x >= 55) & (y >= 55), "Full Risk-Off"), ((rai >= 58) & (breadth >= 45), "RAI/Breadth Risk-Off"), ((breadth >= 65) & (y >= 35), "Universe Breadth Breakdown"),
        ((rai >= 60) & (y < 45), "Risk Appetite Collapse"), ((corr >= 60) & (peak >= 45) & (x < 45), "Correction Pressure"), ((peak >= 60) & (y < 45) & (x < 45), "Fragile Peak"),
        ((credit >= 55) & (vol >= 45), "Credit/Liquidity Shock"), ((fx >= 55) & (z >= 45), "FX/External Stress"), ((supply >= 55) & (eq < 45), "Inflation/Supply Shock"),
        ((eq >= 50) & (x < 45), "Technical Equity Breakdown"), ((cyc >= 50) & (fx >= 35), "Cyclical/China Stress"), (peak >= 48, "Peak Warning"),
        (F.greatest(x, y, z) < 30, "Calm Risk-On")], "Mixed/Transition")


def risk_vector(df: DataFrame) -> DataFrame:
    """Thirteen stress components, three axes, composite, dominant component, archetype and phase."""
    from tideframe.operators.aggregates import row_weighted_mean
    # Rounded so that equal components compare equal when the dominant one is picked.
    d = df.withColumns({k: F.round(row_weighted_mean(df, w), 8) for k, w in COMPONENTS.items()})
    d = d.withColumn("safe_rotation_stress", F.round(row_weighted_mean(d, SAFE_ROTATION), 8))
    d = d.withColumns({k: clip(F.coalesce(F.col(c), F.lit(0.0)), 0, 100) if c in df.columns else F.lit(0.0) for k, c in MODEL_SCORES.items()})
    d = d.withColumns({k: F.round(plain_sum(d, w), 8) for k, w in AXES.items()})
    d = d.withColumn("composite_vector_risk", F.round(plain_sum(d, COMPOSITE), 8))
    return d.withColumns({"dominant_risk_vector": dominant(VECTOR), "risk_archetype": archetype(), "risk_phase": phase("composite_vector_risk")})


# Weights of the analog and the correction score, and the outcomes that count as a correction.
ANALOG = {"down_prob_1w": 0.28, "down_prob_1m": 0.32, "tail_prob_1m": 0.25}
ANALOG_PEAK = 0.15
ANALOG_STATE = ["liquidity_axis_x", "market_breakdown_axis_y", "external_supply_axis_z", "peak_fragility", "composite_vector_risk"]
OUTCOME_ROWS = 21


def outcomes(closes: DataFrame) -> DataFrame:
    """date, returns and worst returns over the next 5 and 20 rows, and the outcomes of both models as 0/1."""
    w = R.day()
    d = closes.select("date", R.forward_return("close", 5, w).alias("ret_1w"), R.forward_return("close", 20, w).alias("ret_1m"), R.forward_min_any("close", 20, w).alias("min_1m"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    week, month, low = F.col("ret_1w"), F.col("ret_1m"), F.col("min_1m")
    flags = {"down_1w": is_(week < 0), "down_1m": is_(month < 0), "tail": is_(month < -0.05) | is_(low < -0.07), "drop": is_(week <= -0.02),
             "month": is_(month <= -0.035) | is_(low <= -0.055), "delayed": is_(week > -0.01) & (is_(month <= -0.03) | is_(low <= -0.055))}
    return d.withColumns({k: c.cast("int") for k, c in flags.items()})


def analog_scores(first: DataFrame, after: DataFrame, k: int = 50, min_history: int = 504, step: int = 5) -> DataFrame:
    """date, analog_risk_score_0_100: outcome shares of the nearest earlier days by the state of the first pass,
    from the last searched day on or before each date."""
    near = A.point_in_time_analogs(first, ANALOG_STATE, k, min_history, OUTCOME_ROWS, step, 4)
    days = first.select("date", (F.row_number().over(R.day()) - 1).cast("bigint").alias("idx"))
    known = days.join(after, "date").select(F.col("idx").alias("hist_idx"), "ret_1w", "ret_1m", "min_1m", "down_1w", "down_1m", "tail")
    stats = A.neighbour_stats(near, known, [k]).join(days, "idx").select("date", *ANALOG)
    d = asof_join(first.select("date", "peak_fragility"), stats)
    seen = F.col("down_prob_1w").isNotNull()
    score = 100 * (total([F.col(c) * w for c, w in ANALOG.items()]) + ANALOG_PEAK * F.coalesce("peak_fragility", F.lit(0.0)) / 100)
    return d.select("date", F.round(F.when(seen, clip(score, 0, 100)).otherwise(0.0), 8).alias("analog_risk_score_0_100"))


def correction_scores(first: DataFrame, after: DataFrame) -> DataFrame:
    """date, correction_pressure_score_0_100: shares of corrections after earlier days of the same phase of the first pass, of
    those days whose outcome is known by then."""
    d = first.select("date", "risk_phase", "peak_fragility", (F.row_number().over(R.day()) - 1).alias("__i")).join(after.select("date", "drop", "month", "delayed"), "date", "left")
    w = Window.partitionBy("risk_phase").orderBy("__i").rangeBetween(Window.unboundedPreceding, -OUTCOME_ROWS)
    p = [F.avg(c).over(w) for c in ("drop", "month", "delayed")]
    return d.select("date", F.round(correction_policy(*p, F.col("peak_fragility"))["correction_pressure_score"], 8).alias("correction_pressure_score_0_100"))


def two_pass_vector(df: DataFrame, closes: DataFrame) -> DataFrame:
    """The risk vector of a first pass gives the state in which earlier days are looked up; their outcomes give the
    analog and the correction score, with which the vector is made again."""
    first, after = staged(risk_vector(df)), staged(outcomes(closes))
    second = df.drop("analog_risk_score_0_100", "correction_pressure_score_0_100")
    return risk_vector(second.join(analog_scores(first, after), "date", "left").join(correction_scores(first, after), "date", "left"))


# Null-aware axes of the three-axis form.
AXIS_3D = {
    "axis1_vol_credit_stress": {"volatility_score": 1.25, "credit_score": 1.25, "VIX_shock_score": 1.10, "VXN_shock_score": 0.75, "MOVE_shock_score": 0.85, "HY_OAS_shock_score": 1.20, "IG_OAS_shock_score": 0.70, "HYG_IEF_shock_score": 0.85},
    "axis2_fx_liquidity_stress": {"fx_score": 1.05, "liquidity_score": 1.10, "DXY_shock_score": 0.80, "USDKRW_shock_score": 1.25, "USDCNH_shock_score": 0.95, "USDJPY_shock_score": 0.65, "NFCI_shock_score": 0.90, "ANFCI_shock_score": 0.90},
    "axis3_peak_fragility_stress": {"peak_fragility_score_0_100": 1.25, "correction_pressure_score_0_100": 1.20, "analog_risk_score_0_100": 1.05, "RAI_overheat_score": 0.80, "RAI_collapse_score": 0.75, "ETF_breadth_shock_score": 1.05, "breadth_score": 0.85, "safe_rotation_score": 0.65}}


def null_aware_mean(df: DataFrame, weights: dict[str, float]) -> Column:
    have = {c: w for c, w in weights.items() if c in df.columns}
    if not have:
        return F.lit(None).cast("double")
    return ratio(total([F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in have.items()]), total([F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in have.items()]))


def axes_3d(df: DataFrame) -> DataFrame:
    """Three axes, their maximum, mean, breadth, norm and the dominant axis."""
    d = df.withColumns({k: clip(null_aware_mean(df, w), 0, 100) for k, w in AXIS_3D.items()})
    a = [F.col(k) for k in AXIS_3D]
    z = [F.coalesce(c, F.lit(0.0)) for c in a]
    known = total([c.isNotNull().cast("int") for c in a])
    return d.withColumns({
        "risk_3d_max_axis": F.greatest(*a), "risk_3d_mean_axis": ratio(total(z), known), "risk_3d_breadth": total([F.coalesce((c >= 35).cast("int"), F.lit(0)) for c in a]),
        "risk_3d_vector_score": clip(F.sqrt(total([c * c for c in z])) / F.sqrt(F.lit(3.0)), 0, 100),
        "risk_3d_dominant_axis": F.when(a[0] >= F.greatest(a[1], a[2]), "axis1").when(a[1] >= F.greatest(a[0], a[2]), "axis2").otherwise("axis3")})


def complacency(momentum, near_high, above_ma, vol, stress) -> Column:
    """Fragility of a calm, extended market: momentum, nearness to highs, low volatility, low stress."""
    c = lambda x: clip(x, 0, 100)
    return c(0.30 * c(clip(momentum, 0) * 350.0) + 0.25 * c(100 + 250.0 * col(near_high)) + 0.20 * c(50 + 180.0 * col(above_ma)) + 0.15 * c(35 - 100.0 * col(vol)) + 0.10 * c(35 - col(stress)))


# Composite model scores.
SCORES = {
    "crash_sentinel_score": {"risk_off_score": 0.22, "liquidity_axis_x": 0.20, "volatility_stress": 0.18, "liquidity_credit_stress": 0.16, "fx_external_stress": 0.14, "RAI_shock_score": 0.10},
    "peak_correction_score": {"peak_fragility": 0.26, "correction_pressure": 0.26, "analog_history_risk": 0.18, "RAI_overheat_score": 0.12, "universe_breadth_stress": 0.10, "market_breakdown_axis_y": 0.08},
    "risk_off_avoidance_score": {"crash_sentinel_score": 0.22, "peak_correction_score": 0.28, "composite_vector_risk": 0.18, "correction_pressure": 0.17, "analog_history_risk": 0.10, "safe_rotation_stress": 0.05}}


def composite_scores(df: DataFrame) -> DataFrame:
    """Crash, peak, avoidance and permission scores with the model regime."""
    from tideframe.operators.aggregates import row_weighted_mean
    d = df
    for k, w in SCORES.items():
        d = d.withColumn(k, F.round(row_weighted_mean(d, w), 8))
    r, c, p = F.col("risk_off_avoidance_score"), F.col("crash_sentinel_score"), F.col("peak_correction_score")
    return d.withColumns({"risk_on_permission_score": clip(100 - r, 0, 100),
                          "model_regime": ladder([((c >= 55) | (r >= 62), "Risk-Off"), ((r >= 45) | (p >= 55), "Fragile"), ((r <= 30) & (p <= 38), "Risk-On")], "Transition")})


# Weights of the peak-fragility rule over percentile terms.
PEAK_RULE = {"near_high": 0.18, "extended": 0.14, "decel": 0.16, "calm": 0.12, "gap_a": 0.12, "gap_b": 0.10, "credit": 0.08, "dollar": 0.05, "rate": 0.05}


def peak_rule(terms: dict[str, Column]) -> Column:
    """100 x weighted percentile terms; the score is 0 while any term is unknown."""
    return F.coalesce(clip(100.0 * total([terms[k] * w for k, w in PEAK_RULE.items()]), 0, 100), F.lit(0.0))


def correction_policy(drop: Column, month: Column, delayed: Column, peak: Column) -> dict[str, Column]:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    s = clip(100.0 * (0.28 * z(drop) + 0.42 * z(month) + 0.22 * z(delayed) + 0.08 * z(peak) / 100.0), 0, 100)
    return {"correction_pressure_score": s, "correction_pressure_state": ladder([(s < 35, "Normal"), (s < 50, "Watch"), (s < 65, "High")], "Extreme")}


# Component names that count as systemic, volatility or credit, equity.
SYSTEMIC, VOL_CREDIT, EQUITY = "VIX|VXN|MOVE|HY|IG|HYG|DXY|USDKRW|USDCNH", "VIX|VXN|MOVE|HY|IG|HYG", "SP500|NASDAQ|SOX|RUSSELL"


def policy_state(df: DataFrame) -> DataFrame:
    """Weighted model probabilities with floors from signals and from the sentinel state.

    Columns: prob_down_1w, prob_down_1w_2pct, prob_down_1w_3pct, prob_down_1m_5pct, risk_off_score,
    signal_down_1w_3pct, signal_down_1w_5pct, sentinel_state, dominant_component, risk_off_momentum_5d.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    base = clip(100 * (0.25 * z("prob_down_1w") + 0.20 * z("prob_down_1w_2pct") + 0.25 * z("prob_down_1w_3pct") + 0.15 * z("prob_down_1m_5pct") + 0.15 * z("risk_off_score") / 100), 0, 100)
    s, dom, r, m = F.col("sentinel_state"), F.col("dominant_component"), z("risk_off_score"), z("risk_off_momentum_5d")
    watch, derisk = s.isin("Watch", "De-risk", "Cash"), s.isin("De-risk", "Cash")
    hard_watch = watch & (dom.rlike(SYSTEMIC) | (r >= 28) | (m >= 8))
    hard_derisk = derisk | (watch & dom.rlike(VOL_CREDIT) & (r >= 40))
    hard_cash = (s == "Cash") | (derisk & dom.rlike(VOL_CREDIT) & (r >= 70))
    floor = lambda cond, v: F.when(cond, float(v)).otherwise(0.0)
    score = F.greatest(base, floor(z("signal_down_1w_3pct") == 1, 50), floor(z("signal_down_1w_5pct") == 1, 65), floor(hard_watch, 35), floor(hard_derisk, 50), floor(hard_cash, 65))
    d = df.withColumns({"ml_risk_off_score": score, "hard_overlay_watch": hard_watch.cast("int"), "hard_overlay_derisk": hard_derisk.cast("int"), "hard_overlay_cash": hard_cash.cast("int"),
                        "hard_overlay_equity_shock": (watch & dom.rlike(EQUITY) & (r >= 45)).cast("int")})
    p = F.col("ml_risk_off_score")
    return d.withColumn("ml_policy_state", ladder([(p < 35, "Normal"), (p < 50, "Watch"), (p < 65, "De-risk")], "Cash"))
