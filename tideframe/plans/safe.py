"""Safe-asset scores, proxy returns and risk budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, clip100, col, ladder, ratio, total
from tideframe.operators import xsec as S

# Base boost of each safe group and its boost per dominant stress component.
STRESS_BOOST = {
    "Cash/short bonds": (15.0, {"credit": 8.0, "volatility": 8.0, "equity": 8.0, "supply_shock": -4.0, "hedge_bid": -4.0}),
    "USD cash": (8.0, {"fx": 16.0, "credit": 16.0, "volatility": 16.0, "equity": 16.0, "supply_shock": 4.0}),
    "Gold": (4.0, {"supply_shock": 18.0, "hedge_bid": 18.0, "volatility": 18.0, "fx": 18.0, "credit": 5.0}),
    "Korea bonds": (5.0, {"volatility": 14.0, "equity": 14.0, "credit": 14.0, "supply_shock": -12.0, "fx": -12.0}),
    "US long bonds": (5.0, {"volatility": 14.0, "equity": 14.0, "credit": 14.0, "supply_shock": -12.0, "fx": -12.0}),
    "US IG bonds": (4.0, {"volatility": 10.0, "equity": 10.0, "credit": -12.0}),
    "Korea defensive": (2.0, {"equity": 8.0, "volatility": 8.0})}
STATE_BOOST = {"Cash": 8.0, "De-risk": 5.0, "Watch": 2.0}
# Economy weights per safe group.
ECONOMY_WEIGHTS = {
    "FX cash": {"fx_external_stress": 0.45, "volatility_stress": 0.25, "liquidity_credit_stress": 0.20, "RAI_shock_score": 0.10},
    "Cash/short bonds": {"risk_off_avoidance_score": 0.40, "volatility_stress": 0.20, "liquidity_credit_stress": 0.20, "ETF_breadth_shock_score": 0.20},
    "Gold": {"hedge_demand": 0.35, "RAI_overheat_score": 0.15, "volatility_stress": 0.20, "fx_external_stress": 0.15, "external_supply_axis_z": 0.15},
    "Korea bonds": {"peak_correction_score": 0.30, "risk_off_avoidance_score": 0.25, "volatility_stress": 0.20, "fx_external_stress": -0.10, "RAI_shock_score": 0.15},
    "US long bonds": {"peak_correction_score": 0.35, "risk_off_avoidance_score": 0.25, "hedge_demand": 0.20, "inflation_supply_stress": -0.20},
    "US IG bonds": {"peak_correction_score": 0.20, "volatility_stress": 0.15, "liquidity_credit_stress": -0.25, "risk_off_avoidance_score": 0.20}}


def stress_score(base, group, component, state, risk_score) -> Column:
    """Base score plus group, component, state and level boosts; other groups keep the base."""
    g, c, s = col(group), col(component), col(state)
    z = F.lit(0.0)
    boost = z
    for name, (fixed, parts) in STRESS_BOOST.items():
        part = z
        for comp, v in parts.items():
            part = F.when(c == comp, v).otherwise(part)
        boost = F.when(g == name, part + fixed).otherwise(boost)
    by_state = z
    for st, v in STATE_BOOST.items():
        by_state = F.when(s == st, v).otherwise(by_state)
    level = clip(F.coalesce(col(risk_score), z) - 25.0, 0, 50) * 0.12
    b = F.coalesce(col(base), F.lit(50.0))
    return F.when(g.isin(list(STRESS_BOOST)), clip100(b + boost + by_state + level)).otherwise(b)


def economy_score(df: DataFrame, group: str, out: str = "economy_score") -> DataFrame:
    """Per (date, symbol) z of the group's weighted risk columns (risk columns joined beforehand)."""
    raw = F.lit(0.0)
    for name, ws in ECONOMY_WEIGHTS.items():
        have = {c: w for c, w in ws.items() if c in df.columns}
        if have:
            v = total([clip(F.coalesce(F.col(c), F.lit(0.0)), 0, 100) / 100 * w for c, w in have.items()]) / max(sum(abs(w) for w in have.values()), 1e-9)
            raw = F.when(F.col(group) == name, v).otherwise(raw)
    return df.withColumn("__raw", raw).withColumn(out, S.z("__raw", S.by_date())).drop("__raw")


def selector_score(tech, economy) -> Column:
    return 0.58 * col(tech) + 0.42 * col(economy)


# Categories of the economy overlay.
INTERMEDIATE = ["Intermediate Treasury", "Aggregate Bond", "IG Credit", "MBS", "TIPS"]


def economy_overlay(df: DataFrame, category: str = "category") -> Column:
    """Category-conditional overlay from rate, volatility, currency, credit and gold moves."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    rate, vix, dvix, dxy, krw, hy, gold, ndx = (z(c) for c in ("rate_chg", "vix_level", "vix_chg", "dxy_ret", "usdkrw_ret", "hy_chg", "gold_ret", "equity_ret"))
    a1, a2, a3 = (z(c) / 100 for c in ("axis1", "axis2", "axis3"))
    stress = clip(clip(vix - 20, 0) / 20 + clip(dvix, 0) / 15 + clip(hy, 0) / 2, 0, 2.5)
    c = F.col(category)
    return (F.when(c == "Long Treasury", -2.4 * rate + 0.45 * stress + 0.25 * a1).when(c.isin(INTERMEDIATE), -1.2 * rate + 0.25 * stress + 0.12 * a1)
            .when(c.isin("Cash", "Short Treasury"), 1.5 * clip(rate, 0) + 0.20 * stress).when(c == "Dollar", 5.0 * dxy + 2.5 * krw + 0.15 * stress + 0.45 * a2)
            .when(c == "Gold", 2.2 * gold - 1.2 * dxy - 0.6 * clip(rate, 0) + 0.20 * stress + 0.35 * a3)
            .when(c.isin("Yen", "Swiss Franc"), -2.0 * dxy + 0.25 * stress + clip(-ndx, 0) + 0.25 * a2).otherwise(0.0))


def economy_panel(wide: DataFrame, levels: dict[str, str], diffs: dict[str, str], returns: dict[str, str]) -> DataFrame:
    """Levels, 5/20-row differences and padded 20-row returns of a date-level wide table."""
    p = wide.withColumns({f"__{c}": R.padded(c, R.day()) for c in returns.values()})
    return p.select("date", *[F.col(c).alias(f"{k}_level") for k, c in levels.items()],
                    *[R.difference(c, n, R.day()).alias(f"{k}_{n}d_chg") for k, c in diffs.items() for n in (5, 20)],
                    *[R.step_return(f"__{c}", 20, R.day()).alias(f"{k}_20d_ret") for k, c in returns.items()])


def proxy_returns(wide: DataFrame, risk: dict[str, float], short: str, long: str, fx: str, dollar: str, gold: str) -> DataFrame:
    """Weighted risk return and synthetic cash, bond, dollar, gold and equal-weight safe returns."""
    ret = lambda c: F.coalesce(R.step_return(f"__p_{c}", 1, R.day()), F.lit(0.0))
    names = set(risk) | {fx, dollar, gold}
    d = wide.withColumns({f"__p_{c}": R.padded(c, R.day()) for c in names} | {"__s": R.padded(short, R.day()), "__l": R.padded(long, R.day())})
    day = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 100 / 252
    d = d.withColumns({"risk_return": total([ret(c) * w for c, w in risk.items()]) / sum(risk.values()), "cash_return": clip(day("__s"), -0.001, 0.001),
                       "bond_return": clip(-12.0 * F.coalesce(R.difference("__l", 1, R.day()), F.lit(0.0)) / 100 + day("__l"), -0.08, 0.08), "gold_return": clip(ret(gold) + 0.5 * ret(fx), -0.10, 0.10),
                       "__usd": 0.7 * ret(fx) + 0.3 * ret(dollar)})
    d = d.withColumn("usd_return", clip(F.col("__usd") + F.col("cash_return"), -0.08, 0.08))
    return d.withColumn("safe_equal_return", 0.35 * F.col("cash_return") + 0.30 * F.col("bond_return") + 0.20 * F.col("gold_return") + 0.15 * F.col("usd_return")).select(
        "date", "risk_return", "cash_return", "bond_return", "gold_return", "usd_return", "safe_equal_return")


# Risk weights per stage, plain and adaptive.
STAGE_BUDGET = {"Normal": 0.70, "Watch": 0.50, "De-risk": 0.35, "Cash": 0.15}
ADAPTIVE_BUDGET = {"Normal": 0.70, "Watch": 0.60, "De-risk": 0.45, "Cash": 0.15}
SAFE_MIX = {"axis2": (0.20, 0.15, 0.25, 0.40), "axis1": (0.20, 0.45, 0.20, 0.15), "axis3": (0.25, 0.35, 0.30, 0.10)}


def stage_budget(stage, table: dict[str, float] = STAGE_BUDGET) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[F.coalesce(col(stage), F.lit("Normal"))], F.lit(0.70))


def vix_budget(vix) -> Column:
    v = col(vix)
    return ladder([(v >= 35, 0.15), (v >= 25, 0.35), (v >= 20, 0.50)], 0.70)


def probability_budget(prob, alert) -> Column:
    p = F.coalesce(col(prob), F.lit(0.0))
    return ladder([(p >= 0.65, 0.15), (p >= 0.50, 0.35), ((p >= 0.38) | (F.coalesce(col(alert), F.lit(0)) == 1), 0.50)], 0.70)


def adaptive_weight(stage, axis1, axis2, axis3, vix) -> Column:
    """Stage budget, relaxed to 0.70 when Cash rests on peak fragility alone."""
    a1, a2, a3 = (F.coalesce(col(a), F.lit(0.0)) for a in (axis1, axis2, axis3))
    peak_only = (col(stage) == "Cash") & (a1 < 30) & (a2 < 35) & (a3 >= a1) & (a3 >= a2) & (col(vix) < 28)
    return F.when(peak_only, 0.70).otherwise(stage_budget(stage, ADAPTIVE_BUDGET))


def dynamic_safe_return(axis1, axis2, axis3) -> Column:
    a1, a2, a3 = (F.coalesce(col(a), F.lit(0.0)) for a in (axis1, axis2, axis3))
    mix = lambda k: total([F.col(c) * w for c, w in zip(("cash_return", "bond_return", "gold_return", "usd_return"), SAFE_MIX[k])])
    return F.when(a2 >= F.greatest(a1, a3), mix("axis2")).when(a1 >= F.greatest(a2, a3), mix("axis1")).otherwise(mix("axis3"))


def worst_stage(a, b) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(x) for x in STAGE_BUDGET]), F.coalesce(col(s), F.lit("Normal")))
    return F.when(rank(a) >= rank(b), col(a)).otherwise(col(b))


def gate_weight(stage, entry, large_alert, alerts) -> Column:
    """Risk weight by stage and entry permission, capped by loss alerts."""
    s, e = col(stage), F.coalesce(col(entry).cast("boolean"), F.lit(False))
    w = ladder([((s == "Normal") & e, 0.60), (s == "Normal", 0.25), ((s == "Watch") & e, 0.45), (s == "Watch", 0.15), ((s == "De-risk") & e, 0.20), (s == "De-risk", 0.05)], 0.05)
    w = F.least(w, F.when(F.coalesce(col(large_alert).cast("boolean"), F.lit(False)), 0.20).otherwise(0.60), F.when(F.coalesce(col(alerts), F.lit(0)) >= 2, 0.25).otherwise(0.60), F.when(~e, 0.25).otherwise(0.60))
    return F.greatest(F.lit(0.0), w)


def two_sleeve_return(weight, risk, safe) -> Column:
    w = col(weight)
    return w * col(risk) + F.least(F.lit(0.60), 1 - w) * col(safe)


# Weights of the confidence score over expanding percentiles.
CONFIDENCE = {"top1_score": 0.30, "topk_score_mean": 0.30, "score_spread": 0.10, "topk_rs20_mean": 0.15, "topk_rs60_mean": 0.15}


def confidence(df: DataFrame, suffix: str = "_pctile") -> Column:
    have = {c: w for c, w in CONFIDENCE.items() if c + suffix in df.columns}
    if not have:
        return F.lit(0.5)
    return total([F.coalesce(F.col(c + suffix), F.lit(0.5)) * w for c, w in have.items()]) / sum(have.values())
