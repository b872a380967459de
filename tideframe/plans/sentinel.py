"""Stress sentinel: shock scores of drivers, component means, confirmation, persistence, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, clip100, col, ladder, total
from tideframe.operators import aggregates as G, folds, xsec as S
from tideframe.operators.stress import shock
from tideframe.plans.risk_vector import dominant

# Component weights and per-state budgets.
COMPONENT_WEIGHTS = {"volatility": 1.25, "credit": 1.25, "fx": 1.05, "equity": 1.20, "cyclical": 0.95, "supply_shock": 0.55, "hedge_bid": 0.35, "liquidity": 0.75,
                     "rai": 0.95, "breadth": 1.10, "safe_rotation": 0.65}
CONFIRMING = ["volatility", "credit", "fx", "equity"]
BUDGET = {"Normal": 100.0, "Watch": 70.0, "De-risk": 35.0, "Cash": 10.0}
EQUITY_PENALTY = {"Normal": 0.0, "Watch": 8.0, "De-risk": 20.0, "Cash": 38.0}
SAFE_BOOST = {"Normal": 0.0, "Watch": 3.0, "De-risk": 8.0, "Cash": 16.0}
HEDGE_BOOST = {"Normal": 0.0, "Watch": 2.0, "De-risk": 6.0, "Cash": 10.0}
DEFENSIVE_BOOST = {"Normal": 0.0, "Watch": 1.0, "De-risk": 3.0, "Cash": 5.0}


def by_state(state, table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(state)]


def shock_scores(drivers: DataFrame, specs: DataFrame) -> DataFrame:
    """date, driver, component, shock.  ``specs``: driver, component, mode (diff/return), direction, weight."""
    w = R.by_entity("driver")
    d = drivers.join(specs, "driver")
    move = F.when(F.col("mode") == "diff", R.difference("level", 1, w)).otherwise(R.step_return("level", 1, w)) * F.col("direction")
    return d.withColumn("move", move).select("date", "driver", "component", shock("move", F.col("weight"), w).alias("shock"))


def component_scores(shocks: DataFrame, components: list[str]) -> DataFrame:
    """date x component means."""
    g = shocks.groupBy("date").pivot("component", components).agg(F.avg("shock"))
    return g.select("date", *[F.col(c).alias(f"{c}_score") for c in components])


def rai(prices: DataFrame, group: str, min_names: int = 20, w_ret: int = 126, w_vol: int = 252, min_vol: int = 126, z_window: int = 756) -> DataFrame:
    """Risk-appetite index: slope of returns on volatility across assets, its z, level and scores."""
    w = R.by_entity()
    d = prices.withColumns({"y": R.step_return("close", w_ret, w), "r1": R.step_return("close", 1, w)}).withColumn("x", R.annual_vol("r1", w_vol, w, min_vol))
    s = G.weighted_slope(d, "y", "x", group, min_names)
    z = R.zscore("slope", z_window, R.day(), R.loose_min_periods(z_window, 20))
    s = s.withColumn("RAI_z", z).withColumn("RAI_20d_change", R.difference("RAI_z", 20, R.day()))
    s = s.withColumns({"RAI_raw": F.col("slope"), "RAI_level_0_100": clip100(50 + 15 * F.col("RAI_z")),
                       "RAI_fear_score": clip100(28 * clip(-F.col("RAI_z") - 0.5, 0)), "RAI_collapse_score": clip100(24 * clip(-F.col("RAI_20d_change") - 0.75, 0)),
                       "RAI_overheat_score": clip100(25 * clip(F.col("RAI_z") - 1.0, 0))})
    return s.withColumn("RAI_shock_score", F.greatest("RAI_fear_score", "RAI_collapse_score")).withColumn(
        "rai_score", clip100(0.7 * F.col("RAI_shock_score") + 0.3 * F.col("RAI_overheat_score"))).drop("slope")


def breadth_scores(prices: DataFrame, risk: Column, safe: Column) -> DataFrame:
    """Breadth damage and safe-rotation scores from the per-date shares."""
    b = G.breadth(prices, risk, safe)
    damage = clip100(0.35 * F.col("below_ma60") + 0.25 * F.col("below_ma20") + 0.25 * F.col("loss20") + 0.15 * F.col("large_loss20"))
    accel = clip100(160 * clip(F.lag("risk_breadth", 10).over(R.day()) - F.col("risk_breadth"), 0))
    b = b.withColumns({"damage": damage, "accel": accel, "rotation": F.col("safe_ret") - F.col("risk_ret")})
    z = R.zscore("rotation", 252, R.day(), R.loose_min_periods(252, 20))
    return b.withColumns({"breadth_score": clip100(0.7 * F.col("damage") + 0.3 * F.col("accel")), "safe_rotation_score": clip100(30 * clip(z, 0))}).drop("damage", "accel")


def sentinel(scores: DataFrame, components: list[str], watch: float, derisk: float, cash: float) -> DataFrame:
    """Raw score, confirmation boost, persistence, final score and state per date.

    ``scores``: date and ``<component>_score`` columns."""
    cols = [f"{c}_score" for c in components]
    raw = total([F.coalesce(F.col(f"{c}_score"), F.lit(0.0)) * COMPONENT_WEIGHTS[c] for c in components]) / sum(COMPONENT_WEIGHTS[c] for c in components)
    n = total([F.coalesce((F.col(f"{c}_score") > 35).cast("int"), F.lit(0)) for c in CONFIRMING if c in components])
    d = scores.withColumns({"raw": raw, "boost": ladder([(n >= 4, 16.0), (n >= 3, 10.0), (n >= 2, 5.0)], 0.0)})
    d = folds.ema(d.withColumn("__s", F.lit(0)), "raw", 3, "persistence", ("__s",)).drop("__s")
    d = d.withColumns({"risk_off_score_raw": clip100("raw"), "risk_off_score": F.round(clip100(0.65 * F.col("raw") + 0.35 * F.col("persistence") + F.col("boost")), 8)})
    d = d.withColumns({"risk_off_momentum_5d": R.difference("risk_off_score", 5, R.day()), "dominant_component": F.regexp_replace(dominant(cols), "_score$", "")})
    d = folds.hysteresis(d, "risk_off_score", watch, derisk, cash, "sentinel_state")
    return d.withColumns({"risk_budget_pct": by_state("sentinel_state", BUDGET), "equity_penalty": by_state("sentinel_state", EQUITY_PENALTY),
                          "safe_asset_boost": by_state("sentinel_state", SAFE_BOOST)}).drop("raw", "boost", "persistence")


def group_adjustment(group, safe: list[str], hedge: list[str], risk: list[str], defensive: list[str], high_beta: list[str], supply: str = "Commodity/Oil") -> Column:
    """Score change of an asset for the sentinel state of the joined latest row."""
    g = col(group)
    penalty = F.col("equity_penalty") * F.when(g.isin(high_beta), 1.15).otherwise(1.0) * F.when((g == supply) & (F.col("dominant_component") == "supply_shock"), 0.45).otherwise(1.0)
    cut = -F.least(F.lit(45.0), penalty + F.greatest(F.lit(0.0), F.col("risk_off_score") - 70.0) * 0.20)
    return (F.when(g.isin(safe), F.col("safe_asset_boost")).when(g.isin(hedge), by_state("sentinel_state", HEDGE_BOOST)).when(g.isin(risk), cut)
            .when(g.isin(defensive), by_state("sentinel_state", DEFENSIVE_BOOST)).otherwise(0.0))


def asset_action(group, state, safe: list[str], hedge: list[str], risk: list[str]) -> Column:
    g, s = col(group), col(state)
    return ladder([((s == "Cash") & g.isin(safe), "core cash"), ((s == "Cash") & g.isin(hedge), "hedge only"), (s == "Cash", "avoid risk"),
                   ((s == "De-risk") & g.isin(safe), "raise cash"), ((s == "De-risk") & g.isin(hedge), "defensive sleeve"), ((s == "De-risk") & g.isin(risk), "cut weight"),
                   ((s == "Watch") & g.isin(risk), "size down")], "normal")


def overlay(scores: DataFrame, latest: DataFrame, group: str, score: str, prob_1w: str, prob_4w: str, sets: dict[str, list[str]]) -> DataFrame:
    """Scores and probabilities moved by the sentinel row joined by date; ranked per date."""
    d = scores.join(latest.select("date", "risk_off_score", "sentinel_state", "dominant_component", "equity_penalty", "safe_asset_boost"), "date")
    d = d.withColumn("adjustment", group_adjustment(group, **sets))
    d = d.withColumns({"adjusted_score": F.round(clip100(F.col(score) + F.col("adjustment")), 2),
                       "adjusted_prob_1w": F.round(clip(F.col(prob_1w) + 0.75 * F.col("adjustment") / 100, 0.01, 0.99), 4),
                       "adjusted_prob_4w": F.round(clip(F.col(prob_4w) + 0.90 * F.col("adjustment") / 100, 0.01, 0.99), 4),
                       "action": asset_action(group, "sentinel_state", sets["safe"], sets["hedge"], sets["risk"])})
    w = Window.partitionBy("date").orderBy(F.desc("adjusted_score"), F.desc("adjusted_prob_4w"), "symbol")
    return d.withColumn("sentinel_rank", F.row_number().over(w))
