"""Driver features, asset scores by regime, weekly point-in-time panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, clip100, col, ladder, logit, ratio, sigmoid, total
from tideframe.operators import asof as A, factors as FA, panel as P, topk as T, xsec as S
from tideframe.session import checkpointed


# Driver weights of the four rule regimes; a driver without a score counts as 0.
REGIME_WEIGHTS = {
    "Risk-On Growth": {"VIX": 0.22, "HY_OAS": 0.20, "NASDAQ100": 0.22, "SOX": 0.22, "DXY": 0.14},
    "Risk-On Cyclical": {"COPPER": 0.22, "WTI": 0.12, "HANGSENG_TECH": 0.22, "CSI300": 0.16, "DXY": 0.14, "US10Y_2Y": 0.14},
    "Defensive / Rate-Cut": {"US10Y": 0.28, "US10Y_REAL": 0.18, "GOLD": 0.22, "COPPER": -0.16, "SP500": -0.16},
    "Risk-Off / Cash": {"VIX": -0.24, "HY_OAS": -0.24, "DXY": -0.18, "USDKRW": -0.18, "SOX": -0.16}}


def regime_scores(scores: DataFrame) -> DataFrame:
    """date and one score per rule regime from (date, driver, riskon_score), scores clipped to +-3."""
    used = list(dict.fromkeys(d for ws in REGIME_WEIGHTS.values() for d in ws))
    v = {d: F.max(F.when(F.col("driver") == d, clip("riskon_score", -3, 3))) for d in used}
    return scores.groupBy("date").agg(*[F.round(total([F.coalesce(v[d], F.lit(0.0)) * w for d, w in ws.items()]), 10).alias(name) for name, ws in REGIME_WEIGHTS.items()])


def driver_features(drivers: DataFrame, specs: DataFrame) -> DataFrame:
    """Eleven features per (date, driver).  ``specs``: driver, transform (diff/return), higher_is_risk_on."""
    w = R.by_entity("driver")
    d = drivers.join(specs, "driver").filter(F.col("level").isNotNull())
    diff = F.col("transform") == "diff"
    chg = lambda n: F.when(diff, R.difference("level", n, w)).otherwise(R.step_return("level", n, w))
    d = d.withColumns({"pos": F.row_number().over(w), "base": chg(1), "chg_5d": chg(5), "chg_20d": chg(20), "chg_60d": chg(60)})
    d = d.withColumns({f"z_{n}d": R.zscore("level", n, w) for n in (20, 60, 252)} | {f"ma{n}_pos": ratio("level", R.mean("level", n, w)) - 1 for n in (20, 60)} | {
        "slope_20d": R.slope("level", "pos", 20, w), "vol_adj_20d": ratio("chg_20d", R.std("base", 60, w)),
        "riskon_score": F.when(F.col("higher_is_risk_on"), 1.0).otherwise(-1.0) * R.zscore("chg_20d", 252, w)})
    return d.drop("pos", "base", "transform", "higher_is_risk_on")


def driver_fit(expected: DataFrame, latest: DataFrame, out: str = "driver_fit_score") -> DataFrame:
    """50 + 16 x mean of clipped driver score times expected sign, per asset; 50 when nothing is known.

    ``expected``: symbol, driver, expected; ``latest``: driver, riskon_score[, date]."""
    keys = [c for c in latest.columns if c not in ("driver", "riskon_score")]
    v = clip("riskon_score", -3, 3) * F.col("expected")
    g = expected.join(latest, "driver").groupBy("symbol", *keys).agg(F.avg(v).alias("__m"))
    return g.select("symbol", *keys, F.coalesce(clip100(50 + 16 * F.col("__m")), F.lit(50.0)).alias(out))


def beta_fit(betas: DataFrame, out: str = "beta_fit_score") -> DataFrame:
    """Sign agreement of betas with the expected signs, weighted by min(|beta|, 3) / 3.
    ``betas``: symbol, driver, beta, expected[, date]."""
    keys = [c for c in betas.columns if c not in ("driver", "beta", "expected")]
    v = F.signum("beta") * F.signum("expected") * F.least(F.abs("beta"), F.lit(3.0)) / 3.0
    return betas.groupBy(*keys).agg(F.avg(v).alias("__m")).select(*keys, F.coalesce(clip100(50 + 35 * F.col("__m")), F.lit(50.0)).alias(out))


def driver_betas(prices: DataFrame, drivers: DataFrame, expected: DataFrame, n: int = 60, min_rows: int = 30) -> DataFrame:
    """Beta of every asset on each of its drivers over the last n joint days, per (date, symbol, driver)."""
    w, wd = R.by_entity(), R.by_entity("driver")
    a = prices.select("date", "symbol", R.step_return("close", 1, w).alias("ret"))
    d = drivers.select("date", "driver", R.step_return("level", 1, wd).alias("dret"))
    j = a.join(expected, "symbol").join(d, ["date", "driver"]).filter(F.col("ret").isNotNull() & F.col("dret").isNotNull())
    return j.select("date", "symbol", "driver", "expected", R.beta("ret", "dret", n, R.by_entity("symbol", "driver"), min_rows).alias("beta"))


def conditional_stats(prices: DataFrame, regimes: DataFrame, horizon: int, min_rows: int = 20, fallback: int = 252) -> DataFrame:
    """Win rate and mean forward return in the current regime, from rows older than horizon + 2
    days; fewer than ``min_rows`` such rows fall back to the last ``fallback`` eligible rows of
    the asset, none at all to (0.52, 0).

    Running sums only: a RANGE window per (symbol, regime) for the regime sample, and the
    difference of two running totals, looked up by row position, for the fallback.
    """
    w = R.by_entity()
    d = prices.select("date", "symbol", R.forward_return("close", horizon, w).alias("fwd")).join(regimes, "date")
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    known = F.col("fwd").isNotNull()
    d = d.withColumns({"__d": day, "__k": known.cast("int"), "__f": F.coalesce("fwd", F.lit(0.0)), "__u": F.when(F.col("fwd") > 0, 1).otherwise(0)})
    lag = -(horizon + 3)
    same = Window.partitionBy("symbol", "regime").orderBy("__d").rangeBetween(Window.unboundedPreceding, lag)
    mine = Window.partitionBy("symbol").orderBy("__d")
    upto = mine.rowsBetween(Window.unboundedPreceding, 0)
    z = lambda c: F.coalesce(c, F.lit(0))
    d = d.withColumns({f"__r{c}": z(F.sum(f"__{c}").over(same)) for c in "kfu"} | {"__n": z(F.sum("__k").over(mine.rangeBetween(Window.unboundedPreceding, lag)))}
                      | {f"__c{c}": F.sum(f"__{c}").over(upto) for c in "kfu"})
    totals = d.filter("__k = 1").select("symbol", F.col("__ck").alias("__i"), F.col("__cf").alias("__tf"), F.col("__cu").alias("__tu"))
    last = totals.withColumnsRenamed({"__i": "__n", "__tf": "__lf", "__tu": "__lu"})
    first = totals.withColumnsRenamed({"__i": "__s", "__tf": "__sf", "__tu": "__su"})
    d = d.withColumn("__s", F.col("__n") - fallback).join(last, ["symbol", "__n"], "left").join(first, ["symbol", "__s"], "left")
    m = F.least(F.col("__n"), F.lit(fallback))
    fb_f, fb_u = F.col("__lf") - z(F.col("__sf")), F.col("__lu") - z(F.col("__su"))
    enough = F.col("__rk") >= min_rows
    win = F.when(enough, ratio("__ru", "__rk")).otherwise(ratio(fb_u, m))
    avg = F.when(enough, ratio("__rf", "__rk")).otherwise(ratio(fb_f, m))
    return d.select("date", "symbol", "regime", F.coalesce(win, F.lit(0.52)).alias("win_rate"), F.coalesce(avg, F.lit(0.0)).alias("avg_return"))


# Weights of the technical, driver and beta edges per horizon.
EDGES = {"1w": (1.0, 0.7, 0.25), "4w": (0.7, 1.0, 0.45)}


def blend_probability(win_rate, technical, driver, beta, horizon: str) -> Column:
    a, b, c = EDGES[horizon]
    edge = lambda x: (col(x) - 50) / 100
    return clip(sigmoid(logit(F.coalesce(col(win_rate), F.lit(0.52))) + a * edge(technical) + b * edge(driver) + c * edge(beta)), 0.05, 0.95)


def asset_scores(prices: DataFrame, drivers: DataFrame, specs: DataFrame, expected: DataFrame, regimes: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Point-in-time asset score table for the given dates (all dates when None): every window is
    computed once over the panel and the rows are then limited by a semi join.  The aggregated
    inputs are read by several branches and are therefore staged."""
    prices, drivers, regimes, expected = (checkpointed(x) for x in (prices, drivers, regimes, expected))
    tech = FA.technical_panel(prices).select("date", "symbol", "technical_score", "risk_penalty", "ret_20", "vol20", "dd252")
    feats = driver_features(drivers, specs).select("date", "driver", "riskon_score")
    betas = driver_betas(prices, drivers, expected)
    pick = (lambda x: x.join(dates, "date", "left_semi")) if dates is not None else (lambda x: x)
    fit = driver_fit(expected, pick(feats))
    bfit = beta_fit(pick(betas).filter(F.col("beta").isNotNull()).select("date", "symbol", "driver", "beta", "expected"))
    c1 = pick(conditional_stats(prices, regimes, 5)).select("date", "symbol", "regime", F.col("win_rate").alias("win_1w"), F.col("avg_return").alias("avg_1w"))
    c4 = pick(conditional_stats(prices, regimes, 20)).select("date", "symbol", F.col("win_rate").alias("win_4w"), F.col("avg_return").alias("avg_4w"))
    k = ["date", "symbol"]
    d = pick(tech).join(c1, k).join(c4, k).join(fit, k, "left").join(bfit, k, "left").fillna(50.0, ["driver_fit_score", "beta_fit_score"])
    d = d.withColumns({f"prob_{h}": blend_probability(f"win_{h}", "technical_score", "driver_fit_score", "beta_fit_score", h) for h in EDGES})
    score = clip100(0.34 * F.col("technical_score") + 0.28 * F.col("driver_fit_score") + 0.18 * F.col("beta_fit_score") + 20.0 * F.col("prob_4w") - F.coalesce("risk_penalty", F.lit(0.0)))
    d = d.withColumn("score_0_100", F.round(score, 2))
    return d.withColumn("rank", S.first_come_rank("score_0_100"))


def weekly_panel(prices: DataFrame, drivers: DataFrame, specs: DataFrame, expected: DataFrame, regimes: DataFrame) -> DataFrame:
    """The score table on the last date of every week with realised returns."""
    w = R.by_entity()
    prices = checkpointed(prices)
    weeks = P.rebalance_dates(prices, "W")
    real = prices.select("date", "symbol", R.forward_return("close", 5, w).alias("realized_1w"), R.forward_return("close", 20, w).alias("realized_4w"))
    d = asset_scores(prices, drivers, specs, expected, regimes, weeks).join(real, ["date", "symbol"])
    return d.withColumns({f"realized_up_{h}": F.when(F.col(f"realized_{h}").isNotNull(), (F.col(f"realized_{h}") > 0).cast("int")) for h in ("1w", "4w")})


def cash_drag(group, regime, safe: list[str], defensive: list[str], off: str = "Risk-Off / Cash", cut: str = "Defensive / Rate-Cut") -> Column:
    """Opportunity cost of safe and defensive groups outside risk-off regimes."""
    g, r = col(group), col(regime)
    is_safe, is_def = g.isin(safe), g.isin(defensive)
    return (F.when(is_def & ~r.isin(off, cut), 5.0).when(is_safe & (r == cut), 7.0).when(is_safe & (r != off), 18.0).otherwise(0.0))


def institutional_score(score, prob, technical, expected_return, bonus: Column, drag: Column, penalty: Column | None = None) -> Column:
    z = lambda x, d: F.coalesce(col(x), F.lit(d))
    out = 0.52 * z(score, 50.0) + 24.0 * z(prob, 0.5) + 0.14 * z(technical, 50.0) + 260.0 * clip(z(expected_return, 0.0), -0.10, 0.10) + bonus - drag
    return clip100(out - penalty if penalty is not None else out)


def rule_regime(scores: dict[str, Column]) -> dict[str, Column]:
    """Label with the largest weighted driver score (the first on ties) and the confidence of its
    lead over the second."""
    names = list(scores)
    best = F.greatest(*scores.values())
    label = F.lit(None).cast("string")
    for n in reversed(names):
        label = F.when(scores[n] == best, n).otherwise(label)
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    return {"rule_regime": label, "rule_confidence": sigmoid(ordered[0] - ordered[1])}


def label_clusters(df: DataFrame, cluster: str, scores: list[str]) -> DataFrame:
    """Cluster -> name of the rule score with the largest mean inside the cluster."""
    from tideframe.plans.risk_vector import dominant
    return df.groupBy(cluster).agg(*[F.avg(s).alias(s) for s in scores]).select(cluster, dominant(scores).alias("label"))


def bubble_merge(scores: DataFrame, bubbles: DataFrame, score: str = "score_0_100") -> DataFrame:
    """Scores less 28 x bubble confidence, re-ranked, with a risk label."""
    d = scores.join(bubbles.select("symbol", "dtcai"), "symbol", "left")
    b = F.coalesce("dtcai", F.lit(0.0))
    d = d.withColumns({"bubble_score_0_100": F.round(clip100(100 * b), 2), "adjusted_score": F.round(clip100(F.col(score) - 28.0 * b), 2),
                       "bubble_label": ladder([(b >= 0.6, "crash-alert"), (b >= 0.3, "caution")], "stable")})
    return d.withColumn("adjusted_rank", S.first_come_rank("adjusted_score"))
