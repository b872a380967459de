"""Stock screen: factor table, percentile scores, routes, checklist, stage gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, flag, ladder, ratio, total
from tideframe.operators import aggregates as G, factors as FA, panel as P, pooled as PO, topk as T
from tideframe.session import checkpointed


def growth_score() -> Column:
    """Share of five growth conditions, unknown counts as not met, scaled to 11."""
    cs = ["return_3m", "return_6m", "return_12m", "revenue_growth", "earnings_growth"]
    return total([flag(F.col(c) > 0) for c in cs]) / 5 * 11


def balance_score(checks: dict[str, Column]) -> Column:
    """Share of met conditions among the known facts, scaled to 16."""
    met = total([flag(c) for c in checks.values()])
    known = total([F.col(k).isNotNull().cast("int") for k in checks])
    return ratio(met, known) * 16


def factor_table(bars: DataFrame, info: DataFrame) -> DataFrame:
    """Every price, volume and fundamental factor, one row per symbol."""
    d = FA.with_derived(FA.factors(bars)).join(FA.divergence_scores(bars), "symbol", "left").join(info, "symbol", "left")
    return d.withColumns({
        "und_gro_score": growth_score(),
        "und_bal_score": balance_score({c: F.col(c) > 0 for c in ("revenue_growth", "earnings_growth", "free_cashflow")}),
        "fcf_to_assets": ratio("free_cashflow", "total_assets"), "cash_to_assets": ratio("total_cash", "total_assets"),
        "rd_to_market_cap": ratio("research_development", "market_cap") * 100, "innovative_roe": F.col("return_on_equity") * 100,
        "net_cash_to_market_cap": ratio(F.col("total_cash") - F.coalesce("total_debt", F.lit(0.0)), "market_cap") * 100})


# Profile of a demonstration screen: factor -> weight, and the factors for which low is good.
DEMO_PROFILE = {
    "lower_is_better": ["volume_price_cv_1m", "drawdown_from_52w_high", "overheat_penalty", "distribution_days_20d"],
    "base": {"return_6m": 1.0, "minervini_qm_score": 1.0, "und_gro_score": 0.5},
    "trend": {"return_3m": 1.0, "return_6m": 1.5, "high_proximity": 1.0, "trend_line_cps": 1.0, "overheat_penalty": 0.5},
    "turnaround": {"ma50_reclaim_score": 1.0, "weekly_bullish_divergence_score": 1.0, "mfi_14": 0.5},
    "survival": {"fcf_to_assets": 1.0, "cash_to_assets": 1.0},
    "risk_control": {"volume_price_cv_1m": 1.0, "distribution_days_20d": 1.0},
    "trend_bonus": {"accumulation_days_20d": 4.0}, "turnaround_bonus": {"ma50_reclaim_score": 5.0},
}


def factor_scores(df: DataFrame, names: list[str], lower: list[str], key: str = "symbol") -> DataFrame:
    """Percent rank of every factor over the whole universe on 0..100, turned round where low is good.

    All factors are ranked in one pass over (factor, value) pairs; no factor column is gathered
    in one task.  A factor known for fewer than two symbols scores null.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select(key, "r.*")
    ranks = PO.mean_rank(long, ["factor"], "value")
    known = long.groupBy("factor").agg(F.count("value").alias("__n"))
    s = long.join(ranks, ["factor", "value"], "left").join(known, "factor")
    p = F.col("rank_pct") * 100
    score = clip(F.when(F.col("factor").isin(lower), 101 - p).otherwise(p), 0, 100)
    s = s.withColumn("score", F.when(F.col("__n") >= 2, score))
    return s.groupBy(key).pivot("factor", names).agg(F.first("score")).select(key, *[F.col(n).alias(f"s_{n}") for n in names])


def known_average(weights: dict[str, float], prefix: str = "s_") -> Column:
    """Weighted mean over the scores that are known, 2 decimals."""
    num = total([F.coalesce(F.col(prefix + f), F.lit(0.0)) * w for f, w in weights.items()])
    den = total([F.when(F.col(prefix + f).isNotNull(), w).otherwise(0.0) for f, w in weights.items()])
    return F.round(ratio(num, den), 2)


def bonus(weights: dict[str, float]) -> Column:
    """Points in proportion to the score of each factor with a positive raw value."""
    return F.round(total([F.when((F.col(f) > 0) & F.col(f"s_{f}").isNotNull(), F.col(f"s_{f}") / 100 * w).otherwise(0.0) for f, w in weights.items()]), 2)


def route_score(trend, turn, survival, fragility) -> Column:
    best = F.greatest(col(trend), col(turn))
    cut = F.when(col(survival) < 35, 20.0).otherwise(0.0) + F.when(col(fragility) > 75, 15.0).otherwise(0.0)
    return F.round(clip(best - cut, 0, 100), 2)


def candidate_type(trend, turn, survival, fragility) -> Column:
    a, b = F.coalesce(col(trend), F.lit(0.0)), F.coalesce(col(turn), F.lit(0.0))
    s = col(survival)
    return ladder([(s < 30, "Avoid - weak survival"), (col(fragility) > 80, "Avoid - fragile"), ((a >= 80) & (b >= 70), "Dual Signal"), (a >= 75, "Trend Leader"),
                   ((b >= 70) & (s.isNull() | (s >= 50)), "Turnaround Candidate")], "Watch")


def scored(table: DataFrame, profile: dict) -> DataFrame:
    """Factor scores combined to trend, turnaround, survival and route scores with a label."""
    groups = [profile[g] for g in ("base", "trend", "turnaround", "survival", "risk_control", "trend_bonus", "turnaround_bonus")]
    names = list(dict.fromkeys(f for g in groups for f in g))
    table = checkpointed(table)  # one row per symbol, read several times below
    d = table.join(factor_scores(table, names, profile["lower_is_better"]), "symbol")
    d = d.withColumns({"base_score": known_average(profile["base"]), "trend_bonus": bonus(profile["trend_bonus"]), "turnaround_bonus": bonus(profile["turnaround_bonus"]),
                       "survival_score": known_average(profile["survival"]), "fragility_score": F.round(100 - known_average(profile["risk_control"]), 2)})
    d = d.withColumns({"trend_score": F.round(clip(known_average(profile["trend"]) + F.col("trend_bonus"), 0, 100), 2),
                       "turnaround_score": F.round(clip(known_average(profile["turnaround"]) + F.col("turnaround_bonus"), 0, 100), 2)})
    d = d.withColumns({"route_score": route_score("trend_score", "turnaround_score", "survival_score", "fragility_score"),
                       "candidate_type": candidate_type("trend_score", "turnaround_score", "survival_score", "fragility_score")})
    return d.select("symbol", "base_score", "trend_score", "turnaround_score", "survival_score", "fragility_score", "route_score", "candidate_type",
                    F.coalesce("route_score", "base_score").alias("comprehensive_score"))


def checklist(items: list[tuple[str, Column, Column]]) -> Column:
    """Array of (label, passed or null, value)."""
    return F.array(*[F.struct(F.lit(l).alias("label"), p.alias("passed"), v.cast("double").alias("value")) for l, p, v in items])


def counts(items: str) -> list[Column]:
    return [F.size(F.filter(items, lambda i: F.coalesce(i["passed"], F.lit(False)))).alias("passed"), F.size(F.filter(items, lambda i: i["passed"].isNotNull())).alias("known")]


def survival_reasons(rules: list[tuple[Column, str]]) -> Column:
    """Failed survival rules joined by ';', or 'pass'."""
    text = F.concat_ws(";", *[F.when(c, r) for c, r in rules])
    return F.when(text == "", "pass").otherwise(text)


def stage_verdicts(d: DataFrame, weights: dict[str, float] | None = None, minimum: float = 60.0, high_share: float = 0.85, max_risk_adjusted: float = 50.0, max_research_ratio: float = 15.0, min_net_cash: float = 10.0) -> DataFrame:
    """Scores of eight stages from tri-state items, weighted gate score, failed stages and verdict.

    An item on an unknown figure is not met, except the price target and the risk-adjusted return,
    which are unknown with their figures; items that no table answers are always unknown."""
    known = lambda c: F.coalesce(c, F.lit(False))
    above = lambda c, x=0.0: known(F.col(c) > x)
    unknown = F.lit(None).cast("boolean")
    research = ratio("research_development", "market_cap") * 100
    net_cash = ratio(F.col("total_cash") - F.coalesce("total_debt", F.lit(0.0)), "market_cap") * 100
    risk_adjusted = ratio("return_6m", F.coalesce(F.when(F.col("beta") != 0, F.abs("beta")), F.lit(1.0)))
    near_high = known(F.col("close") >= F.col("high_52w") * high_share)
    stages = {
        "data": [F.col("close").isNotNull(), F.col("market_cap").isNotNull(), unknown], "survival": [unknown, unknown, unknown],
        "moat": [above("gross_margins", 0.35), above("operating_margins", 0.15), unknown],
        "cash_flow": [above("free_cashflow"), above("gross_margins"), research.isNotNull()],
        "management": [unknown, unknown, unknown],
        "time": [above("return_6m"), above("revenue_growth"), unknown],
        "finance": [above("return_on_equity"), above("return_on_assets"), known(F.col("debt_to_equity") < 150), above("profit_margins"),
                    above("return_on_equity"), known((research > 0) & (100 / research <= max_research_ratio)), unknown, above("revenue_growth"), unknown,
                    known(net_cash >= min_net_cash), near_high, above("earnings_growth")],
        "momentum": [near_high, F.col("close") > F.col("target_price"), risk_adjusted.between(0, max_risk_adjusted)],
    }
    w = weights or {}
    scores = {k: G.item_score(F.array(*[F.struct(i.alias("passed")) for i in items])) for k, items in stages.items()}
    out = d.withColumns({f"stage_{k}": s for k, s in scores.items()})
    num = total([F.coalesce(F.col(f"stage_{k}"), F.lit(0.0)) * w.get(k, 1.0) for k in stages])
    den = total([F.when(F.col(f"stage_{k}").isNotNull(), w.get(k, 1.0)).otherwise(0.0) for k in stages])
    failed = F.concat_ws(", ", *[F.when(F.col(f"stage_{k}") < 60, k) for k in stages])
    unanswered = total([F.col(f"stage_{k}").isNull().cast("int") for k in stages]) > 0
    out = out.withColumns({"gate_score": F.round(ratio(num, den), 2), "failed": failed})
    verdict = (F.when(F.col("gate_score").isNull(), "hold: too few numbers").when((F.col("gate_score") >= minimum) & (F.col("failed") == ""), "pass")
               .when(F.col("failed") != "", F.concat(F.lit("reject: "), F.array_join(F.slice(F.split("failed", ", "), 1, 2), ", "))).when(unanswered, "conditional hold: research open").otherwise("hold"))
    return out.withColumn("verdict", verdict)


def flow_metrics(flows: DataFrame, asof: str, weights: dict[str, float], lead: str, short: int = 45, long: int = 120, sessions: int = 20) -> DataFrame:
    """Net-buy strength of each investor against the traded value of two windows, persistence of
    the lead investor, weighted combination and its acceleration.  ``flows``: date, symbol, investor, buy, sell."""
    day = F.lit(asof).cast("date")
    past = flows.filter(F.col("date") <= day)
    recent = past.filter(F.col("date") > F.date_sub(day, long))
    near = F.col("date") > F.date_sub(day, short)
    value, net = F.col("buy") + F.col("sell"), F.col("buy") - F.col("sell")
    tv = recent.groupBy("symbol").agg(F.sum(F.when(near, value)).alias("t1"), F.sum(value).alias("t2"))
    f = recent.groupBy("symbol", "investor").agg(F.sum(F.when(near, net)).alias("n1"), F.sum(net).alias("n2")).join(tv, "symbol")
    f = f.withColumns({"s1": ratio("n1", "t1") * 100, "s2": ratio("n2", "t2") * 100})
    w = F.lit(None).cast("double")
    for k, v in weights.items():
        w = F.when(F.col("investor") == k, F.lit(float(v))).otherwise(w)
    f = f.withColumn("w", w).filter(F.col("w").isNotNull())
    g = f.groupBy("symbol").agg(F.max(F.when(F.col("investor") == lead, F.col("s1"))).alias(f"strength_{short}"), F.max(F.when(F.col("investor") == lead, F.col("s2"))).alias(f"strength_{long}"),
                                G.weighted_mean("s1", "w").alias(f"combo_{short}"), G.weighted_mean("s2", "w").alias(f"combo_{long}"))
    days = T.last_rows(past.filter(F.col("investor") == lead), sessions)
    p = days.groupBy("symbol").agg((G.rate(F.col("buy") > F.col("sell")) * 100).alias("persistence"))
    return g.join(p, "symbol", "left").withColumn("accel", F.col(f"combo_{short}") - F.col(f"combo_{long}"))


def event_study(bars: DataFrame, events: DataFrame, asof=None) -> DataFrame:
    """Event-day and later returns and the volume ratio around the first bar at or after each event.

    Every bar carries the looked-up neighbours from windows, so an event needs one equi-join.
    """
    w = R.by_entity()
    b = bars if asof is None else bars.filter(F.col("date") <= F.lit(asof).cast("date"))
    c = F.col("close")
    b = b.select("symbol", "date", ((ratio(c, F.lag(c).over(w)) - 1) * 100).alias("event_return"), (R.forward_return(c, 5, w) * 100).alias("post_5"),
                 (R.forward_return(c, 20, w) * 100).alias("post_20"), F.row_number().over(w).alias("__n"),
                 ratio(F.avg("volume").over(w.rowsBetween(0, 4)), F.avg("volume").over(w.rowsBetween(-60, -1))).alias("__vr"))
    b = b.withColumn("volume_ratio", F.when(F.col("__n") > 20, F.col("__vr"))).drop("__n", "__vr")
    # First bar at or after the event: the last one before it tells where it starts.
    nxt = b.select("symbol", "date", F.lag("date").over(w).alias("__prev"))
    span = nxt.withColumnsRenamed({"date": "__bar"})
    from tideframe.operators.asof import interval_join
    iv = span.select("symbol", "__bar", F.date_add(F.coalesce("__prev", F.lit("1900-01-01").cast("date")), 1).alias("valid_from"), F.col("__bar").alias("valid_to"))
    hit = interval_join(events, iv, ("symbol",), on="event_date", closed=True).select("symbol", "event_date", "__bar")
    return hit.join(b.withColumnRenamed("date", "__bar"), ["symbol", "__bar"]).drop("__bar")


def merge_sources(sources: list[DataFrame], keys: list[str], estimates: list[str], asof: str, stamp: str = "estimate_timestamp") -> DataFrame:
    """First non-null by source order; estimates dated after the as-of date are dropped."""
    out, cols = None, {}
    for i, s in enumerate(sources):
        names = [c for c in s.columns if c not in keys]
        part = s.select(*keys, *[F.col(c).alias(f"__{i}_{c}") for c in names])
        for c in names:
            cols.setdefault(c, []).append(f"__{i}_{c}")
        out = part if out is None else out.join(part, keys, "full")
    d = out.select(*keys, *[F.coalesce(*v).alias(c) for c, v in cols.items()])
    late = F.col(stamp) > F.lit(asof).cast("date") if stamp in cols else F.lit(False)
    return d.withColumns({c: F.when(~F.coalesce(late, F.lit(False)), F.col(c)) for c in estimates})


def price_to_quarter(price, quarter) -> Column:
    """Market value over four times the quarter's figure."""
    return ratio(price, col(quarter) * 4)
