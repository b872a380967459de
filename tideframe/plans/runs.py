"""Composed runs: selective dynamic selection and leadership training with evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideframe.operators import learn as LE, metrics as M, periods as PF, topk as T, xsec as S
from tideframe.plans import leadership as L
from tideframe.session import checkpointed

CANDIDATE_FEATURES = ["top_k", "top1_score", "topk_score_mean", "topk_score_min", "score_spread", "score_std", "universe_score_std", "universe_score_iqr"]


def selective_run(candidates: DataFrame, train_end: str, valid_end: str, scores: list[str], thresholds: list[float] | None = None, per_year: float = 52, min_trades: int = 10) -> DataFrame:
    """Entry and utility models on the candidate panel, best candidate per date, entry threshold
    chosen on validation dates, performance per split."""
    d = LE.one_hot(LE.time_split(candidates, train_end, valid_end), "score_col", scores)
    feats = CANDIDATE_FEATURES + [f"score_col_{s}" for s in scores]
    d = checkpointed(d)
    train = d.filter("split = 'train'")
    p = d.withColumns({"entry_gate_prob": LE.gradient_boosted(train, feats, "entry_label", 140).probability(), "predicted_utility": LE.gradient_boosted(train, feats, "utility", 160, regression=True).margin()})
    p = checkpointed(p)
    st = p.agg(F.avg("predicted_utility").alias("__m"), F.stddev_samp("predicted_utility").alias("__s"))
    z = F.coalesce(F.try_divide(F.col("predicted_utility") - F.col("__m"), F.col("__s")), F.lit(0.0))
    p = p.join(st).withColumn("dynamic_score", F.round(0.75 * F.col("entry_gate_prob") + 0.25 * z, 10))
    best = checkpointed(T.best_rows(p, "dynamic_score", ["date"], ["score_col", "top_k"]))
    grid = PF.threshold_grid(best.filter("split = 'valid'"), "entry_gate_prob", thresholds or [0.30 + 0.05 * i for i in range(11)], "portfolio_return", per_year)
    pick = grid.filter(F.col("invested_periods") >= min_trades).withColumn("o", F.round(PF.entry_objective(), 8)).agg(F.coalesce(F.max_by("threshold", F.struct("o", -F.col("threshold"))), F.lit(0.5)).alias("thr"))
    live = best.join(pick)
    live = PF.gated(live, F.col("entry_gate_prob") >= F.col("thr"))
    perf = PF.performance(live, ["split"], "strategy_return", per_year, invested="invested")
    return perf.select("split", "periods", "invested_periods", "coverage", "cumulative_return", "Sharpe", "MDD", "hit_positive").join(pick.withColumnRenamed("thr", "threshold"))


def leadership_run(panel: DataFrame, train_end: str, valid_end: str, ks: list[int], min_trades: int = 3) -> DataFrame:
    """Rules, group labels, entry and ranking models, blends; per score and k the entry threshold that does best on
    the validation dates, and period evaluation on the test dates with and without it."""
    d = L.horizon_rules(panel, L.RULE_5D_V3, L.RULE_20D_V3).withColumnRenamed("etf", "symbol")
    d = d.withColumn("pct", S.pct_rank("forward_20D_excess")).withColumn("grade", S.grade_ceil("pct").cast("double"))
    d = d.withColumn("entry_label", F.when(F.col("forward_20D_excess").isNotNull(), (F.col("forward_20D_excess") > 0).cast("int")))
    feats = ["ETF_RS_20D", "ETF_RS_60D", "ETF_RS_120D", "RS_slope_20D", "weighted_HP", "HP90_share", "MA60_breadth", "RS_positive_share", "rule_20d_score"]
    d = checkpointed(LE.time_split(d.select("date", "symbol", "grp", *feats, "grade", "entry_label", "forward_20D_return", "forward_20D_excess"), train_end, valid_end))
    scored, _ = LE.ranker(d, feats, "grade", rounds=800, rate=0.02, leaves=9, depth=3, min_rows=12, l1=2.0, l2=12.0, patience=100)
    entry = LE.histogram_boosted(d.filter("split = 'train' AND entry_label IS NOT NULL"), feats, "entry_label")
    scored = L.blends(scored.withColumn("entry_prob", F.round(entry.probability(), 10)), "rule_20d_score", "rank_score", [0.5])
    scored = checkpointed(scored.withColumn("entry_adjusted", F.col("blend_rule50") + 0.75 * F.col("entry_prob")))
    names = ["rule_20d_score", "rank_score", "blend_rule50", "entry_adjusted"]
    rows = {s: PF.evaluate_scores(scored.filter(F.col("split") == s), names, ks, "forward_20D_return") for s in ("valid", "test")}
    gate = scored.groupBy("split", "date").agg(F.max("entry_prob").alias("entry_prob"))
    keys = ["score_col", "top_k"]
    grid = PF.threshold_grid(rows["valid"].join(gate.filter("split = 'valid'").drop("split"), "date"), "entry_prob", [0.30 + 0.05 * i for i in range(11)], "portfolio_return", 12, by=tuple(keys))
    pick = grid.filter(F.col("invested_periods") >= min_trades).withColumn("o", F.round(PF.entry_objective(), 8)).groupBy(*keys).agg(F.max_by("threshold", F.struct("o", -F.col("threshold"))).alias("threshold"))
    test = rows["test"].join(gate.filter("split = 'test'").drop("split"), "date").join(pick, keys, "left")
    live = PF.gated(test, F.col("entry_prob") >= F.coalesce("threshold", F.lit(0.5)))
    perf = PF.performance(rows["test"], keys, "portfolio_return", 12, "universe_return").select(*keys, "periods", "cumulative_return", "avg_return", "MDD", "hit_excess")
    gated = PF.performance(live, keys, "strategy_return", 12, invested="invested").select(*keys, "invested_periods", F.col("cumulative_return").alias("gated_return"), F.col("MDD").alias("gated_MDD"))
    return perf.join(gated, keys, "left").join(pick, keys, "left")
