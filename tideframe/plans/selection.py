"""Selections over scored panels: baskets, weekly rank evaluation, strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, ratio
from tideframe.operators import panel as P, topk as T, xsec as S
from tideframe.session import checkpointed


def basket_scores(df: DataFrame, score: str, basket: str, top_means: dict[str, str], n: int = 5, keys=("date",), tie: str = "symbol") -> DataFrame:
    """Basket score: 0.55 x mean of the n best + 0.45 x mean of all, plus means over the n best."""
    w = Window.partitionBy(*keys, basket).orderBy(F.desc_nulls_last(score), tie)
    best = F.col("__rn") <= n
    return (df.withColumn("__rn", F.row_number().over(w)).groupBy(*keys, basket).agg(
        F.count(F.lit(1)).alias("n"),
        (0.55 * F.avg(F.when(best, F.col(score))) + 0.45 * F.avg(score)).alias("basket"),
        *[F.avg(F.when(best, F.col(c))).alias(a) for a, c in top_means.items()]))


def momentum_scores(prices: DataFrame, weights: dict[int, float], vol_weight: float = -0.20, w=None) -> DataFrame:
    """Weighted cross-sectional z of 5/20/60/120-row returns and of 20-row volatility."""
    w = w or R.by_entity()
    p = prices.withColumn("__r1", R.step_return("close", 1, w))
    p = p.withColumns({f"ret_{n}": R.step_return("close", n, w) for n in weights}
                      | {"vol_20": R.std("__r1", 20, w, 10)}
                      | {"fwd_1w": R.forward_return("close", 5, w), "fwd_1m": R.forward_return("close", 20, w)})
    d = S.by_date()
    parts = [S.z(f"ret_{n}", d) * float(k) for n, k in weights.items()] + [S.z("vol_20", d) * float(vol_weight)]
    score = parts[0]
    for x in parts[1:]:
        score = score + x
    return p.withColumn("score", F.round(score, 10)).drop("__r1")


MOMENTUM = {5: 0.20, 20: 0.35, 60: 0.30, 120: 0.15}


def weekly_rank_rows(prices: DataFrame, risk: DataFrame, k: int, block: float = 55.0) -> DataFrame:
    """Per week and horizon: gated momentum selection against what happened.

    ``risk``: one row per date (date, risk, regime), already known at the date.  The price panel
    gives both the week ends and the rows, so it is staged.
    """
    prices = checkpointed(prices)
    scored = P.at_rebalance(momentum_scores(prices, MOMENTUM), "W").join(risk, "date")
    scored = scored.withColumn("gate", 1 - clip(F.coalesce("risk", F.lit(0.0)) / 140.0, 0, 0.55)).filter(F.coalesce("risk", F.lit(0.0)) < block)
    scored = scored.withColumn("score", F.round(F.col("score") * F.col("gate"), 10))
    long = scored.select("date", "symbol", "regime", "gate", "score", F.explode(F.array(
        F.struct(F.lit("1w").alias("horizon"), F.col("fwd_1w").alias("fwd")), F.struct(F.lit("1m").alias("horizon"), F.col("fwd_1m").alias("fwd")))).alias("h"))
    long = long.select("*", "h.*").drop("h").filter(F.col("fwd").isNotNull())
    key = ("date", "horizon")
    pred = S.first_come_rank("score", key)
    act = S.first_come_rank("fwd", key)
    r = long.withColumns({"pr": pred, "ar": act})
    p_in, a_in = F.col("pr") <= k, F.col("ar") <= k
    g = r.groupBy("date", "horizon", "regime").agg(
        F.count(F.lit(1)).alias("names"), F.max("gate").alias("risk_gate"),
        F.avg(F.when(p_in, F.col("fwd"))).alias("topk_return"), F.avg("fwd").alias("universe_return"),
        F.avg(F.when(a_in, F.col("fwd"))).alias("actual_topk_return"),
        (F.sum((p_in & a_in).cast("int")) / k).alias("overlap"),
        F.max(((F.col("pr") == 1) & (F.col("ar") == 1)).cast("int")).alias("top1_exact"),
        F.max(((F.col("ar") == 1) & p_in).cast("int")).alias("actual_top1_in_topk"))
    return g.filter(F.col("names") >= k)


def weekly_rank_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horizon", "regime").agg(
        F.count(F.lit(1)).alias("weeks"), F.avg("topk_return").alias("avg_topk_return"),
        F.avg("universe_return").alias("avg_universe_return"), F.avg("actual_topk_return").alias("avg_actual_topk_return"),
        F.avg("overlap").alias("topk_overlap_rate"), F.avg("top1_exact").alias("top1_exact_rate"),
        F.avg("actual_top1_in_topk").alias("actual_top1_in_topk_rate"))


def fast_weekly_panel(prices: DataFrame) -> DataFrame:
    """Weekly momentum score, two probabilities and realised returns; rows without both returns drop out."""
    d = momentum_scores(prices, {5: 0.24, 20: 0.34, 60: 0.28, 120: 0.14}, -0.18)
    day = S.by_date()
    slow = 0.45 * S.z("ret_20", day) + 0.35 * S.z("ret_60", day) + 0.20 * S.z("ret_120", day)
    d = d.withColumns({"p1": clip(0.50 + 0.10 * F.col("score"), 0.05, 0.95), "p4": clip(0.50 + 0.12 * slow, 0.05, 0.95), "raw": F.col("score")})
    d = d.withColumn("score", clip(50.0 + 12.0 * F.col("raw"), 0, 100))
    return P.at_rebalance(d, "W").filter(F.col("fwd_1w").isNotNull() & F.col("fwd_1m").isNotNull())


def basket_evaluation(baskets: DataFrame, score: str, ret: str, basket: str) -> DataFrame:
    """Over dates with at least three baskets: return of the best-scored basket, mean, exact hit,
    actual best among the three best scored, overlap of the two top threes."""
    day = Window.partitionBy("date")
    d = baskets.withColumns({"n_b": F.count(F.lit(1)).over(day), "p": F.row_number().over(day.orderBy(F.desc(score), basket)), "a": F.row_number().over(day.orderBy(F.desc_nulls_last(ret), basket))})
    p, a = F.col("p"), F.col("a")
    g = d.filter("n_b >= 3").groupBy("date").agg(F.max(F.when(p == 1, F.col(ret))).alias("x"), F.avg(ret).alias("m"), F.count_if((p == 1) & (a == 1)).alias("h"),
                                                F.count_if((a == 1) & (p <= 3)).alias("i3"), (F.count_if((p <= 3) & (a <= 3)) / 3.0).alias("o"))
    return g.agg(F.count(F.lit(1)).alias("weeks"), F.avg("x").alias("pred_return"), F.avg("m").alias("mean_return"), F.avg("h").alias("top1_hit"), F.avg("i3").alias("in_top3"), F.avg("o").alias("overlap3"))
