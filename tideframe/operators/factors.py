"""Technical factors: daily columns as entity windows, then one row per symbol from the last
bars.  ``daily`` costs one shuffle on the symbol; every last-row factor is a conditional
aggregate over the last ``keep`` bars, so all of them share one pass.  No factor looks back further
than ``KEEP`` bars; one that would is an error rather than null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, flag, ratio
from tideframe.operators import folds, panel as P, topk as T

#: Bars kept per symbol; the longest look-back of the factors here is 252 bars.
KEEP = 260


def signed_flow(w: WindowSpec, sign: int) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = typical - F.lag(typical).over(w)
    return F.when((d > 0) if sign > 0 else (d < 0), typical * F.col("volume")).otherwise(0.0)


def money_flow(pos, neg, n: int, w: WindowSpec) -> Column:
    p, m = R.guarded(F.sum, pos, R.trailing(w, n), n), R.guarded(F.sum, neg, R.trailing(w, n), n)
    return ratio(100 * p, p + m)


def rsi(delta, n: int, w: WindowSpec) -> Column:
    d = col(delta)
    gain = R.mean(F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), n, w)
    loss = R.mean(F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), n, w)
    return 100 - ratio(F.lit(100.0), 1 + ratio(gain, loss))


def chaikin(n: int, w: WindowSpec) -> Column:
    h, l, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    flow = ratio((c - l) - (h - c), h - l) * v
    return ratio(R.guarded(F.sum, flow, R.trailing(w, n), n), R.guarded(F.sum, v, R.trailing(w, n), n))


def macd_hist(df: DataFrame, keys: tuple[str, ...] = ("symbol",), out: str = "macd_hist") -> DataFrame:
    d = folds.ema(folds.ema(df, "close", 12, "__f", keys), "close", 26, "__s", keys)
    d = folds.ema(d.withColumn("__m", F.col("__f") - F.col("__s")), "__m", 9, "__g", keys)
    return d.withColumn(out, F.col("__m") - F.col("__g")).drop("__f", "__s", "__m", "__g")


def daily(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with the per-day columns the factors need."""
    w = R.by_entity(*keys)
    d = bars.withColumns({"ret": R.step_return("close", 1, w), "delta": R.difference("close", 1, w), "dollar": F.col("close") * F.col("volume"),
                          "pos_flow": signed_flow(w, 1), "neg_flow": signed_flow(w, -1), "ma50": R.mean("close", 50, w), "vol10": R.mean("volume", 10, w)})
    d = d.withColumns({"mfi": money_flow("pos_flow", "neg_flow", 14, w), "rsi": rsi("delta", 14, w), "cmf": chaikin(21, w)})
    return folds.obv(d, keys=keys)


def last_bars(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), keep: int = KEEP) -> DataFrame:
    return T.last_rows(daily(bars, keys), keep, keys)


def enough(n: int, x: Column) -> Column:
    if n > KEEP:
        raise ValueError(f"a factor over {n} bars needs more than the {KEEP} bars kept")
    return F.when(F.max("rn") >= n, x)


def tail_avg(c: str, n: int, skip: int = 0) -> Column:
    return F.avg(F.when((F.col("rn") > skip) & (F.col("rn") <= n + skip), F.col(c)))


def volume_ratio(c: str, short: int, long: int) -> Column:
    return enough(long, ratio(tail_avg(c, short), tail_avg(c, long)))


def up_down_volume(n: int = 20) -> Column:
    s = lambda cond: F.sum(F.when((F.col("rn") <= n) & cond, F.col("volume")).otherwise(0.0))
    return enough(n + 1, ratio(s(F.col("ret") > 0), s(F.col("ret") < 0)))


def up_days_have_volume(n: int = 25) -> Column:
    """Mean volume of rising days above that of falling days within the last n closes."""
    m = lambda cond: F.avg(F.when((F.col("rn") < n) & cond, F.col("volume")))
    return enough(n, m(F.col("ret") > 0) > m(F.col("ret") < 0))


def heavy_days(sign: int, n: int = 20) -> Column:
    """Days beyond 1.5% on more volume than the 10-bar mean taken inside the n + 1 bars."""
    move = F.col("ret") > 0.015 if sign > 0 else F.col("ret") < -0.015
    return enough(n + 1, F.count_if((F.col("rn") <= n - 8) & move & (F.col("volume") > F.col("vol10"))))


def price_volume_cv() -> Column:
    x = T.tail("dollar", 21)
    return enough(20, ratio(F.stddev_pop(x), F.avg(x)))


def linear_slope(c: str, n: int) -> Column:
    """OLS slope over the last n bars in percent of their mean (at least 20 bars)."""
    x, t = T.tail(c, n), -F.col("rn").cast("double")
    return enough(20, ratio(F.regr_slope(x, t), F.avg(x)) * 100)


def overheat(r3, r6, r12, hp) -> Column:
    r3, r6, r12, hp = col(r3), col(r6), col(r12), col(hp)
    zero = F.lit(0.0)
    pts = (F.when(r12 > 120, F.least(F.lit(12.0), (r12 - 120) / 15)).otherwise(zero) + F.when(r3 > 45, F.least(F.lit(10.0), (r3 - 45) / 7)).otherwise(zero)
           + F.when((hp >= 0.98) & (r3 > 25), 5.0).otherwise(zero) + F.when((r6 > 0) & (r3 > 30) & (F.try_divide(r3, r6) > 0.75), 4.0).otherwise(zero))
    return F.round(F.least(F.lit(25.0), pts), 4)


def trend_template() -> Column:
    """Seven moving-average and 52-week checks, scaled to 17."""
    p, m50, m150, m200 = T.at_back("close", 1), tail_avg("close", 50), tail_avg("close", 150), tail_avg("close", 200)
    m200_then = enough(221, tail_avg("close", 200, 21))
    hi, lo = F.max(T.tail("close", 252)), F.min(T.tail("close", 252))
    checks = [(p > m150) & (p > m200), m150 > m200, m200 > m200_then, (m50 > m150) & (m50 > m200), p > m50, p >= lo * 1.3, p >= hi * 0.75]
    points = flag(checks[0])
    for c in checks[1:]:
        points = points + flag(c)
    return enough(200, points / 7 * 17)


def ma_reclaim(n: int = 50, lookback: int = 20) -> Column:
    below = F.max(F.when((F.col("rn") <= lookback) & (F.col("close") < F.col("ma50")), 1).otherwise(0)) == 1
    p, m = T.at_back("close", 1), T.at_back("ma50", 1)
    return enough(n + lookback, F.when((p > m) & below, 100.0).when(p > m, 60.0).otherwise(0.0))


def base_breakout() -> Column:
    p = T.at_back("close", 1)
    prior = F.max(F.when((F.col("rn") >= 2) & (F.col("rn") <= 61), F.col("close")))
    vr = ratio(tail_avg("volume", 20), tail_avg("volume", 60))
    return enough(80, F.when((p > prior) & (vr > 1.2), 100.0).when(p > prior, 75.0).when(p > prior * 0.95, 50.0).otherwise(0.0))


def trading_value(n: int) -> Column:
    return F.sum(T.tail("dollar", n))


FACTORS = {
    "return_3m": lambda: T.sessions_return("close", 63), "return_6m": lambda: T.sessions_return("close", 126), "return_12m": lambda: T.sessions_return("close", 252),
    "mfi_14": lambda: T.at_back("mfi", 1), "rsi_14": lambda: T.at_back("rsi", 1), "cmf_21": lambda: T.at_back("cmf", 1),
    "dollar_volume_ratio_20_120": lambda: volume_ratio("dollar", 20, 120), "relative_volume_20_60": lambda: volume_ratio("volume", 20, 60),
    "up_down_volume_ratio_20d": up_down_volume, "up_days_have_volume": up_days_have_volume,
    "accumulation_days_20d": lambda: heavy_days(1), "distribution_days_20d": lambda: heavy_days(-1),
    "volume_price_cv_1m": price_volume_cv, "trend_line_cps": lambda: linear_slope("close", 126), "obv_slope_60d": lambda: linear_slope("obv", 60),
    "obv_high_proximity": lambda: ratio(T.at_back("obv", 1), F.max(T.tail("obv", 120))),
    "minervini_qm_score": trend_template, "ma50_reclaim_score": ma_reclaim, "base_breakout_score": base_breakout,
    "close": lambda: T.at_back("close", 1), "high_52w": lambda: F.max(T.tail("close", 252)), "low_52w": lambda: F.min(T.tail("close", 252)),
    "trading_value_20d": lambda: trading_value(20), "trading_value_60d": lambda: trading_value(60),
    "ma50": lambda: enough(50, tail_avg("close", 50)), "ma150": lambda: enough(150, tail_avg("close", 150)), "ma200": lambda: enough(200, tail_avg("close", 200)),
    "ma200_then": lambda: enough(221, tail_avg("close", 200, 21)), "bars": lambda: F.max("rn"),
}


def factors(bars: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per symbol; every named factor from one aggregate."""
    names = names or list(FACTORS)
    return last_bars(bars, keys).groupBy(*keys).agg(*[FACTORS[n]().alias(n) for n in names])


def with_derived(df: DataFrame) -> DataFrame:
    hp = ratio("close", "high_52w")
    d = df.withColumns({"high_proximity": hp, "drawdown_from_52w_high": (ratio("high_52w", "close") - 1) * 100})
    return d.withColumn("overheat_penalty", overheat("return_3m", "return_6m", "return_12m", "high_proximity"))


# --- pivots and divergence -------------------------------------------------------------

def pivots(df: DataFrame, order: int, keys: list[str], date: str = "date") -> DataFrame:
    """Rows with ``low_pivot`` / ``high_pivot``: local extremes inside a full frame of +-order rows."""
    w = Window.partitionBy(*keys).orderBy(date)
    f = w.rowsBetween(-order, order)
    full = F.count(F.lit(1)).over(f) == 2 * order + 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = df.withColumns({"pos": F.row_number().over(w) - 1, "n": n, "__full": full, "__lo": F.min("low").over(f), "__hi": F.max("high").over(f)})
    return d.withColumns({"low_pivot": F.col("__full") & (F.col("low") == F.col("__lo")), "high_pivot": F.col("__full") & (F.col("high") == F.col("__hi"))}).drop("__full", "__lo", "__hi")


INDICATORS = ["rsi", "macd_hist", "obv", "mfi", "cmf"]


def divergence(bars: DataFrame, order: int, recent: int, prefix: str) -> DataFrame:
    """Bullish and bearish divergence points per symbol: the last two price pivots against the
    indicator at the same bars, 25 points regular and 15 hidden per indicator, capped at 100."""
    d = macd_hist(daily(bars))
    long = d.select("symbol", "date", "low", "high", F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("value")) for i in INDICATORS])).alias("r"))
    long = long.select("symbol", "date", "low", "high", "r.indicator", "r.value").filter(F.col("value").isNotNull())
    p = pivots(long, order, ["symbol", "indicator"]).filter((F.col("low_pivot") | F.col("high_pivot")) & (F.col("n") >= 8))
    side = p.select("symbol", "indicator", "n", "pos", F.explode(F.array(
        F.when(F.col("low_pivot"), F.struct(F.lit("low").alias("side"), F.col("low").alias("price"), F.col("value"))),
        F.when(F.col("high_pivot"), F.struct(F.lit("high").alias("side"), F.col("high").alias("price"), F.col("value"))))).alias("s")).filter("s is not null")
    w = Window.partitionBy("symbol", "indicator", "side").orderBy(F.desc("pos"))
    two = side.select("symbol", "indicator", "n", "pos", "s.*").withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pair = two.groupBy("symbol", "indicator", "side").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("rn") == 1, F.col("n") - 1 - F.col("pos"))).alias("age"),
                                                          *[T.at_back(c, i).alias(f"{c}{i}") for c in ("price", "value") for i in (1, 2)])
    ok = (F.col("k") == 2) & (F.col("age") <= recent + order)
    up_price, up_value = F.col("price1") > F.col("price2"), F.col("value1") > F.col("value2")
    dn_price, dn_value = F.col("price1") < F.col("price2"), F.col("value1") < F.col("value2")
    low, high = ok & (F.col("side") == "low"), ok & (F.col("side") == "high")
    pts = lambda reg, hid: F.least(F.lit(100.0), F.sum(F.when(reg, 25.0).otherwise(0.0) + F.when(hid, 15.0).otherwise(0.0)))
    got = pair.groupBy("symbol").agg(pts(low & dn_price & up_value, low & up_price & dn_value).alias("bull"), pts(high & up_price & dn_value, high & dn_price & up_value).alias("bear"))
    size = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("__bars"))
    out = size.join(got, "symbol", "left")
    enough_bars = F.col("__bars") >= max(12, order * 4 + recent)
    return out.select("symbol", *[F.when(enough_bars, F.coalesce(c, F.lit(0.0))).alias(f"{prefix}_{n}_divergence_score") for c, n in (("bull", "bullish"), ("bear", "bearish"))])


def divergence_scores(bars: DataFrame, min_bars: int = 80) -> DataFrame:
    wk = divergence(P.resample_bars(bars, "W"), 2, 5, "weekly")
    mo = divergence(P.resample_bars(bars, "M"), 1, 4, "monthly")
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"))
    d = n.join(wk, "symbol").join(mo, "symbol")
    cols = [c for c in d.columns if c.endswith("_score")]
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    net = z("weekly_bullish_divergence_score") + z("monthly_bullish_divergence_score") - z("weekly_bearish_divergence_score") - z("monthly_bearish_divergence_score")
    keep = F.col("__n") >= min_bars
    return d.select("symbol", *[F.when(keep, F.col(c)).alias(c) for c in cols], F.when(keep, net).alias("divergence_net_score"))


# --- panel scores -----------------------------------------------------------------------

def technical_panel(prices: DataFrame, with_slope: bool = True, min_rows: int = 0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per (symbol, date): returns, volatility, drawdown, bounded technical score and risk penalty,
    each from data up to the date.  The weekly form leaves the slope out and is 50 before
    ``min_rows`` rows; an unknown score is 50."""
    w = R.by_entity(*keys)
    d = prices.withColumns({"ret": R.step_return("close", 1, w), "pos": F.row_number().over(w), "lc": F.when(F.col("close") > 0, F.log("close"))})
    d = d.withColumns({f"ret_{n}": R.step_return("close", n, w) for n in (5, 20, 60, 120)} | {
        "vol20": R.annual_vol("ret", 20, w), "dd252": ratio("close", F.max("close").over(R.trailing(w, 252))) - 1,
        "ma_dist": F.coalesce(ratio("close", R.mean("close", 200, w)) - 1, F.lit(0.0)), "speed": R.slope("lc", "pos", 20, w)})
    edge = 3.0 * F.col("ret_20") + 2.0 * F.col("ret_60") + 1.2 * F.col("ret_120") + F.col("ma_dist") - 0.8 * clip(F.col("vol20") - 0.20, 0)
    if with_slope:
        edge = edge + 18.0 * F.col("speed")
    score = F.coalesce(clip(50 + 42 * F.tanh(edge), 0, 100), F.lit(50.0))
    score = F.when(F.col("pos") >= min_rows, score).otherwise(50.0)
    return d.withColumns({"technical_score": score, "risk_penalty": risk_penalty("vol20", "dd252")}).drop("lc", "speed")


def risk_penalty(vol, drawdown) -> Column:
    return clip((col(vol) - 0.18) * 25 + F.abs(col(drawdown)) * 15, 0, 18)


def ema_features(prices: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trend flags, spreads, slopes and distance of the 4/6/20 exponential means."""
    w = R.by_entity(*keys)
    d = prices
    for s in (4, 6, 20):
        d = folds.ema(d, "close", s, f"ema{s}", keys, min_periods=s)
    e4, e6, e20 = (F.col(f"ema{s}") for s in (4, 6, 20))
    return d.withColumns({
        "ema_trend": flag((e4 > e6) & (e6 > e20)), "close_above_ema20": flag(F.col("close") > e20), "ema4_gt_ema6": flag(e4 > e6), "ema6_gt_ema20": flag(e6 > e20),
        "ema4_ema6_spread": ratio(e4, e6) - 1, "ema6_ema20_spread": ratio(e6, e20) - 1, "dist_to_ema20": ratio("close", e20) - 1,
        "ema4_slope3": R.step_return("ema4", 3, w), "ema6_slope5": R.step_return("ema6", 5, w), "ema20_slope10": R.step_return("ema20", 10, w)})
