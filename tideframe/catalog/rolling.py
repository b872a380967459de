"""2.5 Time-series windows."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, ratio
from tideframe.operators import panel as P, ranks as RK, states
from tideframe.plans.fixtures import BRAND, DRIVERS, ETF, MARKET, RISK, WEEKLY



def over(expr, frame="", part="symbol", order="date"):
    p = f"PARTITION BY {part} " if part else ""
    return f"{expr} OVER ({p}ORDER BY {order} {frame})"


def rows(n):
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def g(agg, x, n, mp=None, part="symbol"):
    """Guarded rolling aggregate in SQL."""
    return f"CASE WHEN {over(f'count({x})', rows(n), part)} >= {mp or n} THEN {over(f'{agg}({x})', rows(n), part)} END"


def lag(x, n, part="symbol"):
    return over(f"lag({x},{n})", "", part)


def zs(x, n, mp=None, part="symbol"):
    return f"(({x})-({g('avg', x, n, mp, part)}))/nullif({g('stddev_samp', x, n, mp, part)},0)"


def px(*exprs, src=BRAND, keys="date, symbol"):
    return f"SELECT {keys}, {', '.join(exprs)} FROM {src}"


def sel(t, *cols, src="brand"):
    return getattr(t, src).select("date", "symbol", *cols)


@query("wn01_n_period_return", fin("date symbol r5 r20", px(f"close/{lag('close', 5)}-1 AS r5", f"close/{lag('close', 20)}-1 AS r20")))
def _(t):
    return sel(t, R.step_return("close", 5, R.by_entity()).alias("r5"), R.step_return("close", 20, R.by_entity()).alias("r20"))


GAPPY = f"(SELECT date, symbol, CASE WHEN day(date) % 7 = 3 THEN NULL ELSE close END AS close FROM {BRAND})"


def gappy(t):
    return t.brand.withColumn("close", F.when(F.dayofmonth("date") % 7 != 3, F.col("close")))


@query("wn02_padded_pct_change", fin("date symbol chg", f"SELECT date, symbol, f/{lag('f', 5)}-1 AS chg FROM (SELECT *, "
       + over("last_value(close IGNORE NULLS)", "ROWS UNBOUNDED PRECEDING") + f" AS f FROM {GAPPY})"))
def _(t):
    p = gappy(t).withColumn("f", R.padded("close", R.by_entity()))
    return p.select("date", "symbol", R.step_return("f", 5, R.by_entity()).alias("chg"))


@query("wn03_n_period_difference", fin("date driver:s d5 d20", f"SELECT date, driver, level-{lag('level', 5, 'driver')} AS d5, level-{lag('level', 20, 'driver')} AS d20 FROM {DRIVERS}"))
def _(t):
    w = R.by_entity("driver")
    return t.drivers.select("date", "driver", R.difference("level", 5, w).alias("d5"), R.difference("level", 20, w).alias("d20"))


@query("wn04_forward_return", fin("date symbol f5 f20", px(f"{over('lead(close,5)')}/close-1 AS f5", f"{over('lead(close,20)')}/close-1 AS f20")))
def _(t):
    return sel(t, R.forward_return("close", 5, R.by_entity()).alias("f5"), R.forward_return("close", 20, R.by_entity()).alias("f20"))


_AH = "ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING"


@query("wn05_forward_min_strict", fin("date symbol m20", px(
    f"CASE WHEN {over('count(close)', _AH)}>=10 AND {over('lead(1,19)')} IS NOT NULL THEN {over('min(close)', _AH)}/close-1 END AS m20")))
def _(t):
    return sel(t, R.forward_min_strict("close", 20, R.by_entity()).alias("m20"))


@query("wn06_forward_min_any", fin("date symbol m20", px(f"{over('min(close)', _AH)}/close-1 AS m20")))
def _(t):
    return sel(t, R.forward_min_any("close", 20, R.by_entity()).alias("m20"))


@query("wn07_portfolio_path_minimum", fin("date n:i path_min", f"""
WITH p AS (SELECT date, symbol, score, {', '.join(f"{over(f'lead(close,{i})')}/close-1 AS s{i}" for i in range(1, 6))} FROM
 (SELECT e.date, e.symbol, close, score FROM {ETF} e LEFT JOIN (SELECT date AS d2, symbol AS s2, score FROM {WEEKLY}) k ON date=d2 AND symbol=s2)),
 k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM p WHERE score IS NOT NULL)
SELECT date, count(*) AS n, least({', '.join(f'avg(s{i})' for i in range(1, 6))}) AS path_min FROM k WHERE rn<=3 GROUP BY date"""))
def _(t):
    steps = t.etf.select("date", "symbol", *[R.forward_return("close", i, R.by_entity()).alias(f"s{i}") for i in range(1, 6)])
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol"))
    picks = t.weekly.select("date", "symbol", rn.alias("rn")).filter("rn <= 3")
    return picks.join(steps, ["date", "symbol"]).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.least(*[F.avg(f"s{i}") for i in range(1, 6)]).alias("path_min"))


@query("wn08_rolling_mean", fin("date symbol ma20 ma60", px(f"{g('avg', 'close', 20)} AS ma20", f"{g('avg', 'close', 60, 45)} AS ma60")))
def _(t):
    return sel(t, R.mean("close", 20, R.by_entity()).alias("ma20"), R.mean("close", 60, R.by_entity(), 45).alias("ma60"))


@query("wn09_high_proximity", fin("date symbol hp252 dist60", px(f"close/({g('max', 'close', 252, 180)}) AS hp252", f"close/({g('max', 'close', 60, 20)})-1 AS dist60")))
def _(t):
    return sel(t, ratio("close", R.high("close", 252, R.by_entity(), 180)).alias("hp252"), (ratio("close", R.high("close", 60, R.by_entity(), 20)) - 1).alias("dist60"))


_RET = f"(SELECT *, close/{lag('close', 1)}-1 AS ret FROM {BRAND})"


def with_ret(df):
    return df.withColumn("ret", R.step_return("close", 1, R.by_entity()))


@query("wn10_annualised_volatility", fin("date symbol vol20 vol60", px(f"({g('stddev_samp', 'ret', 20)})*sqrt(252.0) AS vol20", f"({g('stddev_samp', 'ret', 60, 20)})*sqrt(252.0) AS vol60", src=_RET)))
def _(t):
    return with_ret(t.brand).select("date", "symbol", R.annual_vol("ret", 20, R.by_entity()).alias("vol20"), R.annual_vol("ret", 60, R.by_entity(), 20).alias("vol60"))


@query("wn11_rolling_zscore", fin("date symbol z20 z60", px(f"{zs('close', 20)} AS z20", f"{zs('close', 60)} AS z60")))
def _(t):
    return sel(t, R.zscore("close", 20, R.by_entity()).alias("z20"), R.zscore("close", 60, R.by_entity()).alias("z60"))


@query("wn12_rolling_zscore_min_periods", fin("date symbol za zb", px(f"{zs('close', 60, 20)} AS za", f"{zs('close', 252, 84)} AS zb")))
def _(t):
    return sel(t, R.zscore("close", 60, R.by_entity(), R.loose_min_periods(60, 10)).alias("za"), R.zscore("close", 252, R.by_entity(), R.loose_min_periods(252, 20)).alias("zb"))


_POS = f"(SELECT *, {over('row_number()')} AS pos FROM {BRAND})"
_REL = f"""(SELECT b.date, symbol, b.close, m.close AS bench, ln(b.close/m.close) AS lr, {over('row_number()', order='b.date')} AS pos
 FROM {BRAND} b JOIN {MARKET} m ON b.date=m.date)"""


@query("wn13_rolling_slope", fin("date symbol slope20 rs_slope20", px(*[
    f"CASE WHEN {over(f'count({c})', rows(20))}=20 THEN {over(f'regr_slope({c},pos)', rows(20))} END AS {a}" for c, a in (("close", "slope20"), ("lr", "rs_slope20"))], src=_REL), 5))
def _(t):
    j = t.brand.join(t.market.withColumnRenamed("close", "bench"), "date")
    j = j.withColumns({"lr": R.log_ratio("close", "bench"), "pos": F.row_number().over(R.by_entity())})
    return j.select("date", "symbol", *[F.round(R.slope(c, "pos", 20, R.by_entity()), 5).alias(a) for c, a in (("close", "slope20"), ("lr", "rs_slope20"))])


@query("wn14_rolling_percentile_rank", fin("date symbol pr", f"""SELECT date, symbol, CASE WHEN len(v)>=60 THEN
 (len(list_filter(v, lambda x: x<close)) + (len(list_filter(v, lambda x: x=close))+1)/2.0)/len(v) END AS pr
 FROM (SELECT date, symbol, close, {over('list(close)', rows(252))} AS v FROM {BRAND})"""))
def _(t):
    d = RK.ranked(t.brand, {"f": ("close", 252, True)}, ("symbol",))
    return d.select("date", "symbol", RK.percentile_rank("f", "close", 60).alias("pr"))


@query("wn15_trailing_percentile", fin("date symbol tp", f"""SELECT date, symbol, CASE WHEN len(v)>=189 THEN
 len(list_filter(v, lambda x: x<=close))::DOUBLE/len(v) END AS tp
 FROM (SELECT date, symbol, close, {over('list(close)', 'ROWS BETWEEN 756 PRECEDING AND 1 PRECEDING')} AS v FROM {BRAND})"""))
def _(t):
    d = RK.ranked(t.brand, {"f": ("close", 756, False)}, ("symbol",))
    return d.select("date", "symbol", RK.share_not_above("f", "close", 189).alias("tp"))


@query("wn16_expanding_percentile", fin("date ep", f"""SELECT date, CASE WHEN len(v)>=26 THEN len(list_filter(v, lambda x: x<=close))::DOUBLE/len(v) END AS ep
 FROM (SELECT date, close, {over('list(close)', 'ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING', '')} AS v FROM {MARKET})"""))
def _(t):
    return RK.ranked(t.market, {"f": ("close", None, False)}).select("date", RK.share_not_above("f", "close", 26).alias("ep"))


_MV = f"(SELECT *, level-{lag('level', 1, 'driver')} AS mv FROM {DRIVERS})"


def shock_sql(part="driver"):
    sd = f"nullif({g('stddev_samp', 'mv', 252, 60, part)},0)"
    z5 = f"({g('sum', 'mv', 5, 3, part)})/({sd}*sqrt(5.0))"
    z20 = f"({g('sum', 'mv', 20, 10, part)})/({sd}*sqrt(20.0))"
    return f"least(100, 32.0*greatest(0, greatest(mv/{sd}, {z5}, {z20})))"


@query("wn17_scaled_move_shock", fin("date driver:s shock", f"SELECT date, driver, CASE WHEN greatest(mv/nullif({g('stddev_samp', 'mv', 252, 60, 'driver')},0), "
       f"({g('sum', 'mv', 5, 3, 'driver')})/nullif({g('stddev_samp', 'mv', 252, 60, 'driver')},0)) IS NOT NULL THEN {shock_sql()} END AS shock FROM {_MV}"))
def _(t):
    from tideframe.operators.stress import shock
    w = R.by_entity("driver")
    d = t.drivers.withColumn("mv", R.difference("level", 1, w))
    return d.select("date", "driver", shock("mv", 1.0, w).alias("shock"))


@query("wn18_rolling_drawdown", fin("date symbol dd60 dd252", px(f"close/({g('max', 'close', 60, 15)})-1 AS dd60", f"close/({g('max', 'close', 252, 63)})-1 AS dd252")))
def _(t):
    return sel(t, R.drawdown("close", 60, R.by_entity()).alias("dd60"), R.drawdown("close", 252, R.by_entity()).alias("dd252"))


_TOP = f"""(SELECT date, avg(r) AS r FROM (SELECT date, least(0.2,greatest(-0.2,coalesce(ret_1w,0)))*0.05 AS r, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM {WEEKLY}) WHERE rn<=3 GROUP BY date)"""


def top_returns(t):
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol"))
    r = clip(F.coalesce("ret_1w", F.lit(0.0)), -0.2, 0.2) * 0.05
    return t.weekly.select("date", r.alias("r"), rn.alias("rn")).filter("rn <= 3").groupBy("date").agg(F.avg("r").alias("r"))


@query("wn19_equity_curve", fin("date equity", f"SELECT date, exp(sum(ln(1+r)) OVER (ORDER BY date)) AS equity FROM {_TOP}"))
def _(t):
    return top_returns(t).select("date", R.equity("r", R.day()).alias("equity"))


@query("wn20_maximum_drawdown", fin("mdd", f"SELECT min(e/m-1) AS mdd FROM (SELECT e, max(e) OVER (ORDER BY date) AS m FROM (SELECT date, exp(sum(ln(1+r)) OVER (ORDER BY date)) AS e FROM {_TOP}))"))
def _(t):
    e = top_returns(t).select("date", R.equity("r", R.day()).alias("e"))
    return e.select(R.off_peak("e", R.day()).alias("d")).agg(F.min("d").alias("mdd"))


def _gp(agg, n, mp):
    f = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"CASE WHEN {over('count(r)', f, '')}>={mp} THEN {over(f'{agg}(r)', f, '')} END"


@query("wn21_weekly_lag_features", fin("date lag1 lag2 m4 m8 lo4 hi4 chg1 chg4 accel", f"""SELECT date, {lag('r', 1, '')} AS lag1, {lag('r', 2, '')} AS lag2,
 {_gp('avg', 4, 2)} AS m4, {_gp('avg', 8, 3)} AS m8, {_gp('min', 4, 2)} AS lo4, {_gp('max', 4, 2)} AS hi4,
 r-{lag('r', 1, '')} AS chg1, r-{lag('r', 4, '')} AS chg4, (r-{lag('r', 1, '')})-({lag('r', 1, '')}-{lag('r', 2, '')}) AS accel FROM {_TOP}"""))
def _(t):
    gp = lambda agg, n, mp: R.guarded(agg, "r", R.prior(R.day(), n), mp)
    d1 = R.difference("r", 1, R.day())
    return top_returns(t).select("date", F.lag("r", 1).over(R.day()).alias("lag1"), F.lag("r", 2).over(R.day()).alias("lag2"),
                                 gp(F.avg, 4, 2).alias("m4"), gp(F.avg, 8, 3).alias("m8"), gp(F.min, 4, 2).alias("lo4"),
                                 gp(F.max, 4, 2).alias("hi4"), d1.alias("chg1"), R.difference("r", 4, R.day()).alias("chg4"),
                                 (d1 - (F.lag("r", 1).over(R.day()) - F.lag("r", 2).over(R.day()))).alias("accel"))


_GRID = f"""(SELECT c.date, s.symbol, b.close FROM (SELECT DISTINCT date FROM {BRAND}) c CROSS JOIN (SELECT DISTINCT symbol FROM {BRAND}) s
 LEFT JOIN {BRAND} b ON b.date=c.date AND b.symbol=s.symbol)"""


@query("wn22_limited_forward_fill", fin("date symbol close", px(f"{over('last_value(close IGNORE NULLS)', 'ROWS BETWEEN 5 PRECEDING AND CURRENT ROW')} AS close", src=_GRID)))
def _(t):
    return P.on_calendar(t.brand, "close", limit=5).select("date", "symbol", "close")


@query("wn23_fill_both_ways", fin("date symbol f b", px(f"{over('last_value(close IGNORE NULLS)', 'ROWS UNBOUNDED PRECEDING')} AS f",
       f"{over('first_value(close IGNORE NULLS)', 'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS b", src=GAPPY)))
def _(t):
    return gappy(t).select("date", "symbol", R.padded("close", R.by_entity()).alias("f"), R.back_filled("close", R.by_entity()).alias("b"))


@query("wn24_prior_state_stats", fin("date symbol ret_1w_state_mean_prior ret_1w_state_hit_prior ret_1w_state_count_prior:i", f"""
SELECT date, symbol, avg(ret_1w) OVER f AS ret_1w_state_mean_prior, avg(CASE WHEN ret_1w IS NOT NULL THEN (ret_1w>0)::INT END) OVER f AS ret_1w_state_hit_prior,
 count(*) OVER f AS ret_1w_state_count_prior FROM {WEEKLY}
WINDOW f AS (PARTITION BY floor(score/10) ORDER BY date, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def _(t):
    return states.prior_state_stats(t.weekly.withColumn("state", F.floor(F.col("score") / 10)), "state", "ret_1w").select(
        "date", "symbol", "ret_1w_state_mean_prior", "ret_1w_state_hit_prior", "ret_1w_state_count_prior")


_JR = f"""(SELECT a.date, symbol, a.ret, m.mret FROM {_RET} a JOIN (SELECT date, close/{lag('close', 1, '')}-1 AS mret FROM {MARKET}) m ON a.date=m.date
 WHERE a.ret IS NOT NULL AND m.mret IS NOT NULL)"""


def joint_returns(t):
    m = t.market.select("date", R.step_return("close", 1, R.day()).alias("mret"))
    return with_ret(t.brand).join(m, "date").filter(F.col("ret").isNotNull() & F.col("mret").isNotNull())


@query("wn25_rolling_beta", fin("date symbol beta", px(f"CASE WHEN {over('count(*)', rows(60))}>=30 THEN {over('covar_samp(ret,mret)', rows(60))}/{over('var_samp(mret)', rows(60))} END AS beta", src=_JR)))
def _(t):
    return joint_returns(t).select("date", "symbol", R.beta("ret", "mret", 60, R.by_entity(), 30).alias("beta"))


@query("wn26_benchmark_beta_correlation", fin("symbol beta corr n:i", f"""SELECT symbol, CASE WHEN count(*)>=30 THEN regr_slope(ret,mret) END AS beta,
 CASE WHEN count(*)>=30 THEN corr(ret,mret) END AS corr, count(*) AS n FROM (SELECT *, {over('row_number()', order='date DESC')} AS rn FROM {_JR}) WHERE rn<=252 GROUP BY symbol"""))
def _(t):
    from tideframe.operators.topk import last_rows
    x = last_rows(joint_returns(t), 252)
    ok = F.count(F.lit(1)) >= 30
    return x.groupBy("symbol").agg(F.when(ok, F.regr_slope("ret", "mret")).alias("beta"), F.when(ok, F.corr("ret", "mret")).alias("corr"),
                                   F.count(F.lit(1)).alias("n"))


@query("wn27_sessions_return", fin("symbol r63", f"""SELECT symbol, CASE WHEN max(rn)>63 THEN (max(close) FILTER (rn=1)/max(close) FILTER (rn=63)-1)*100 END AS r63
 FROM (SELECT symbol, close, {over('row_number()', order='date DESC')} AS rn FROM {BRAND}) GROUP BY symbol"""))
def _(t):
    from tideframe.operators.topk import last_rows, sessions_return
    x = last_rows(t.brand, 64)
    return x.groupBy("symbol").agg(sessions_return("close", 63).alias("r63"))


@query("wn28_trailing_return_at_end", fin("symbol r20 r20_or_zero", f"""SELECT symbol, max(close) FILTER (rn=1)/max(close) FILTER (rn=21)-1 AS r20,
 coalesce(max(close) FILTER (rn=1)/max(close) FILTER (rn=21)-1, 0) AS r20_or_zero
 FROM (SELECT symbol, close, {over('row_number()', order='date DESC')} AS rn FROM {BRAND}) GROUP BY symbol"""))
def _(t):
    from tideframe.operators.topk import at_back, last_rows
    r = ratio(at_back("close", 1), at_back("close", 21)) - 1
    return last_rows(t.brand, 21).groupBy("symbol").agg(r.alias("r20"), F.coalesce(r, F.lit(0.0)).alias("r20_or_zero"))


@query("wn29_relative_strength", fin("date symbol rel rs20", f"SELECT date, symbol, close/bench AS rel, (close/{lag('close', 20)}-1)-(bench/{lag('bench', 20)}-1) AS rs20 FROM {_REL}"))
def _(t):
    j = t.brand.join(t.market.withColumnRenamed("close", "bench"), "date")
    return j.select("date", "symbol", ratio("close", "bench").alias("rel"), (R.step_return("close", 20, R.by_entity()) - R.step_return("bench", 20, R.by_entity())).alias("rs20"))


@query("wn30_embedding_drift", fin("vec_id:i drift", """WITH d AS (SELECT a.vec_id, CASE WHEN b.vec_id IS NOT NULL THEN
 sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE-p[2]::DOUBLE)*(p[1]::DOUBLE-p[2]::DOUBLE)))) END AS d
 FROM embeddings a LEFT JOIN embeddings b ON b.vec_id=a.vec_id-1)
SELECT vec_id, CASE WHEN count(d) OVER f >= 20 THEN avg(d) OVER f END AS drift FROM d
 WINDOW f AS (ORDER BY vec_id RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)""", 5))
def _(t):
    from tideframe.operators.analogs import embedding_drift
    return embedding_drift(t.embeddings, "vec_id", "embedding", 20).select("vec_id", F.round("drift", 5).alias("drift"))
