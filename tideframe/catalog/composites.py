"""2.12 Composite scores and panels."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.rolling import g, lag, over, rows, zs
from tideframe.catalog.xsec import zsql
from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, ratio
from tideframe.operators import aggregates as G, asof as A, factors as FA, folds as FO, panel as P, ranks as RK, topk as T, xsec as S
from tideframe.operators.thresholds import stage_of
from tideframe.plans import assets as AS, leadership as L, risk_vector as RV, safe as SF, sentinel as SE
from tideframe.plans.fixtures import BRAND, DRIVERS, ETF, HOLDINGS, MARKET, REGIME, RISK, WEEKDAYS, WEEKLY

# Stand-ins: part type -> (driver role, component, mode, direction).
ROLES = {"ECONOMY": ("VIX", "volatility", "diff", 1.0), "STANDARD": ("HY_OAS", "credit", "diff", 1.0), "PROMO": ("NASDAQ100", "equity", "return", -1.0),
         "MEDIUM": ("DXY", "fx", "return", 1.0), "SMALL": ("WTI", "supply_shock", "return", 1.0), "LARGE": ("GOLD", "hedge_bid", "return", 1.0)}


def specs(t):
    rows_ = [(d, c, m, s, 1.0, m, s > 0) for d, (_, c, m, s) in ROLES.items()]
    return t.spark.createDataFrame(rows_, "driver string, component string, mode string, direction double, weight double, transform string, higher_is_risk_on boolean")


def wide(t):
    p = t.drivers.groupBy("date").pivot("driver", list(ROLES)).agg(F.first("level"))
    return p.select("date", *[F.col(d).alias(r[0]) for d, r in ROLES.items()])


WIDE = "(SELECT date, " + ", ".join(f"max(level) FILTER (driver='{d}') AS {r[0]}" for d, r in ROLES.items()) + f" FROM {DRIVERS} GROUP BY date)"


def shocks(t):
    d = SE.shock_scores(t.drivers, specs(t)).filter("shock is not null")
    x = d.groupBy("date").pivot("driver", list(ROLES)).agg(F.first("shock"))
    cols = [F.col(d).alias(f"{r[0]}_shock_score") for d, r in ROLES.items()] + [F.col(d).alias(f"{r[1]}_score") for d, r in ROLES.items()]
    return x.select("date", *cols)


_mv = " ".join(f"WHEN '{d}' THEN {s}*({'level-{l}' if m == 'diff' else 'level/{l}-1'})" for d, (_, _, m, s) in ROLES.items()).replace("{l}", lag("level", 1, "driver"))
_sd = f"nullif({g('stddev_samp', 'mv', 252, 60, 'driver')},0)"
_SL = f"""(SELECT date, driver, least(100,greatest(0,32.0*greatest(mv/{_sd}, ({g('sum', 'mv', 5, 3, 'driver')})/({_sd}*sqrt(5.0)), ({g('sum', 'mv', 20, 10, 'driver')})/({_sd}*sqrt(20.0))))) AS shock,
 greatest(mv/{_sd}, ({g('sum', 'mv', 5, 3, 'driver')})/({_sd}*sqrt(5.0)), ({g('sum', 'mv', 20, 10, 'driver')})/({_sd}*sqrt(20.0))) AS raw FROM (SELECT date, driver, CASE driver {_mv} END AS mv FROM {DRIVERS}))"""
SHOCKS = "(SELECT date, " + ", ".join(f"max(shock) FILTER (driver='{d}') AS {r[0]}_shock_score, max(shock) FILTER (driver='{d}') AS {r[1]}_score" for d, r in ROLES.items()) + f" FROM {_SL} WHERE raw IS NOT NULL GROUP BY date)"
HAVE = [f"{r[0]}_shock_score" for r in ROLES.values()] + [f"{r[1]}_score" for r in ROLES.values()]
COMPS = [r[1] for r in ROLES.values()]


def clipped(c):
    return f"least(100,greatest(0,coalesce({c},0)))"


def wmean(ws, have):
    ks = {c: w for c, w in ws.items() if c in have}
    return f"least(100,greatest(0,({'+'.join(f'{clipped(c)}*{w}' for c, w in ks.items()) or '0'})/{max(sum(ks.values()), 1e-9)}))"


def psum(ws, have):
    return "least(100,greatest(0," + "+".join(f"coalesce({c},0)*{w}" for c, w in ws.items() if c in have) + "))"


def wsum(ws, prefix="z_"):
    return "+".join(f"{w}*{prefix}{c}" for c, w in ws.items())


# --- leadership panel --------------------------------------------------------------------

def grid(src):
    return f"(SELECT c.date, s.symbol, x.close AS raw FROM (SELECT DISTINCT date FROM {src}) c CROSS JOIN (SELECT DISTINCT symbol FROM {src}) s LEFT JOIN {src} x ON x.date=c.date AND x.symbol=s.symbol)"


def pwin(src):
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    return f"""(SELECT *, {', '.join(f'close/lag(close,{n}) {w}-1 AS ret{n}' for n in (5, 20, 60, 120))}, {g('avg', 'close', 60, 45)} AS ma60, {g('avg', 'close', 200, 150)} AS ma200, {g('max', 'close', 252, 180)} AS high252,
 lead(close,5) {w}/close-1 AS fwd5, lead(close,20) {w}/close-1 AS fwd20, row_number() {w}-1 AS pos, count(*) OVER (PARTITION BY symbol) AS days
 FROM (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING) AS close FROM {grid(src)}))"""


_MK = f"(SELECT date, 'benchmark' AS symbol, close FROM {MARKET})"
CP01 = f"""WITH fw AS MATERIALIZED (SELECT * FROM {pwin(f'(SELECT date, symbol, close FROM {ETF})')}), bw AS MATERIALIZED (SELECT * FROM {pwin(_MK)}), cw AS MATERIALIZED (SELECT * FROM {pwin(BRAND)}),
 j AS (SELECT f.*, b.close AS bc, b.ret5 AS b5, b.ret20 AS b20, b.ret60 AS b60, b.ret120 AS b120, b.fwd5 AS bf5, b.fwd20 AS bf20, ln(f.close/b.close) AS lr FROM fw f JOIN bw b ON f.date=b.date),
 s AS (SELECT *, CASE WHEN count(lr) {'OVER (PARTITION BY symbol ORDER BY date ' + rows(20) + ')'}=20 THEN regr_slope(lr,pos) {'OVER (PARTITION BY symbol ORDER BY date ' + rows(20) + ')'} END AS slope FROM j),
 r AS MATERIALIZED (SELECT * FROM s WHERE date IN (SELECT max(date) FROM fw GROUP BY {WEEKDAYS.format(d='date')}) AND pos>=260 AND pos+20<days AND raw IS NOT NULL AND bc IS NOT NULL),
 h AS MATERIALIZED (SELECT date AS sd, etf, component, weight AS w FROM {HOLDINGS}), sn AS (SELECT DISTINCT etf, sd FROM h),
 d AS (SELECT r.date, r.symbol AS etf, sn.sd, r.b20, r.b60 FROM r ASOF JOIN sn ON r.symbol=sn.etf AND r.date>=sn.sd),
 c AS (SELECT d.date, d.etf, h.component, h.w, x.close, x.close/nullif(x.high252,0) AS hp, x.ret20, x.ret60, x.ret20-d.b20 AS rs20, x.ret60-d.b60 AS rs60, x.ma60, x.ma200, CASE WHEN x.ret20 IS NOT NULL THEN greatest(h.w*x.ret20,0) END AS gain
  FROM d JOIN h ON h.etf=d.etf AND h.sd=d.sd LEFT JOIN cw x ON x.symbol=h.component AND x.date=d.date),
 k AS (SELECT *, greatest(1,ceil(0.2*count(*) OVER g)) AS tail, row_number() OVER (PARTITION BY date,etf ORDER BY ret20 DESC NULLS LAST, component) AS hi, row_number() OVER (PARTITION BY date,etf ORDER BY ret20 NULLS LAST, component) AS lo,
  row_number() OVER (PARTITION BY date,etf ORDER BY w DESC, component) AS rw, row_number() OVER (PARTITION BY date,etf ORDER BY gain DESC NULLS LAST, component) AS rg FROM c WINDOW g AS (PARTITION BY date,etf)),
 a AS (SELECT date, etf, sum(w*hp)/nullif(sum(w) FILTER (hp IS NOT NULL),0) AS weighted_HP, median(hp) AS median_HP, coalesce(sum(w) FILTER (hp>=0.9),0)/nullif(sum(w) FILTER (hp IS NOT NULL),0) AS HP90_share,
  sum(w*rs20)/nullif(sum(w) FILTER (rs20 IS NOT NULL),0) AS weighted_component_RS_20D, sum(w*rs60)/nullif(sum(w) FILTER (rs60 IS NOT NULL),0) AS weighted_component_RS_60D, median(rs20) AS median_component_RS_20D,
  coalesce(sum(w) FILTER (rs20>0),0)/nullif(sum(w) FILTER (rs20 IS NOT NULL),0) AS RS_positive_share, coalesce(sum(w) FILTER (close>ma60),0)/nullif(sum(w) FILTER (close IS NOT NULL AND ma60 IS NOT NULL),0) AS MA60_breadth,
  coalesce(sum(w) FILTER (close>ma200),0)/nullif(sum(w) FILTER (close IS NOT NULL AND ma200 IS NOT NULL),0) AS MA200_breadth, median(ret20) AS median_component_return_20D, median(ret60) AS median_component_return_60D,
  avg(ret20)-median(ret20) AS mean_minus_median_return_20D, avg(ret20) FILTER (hi<=tail) AS top20_component_return_mean, avg(ret20) FILTER (lo<=tail) AS bottom20_component_return_mean, count(*) AS holding_count, 1/sum(w*w) AS effective_N,
  sum(w) FILTER (rw<=5) AS top5_weight_share, sum(w) FILTER (rw<=10) AS top10_weight_share, coalesce(sum(gain) FILTER (rg<=5)/nullif(sum(gain),0),0) AS top5_return_contribution_share FROM k GROUP BY 1,2),
 p AS (SELECT r.date, r.symbol AS etf, r.ret5 AS ETF_return_5D, r.ret20 AS ETF_return_20D, r.ret60 AS ETF_return_60D, r.ret120 AS ETF_return_120D, r.ret20-b20 AS ETF_RS_20D, r.ret60-b60 AS ETF_RS_60D, r.ret120-b120 AS ETF_RS_120D, slope AS RS_slope_20D,
  fwd5 AS forward_5D_return, fwd20 AS forward_20D_return, fwd5-bf5 AS forward_5D_excess, fwd20-bf20 AS forward_20D_excess, a.* EXCLUDE (date, etf) FROM r LEFT JOIN a ON a.date=r.date AND a.etf=r.symbol),
 panel AS MATERIALIZED (SELECT *, weighted_HP-lag(weighted_HP,20) OVER e AS HP_change_20D, MA60_breadth-lag(MA60_breadth,20) OVER e AS Breadth_change_20D,
  CASE WHEN coalesce(holding_count,0)<=5 OR effective_N<8 THEN 'concentrated' WHEN effective_N>=20 THEN 'diversified' ELSE 'mid' END AS holding_logic FROM p WINDOW e AS (PARTITION BY etf ORDER BY date))"""
_PCOLS = "ETF_return_5D ETF_return_20D ETF_return_60D ETF_return_120D ETF_RS_20D ETF_RS_60D ETF_RS_120D RS_slope_20D forward_5D_return forward_20D_return forward_5D_excess forward_20D_excess"


def panel(t):
    return L.leadership_panel(t.etf, t.market, t.holdings, t.brand)


@query("cp01_leadership_panel", fin("date etf:s " + _PCOLS + " " + " ".join(c for c in L.COMPONENT_COLUMNS if c != "holding_count") + " holding_count:i", CP01 + " SELECT * REPLACE (coalesce(holding_count,0) AS holding_count) FROM panel"))
def _(t):
    return panel(t).select("date", "etf", *_PCOLS.split(), *L.COMPONENT_COLUMNS)


@query("cp02_holding_logic", fin("date etf:s holding_logic:s HP_change_20D Breadth_change_20D", CP01 + " SELECT * FROM panel"))
def _(t):
    return panel(t).select("date", "etf", "holding_logic", "HP_change_20D", "Breadth_change_20D")


def zc(cols, min_group, src="panel"):
    """Winsorised per-date z of many columns in SQL."""
    q = ", ".join(f"quantile_cont({c},0.01) AS lo_{c}, quantile_cont({c},0.99) AS hi_{c}, count({c}) AS n_{c}" for c in cols)
    keep = lambda c: f"n_{c}>={min_group}" if min_group else "true"
    cl = ", ".join(f"CASE WHEN {c} IS NOT NULL AND {keep(c)} THEN least(greatest({c},lo_{c}),hi_{c}) ELSE {c} END AS c_{c}" for c in cols)
    z = ", ".join(f"{zsql('c_' + c)} AS z_{c}" for c in cols)
    return f"(SELECT *, {z} FROM (SELECT p.*, {cl} FROM {src} p JOIN (SELECT date, {q} FROM {src} GROUP BY date) q ON p.date=q.date))"


_SUB = ", ".join(f"{wsum(v, '')} AS {k}" for k, v in L.SUB_SCORES.items())


@query("cp03_rule_scores_v1", fin("date etf:s Final_Rule_Score Final_Rule_Score_0_100 rule_rank:i", CP01 + f""", s1 AS (SELECT *, {_SUB}, coalesce(effective_N/nullif(effective_N+20,0),0) AS rel FROM {zc(L.RULE_INPUTS, 20)}),
 s2 AS (SELECT *, rel*Breadth_Score+(1-rel)*ETF_RS_Score AS Adjusted_Breadth_Score FROM s1), s3 AS (SELECT *, round(CASE holding_logic WHEN 'concentrated' THEN {wsum(L.CLASS_SCORES['concentrated'], '')} WHEN 'diversified' THEN {wsum(L.CLASS_SCORES['diversified'], '')} ELSE {wsum(L.CLASS_SCORES['mid'], '')} END,10) AS Final_Rule_Score FROM s2)
 SELECT *, least(100,greatest(0,50+18*tanh(Final_Rule_Score/2))) AS Final_Rule_Score_0_100, row_number() OVER (PARTITION BY date ORDER BY Final_Rule_Score DESC, etf) AS rule_rank FROM s3"""))
def _(t):
    return L.rule_scores(panel(t)).select("date", "etf", "Final_Rule_Score", "Final_Rule_Score_0_100", "rule_rank")


_V2 = sorted(set(L.RULE_5D_V2) | set(L.RULE_20D_V2))


@query("cp04_rule_scores_v2", fin("date etf:s rule_5d_score rule_20d_score", CP01 + f" SELECT date, etf, {wsum(L.RULE_5D_V2)} AS rule_5d_score, {wsum(L.RULE_20D_V2)} AS rule_20d_score FROM {zc(_V2, None)}"))
def _(t):
    return L.horizon_rules(panel(t), L.RULE_5D_V2, L.RULE_20D_V2).select("date", "etf", "rule_5d_score", "rule_20d_score")


@query("cp04_rule_scores_v3_grouped", fin("date etf:s rule_5d_score rule_20d_score", CP01 + ", q AS (SELECT p.*, grp, " + ", ".join(
    f"CASE WHEN count({c}) OVER (PARTITION BY date, grp)>=3 THEN {zsql(c, 'date, grp')} ELSE {zsql(c)} END AS z_{c}" for c in _V2) + f" FROM panel p JOIN (SELECT DISTINCT symbol, grp FROM {ETF}) u ON u.symbol=p.etf) SELECT date, etf, {wsum(L.RULE_5D_V3)} AS rule_5d_score, {wsum(L.RULE_20D_V3)} AS rule_20d_score FROM q"))
def _(t):
    return L.horizon_rules(panel(t), L.RULE_5D_V3, L.RULE_20D_V3, "grp").select("date", "etf", "rule_5d_score", "rule_20d_score")


_AF = f"""af AS MATERIALIZED (SELECT *, {', '.join(f'close/lag(close,{n}) OVER w-1 AS ret_{n}' for n in (20, 60, 120))}, {', '.join(f'(close/lag(close,{n}) OVER w-1)-(bench/lag(bench,{n}) OVER w-1) AS excess_{n}' for n in (20, 60, 120))},
 ({g('stddev_samp', 'r1', 20)})*sqrt(252.0) AS vol_20, close/({g('max', 'close', 60, 15)})-1 AS drawdown_60, close/({g('max', 'close', 252, 60)}) AS high_proximity_252, coalesce(close>({g('avg', 'close', 60, 30)}),false)::INT::DOUBLE AS above_ma60, coalesce(close>({g('avg', 'close', 200, 100)}),false)::INT::DOUBLE AS above_ma200,
 CASE WHEN {over('count(lr)', rows(20))}=20 THEN {over('regr_slope(lr,pos)', rows(20))} END AS rs_slope_20 FROM (SELECT e.date, symbol, grp, e.close, m.close AS bench, ln(e.close/m.close) AS lr, e.close/lag(e.close,1) OVER v-1 AS r1, row_number() OVER v AS pos FROM {ETF} e JOIN {MARKET} m ON e.date=m.date WINDOW v AS (PARTITION BY symbol ORDER BY e.date)) WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("cp05_long_history_leadership", fin("date symbol s", f"WITH {_AF} SELECT date, symbol, {wsum(L.LONG_HISTORY)} AS s FROM {zc(list(L.LONG_HISTORY), None, 'af')}"))
def _(t):
    return L.rule_over_z(L.asset_features(t.etf, t.market), L.LONG_HISTORY, "s").select("date", "symbol", "s")


_CATS = ["Long Treasury", "TIPS", "Cash", "Dollar", "Gold", "Yen"]


def economy(t):
    m = SF.economy_panel(wide(t), {"vix": "VIX"}, {"rate": "HY_OAS", "vix": "VIX"}, {"dxy": "DXY", "gold": "GOLD", "equity": "NASDAQ100"})
    return m.select("date", (F.col("rate_20d_chg") / 1000).alias("rate_chg"), (F.col("vix_level") / 100).alias("vix_level"), (F.col("vix_20d_chg") / 100).alias("vix_chg"),
                    F.col("dxy_20d_ret").alias("dxy_ret"), F.col("gold_20d_ret").alias("gold_ret"), F.col("equity_20d_ret").alias("equity_ret"))


_ff = lambda c: over(f"last_value({c} IGNORE NULLS)", "ROWS UNBOUNDED PRECEDING", "")
ECONOMY = f"""(SELECT date, (HY_OAS-lag(HY_OAS,20) OVER (ORDER BY date))/1000 AS rate_chg, VIX/100 AS vix_level, (VIX-lag(VIX,20) OVER (ORDER BY date))/100 AS vix_chg, d/lag(d,20) OVER (ORDER BY date)-1 AS dxy_ret, gg/lag(gg,20) OVER (ORDER BY date)-1 AS gold_ret,
 e/lag(e,20) OVER (ORDER BY date)-1 AS equity_ret FROM (SELECT *, {_ff('DXY')} AS d, {_ff('GOLD')} AS gg, {_ff('NASDAQ100')} AS e FROM {WIDE}))"""


@query("cp06_safe_score_with_overlay", fin("date symbol s", f"""WITH {_AF}, m AS (SELECT date, coalesce(rate_chg,0) AS rc, coalesce(dxy_ret,0) AS dx, coalesce(gold_ret,0) AS gr, coalesce(equity_ret,0) AS eq, least(2.5, greatest(0,coalesce(vix_level,0)-20)/20+greatest(0,coalesce(vix_chg,0))/15) AS st FROM {ECONOMY}),
 o AS (SELECT af.*, CASE {_CATS}[(ascii(reverse(af.symbol))-48)%6+1] WHEN 'Long Treasury' THEN -2.4*rc+0.45*st WHEN 'TIPS' THEN -1.2*rc+0.25*st WHEN 'Cash' THEN 1.5*greatest(rc,0)+0.2*st WHEN 'Dollar' THEN 5.0*dx+0.15*st WHEN 'Gold' THEN 2.2*gr-1.2*dx-0.6*greatest(rc,0)+0.2*st ELSE -2.0*dx+0.25*st+greatest(-eq,0) END AS ov FROM af ASOF LEFT JOIN m ON af.date>=m.date)
 SELECT date, symbol, 0.55*round({wsum(L.LONG_SAFE)},10)+0.45*round(z_ov,10) AS s FROM {zc([*L.LONG_SAFE, 'ov'], None, 'o')}"""))
def _(t):
    d = L.asset_features(t.etf, t.market)
    k = ((F.ascii(F.reverse("symbol")) - 48) % 6 + 1).cast("int")
    d = A.asof_join(d, economy(t)).withColumn("category", F.element_at(F.array(*[F.lit(c) for c in _CATS]), k))
    d = L.rule_over_z(d.withColumn("ov", SF.economy_overlay(d)), L.LONG_SAFE, "rule")
    d = L.rule_over_z(d, {"ov": 1.0}, "zo")
    return d.select("date", "symbol", (0.55 * F.col("rule") + 0.45 * F.col("zo")).alias("s"))


@query("cp07_economy_panel", fin("date rate_chg vix_level vix_chg dxy_ret gold_ret equity_ret", f"FROM {ECONOMY}"))
def _(t):
    return economy(t)


_TR = "CASE driver " + " ".join(f"WHEN '{d}' THEN '{r[2]}'" for d, r in ROLES.items()) + " END"
_UP = "CASE driver " + " ".join(f"WHEN '{d}' THEN {1 if r[3] > 0 else -1}" for d, r in ROLES.items()) + " END"
_ch = lambda n: f"CASE WHEN {_TR}='diff' THEN level-{lag('level', n, 'driver')} ELSE level/{lag('level', n, 'driver')}-1 END"
DFEAT = f"""(SELECT date, driver, chg_5d, chg_20d, chg_60d, {', '.join(f"{zs('level', n, None, 'driver')} AS z_{n}d" for n in (20, 60, 252))}, level/({g('avg', 'level', 20, None, 'driver')})-1 AS ma20_pos, level/({g('avg', 'level', 60, None, 'driver')})-1 AS ma60_pos,
 CASE WHEN {over('count(level)', rows(20), 'driver')}=20 THEN {over('regr_slope(level,pos)', rows(20), 'driver')} END AS slope_20d, chg_20d/nullif({g('stddev_samp', 'base', 60, None, 'driver')},0) AS vol_adj_20d, {_UP}*({zs('chg_20d', 252, None, 'driver')}) AS riskon_score
 FROM (SELECT date, driver, level, {_ch(1)} AS base, {_ch(5)} AS chg_5d, {_ch(20)} AS chg_20d, {_ch(60)} AS chg_60d, {over('row_number()', '', 'driver')} AS pos FROM {DRIVERS}))"""
_DC = "chg_5d chg_20d chg_60d z_20d z_60d z_252d ma20_pos ma60_pos slope_20d vol_adj_20d riskon_score"


@query("cp08_driver_features", fin(f"date driver:s {_DC}", f"FROM {DFEAT}", 5))
def _(t):
    d = AS.driver_features(t.drivers, specs(t).select("driver", "transform", "higher_is_risk_on"))
    return d.select("date", "driver", *[(F.floor(F.col(c) * 1e5 + 0.5) / 1e5).alias(c) for c in _DC.split()])


def expected(t):
    n = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    sgn = F.when(n % 2 == 0, 1.0).otherwise(-1.0)
    s = t.nation.select(F.col("n_name").alias("symbol"))
    pairs = F.explode(F.array(F.struct(F.lit("ECONOMY").alias("driver"), sgn.alias("expected")), F.struct(F.lit("PROMO").alias("driver"), (-0.5 * sgn).alias("expected"))))
    return s.select("symbol", pairs.alias("p")).select("symbol", "p.*")


EXPECT = "(SELECT n_name AS symbol, d AS driver, CASE WHEN CAST(regexp_extract(n_name,'([0-9]+)$',1) AS INT)%2=0 THEN x ELSE -x END AS expected FROM nation, (VALUES ('ECONOMY',1.0),('PROMO',-0.5)) v(d,x))"
_BETA = f"""(SELECT date, symbol, driver, expected, CASE WHEN count(*) OVER f>=30 THEN covar_samp(ret,dret) OVER f/var_samp(dret) OVER f END AS beta FROM (SELECT a.date, a.symbol, e.driver, expected, ret, dret FROM
 (SELECT date, symbol, close/{lag('close', 1)}-1 AS ret FROM {ETF}) a JOIN {EXPECT} e ON e.symbol=a.symbol JOIN (SELECT date, driver, level/{lag('level', 1, 'driver')}-1 AS dret FROM {DRIVERS}) d ON d.date=a.date AND d.driver=e.driver WHERE ret IS NOT NULL AND dret IS NOT NULL)
 WINDOW f AS (PARTITION BY symbol, driver ORDER BY date ROWS 59 PRECEDING))"""
FIT = f"(SELECT symbol, date, least(100,greatest(0,50+16*coalesce(avg(least(3,greatest(-3,riskon_score))*expected) FILTER (riskon_score IS NOT NULL),0))) AS driver_fit FROM {EXPECT} e JOIN {DFEAT} f ON f.driver=e.driver GROUP BY 1,2)"
BFIT = f"(SELECT symbol, date, least(100,greatest(0,50+35*avg(sign(beta)*sign(expected)*least(abs(beta),3)/3))) AS beta_fit FROM {_BETA} WHERE beta IS NOT NULL GROUP BY 1,2)"


@query("cp09_driver_and_beta_fit", fin("date symbol driver_fit beta_fit", f"SELECT f.date, f.symbol, driver_fit, coalesce(beta_fit,50) AS beta_fit FROM {FIT} f LEFT JOIN {BFIT} b ON b.date=f.date AND b.symbol=f.symbol"))
def _(t):
    feats = AS.driver_features(t.drivers, specs(t).select("driver", "transform", "higher_is_risk_on")).select("date", "driver", "riskon_score")
    f = AS.driver_fit(expected(t), feats, "driver_fit")
    b = AS.beta_fit(AS.driver_betas(t.etf, t.drivers, expected(t)).filter("beta is not null"), "beta_fit")
    return f.join(b, ["date", "symbol"], "left").fillna(50.0, ["beta_fit"]).select("date", "symbol", "driver_fit", "beta_fit")


def cond_sql(h):
    return f"""(WITH x AS MATERIALIZED (SELECT p.date, symbol, regime, fwd, row_number() OVER (PARTITION BY symbol ORDER BY p.date) AS i FROM (SELECT date, symbol, lead(close,{h}) OVER (PARTITION BY symbol ORDER BY date)/close-1 AS fwd FROM {ETF}) p JOIN {REGIME} g ON g.date=p.date),
 k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x WHERE fwd IS NOT NULL),
 s AS (SELECT x.date, x.symbol, x.regime, count(*) FILTER (k.regime=x.regime) AS c, avg((k.fwd>0)::INT) FILTER (k.regime=x.regime) AS w, avg(k.fwd) FILTER (k.regime=x.regime) AS a, max(k.n) AS top FROM x LEFT JOIN k ON k.symbol=x.symbol AND k.date<x.date-{h + 2} GROUP BY 1,2,3),
 f AS (SELECT s.date, s.symbol, avg((k.fwd>0)::INT) AS w, avg(k.fwd) AS a FROM s JOIN k ON k.symbol=s.symbol AND k.n<=s.top AND k.n>s.top-252 WHERE s.c<20 GROUP BY 1,2)
 SELECT s.date, s.symbol, s.regime, coalesce(CASE WHEN c>=20 THEN s.w ELSE f.w END,0.52) AS win_rate, coalesce(CASE WHEN c>=20 THEN s.a ELSE f.a END,0) AS avg_return FROM s LEFT JOIN f ON f.date=s.date AND f.symbol=s.symbol)"""


@query("cp10_conditional_forward_stats", fin("date symbol regime:s win_rate avg_return", f"FROM {cond_sql(5)}"))
def _(t):
    return AS.conditional_stats(t.etf.select("date", "symbol", "close"), t.regime, 5)


def prob_sql(win, tech, fit, beta, h):
    a, b, c = AS.EDGES[h]
    e = lambda x: f"(({x})-50)/100"
    q = f"least(0.99,greatest(0.01,coalesce({win},0.52)))"
    x = f"ln({q}/(1-{q}))+{a}*{e(tech)}+{b}*{e(fit)}+{c}*{e(beta)}"
    return f"least(0.95,greatest(0.05,1/(1+exp(-least(20,greatest(-20,{x}))))))"


@query("cp11_probability_blend", fin("date symbol p1 p4", f"SELECT date, symbol, {prob_sql('prob', 'score', 'score/2', '60', '1w')} AS p1, {prob_sql('prob', 'score', 'score/2', '60', '4w')} AS p4 FROM {WEEKLY}"))
def _(t):
    b = lambda h: AS.blend_probability("prob", "score", F.col("score") / 2, F.lit(60.0), h)
    return t.weekly.select("date", "symbol", b("1w").alias("p1"), b("4w").alias("p4"))


_TECH = None


def tech_sql(src):
    from tideframe.catalog.factors import _TP
    return _TP.replace(BRAND, f"(SELECT date, symbol, close FROM {src})")


def scores_sql(weeks):
    pen = "CASE WHEN vol20 IS NOT NULL THEN least(18,greatest(0,(vol20-0.18)*25+abs(dd)*15)) ELSE 0 END"
    return f"""(SELECT *, round(least(100,greatest(0,0.34*ts+0.28*df+0.18*bf+20.0*p4-pen)),2) AS score FROM (SELECT t.date, t.symbol, c1.regime, ts, {pen} AS pen, coalesce(driver_fit,50) AS df, coalesce(beta_fit,50) AS bf, {prob_sql('c1.win_rate', 'ts', 'coalesce(driver_fit,50)', 'coalesce(beta_fit,50)', '1w')} AS p1, {prob_sql('c4.win_rate', 'ts', 'coalesce(driver_fit,50)', 'coalesce(beta_fit,50)', '4w')} AS p4
 FROM {tech_sql(ETF)} t JOIN {cond_sql(5)} c1 ON c1.date=t.date AND c1.symbol=t.symbol JOIN {cond_sql(20)} c4 ON c4.date=t.date AND c4.symbol=t.symbol LEFT JOIN {FIT} f ON f.date=t.date AND f.symbol=t.symbol LEFT JOIN {BFIT} b ON b.date=t.date AND b.symbol=t.symbol WHERE t.date IN ({weeks})))"""


_WK = f"SELECT max(date) FROM {ETF} GROUP BY {WEEKDAYS.format(d='date')}"


def sp(t):
    return specs(t).select("driver", "transform", "higher_is_risk_on")


@query("cp12_asset_score_table", fin("date symbol regime:s p1 p4 score rk:i", f"SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk FROM {scores_sql('SELECT max(date) FROM (SELECT e.date FROM ' + ETF + ' e JOIN ' + REGIME + ' r ON r.date=e.date)')}", 4))
def _(t):
    last = t.etf.join(t.regime, "date").agg(F.max("date").alias("date"))
    d = AS.asset_scores(t.etf.select("date", "symbol", "close"), t.drivers, sp(t), expected(t), t.regime, last)
    r4 = lambda c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4
    return d.select("date", "symbol", "regime", r4("prob_1w").alias("p1"), r4("prob_4w").alias("p4"), F.col("score_0_100").alias("score"), F.col("rank").alias("rk"))


@query("cp13_weekly_walkforward_panel", fin("date symbol regime:s p1 p4 score realized_1w up:i", f"SELECT s.*, r.f AS realized_1w, CASE WHEN r.f IS NOT NULL THEN (r.f>0)::INT END AS up FROM {scores_sql(_WK)} s JOIN (SELECT date, symbol, lead(close,5) OVER (PARTITION BY symbol ORDER BY date)/close-1 AS f FROM {ETF}) r ON r.date=s.date AND r.symbol=s.symbol", 4))
def _(t):
    d = AS.weekly_panel(t.etf.select("date", "symbol", "close"), t.drivers, sp(t), expected(t), t.regime)
    r4 = lambda c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4
    return d.select("date", "symbol", "regime", r4("prob_1w").alias("p1"), r4("prob_4w").alias("p4"), F.col("score_0_100").alias("score"), r4("realized_1w").alias("realized_1w"), F.col("realized_up_1w").alias("up"))


_MOM = f"""(SELECT *, {', '.join(f"{zsql(f'r{n}')} AS z{n}" for n in (5, 20, 60, 120))}, {zsql('v20')} AS zv FROM (SELECT date, symbol, grp, {', '.join(f'close/lag(close,{n}) OVER w-1 AS r{n}' for n in (5, 20, 60, 120))}, {g('stddev_samp', 'r1', 20, 10)} AS v20, lead(close,5) OVER w/close-1 AS f1w, lead(close,20) OVER w/close-1 AS f1m
 FROM (SELECT *, close/{lag('close', 1)}-1 AS r1 FROM {ETF}) WINDOW w AS (PARTITION BY symbol ORDER BY date)))"""


@query("cp14_fast_weekly_panel", fin("date symbol score p1 p4", f"SELECT date, symbol, least(100,greatest(0,50+12*x)) AS score, least(0.95,greatest(0.05,0.5+0.1*x)) AS p1, least(0.95,greatest(0.05,0.5+0.12*(0.45*z20+0.35*z60+0.2*z120))) AS p4 FROM (SELECT *, round(0.24*z5+0.34*z20+0.28*z60+0.14*z120-0.18*zv,10) AS x FROM {_MOM}) WHERE date IN ({_WK}) AND f1w IS NOT NULL AND f1m IS NOT NULL"))
def _(t):
    from tideframe.plans.selection import fast_weekly_panel
    return fast_weekly_panel(t.etf).select("date", "symbol", F.col("score").alias("score"), "p1", "p4")


@query("cp15_institutional_score", fin("date symbol s drag", f"""SELECT date, symbol, least(100,greatest(0,0.52*score+24*prob+0.14*score+260*least(0.1,greatest(-0.1,coalesce(ret_4w,0)))+CASE WHEN prob>=0.6 THEN 5 ELSE 0 END-drag)) AS s, drag FROM
 (SELECT *, CASE WHEN grp='EUROPE' AND regime NOT IN ('BUILDING','MACHINERY') THEN 5 WHEN grp='ASIA' AND regime='MACHINERY' THEN 7 WHEN grp='ASIA' AND regime<>'BUILDING' THEN 18 ELSE 0 END AS drag FROM {WEEKLY})"""))
def _(t):
    drag = AS.cash_drag("grp", "regime", ["ASIA"], ["EUROPE"], "BUILDING", "MACHINERY")
    bonus = F.when(F.col("prob") >= 0.6, 5.0).otherwise(0.0)
    return t.weekly.select("date", "symbol", AS.institutional_score("score", "prob", "score", "ret_4w", bonus, drag).alias("s"), drag.alias("drag"))


def sent(t):
    return SE.sentinel(shocks(t), COMPS, 30, 40, 55)


_cw = {c: SE.COMPONENT_WEIGHTS[c] for c in COMPS}
_raw = "(" + "+".join(f"coalesce({c}_score,0)*{w}" for c, w in _cw.items()) + f")/{sum(_cw.values())}"
_nc = "+".join(f"coalesce(({c}_score>35)::INT,0)" for c in SE.CONFIRMING)
SENT = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, {_raw} AS raw, CASE WHEN {_nc}>=4 THEN 16.0 WHEN {_nc}>=3 THEN 10.0 WHEN {_nc}>=2 THEN 5.0 ELSE 0.0 END AS boost, row_number() OVER (ORDER BY date) AS n FROM {SHOCKS}),
 e AS (SELECT n, raw AS p FROM b WHERE n=1 UNION ALL SELECT b.n, b.raw*0.5+e.p*0.5 FROM e JOIN b ON b.n=e.n+1),
 q AS MATERIALIZED (SELECT b.*, round(least(100,greatest(0,0.65*raw+0.35*p+boost)),8) AS v FROM b JOIN e ON e.n=b.n),
 h(n, st) AS (SELECT n, CASE WHEN v>=55 THEN 'Cash' WHEN v>=40 THEN 'De-risk' WHEN v>=30 THEN 'Watch' ELSE 'Normal' END FROM q WHERE n=1 UNION ALL SELECT q.n, CASE WHEN h.st='Cash' AND q.v>=35 THEN 'Cash' WHEN q.v>=55 THEN 'Cash' WHEN q.v>=40 THEN 'De-risk' WHEN h.st='De-risk' AND q.v>=25 THEN 'De-risk' WHEN q.v>=30 THEN 'Watch' ELSE 'Normal' END FROM h JOIN q ON q.n=h.n+1),
 sent AS MATERIALIZED (SELECT q.*, st, v-lag(v,5) OVER (ORDER BY q.n) AS mom, CASE """ + " ".join(f"WHEN {c}_score=greatest({','.join(f'{x}_score' for x in COMPS)}) THEN '{c}'" for c in COMPS) + " ELSE 'none' END AS dom FROM q JOIN h ON h.n=q.n)"


@query("cp16_sentinel_score", fin("date v mom st:s dom:s budget", SENT + " SELECT *, CASE st WHEN 'Cash' THEN 10 WHEN 'De-risk' THEN 35 WHEN 'Watch' THEN 70 ELSE 100 END AS budget FROM sent"))
def _(t):
    return sent(t).select("date", F.col("risk_off_score").alias("v"), F.col("risk_off_momentum_5d").alias("mom"), F.col("sentinel_state").alias("st"), F.col("dominant_component").alias("dom"), F.col("risk_budget_pct").alias("budget"))


SETS = {"safe": ["ASIA"], "hedge": ["EUROPE"], "risk": ["AMERICA", "AFRICA"], "defensive": ["MIDDLE EAST"], "high_beta": ["AFRICA"]}


@query("cp17_sentinel_overlay", fin("date symbol adj s p4 action:s rk:i", SENT + f""", o AS (SELECT w.date, symbol, score, prob, CASE grp WHEN 'ASIA' THEN CASE st WHEN 'Cash' THEN 16 WHEN 'De-risk' THEN 8 WHEN 'Watch' THEN 3 ELSE 0 END WHEN 'EUROPE' THEN CASE st WHEN 'Cash' THEN 10 WHEN 'De-risk' THEN 6 WHEN 'Watch' THEN 2 ELSE 0 END
 WHEN 'MIDDLE EAST' THEN CASE st WHEN 'Cash' THEN 5 WHEN 'De-risk' THEN 3 WHEN 'Watch' THEN 1 ELSE 0 END ELSE -least(45, CASE st WHEN 'Cash' THEN 38 WHEN 'De-risk' THEN 20 WHEN 'Watch' THEN 8 ELSE 0 END*CASE WHEN grp='AFRICA' THEN 1.15 ELSE 1.0 END+greatest(0,v-70)*0.2) END::DOUBLE AS adj,
 CASE WHEN st='Cash' THEN CASE grp WHEN 'ASIA' THEN 'core cash' WHEN 'EUROPE' THEN 'hedge only' ELSE 'avoid risk' END WHEN st='De-risk' THEN CASE grp WHEN 'ASIA' THEN 'raise cash' WHEN 'EUROPE' THEN 'defensive sleeve' WHEN 'MIDDLE EAST' THEN 'normal' ELSE 'cut weight' END WHEN st='Watch' AND grp IN ('AMERICA','AFRICA') THEN 'size down' ELSE 'normal' END AS action
 FROM {WEEKLY} w JOIN sent ON sent.date=w.date), a AS (SELECT *, round(least(100,greatest(0,score+adj)),2) AS s, round(least(0.99,greatest(0.01,prob+0.9*adj/100)),4) AS p4 FROM o) SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, p4 DESC, symbol) AS rk FROM a""", 2))
def _(t):
    d = SE.overlay(t.weekly, sent(t), "grp", "score", "prob", "prob", SETS)
    r2 = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    return d.select("date", "symbol", r2("adjustment").alias("adj"), r2("adjusted_score").alias("s"), r2("adjusted_prob_4w").alias("p4"), "action", F.col("sentinel_rank").alias("rk"))


def vector(t):
    d = sent(t).join(t.risk.select("date", F.col("score").alias("peak_fragility_score_0_100")), "date", "left")
    return RV.two_pass_vector(d, t.market)


_have = set(HAVE) | {"risk_off_score"}
_c1 = ", ".join(f"round({wmean(w, _have)},8) AS {k}" for k, w in RV.COMPONENTS.items())
_all = set(RV.VECTOR) | {"risk_off_score"}


def vector_sql(p, source, analog, correction):
    """Tables <p>v1 ... <p>vec of one pass over the sentinel table ``source``."""
    return f"""{p}v1 AS (SELECT s.*, s.v AS risk_off_score, r.score AS pk, {_c1.replace('risk_off_score', 's.v')} FROM {source} s LEFT JOIN {RISK} r ON r.date=s.date),
 {p}v2 AS (SELECT x.*, round({wmean(RV.SAFE_ROTATION, {'hedge_demand'})},8) AS safe_rotation_stress, {clipped('pk')} AS peak_fragility, {analog} AS analog_history_risk, {correction} AS correction_pressure FROM {p}v1 x{'' if p else ' LEFT JOIN analog an ON an.date=x.date LEFT JOIN corr co ON co.date=x.date'}),
 {p}v3 AS (SELECT *, {', '.join(f'round({psum(w, _all)},8) AS {k}' for k, w in RV.AXES.items())} FROM {p}v2), {p}v4 AS (SELECT *, round({psum(RV.COMPOSITE, _all | set(RV.AXES))},8) AS composite_vector_risk FROM {p}v3),
 {p}vec AS MATERIALIZED (SELECT *, CASE """ + " ".join(f"WHEN {c}=greatest({','.join(RV.VECTOR)}) THEN '{c}'" for c in RV.VECTOR) + """ END AS dominant_risk_vector, CASE WHEN composite_vector_risk>=70 THEN 'Crisis' WHEN composite_vector_risk>=55 THEN 'Risk-Off' WHEN composite_vector_risk>=40 THEN 'Warning' WHEN composite_vector_risk>=25 THEN 'Fragile' ELSE 'Normal' END AS risk_phase,
 CASE WHEN liquidity_axis_x>=55 AND market_breakdown_axis_y>=55 THEN 'Full Risk-Off' WHEN correction_pressure>=60 AND peak_fragility>=45 AND liquidity_axis_x<45 THEN 'Correction Pressure' WHEN peak_fragility>=60 AND market_breakdown_axis_y<45 AND liquidity_axis_x<45 THEN 'Fragile Peak' WHEN liquidity_credit_stress>=55 AND volatility_stress>=45 THEN 'Credit/Liquidity Shock'
 WHEN fx_external_stress>=55 AND external_supply_axis_z>=45 THEN 'FX/External Stress' WHEN inflation_supply_stress>=55 AND equity_breakdown_stress<45 THEN 'Inflation/Supply Shock' WHEN equity_breakdown_stress>=50 AND liquidity_axis_x<45 THEN 'Technical Equity Breakdown'
 WHEN peak_fragility>=48 THEN 'Peak Warning' WHEN greatest(liquidity_axis_x,market_breakdown_axis_y,external_supply_axis_z)<30 THEN 'Calm Risk-On' ELSE 'Mixed/Transition' END AS risk_archetype FROM """ + p + "v4)"


_AS = RV.ANALOG_STATE
_aok = lambda f: f"(q.{f} IS NOT NULL AND q.c_{f}/(q.idx-21.0)>0.8 AND q.s_{f}>1e-12)"
_aused = "+".join(f"{_aok(f)}::INT" for f in _AS)
_ad2 = "+".join(f"CASE WHEN {_aok(f)} THEN pow(coalesce((h.{f}-q.m_{f})/q.s_{f},0)-(q.{f}-q.m_{f})/q.s_{f},2) ELSE 0 END" for f in _AS)
_FLAGS = "coalesce(r1<0,false)::INT AS d1, coalesce(r2<0,false)::INT AS d2, (coalesce(r2<-0.05,false) OR coalesce(lo<-0.07,false))::INT AS tl, coalesce(r1<=-0.02,false)::INT AS dr, (coalesce(r2<=-0.035,false) OR coalesce(lo<=-0.055,false))::INT AS mo, (coalesce(r1>-0.01,false) AND (coalesce(r2<=-0.03,false) OR coalesce(lo<=-0.055,false)))::INT AS de"
VECTOR = SENT + ", " + vector_sql("p", "sent", "0.0", "0.0") + f""", after AS MATERIALIZED (SELECT date, {_FLAGS} FROM (SELECT date, lead(close,5) OVER (ORDER BY date)/close-1 AS r1, lead(close,20) OVER (ORDER BY date)/close-1 AS r2, min(close) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)/close-1 AS lo FROM {MARKET})),
 st AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date)-1 AS idx, {', '.join(f'avg({f}) OVER h AS m_{f}, stddev_pop({f}) OVER h AS s_{f}, count({f}) OVER h AS c_{f}' for f in _AS)} FROM pvec WINDOW h AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 22 PRECEDING)),
 nb AS (SELECT * FROM (SELECT q.date, h.date AS hist, row_number() OVER (PARTITION BY q.idx ORDER BY ({_ad2})/({_aused}), h.idx) AS rn FROM st q JOIN st h ON h.idx<q.idx-21 WHERE q.idx>=504 AND q.idx%5=0 AND {_aused}>=4) WHERE rn<=50),
 share AS (SELECT nb.date, 0.28*avg(d1)+0.32*avg(d2)+0.25*avg(tl) AS p FROM nb JOIN after a ON a.date=nb.hist GROUP BY nb.date),
 analog AS (SELECT x.date, round(CASE WHEN s.p IS NOT NULL THEN least(100,greatest(0,100*(s.p+0.15*coalesce(x.peak_fragility,0)/100))) ELSE 0 END,8) AS score FROM st x ASOF LEFT JOIN share s ON x.date>=s.date),
 corr AS (SELECT date, round(least(100,greatest(0,100*(0.28*coalesce(avg(dr) OVER c,0)+0.42*coalesce(avg(mo) OVER c,0)+0.22*coalesce(avg(de) OVER c,0)+0.08*coalesce(peak_fragility,0)/100))),8) AS score FROM (SELECT st.date, st.idx, st.risk_phase, st.peak_fragility, a.dr, a.mo, a.de FROM st LEFT JOIN after a ON a.date=st.date) WINDOW c AS (PARTITION BY risk_phase ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 21 PRECEDING)),
 """ + vector_sql("", "sent", clipped("an.score"), clipped("co.score"))


@query("cp18_risk_vector", fin("date liquidity_axis_x market_breakdown_axis_y external_supply_axis_z composite_vector_risk dominant_risk_vector:s risk_archetype:s risk_phase:s", VECTOR + " SELECT * FROM vec"))
def _(t):
    return vector(t).select("date", *RV.AXES, "composite_vector_risk", "dominant_risk_vector", "risk_archetype", "risk_phase")


def nmean(ws, have):
    ks = {c: w for c, w in ws.items() if c in have}
    x = f"({'+'.join(f'coalesce({c},0)*{w}' for c, w in ks.items())})/nullif({'+'.join(f'CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END' for c, w in ks.items())},0)"
    return f"CASE WHEN {x}>100 THEN 100 ELSE {x} END"


@query("cp19_three_axis_scores", fin("date a1 a2 mx mean norm breadth:i dom:s calm", f"""SELECT *, greatest(a1,a2,a3) AS mx, (coalesce(a1,0)+coalesce(a2,0)+coalesce(a3,0))/nullif((a1 IS NOT NULL)::INT+(a2 IS NOT NULL)::INT+(a3 IS NOT NULL)::INT,0) AS mean, least(100,sqrt(coalesce(a1,0)*coalesce(a1,0)+coalesce(a2,0)*coalesce(a2,0)+coalesce(a3,0)*coalesce(a3,0))/sqrt(3.0)) AS norm,
 coalesce((a1>=35)::INT,0)+coalesce((a2>=35)::INT,0)+coalesce((a3>=35)::INT,0) AS breadth, CASE WHEN a1>=greatest(a2,a3) THEN 'axis1' WHEN a2>=greatest(a1,a3) THEN 'axis2' ELSE 'axis3' END AS dom,
 CASE WHEN a1+m+nh+am+vl IS NOT NULL THEN least(100,greatest(0,0.30*least(100,greatest(0,greatest(0,m)*350))+0.25*least(100,greatest(0,100+250*nh))+0.20*least(100,greatest(0,50+180*am))+0.15*least(100,greatest(0,35-100*vl))+0.10*least(100,greatest(0,35-a1)))) END AS calm FROM
 (SELECT s.date, {nmean(RV.AXIS_3D['axis1_vol_credit_stress'], _have)} AS a1, {nmean(RV.AXIS_3D['axis2_fx_liquidity_stress'], _have)} AS a2, r.score AS a3, m, nh, am, vl FROM {SHOCKS} s LEFT JOIN {RISK} r ON r.date=s.date LEFT JOIN (SELECT date, close/{lag('close', 60, '')}-1 AS m, close/({g('max', 'close', 252, 60, '')})-1 AS nh, close/({g('avg', 'close', 200, 60, '')})-1 AS am, ({g('stddev_samp', 'r1', 20, 10, '')})*sqrt(252.0) AS vl FROM (SELECT *, close/{lag('close', 1, '')}-1 AS r1 FROM {MARKET})) k ON k.date=s.date)""".replace("PARTITION BY  ", "")))
def _(t):
    m = t.market.withColumn("r1", R.step_return("close", 1, R.day()))
    m = m.select("date", R.step_return("close", 60, R.day()).alias("m"), (ratio("close", R.high("close", 252, R.day(), 60)) - 1).alias("nh"), (ratio("close", R.mean("close", 200, R.day(), 60)) - 1).alias("am"), R.annual_vol("r1", 20, R.day(), 10).alias("vl"))
    d = RV.axes_3d(shocks(t).join(t.risk.select("date", F.col("score").alias("peak_fragility_score_0_100")), "date", "left"))
    d = d.join(m, "date", "left").withColumn("calm", RV.complacency("m", "nh", "am", "vl", "axis1_vol_credit_stress"))
    d = d.select("date", F.col("axis1_vol_credit_stress").alias("a1"), F.col("axis2_fx_liquidity_stress").alias("a2"), F.col("risk_3d_max_axis").alias("mx"), F.col("risk_3d_mean_axis").alias("mean"),
                 F.col("risk_3d_vector_score").alias("norm"), F.col("risk_3d_breadth").alias("breadth"), F.col("risk_3d_dominant_axis").alias("dom"), "calm")
    return d


_S = {k: wmean(w, _all | set(RV.AXES) | {"composite_vector_risk", "crash_sentinel_score", "peak_correction_score"}) for k, w in RV.SCORES.items()}


@query("cp20_composite_scores", fin("date crash_sentinel_score peak_correction_score risk_off_avoidance_score risk_on_permission_score model_regime:s", VECTOR + f""", c1 AS (SELECT *, round({_S['crash_sentinel_score']},8) AS crash_sentinel_score, round({_S['peak_correction_score']},8) AS peak_correction_score FROM vec), c2 AS (SELECT *, round({_S['risk_off_avoidance_score']},8) AS risk_off_avoidance_score FROM c1)
 SELECT *, 100-risk_off_avoidance_score AS risk_on_permission_score, CASE WHEN crash_sentinel_score>=55 OR risk_off_avoidance_score>=62 THEN 'Risk-Off' WHEN risk_off_avoidance_score>=45 OR peak_correction_score>=55 THEN 'Fragile' WHEN risk_off_avoidance_score<=30 AND peak_correction_score<=38 THEN 'Risk-On' ELSE 'Transition' END AS model_regime FROM c2"""))
def _(t):
    return RV.composite_scores(vector(t)).select("date", *RV.SCORES, "risk_on_permission_score", "model_regime")


def _pr(x):
    v = f"list({x}) FILTER ({x} IS NOT NULL) OVER (ORDER BY date {rows(252)})"
    return f"(CASE WHEN {x} IS NOT NULL AND len({v})>=60 THEN (len(list_filter({v}, lambda q: q<{x}))+(len(list_filter({v}, lambda q: q={x}))+1)/2.0)/len({v}) END)"


_PK = ["near", "ext", "decel", "calm", "gap"]


# Series that stand for economic drivers: six part types and fourteen brands; whether a move is a difference, and its sign.
STAND_INS = {r[0]: ("type", d, r[2], r[3]) for d, r in ROLES.items()} | {n: ("brand", f"Brand#{10 * (k // 5 + 1) + k % 5 + 1}", "diff" if n.startswith("US10Y") else "return", s) for k, (n, s) in enumerate((
    ("SOX", 1.0), ("SP500", 1.0), ("RUSSELL2000", 1.0), ("HYG_IEF", 1.0), ("COPPER", 1.0), ("HANGSENG_TECH", 1.0), ("CSI300", 1.0), ("US10Y_2Y", 1.0), ("US10Y", -1.0), ("US10Y_REAL", -1.0), ("USDKRW", -1.0), ("USDJPY", -1.0), ("MOVE", -1.0), ("VXN", -1.0)))}
_ECON = "(" + " UNION ALL ".join(f"SELECT date, '{n}' AS driver, {'level' if kind == 'type' else 'close'} AS level FROM {DRIVERS if kind == 'type' else BRAND} WHERE {'driver' if kind == 'type' else 'symbol'}='{key}'" for n, (kind, key, _, _) in STAND_INS.items()) + ")"


def stand_ins(t):
    """date, driver, level of all twenty drivers."""
    name = lambda kind, c: F.create_map(*[F.lit(x) for n, (k, key, _, _) in STAND_INS.items() if k == kind for x in (key, n)])[F.col(c)]
    types = t.drivers.select("date", name("type", "driver").alias("driver"), "level")
    return types.unionByName(t.brand.select("date", name("brand", "symbol").alias("driver"), F.col("close").alias("level"))).where("driver IS NOT NULL")


_PKS = ["NASDAQ100", "VIX", "SOX", "RUSSELL2000", "HYG_IEF", "DXY", "US10Y"]
_PKW = f"(SELECT date, {', '.join(f'last_value({n} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}' for n in _PKS)} FROM (SELECT date, {', '.join(f"max(level) FILTER (driver='{n}') AS {n}" for n in _PKS)} FROM {_ECON} GROUP BY date))"
_r20 = lambda n: f"{n}/lag({n},20) OVER (ORDER BY date)-1"
_PKT = {"extended": f"NASDAQ100/({g('avg', 'NASDAQ100', 60, 20, '')})-1", "decel": f"-(({_r20('NASDAQ100')})-(NASDAQ100/lag(NASDAQ100,60) OVER (ORDER BY date)-1))", "calm": f"-({zs('VIX', 252, 84, '')})",
        "gap_a": f"({_r20('NASDAQ100')})-({_r20('SOX')})", "gap_b": f"({_r20('NASDAQ100')})-({_r20('RUSSELL2000')})", "credit": f"-({_r20('HYG_IEF')})", "dollar": _r20("DXY"), "rate": _r20("US10Y")}


@query("cp21_peak_fragility_rule", fin("date near:i s", f"""SELECT date, near, coalesce(least(100,greatest(0,100*(0.18*near+{'+'.join(f'{RV.PEAK_RULE[k]}*p_{k}' for k in _PKT)}))),0) AS s FROM (SELECT date, near, {', '.join(f'{_pr(k)} AS p_{k}' for k in _PKT)} FROM
 (SELECT date, (coalesce(NASDAQ100/({g('max', 'NASDAQ100', 60, 20, '')})-1>=-0.03,false))::INT AS near, {', '.join(f'{x} AS {k}' for k, x in _PKT.items())} FROM {_PKW}))"""))
def _(t):
    w = stand_ins(t).groupBy("date").agg(*[F.max(F.when(F.col("driver") == n, F.col("level"))).alias(n) for n in _PKS])
    w = w.select("date", *[R.padded(n, R.day()).alias(n) for n in _PKS])
    r20 = lambda n: R.step_return(n, 20, R.day())
    nas = "NASDAQ100"
    w = w.select("date", F.coalesce((ratio(nas, R.high(nas, 60, R.day(), 20)) - 1 >= -0.03).cast("int"), F.lit(0)).alias("near"), (ratio(nas, R.mean(nas, 60, R.day(), 20)) - 1).alias("extended"),
                 (-(r20(nas) - R.step_return(nas, 60, R.day()))).alias("decel"), (-R.zscore("VIX", 252, R.day(), 84)).alias("calm"), (r20(nas) - r20("SOX")).alias("gap_a"), (r20(nas) - r20("RUSSELL2000")).alias("gap_b"),
                 (-r20("HYG_IEF")).alias("credit"), r20("DXY").alias("dollar"), r20("US10Y").alias("rate"))
    w = RK.ranked(w, {k: (k, 252, True) for k in _PKT})
    return w.select("date", "near", RV.peak_rule({"near_high": F.col("near")} | {k: RK.percentile_rank(k, k, 60) for k in _PKT}).alias("s"))


_CX = {"nasdaq_sox_rs_20d": "n20-s20", "nasdaq_sp500_rs_20d": "n20-p20", "nasdaq_russell_rs_20d": "n20-u20", "sox_sp500_rs_20d": "s20-p20", "credit_equity_divergence": "n20-c20", "vol_complacency_reversal": "-vz-abs(nh)",
       "peak_without_riskoff": "peak_fragility-risk_off_score", "analog_peak_combo": "0.5*analog_history_risk+0.5*peak_fragility", "breakdown_acceleration": "CASE WHEN v5>0 THEN v5 WHEN v5 IS NOT NULL THEN 0 END-n5",
       "late_cycle_pressure": "0.35*peak_fragility+0.25*analog_history_risk+0.2*fx_external_stress+0.2*liquidity_credit_stress", "rai_breadth_collapse_pressure": "0.4*rai_appetite_stress+0.35*universe_breadth_stress+0.25*safe_rotation_stress"}
_CW = {"n20": ("NASDAQ100", "r20"), "s20": ("SOX", "r20"), "p20": ("SP500", "r20"), "u20": ("RUSSELL2000", "r20"), "c20": ("HYG_IEF", "r20"), "n5": ("NASDAQ100", "r5"), "v5": ("VIX", "r5"), "vz": ("VIX", "z252"), "nh": ("NASDAQ100", "dh60")}


@query("cp22_cross_terms", fin("date " + " ".join(_CX), VECTOR + f""", ct AS (SELECT date, driver, level/{lag('level', 20, 'driver')}-1 AS r20, level/{lag('level', 5, 'driver')}-1 AS r5, {zs('level', 252, 84, 'driver')} AS z252, level/({g('max', 'level', 60, 20, 'driver')})-1 AS dh60 FROM {_ECON} WHERE level<>0),
 cw AS (SELECT date, {', '.join(f"max({c}) FILTER (driver='{d}') AS {a}" for a, (d, c) in _CW.items())} FROM ct GROUP BY date)
 SELECT cw.date, {', '.join(f'{x} AS {a}' for a, x in _CX.items())} FROM cw LEFT JOIN vec ON vec.date=cw.date"""))
def _(t):
    from tideframe.plans.history import correction_features, cross_terms
    return cross_terms(correction_features(stand_ins(t)), vector(t))


@query("cp22_correction_features", fin("date driver:s r5 r10 r20 r60 z60 z252 dh60 dh120 dm60 v20", f"""SELECT date, driver, {', '.join(f"level/{lag('level', n, 'driver')}-1 AS r{n}" for n in (5, 10, 20, 60))}, {zs('level', 60, 20, 'driver')} AS z60, {zs('level', 252, 84, 'driver')} AS z252, level/({g('max', 'level', 60, 20, 'driver')})-1 AS dh60, level/({g('max', 'level', 120, 40, 'driver')})-1 AS dh120,
 level/({g('avg', 'level', 60, 20, 'driver')})-1 AS dm60, {g('stddev_samp', 'r1', 20, 10, 'driver')} AS v20 FROM (SELECT *, level/{lag('level', 1, 'driver')}-1 AS r1 FROM {DRIVERS})"""))
def _(t):
    from tideframe.plans.history import correction_features
    return correction_features(t.drivers)


@query("cp23_correction_composite", fin("date s st:s", f"SELECT date, s, CASE WHEN s<35 THEN 'Normal' WHEN s<50 THEN 'Watch' WHEN s<65 THEN 'High' ELSE 'Extreme' END AS st FROM (SELECT date, least(100,greatest(0,100*(0.28*score/100+0.42*(1-score/100)+0.22*score/200+0.08*score/100))) AS s FROM {RISK})"))
def _(t):
    p = F.col("score") / 100
    c = RV.correction_policy(p, 1 - p, p / 2, F.col("score"))
    return t.risk.select("date", c["correction_pressure_score"].alias("s"), c["correction_pressure_state"].alias("st"))


def _v3(c):
    return f"least(3,greatest(-3,coalesce({c},0)))"




def riskon(t):
    f = AS.driver_features(t.drivers, sp(t)).groupBy("date").pivot("driver", list(ROLES)).agg(F.first("riskon_score"))
    return f.select("date", *[F.col(d).alias(f"r_{r[0]}") for d, r in ROLES.items()])


_ROFF = "(SELECT date, driver, CASE driver " + " ".join(f"WHEN '{n}' THEN {sign}" for n, (_, _, _, sign) in STAND_INS.items()) + f" END*({zs('chg', 252, None, 'driver')}) AS r FROM (SELECT date, driver, CASE WHEN driver IN ({','.join(repr(n) for n, e in STAND_INS.items() if e[2] == 'diff')}) THEN level-{lag('level', 20, 'driver')} ELSE level/{lag('level', 20, 'driver')}-1 END AS chg FROM {_ECON} WHERE level IS NOT NULL))"
_RG = {n: "+".join(f"({w})*coalesce(max(least(3,greatest(-3,r))) FILTER (driver='{d}' AND r IS NOT NULL),0)" for d, w in ws.items()) for n, ws in AS.REGIME_WEIGHTS.items()}
_RN4 = dict(zip(_RG, "gydc"))


@query("cp24_rule_regime", fin("date rule_regime:s rule_confidence", f"SELECT date, CASE WHEN g>=greatest(y,d,c) THEN 'Risk-On Growth' WHEN y>=greatest(d,c) THEN 'Risk-On Cyclical' WHEN d>=c THEN 'Defensive / Rate-Cut' ELSE 'Risk-Off / Cash' END AS rule_regime, 1/(1+exp(-(list_reverse_sort([g,y,d,c])[1]-list_reverse_sort([g,y,d,c])[2]))) AS rule_confidence FROM (SELECT date, {', '.join(f'round({x},10) AS {_RN4[n]}' for n, x in _RG.items())} FROM {_ROFF} GROUP BY date)"))
def _(t):
    rows_ = [(n, m, s > 0) for n, (_, _, m, s) in STAND_INS.items()]
    specs_ = t.spark.createDataFrame(rows_, "driver string, transform string, higher_is_risk_on boolean")
    scores = AS.regime_scores(AS.driver_features(stand_ins(t), specs_))
    return scores.select("date", *[c.alias(k) for k, c in AS.rule_regime({n: F.col(f"`{n}`") for n in AS.REGIME_WEIGHTS}).items()])


_SG = "['Cash/short bonds','USD cash','Gold','US long bonds','US IG bonds','Korea defensive','Other']"


def safe_groups():
    n = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in ("Cash/short bonds", "USD cash", "Gold", "US long bonds", "US IG bonds", "Korea defensive", "Other")]), (n % 7 + 1).cast("int"))


def _boost():
    parts = " ".join("WHEN '{}' THEN {}+CASE dom {} ELSE 0 END".format(k, b, " ".join(f"WHEN '{c}' THEN {x}" for c, x in p.items())) for k, (b, p) in SF.STRESS_BOOST.items())
    return f"CASE sg {parts} END"


@query("cp25_safe_stress_score", fin("date symbol s", SENT + f", x AS (SELECT w.date, symbol, score, v, st, dom, {_SG}[CAST(regexp_extract(symbol,'([0-9]+)$',1) AS INT)%7+1] AS sg FROM {WEEKLY} w JOIN sent ON sent.date=w.date) SELECT date, symbol, CASE WHEN sg='Other' THEN score ELSE least(100,greatest(0,score+{_boost()}+CASE st WHEN 'Cash' THEN 8 WHEN 'De-risk' THEN 5 WHEN 'Watch' THEN 2 ELSE 0 END+least(50,greatest(0,v-25))*0.12)) END AS s FROM x"))
def _(t):
    d = t.weekly.join(sent(t), "date").withColumn("sg", safe_groups())
    return d.select("date", "symbol", SF.stress_score("score", "sg", "dominant_component", "sentinel_state", "risk_off_score").alias("s"))


_MWH = {k: {c: w for c, w in ws.items() if c in _all | set(RV.AXES) | {"risk_off_avoidance_score", "peak_correction_score"}} for k, ws in SF.ECONOMY_WEIGHTS.items()}


@query("cp26_safe_economy_selector", fin("date symbol s", VECTOR + f""", c1 AS (SELECT *, round({_S['crash_sentinel_score']},8) AS crash_sentinel_score, round({_S['peak_correction_score']},8) AS peak_correction_score FROM vec), c2 AS (SELECT *, round({_S['risk_off_avoidance_score']},8) AS risk_off_avoidance_score FROM c1),
 x AS (SELECT w.date, symbol, score, CASE {_SG}[CAST(regexp_extract(symbol,'([0-9]+)$',1) AS INT)%7+1] """ + " ".join(f"WHEN '{k}' THEN ({'+'.join(f'{clipped(c)}/100*({w})' for c, w in ws.items())})/{sum(abs(x) for x in ws.values())}" for k, ws in _MWH.items() if k not in ("FX cash", "Korea bonds")) + f""" ELSE 0 END AS raw FROM {WEEKLY} w JOIN c2 ON c2.date=w.date)
 SELECT date, symbol, 0.58*{zsql('score')}+0.42*{zsql('raw')} AS s FROM x"""))
def _(t):
    d = t.weekly.join(RV.composite_scores(vector(t)).drop("score"), "date").withColumn("sg", safe_groups())
    d = SF.economy_score(d, "sg").withColumn("tech", S.z("score", S.by_date()))
    return d.select("date", "symbol", SF.selector_score("tech", "economy_score").alias("s"))


@query("cp27_policy_state", fin("date p st:s hw:i hd:i hc:i", SENT + f""", x AS (SELECT sent.date, v, st AS ss, CASE dom WHEN 'volatility' THEN 'VIX' WHEN 'credit' THEN 'HY_OAS' WHEN 'equity' THEN 'NASDAQ100' WHEN 'fx' THEN 'DXY' ELSE 'WTI' END AS d, coalesce(mom,0) AS m, r.score/100 AS p FROM sent JOIN {RISK} r ON r.date=sent.date),
 y AS (SELECT *, ss<>'Normal' AND (regexp_matches(d,'{RV.SYSTEMIC}') OR v>=28 OR m>=8) AS hw, ss IN ('De-risk','Cash') OR (ss<>'Normal' AND regexp_matches(d,'{RV.VOL_CREDIT}') AND v>=40) AS hd, ss='Cash' OR (ss='De-risk' AND regexp_matches(d,'{RV.VOL_CREDIT}') AND v>=70) AS hc FROM x),
 k AS (SELECT date, hw, hd, hc, greatest(least(100,100*(0.25*p+0.20*p+0.25*p/2+0.15*p+0.15*v/100)), CASE WHEN p>=0.9 THEN 50 ELSE 0 END, CASE WHEN hw THEN 35 ELSE 0 END, CASE WHEN hd THEN 50 ELSE 0 END, CASE WHEN hc THEN 65 ELSE 0 END) AS p FROM y) SELECT *, CASE WHEN p<35 THEN 'Normal' WHEN p<50 THEN 'Watch' WHEN p<65 THEN 'De-risk' ELSE 'Cash' END AS st FROM k"""))
def _(t):
    name = {"volatility": "VIX", "credit": "HY_OAS", "equity": "NASDAQ100", "fx": "DXY"}
    dom = F.coalesce(F.create_map(*[F.lit(x) for kv in name.items() for x in kv])[F.col("dominant_component")], F.lit("WTI"))
    d = sent(t).withColumn("dominant_component", dom).join(t.risk.select("date", (F.col("score") / 100).alias("p")), "date")
    d = d.withColumns({"prob_down_1w": F.col("p"), "prob_down_1w_2pct": F.col("p"), "prob_down_1w_3pct": F.col("p") / 2, "prob_down_1m_5pct": F.col("p"), "signal_down_1w_3pct": (F.col("p") >= 0.9).cast("int")})
    return RV.policy_state(d).select("date", F.col("ml_risk_off_score").alias("p"), F.col("ml_policy_state").alias("st"), F.col("hard_overlay_watch").alias("hw"), F.col("hard_overlay_derisk").alias("hd"), F.col("hard_overlay_cash").alias("hc"))


def proxies(t):
    return SF.proxy_returns(wide(t), {"NASDAQ100": 0.4, "WTI": 0.3}, "HY_OAS", "VIX", "DXY", "DXY", "GOLD")


_r1 = lambda c: f"coalesce({c}/lag({c},1) OVER (ORDER BY date)-1,0)"
PROXY = f"""(SELECT *, 0.35*cash_return+0.30*bond_return+0.20*gold_return+0.15*usd_return AS safe_equal_return FROM (SELECT *, least(0.08,greatest(-0.08,0.7*rx+0.3*rx+cash_return)) AS usd_return FROM (SELECT date, (0.4*{_r1('n')}+0.3*{_r1('wt')})/0.7 AS risk_return, least(0.001,greatest(-0.001,coalesce(h,0)/100/252)) AS cash_return,
 least(0.08,greatest(-0.08,-12.0*coalesce(v-lag(v,1) OVER (ORDER BY date),0)/100+coalesce(v,0)/100/252)) AS bond_return, least(0.1,greatest(-0.1,{_r1('gg')}+0.5*{_r1('d')})) AS gold_return, {_r1('d')} AS rx FROM (SELECT date, {', '.join(f'{_ff(c)} AS {a}' for c, a in (('NASDAQ100', 'n'), ('WTI', 'wt'), ('HY_OAS', 'h'), ('VIX', 'v'), ('DXY', 'd'), ('GOLD', 'gg')))} FROM {WIDE}))))"""


@query("cp28_proxy_returns", fin("date risk_return cash_return bond_return gold_return usd_return safe_equal_return", f"FROM {PROXY}"))
def _(t):
    return proxies(t)


_ST3 = f"(SELECT date, close, score, CASE WHEN score<50 THEN 'Normal' WHEN score<60 THEN 'Watch' WHEN score<70 THEN 'De-risk' ELSE 'Cash' END AS st FROM {RISK})"


@query("cp29_risk_budgets", fin("date wt ad vx pb mix", f"""SELECT s.date, CASE st WHEN 'Normal' THEN 0.7 WHEN 'Watch' THEN 0.5 WHEN 'De-risk' THEN 0.35 ELSE 0.15 END AS wt, CASE WHEN st='Cash' AND a1<30 AND a2<35 AND a3>=a1 AND a3>=a2 AND vx<28 THEN 0.7 ELSE CASE st WHEN 'Normal' THEN 0.7 WHEN 'Watch' THEN 0.6 WHEN 'De-risk' THEN 0.45 ELSE 0.15 END END AS ad,
 CASE WHEN vx>=35 THEN 0.15 WHEN vx>=25 THEN 0.35 WHEN vx>=20 THEN 0.5 ELSE 0.7 END AS vx, CASE WHEN score>=65 THEN 0.15 WHEN score>=50 THEN 0.35 WHEN score>=38 THEN 0.5 ELSE 0.7 END AS pb, CASE WHEN a2>=greatest(a1,a3) THEN 0.20*cash_return+0.15*bond_return+0.25*gold_return+0.40*usd_return WHEN a1>=greatest(a2,a3) THEN 0.20*cash_return+0.45*bond_return+0.20*gold_return+0.15*usd_return ELSE 0.25*cash_return+0.35*bond_return+0.30*gold_return+0.10*usd_return END AS mix
 FROM (SELECT *, day(date)::DOUBLE AS a1, month(date)*3.0 AS a2, score AS a3, score/2 AS vx FROM {_ST3}) s JOIN {PROXY} p ON p.date=s.date"""))
def _(t):
    d = t.risk.join(proxies(t), "date").withColumns({"st": stage_of("score", 50, 60, 70), "a1": F.dayofmonth("date").cast("double"), "a2": F.month("date") * 3.0, "v": F.col("score") / 2})
    return d.select("date", SF.stage_budget("st").alias("wt"), SF.adaptive_weight("st", "a1", "a2", "score", "v").alias("ad"), SF.vix_budget("v").alias("vx"), SF.probability_budget(F.col("score") / 100, F.lit(0)).alias("pb"), SF.dynamic_safe_return("a1", "a2", "score").alias("mix"))


@query("cp30_gate_weight", fin("date stage:s wt", f"""SELECT date, st AS stage, greatest(0,least(CASE st WHEN 'Normal' THEN CASE WHEN e THEN 0.6 ELSE 0.25 END WHEN 'Watch' THEN CASE WHEN e THEN 0.45 ELSE 0.15 END WHEN 'De-risk' THEN CASE WHEN e THEN 0.2 ELSE 0.05 END ELSE 0.05 END, CASE WHEN l THEN 0.2 ELSE 0.6 END, CASE WHEN k>=2 THEN 0.25 ELSE 0.6 END, CASE WHEN e THEN 0.6 ELSE 0.25 END)) AS wt
 FROM (SELECT *, day(date)%2=0 AS e, day(date)%7=0 AS l, day(date)%4 AS k FROM {_ST3})"""))
def _(t):
    d = t.risk.withColumns({"a": stage_of("score", 50, 60, 70), "b": F.lit("Normal")}).withColumn("stage", SF.worst_stage("a", "b"))
    n = F.dayofmonth("date")
    return d.select("date", "stage", SF.gate_weight("stage", n % 2 == 0, n % 7 == 0, n % 4).alias("wt"))


def candidates(t):
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol"))
    d = t.weekly.withColumn("rn", rn)
    return d.groupBy("date").agg(F.max("score").alias("top1_score"), F.avg(F.when(F.col("rn") <= 3, F.col("score"))).alias("topk_score_mean"), (F.max("score") - F.median("score")).alias("score_spread"))


_EP = lambda c: f"(CASE WHEN len(l_{c})>=26 THEN len(list_filter(l_{c}, lambda q: q<={c}))::DOUBLE/len(l_{c}) END)"


@query("cp31_confidence_score", fin("date s", f"""SELECT date, (0.3*coalesce({_EP('a')},0.5)+0.3*coalesce({_EP('b')},0.5)+0.1*coalesce({_EP('c')},0.5))/0.7 AS s FROM (SELECT *, {', '.join(f"list({c}) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_{c}" for c in 'abc')} FROM
 (SELECT date, max(score) AS a, round(avg(score) FILTER (rn<=3),8) AS b, round(max(score)-median(score),8) AS c FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM {WEEKLY}) GROUP BY date))"""))
def _(t):
    d = candidates(t).withColumns({c: F.round(c, 8) for c in ("topk_score_mean", "score_spread")})
    parts = ("top1_score", "topk_score_mean", "score_spread")
    d = RK.ranked(d, {c: (c, None, False) for c in parts})
    d = d.withColumns({f"{c}_pctile": RK.share_not_above(c, c, 26) for c in parts})
    return d.select("date", SF.confidence(d).alias("s"))


@query("cp32_score_blends", fin("date symbol blend_rule25 blend_rule50", f"SELECT date, symbol, {', '.join(f'{s}*{zsql('score', fn='stddev_pop')}+{1 - s}*{zsql('prob', fn='stddev_pop')} AS blend_rule{round(s * 100)}' for s in (0.25, 0.5))} FROM {WEEKLY}"))
def _(t):
    return L.blends(t.weekly, "score", "prob", [0.25, 0.5]).select("date", "symbol", "blend_rule25", "blend_rule50")


@query("cp33_bubble_penalty", fin("date symbol s bubble lab:s rk:i", f"SELECT date, symbol, s, b*100 AS bubble, CASE WHEN b>=0.6 THEN 'crash-alert' WHEN b>=0.3 THEN 'caution' ELSE 'stable' END AS lab, row_number() OVER (PARTITION BY date ORDER BY s DESC, symbol) AS rk FROM (SELECT date, symbol, b, round(least(100,greatest(0,score-28*b)),2) AS s FROM (SELECT *, coalesce(CASE WHEN n%3<>0 THEN n/25.0 END,0) AS b FROM (SELECT *, CAST(regexp_extract(symbol,'([0-9]+)$',1) AS INT) AS n FROM {WEEKLY}) w))".replace("*, CAST", "date, symbol, score, CAST"), 2))
def _(t):
    n = F.regexp_extract("n_name", "([0-9]+)$", 1).cast("int")
    b = t.nation.select(F.col("n_name").alias("symbol"), (n / 25.0).alias("dtcai")).filter(n % 3 != 0)
    d = AS.bubble_merge(t.weekly, b, "score")
    r2 = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    return d.select("date", "symbol", r2("adjusted_score").alias("s"), r2("bubble_score_0_100").alias("bubble"), F.col("bubble_label").alias("lab"), F.col("adjusted_rank").alias("rk"))


@query("cp34_analog_features", fin("date driver:s level r5 r20 z60", f"SELECT date, driver, level, level/{lag('level', 5, 'driver')}-1 AS r5, level/{lag('level', 20, 'driver')}-1 AS r20, {zs('level', 60, 20, 'driver')} AS z60 FROM {DRIVERS}"))
def _(t):
    from tideframe.plans.history import analog_features
    return analog_features(t.drivers)


@query("cp35_market_panel", fin("date composite VIX GOLD close", VECTOR + f" SELECT v.date, composite_vector_risk AS composite, {_ff('w.VIX').replace('ORDER BY date', 'ORDER BY v.date')} AS VIX, {_ff('w.GOLD').replace('ORDER BY date', 'ORDER BY v.date')} AS GOLD, m.close FROM vec v LEFT JOIN {WIDE} w ON w.date=v.date LEFT JOIN {MARKET} m ON m.date=v.date"))
def _(t):
    d = vector(t).select("date", F.col("composite_vector_risk").alias("composite")).join(wide(t), "date", "left").join(t.market, "date", "left")
    return d.select("date", "composite", R.padded("VIX", R.day()).alias("VIX"), R.padded("GOLD", R.day()).alias("GOLD"), "close")
