"""2.11 Technical and stock factors."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.folds import ema_sql
from tideframe.functions import rolling as R
from tideframe.functions.scalar import ratio
from tideframe.operators import aggregates as G, factors as FA, folds as FO, panel as P, topk as T
from tideframe.plans.fixtures import BARS, BRAND, MARKET, WEEKDAYS

_S = "PARTITION BY symbol ORDER BY date"


def _rows(n):
    return f"OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# Daily columns of the bars, numbered from the end (rn = 1 is the last bar).
DAILY = f"""(SELECT *, sum(sv) OVER ({_S}) AS obv, CASE WHEN count(close) {_rows(14)}>=14 THEN 100*sum(pf) {_rows(14)}/nullif(sum(pf) {_rows(14)}+sum(nf) {_rows(14)},0) END AS mfi,
 CASE WHEN count(delta) {_rows(14)}>=14 THEN 100-100/(1+avg(greatest(delta,0)) FILTER (delta IS NOT NULL) {_rows(14)}/nullif(avg(greatest(-delta,0)) FILTER (delta IS NOT NULL) {_rows(14)},0)) END AS rsi,
 CASE WHEN count(fl) {_rows(21)}>=21 THEN sum(fl) {_rows(21)}/nullif(sum(volume) {_rows(21)},0) END AS cmf,
 CASE WHEN count(close) {_rows(50)}>=50 THEN avg(close) {_rows(50)} END AS ma50, CASE WHEN count(volume) {_rows(10)}>=10 THEN avg(volume) {_rows(10)} END AS vol10 FROM
 (SELECT *, close/lag(close) OVER ({_S})-1 AS ret, close-lag(close) OVER ({_S}) AS delta, close*volume AS dollar, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn,
 coalesce(sign(close-lag(close) OVER ({_S})),0)*volume AS sv, CASE WHEN ty>lag(ty) OVER ({_S}) THEN ty*volume ELSE 0 END AS pf, CASE WHEN ty<lag(ty) OVER ({_S}) THEN ty*volume ELSE 0 END AS nf,
 ((close-low)-(high-close))/nullif(high-low,0)*volume AS fl FROM (SELECT *, (high+low+close)/3 AS ty FROM {BARS})))"""


def last(*pairs, where="true"):
    return f"SELECT symbol, {', '.join(f'{e} AS {a}' for a, e in pairs)} FROM {DAILY} WHERE rn<=260 GROUP BY symbol"


def av(c, n, skip=0):
    return f"avg({c}) FILTER (rn>{skip} AND rn<={n + skip})"


def back(c, k=1):
    return f"max({c}) FILTER (rn={k})"


def reg(name, sql, *factors):
    cols = "symbol " + " ".join(factors)
    query(name, fin(cols, sql))(lambda t: FA.factors(t.bars, [f.split(":")[0] for f in factors]))


reg("tf01_money_flow_index", last(("mfi_14", back("mfi"))), "mfi_14")
reg("tf02_rsi", last(("rsi_14", back("rsi"))), "rsi_14")


@query("tf03_macd_histogram", fin("date symbol macd_hist", f"""{ema_sql(BRAND, [12, 26])}, m AS (SELECT symbol, date, n, e12-e26 AS x FROM r),
 q AS (SELECT symbol, date, n, x, x AS s FROM m WHERE n=1 UNION ALL SELECT m.symbol, m.date, m.n, m.x, m.x*0.2+q.s*0.8 FROM q JOIN m ON m.symbol=q.symbol AND m.n=q.n+1)
 SELECT date, symbol, x-s AS macd_hist FROM q""", 5))
def _(t):
    d = FA.macd_hist(t.brand)
    return d.select("date", "symbol", (F.floor(F.col("macd_hist") * 1e5 + 0.5) / 1e5).alias("macd_hist"))


WBARS = f"(SELECT max(date) AS date, symbol, arg_min(open,date) AS open, max(high) AS high, min(low) AS low, arg_max(close,date) AS close, sum(volume) AS volume FROM {BARS} GROUP BY symbol, {WEEKDAYS.format(d='date')})"


@query("tf04_chaikin_money_flow", fin("symbol cmf_21", last(("cmf_21", back("cmf"))).replace(BARS, WBARS)))
def _(t):
    return FA.factors(P.resample_bars(t.bars, "W"), ["cmf_21"])


reg("tf05_volume_ratios", last(("dollar_volume_ratio_20_120", f"CASE WHEN max(rn)>=120 THEN {av('dollar', 20)}/nullif({av('dollar', 120)},0) END"),
                               ("relative_volume_20_60", f"CASE WHEN max(rn)>=60 THEN {av('volume', 20)}/nullif({av('volume', 60)},0) END")), "dollar_volume_ratio_20_120", "relative_volume_20_60")
reg("tf06_up_down_volume", last(("up_down_volume_ratio_20d", "CASE WHEN max(rn)>=21 THEN coalesce(sum(volume) FILTER (rn<=20 AND ret>0),0)/nullif(coalesce(sum(volume) FILTER (rn<=20 AND ret<0),0),0) END"),
                                ("up_days_have_volume", "CASE WHEN max(rn)>=25 THEN avg(volume) FILTER (rn<25 AND ret>0)>avg(volume) FILTER (rn<25 AND ret<0) END")), "up_down_volume_ratio_20d", "up_days_have_volume:i")
reg("tf07_accumulation_days", last(*[(n, f"CASE WHEN max(rn)>=21 THEN count(*) FILTER (rn<=12 AND ret{c} AND volume>vol10) END") for n, c in (("accumulation_days_20d", ">0.015"), ("distribution_days_20d", "<-0.015"))]),
    "accumulation_days_20d:i", "distribution_days_20d:i")
reg("tf08_volume_price_cv", last(("volume_price_cv_1m", "CASE WHEN max(rn)>=20 THEN stddev_pop(dollar) FILTER (rn<=21)/nullif(avg(dollar) FILTER (rn<=21),0) END")), "volume_price_cv_1m")
reg("tf09_linear_slope", last(*[(a, f"CASE WHEN max(rn)>=20 THEN regr_slope({c},-rn) FILTER (rn<={n})/nullif(avg({c}) FILTER (rn<={n}),0)*100 END") for a, c, n in (("trend_line_cps", "close", 126), ("obv_slope_60d", "obv", 60))]), "trend_line_cps", "obv_slope_60d")


def _ret(n):
    return f"CASE WHEN max(rn)>{n} THEN ({back('close')}/{back('close', n)}-1)*100 END"


@query("tf10_overheat_penalty", fin("symbol high_proximity overheat_penalty", f"""SELECT symbol, hp AS high_proximity, round(least(25.0, CASE WHEN c>120 THEN least(12.0,(c-120)/15) ELSE 0 END + CASE WHEN a>45 THEN least(10.0,(a-45)/7) ELSE 0 END
 + CASE WHEN hp>=0.98 AND a>25 THEN 5.0 ELSE 0 END + CASE WHEN b>0 AND a>30 AND a/b>0.75 THEN 4.0 ELSE 0 END),4) AS overheat_penalty FROM ({last(("a", _ret(63)), ("b", _ret(126)), ("c", _ret(252)), ("hp", back("close") + "/max(close) FILTER (rn<=252)"))})"""))
def _(t):
    d = FA.with_derived(FA.factors(t.bars, ["return_3m", "return_6m", "return_12m", "close", "high_52w"]))
    return d.select("symbol", "high_proximity", "overheat_penalty")


_B = lambda c: f"coalesce({c},false)::INT"
_TT = f"""SELECT symbol, CASE WHEN n>=200 THEN ({_B('p>m150 AND p>m200')}+{_B('m150>m200')}+{_B('m200>m200t')}+{_B('m50>m150 AND m50>m200')}+{_B('p>m50')}+{_B('p>=lo*1.3')}+{_B('p>=hi*0.75')})/7.0*17 END AS minervini_qm_score FROM
 ({last(("n", "max(rn)"), ("p", back("close")), ("m50", av("close", 50)), ("m150", av("close", 150)), ("m200", av("close", 200)), ("m200t", "CASE WHEN max(rn)>=221 THEN " + av("close", 200, 21) + " END"), ("hi", "max(close) FILTER (rn<=252)"), ("lo", "min(close) FILTER (rn<=252)"))})"""
reg("tf11_trend_template", _TT, "minervini_qm_score")


@query("tf12_pivots", fin("date symbol low_pivot:i high_pivot:i", f"""SELECT date, symbol, count(*) OVER f=5 AND low=min(low) OVER f AS low_pivot, count(*) OVER f=5 AND high=max(high) OVER f AS high_pivot FROM {BARS} WINDOW f AS ({_S} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""))
def _(t):
    return FA.pivots(t.bars, 2, ["symbol"]).select("date", "symbol", "low_pivot", "high_pivot")


@query("tf13_divergence_scores")
def _(t):
    return FA.divergence_scores(t.bars)


reg("tf14_ma_reclaim", last(("ma50_reclaim_score", f"CASE WHEN max(rn)>=70 THEN CASE WHEN {back('close')}>{back('ma50')} AND bool_or(rn<=20 AND coalesce(close<ma50,false)) THEN 100 WHEN {back('close')}>{back('ma50')} THEN 60 ELSE 0 END END")), "ma50_reclaim_score")
_PH = "max(close) FILTER (rn>=2 AND rn<=61)"
reg("tf15_base_breakout", last(("base_breakout_score", f"CASE WHEN max(rn)>=80 THEN CASE WHEN {back('close')}>{_PH} AND {av('volume', 20)}/nullif({av('volume', 60)},0)>1.2 THEN 100 WHEN {back('close')}>{_PH} THEN 75 WHEN {back('close')}>{_PH}*0.95 THEN 50 ELSE 0 END END")), "base_breakout_score")


# Company-like facts per brand, from the part and lineitem tables.
INFO = """(SELECT p_brand AS symbol, sum(CAST(round(p_retailprice*100) AS BIGINT))::DOUBLE/100 AS market_cap, count(*)*600.0 AS total_assets, sum(p_size)::DOUBLE*9 AS debt_to_equity_raw,
 (sum(p_size)::DOUBLE/count(*)-25)/20 AS revenue_growth, CASE WHEN count(*)%3<>0 THEN (count(*)::DOUBLE%7-3)/5 END AS earnings_growth, CASE WHEN count(*)%4<>0 THEN (count(*)::DOUBLE%11-4)*1000 END AS free_cashflow, count(*)%5*100.0 AS total_cash,
 CASE WHEN count(*)%5<>0 THEN sum(p_size)%10/20.0::DOUBLE END AS gross_margins, (sum(p_size)%7-2)/20.0::DOUBLE AS operating_margins, CASE WHEN sum(p_size)%3<>0 THEN (count(*)%7-3)/20.0::DOUBLE END AS profit_margins,
 CASE WHEN count(*)%6<>0 THEN (count(*)%9-4)/20.0::DOUBLE END AS return_on_equity, (count(*)%5-2)/40.0::DOUBLE AS return_on_assets, (sum(p_size)%300)::DOUBLE AS debt_to_equity, CASE WHEN sum(p_size)%4<>0 THEN (count(*)%4*5000)::DOUBLE END AS research_development,
 CASE WHEN count(*)%2=0 THEN (count(*)%3*100)::DOUBLE END AS total_debt, CASE WHEN count(*)%3<>0 THEN sum(CAST(round(p_retailprice*100) AS BIGINT))::DOUBLE/100/count(*) END AS target_price, CASE WHEN sum(p_size)%5<>0 THEN (count(*)%5-1)/2.0::DOUBLE END AS beta FROM part GROUP BY 1)"""


def info(t):
    n, size = F.count(F.lit(1)), F.sum("p_size").cast("double")
    return t.part.groupBy(F.col("p_brand").alias("symbol")).agg(
        (F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).cast("double") / 100).alias("market_cap"), (n * 600.0).alias("total_assets"), (size * 9).alias("debt_to_equity_raw"),
        ((size / n - 25) / 20).alias("revenue_growth"), F.when(n % 3 != 0, (n.cast("double") % 7 - 3) / 5).alias("earnings_growth"),
        F.when(n % 4 != 0, (n.cast("double") % 11 - 4) * 1000).alias("free_cashflow"), (n % 5 * 100.0).alias("total_cash"),
        F.when(n % 5 != 0, size % 10 / 20).alias("gross_margins"), ((size % 7 - 2) / 20).alias("operating_margins"), F.when(size % 3 != 0, (n % 7 - 3) / 20).alias("profit_margins"),
        F.when(n % 6 != 0, (n % 9 - 4) / 20).alias("return_on_equity"), ((n % 5 - 2) / 40).alias("return_on_assets"), (size % 300).alias("debt_to_equity"),
        F.when(size % 4 != 0, (n % 4 * 5000).cast("double")).alias("research_development"), F.when(n % 2 == 0, (n % 3 * 100).cast("double")).alias("total_debt"),
        F.when(n % 3 != 0, F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).cast("double") / 100 / n).alias("target_price"), F.when(size % 5 != 0, (n % 5 - 1) / 2).alias("beta"))


@query("tf16_growth_and_balance", fin("symbol growth balance", f"""SELECT i.symbol, ({_B('a>0')}+{_B('b>0')}+{_B('c>0')}+{_B('revenue_growth>0')}+{_B('earnings_growth>0')})/5.0*11 AS growth,
 (({_B('revenue_growth>0')}+{_B('earnings_growth>0')}+{_B('free_cashflow>0')})/nullif((revenue_growth IS NOT NULL)::INT+(earnings_growth IS NOT NULL)::INT+(free_cashflow IS NOT NULL)::INT,0)::DOUBLE)*16 AS balance
 FROM {INFO} i JOIN ({last(("a", _ret(63)), ("b", _ret(126)), ("c", _ret(252)))}) f ON f.symbol=i.symbol"""))
def _(t):
    from tideframe.plans.screening import balance_score, growth_score
    d = FA.factors(t.bars, ["return_3m", "return_6m", "return_12m"]).join(info(t), "symbol")
    checks = {c: F.col(c) > 0 for c in ("revenue_growth", "earnings_growth", "free_cashflow")}
    return d.select("symbol", growth_score().alias("growth"), balance_score(checks).alias("balance"))


@query("tf17_factor_assembly")
def _(t):
    from tideframe.plans.screening import factor_table
    return factor_table(t.bars, info(t))


@query("tf18_scores_and_routes")
def _(t):
    from tideframe.plans import screening as SC
    return SC.scored(SC.factor_table(t.bars, info(t)), SC.DEMO_PROFILE)


@query("tf19_checklist_and_survival", fin("symbol passed:i known:i survival:s", f"""SELECT f.symbol, {_B('p>m50')}+{_B('m150>m200')}+{_B('p>=lo*1.3')}+{_B('p>=hi*0.75')}+coalesce(uv,false)::INT+{_B('earnings_growth>0')} AS passed,
 5+(uv IS NOT NULL)::INT AS known, coalesce(nullif(concat_ws(';', CASE WHEN revenue_growth<-0.15 THEN 'growth_lt_-15pct' END, CASE WHEN total_cash/total_assets<0.01 AND free_cashflow/total_assets<-0.05 THEN 'cash_low_and_fcf_negative' END),''),'pass') AS survival
 FROM {INFO} i JOIN ({last(("p", back("close")), ("m50", "CASE WHEN max(rn)>=50 THEN " + av("close", 50) + " END"), ("m150", "CASE WHEN max(rn)>=150 THEN " + av("close", 150) + " END"), ("m200", "CASE WHEN max(rn)>=200 THEN " + av("close", 200) + " END"), ("hi", "max(close) FILTER (rn<=252)"), ("lo", "min(close) FILTER (rn<=252)"), ("uv", "CASE WHEN max(rn)>=25 THEN avg(volume) FILTER (rn<25 AND ret>0)>avg(volume) FILTER (rn<25 AND ret<0) END"))}) f ON f.symbol=i.symbol"""))
def _(t):
    from tideframe.plans.screening import checklist, counts, survival_reasons
    d = FA.factors(t.bars, ["close", "ma50", "ma150", "ma200", "high_52w", "low_52w", "up_days_have_volume"]).join(info(t), "symbol")
    known = lambda c: F.coalesce(c, F.lit(False))
    items = checklist([("above MA50", known(F.col("close") > F.col("ma50")), F.col("close")), ("MA150 above MA200", known(F.col("ma150") > F.col("ma200")), F.col("ma150")),
                       ("30% above the 52-week low", F.col("close") >= F.col("low_52w") * 1.3, F.col("low_52w")), ("within 25% of the 52-week high", F.col("close") >= F.col("high_52w") * 0.75, F.col("high_52w")),
                       ("volume on rising days", F.col("up_days_have_volume"), F.lit(None)), ("earnings growth", known(F.col("earnings_growth") > 0), F.col("earnings_growth"))])
    reasons = survival_reasons([(F.col("revenue_growth") < -0.15, "growth_lt_-15pct"),
                                ((ratio("total_cash", "total_assets") < 0.01) & (ratio("free_cashflow", "total_assets") < -0.05), "cash_low_and_fcf_negative")])
    d = d.withColumns({"items": items, "survival": reasons})
    return d.select("symbol", *counts("items"), "survival")


_STAGES = {
    "data": ["p IS NOT NULL", "market_cap IS NOT NULL"], "moat": [_B("gross_margins>0.35"), _B("operating_margins>0.15")],
    "cash_flow": [_B("free_cashflow>0"), _B("gross_margins>0"), "research_development IS NOT NULL"], "time": [_B("r6>0"), _B("revenue_growth>0")],
    "finance": [_B(c) for c in ("return_on_equity>0", "return_on_assets>0", "debt_to_equity<150", "profit_margins>0", "return_on_equity>0", "research_development>0 AND market_cap/research_development<=15", "revenue_growth>0",
                                "(total_cash-coalesce(total_debt,0))/market_cap*100>=10", "p>=hi*0.85", "earnings_growth>0")],
    "momentum": [_B("p>=hi*0.85"), "p>target_price", "r6/coalesce(nullif(abs(beta),0),1) BETWEEN 0 AND 50"]}
_STAGE_SCORE = lambda items: f"round(({'+'.join(f'coalesce(({i})::INT,0)' for i in items)})*100.0/nullif({'+'.join(f'(({i}) IS NOT NULL)::INT' for i in items)},0)::DOUBLE,2)"
_GATES = f"""SELECT symbol, floor(({'+'.join(f"coalesce({k},0)" for k in _STAGES)})/({'+'.join(f"({k} IS NOT NULL)::INT" for k in _STAGES)})*100+0.5+1e-7)/100 AS gate_score,
 concat_ws(', ', {', '.join(f"CASE WHEN {k}<60 THEN '{k}' END" for k in _STAGES)}) AS failed FROM (SELECT symbol, {', '.join(f'{_STAGE_SCORE(v)} AS {k}' for k, v in _STAGES.items())} FROM
 (SELECT f.symbol, p, hi, r6, i.* EXCLUDE symbol FROM ({last(("p", back("close")), ("hi", "max(close) FILTER (rn<=252)"), ("r6", _ret(126)))}) f LEFT JOIN {INFO} i ON i.symbol=f.symbol))"""


@query("tf20_stage_gates_and_verdict", fin("symbol gate_score failed:s verdict:s", f"SELECT *, CASE WHEN failed<>'' THEN 'reject: '||array_to_string(string_split(failed,', ')[1:2],', ') WHEN gate_score>=60 THEN 'pass' ELSE 'conditional hold: research open' END AS verdict FROM ({_GATES})"))
def _(t):
    from tideframe.plans import screening as SC
    d = FA.factors(t.bars, ["close", "high_52w", "return_6m"]).join(info(t), "symbol", "left")
    return SC.stage_verdicts(d).select("symbol", "gate_score", "failed", "verdict")


FLOW = """(SELECT CAST(o_orderdate AS DATE) AS date, n_name AS symbol, c_mktsegment AS investor, sum(CASE WHEN o_orderpriority<'3' THEN CAST(round(o_totalprice*100) AS BIGINT) ELSE 0 END)::DOUBLE/100 AS buy,
 sum(CASE WHEN o_orderpriority>='3' THEN CAST(round(o_totalprice*100) AS BIGINT) ELSE 0 END)::DOUBLE/100 AS sell FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,3)"""


def flows(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    v = F.round(F.col("o_totalprice") * 100).cast("long")
    side = lambda cond: F.sum(F.when(cond, v).otherwise(0)).cast("double") / 100
    return j.groupBy(F.to_date("o_orderdate").alias("date"), F.col("n_name").alias("symbol"), F.col("c_mktsegment").alias("investor")).agg(
        side(F.col("o_orderpriority") < "3").alias("buy"), side(F.col("o_orderpriority") >= "3").alias("sell"))


@query("tf21_investor_flows", fin("symbol strength_45 strength_120 persistence combo_45 accel", f"""WITH v AS (SELECT symbol, sum(buy+sell) FILTER (date>DATE '2001-06-30'-45) AS t1, sum(buy+sell) AS t2 FROM {FLOW} WHERE date<=DATE '2001-06-30' AND date>DATE '2001-06-30'-120 GROUP BY 1),
 f AS (SELECT f.symbol, investor, sum(buy-sell) FILTER (date>DATE '2001-06-30'-45)/any_value(t1)*100 AS s1, sum(buy-sell)/any_value(t2)*100 AS s2 FROM {FLOW} f JOIN v ON v.symbol=f.symbol WHERE date<=DATE '2001-06-30' AND date>DATE '2001-06-30'-120 GROUP BY 1,2),
 p AS (SELECT symbol, avg((buy>sell)::INT)*100 AS persistence FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM {FLOW} WHERE investor='BUILDING' AND date<=DATE '2001-06-30') WHERE rn<=20 GROUP BY 1)
 SELECT f.symbol, max(s1) FILTER (investor='BUILDING') AS strength_45, max(s2) FILTER (investor='BUILDING') AS strength_120, any_value(persistence) AS persistence,
 sum(s1*w)/sum(w) FILTER (s1 IS NOT NULL) AS combo_45, combo_45-sum(s2*w)/sum(w) FILTER (s2 IS NOT NULL) AS accel FROM f JOIN (VALUES ('BUILDING',1.0),('MACHINERY',1.0),('FURNITURE',0.5),('HOUSEHOLD',0.35)) k(i,w) ON i=investor LEFT JOIN p ON p.symbol=f.symbol GROUP BY 1""", 5))
def _(t):
    from tideframe.plans.screening import flow_metrics
    d = flow_metrics(flows(t), "2001-06-30", {"BUILDING": 1.0, "MACHINERY": 1.0, "FURNITURE": 0.5, "HOUSEHOLD": 0.35}, "BUILDING")
    r5 = lambda c: (F.floor(F.col(c) * 1e5 + 0.5) / 1e5).alias(c)
    return d.select("symbol", *[r5(c) for c in ("strength_45", "strength_120", "persistence", "combo_45", "accel")])


@query("tf22_event_study", fin("symbol event_date event_return post_5 post_20 volume_ratio", f"""WITH b AS (SELECT *, row_number() OVER ({_S})-1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM {BARS}),
 e AS (SELECT symbol, d AS event_date, min(pos) AS p FROM b JOIN (VALUES (DATE '1997-03-01'),(DATE '1999-07-11'),(DATE '2001-10-20')) v(d) ON date>=d GROUP BY 1,2)
 SELECT e.symbol, event_date, (max(close) FILTER (pos=p)/max(close) FILTER (pos=p-1)-1)*100 AS event_return, (max(close) FILTER (pos=p+5)/max(close) FILTER (pos=p)-1)*100 AS post_5, (max(close) FILTER (pos=p+20)/max(close) FILTER (pos=p)-1)*100 AS post_20,
 CASE WHEN any_value(p)>=20 THEN avg(volume) FILTER (pos>=p AND pos<p+5)/nullif(avg(volume) FILTER (pos<p AND pos>=p-60),0) END AS volume_ratio FROM e JOIN b ON b.symbol=e.symbol AND pos BETWEEN p-60 AND p+20 GROUP BY 1,2"""))
def _(t):
    from tideframe.plans.screening import event_study
    ev = t.brand.select("symbol").distinct().withColumn("event_date", F.explode(F.array(*[F.lit(d).cast("date") for d in ("1997-03-01", "1999-07-11", "2001-10-20")])))
    return event_study(t.bars, ev)


@query("tf23_source_precedence", fin("symbol growth estimate ps", f"""SELECT symbol, coalesce(earnings_growth, revenue_growth) AS growth, CASE WHEN length(symbol)=7 THEN free_cashflow END AS estimate, market_cap/nullif(total_assets*4,0) AS ps FROM {INFO}"""))
def _(t):
    from tideframe.plans.screening import merge_sources, price_to_quarter
    i = info(t)
    a = i.select("symbol", F.col("earnings_growth").alias("growth"))
    b = i.select("symbol", F.col("revenue_growth").alias("growth"), F.col("free_cashflow").alias("estimate"),
                 F.when(F.length("symbol") == 7, F.lit("2000-01-01")).otherwise("2002-01-01").cast("date").alias("estimate_timestamp"))
    m = merge_sources([a, b], ["symbol"], estimates=["estimate"], asof="2001-01-01")
    return m.join(i.select("symbol", price_to_quarter("market_cap", "total_assets").alias("ps")), "symbol").select("symbol", "growth", "estimate", "ps")


reg("tf24_trading_value", last(("trading_value_20d", "sum(dollar) FILTER (rn<=20)"), ("trading_value_60d", "sum(dollar) FILTER (rn<=60)")), "trading_value_20d", "trading_value_60d")

_TP = f"""(SELECT *, CASE WHEN edge IS NULL THEN 50 ELSE least(100,greatest(0,50+42*tanh(edge))) END AS ts, CASE WHEN edge2 IS NULL OR pos<130 THEN 50 ELSE least(100,greatest(0,50+42*tanh(edge2))) END AS ts2 FROM
 (SELECT *, 3*r20+2*r60+1.2*r120+mad-0.8*greatest(vol20-0.2,0)+CASE WHEN vol20 IS NULL THEN NULL ELSE 0 END AS edge2, 3*r20+2*r60+1.2*r120+mad-0.8*greatest(vol20-0.2,0)+18*speed+CASE WHEN vol20 IS NULL THEN NULL ELSE 0 END AS edge FROM
 (SELECT date, symbol, pos, close/lag(close,20) OVER ({_S})-1 AS r20, close/lag(close,60) OVER ({_S})-1 AS r60, close/lag(close,120) OVER ({_S})-1 AS r120, coalesce(close/(CASE WHEN count(*) {_rows(200)}>=200 THEN avg(close) {_rows(200)} END)-1,0) AS mad,
 CASE WHEN count(ret) {_rows(20)}>=20 THEN stddev_samp(ret) {_rows(20)}*sqrt(252.0) END AS vol20, CASE WHEN count(*) {_rows(20)}=20 THEN regr_slope(ln(close),pos) {_rows(20)} END AS speed, close/max(close) {_rows(252)}-1 AS dd FROM
 (SELECT *, close/lag(close) OVER ({_S})-1 AS ret, row_number() OVER ({_S}) AS pos FROM {BRAND}))))"""


@query("tf25_technical_score", fin("date symbol ts ts_weekly", f"SELECT date, symbol, ts, ts2 AS ts_weekly FROM {_TP}"))
def _(t):
    a = FA.technical_panel(t.brand).select("date", "symbol", F.col("technical_score").alias("ts"))
    b = FA.technical_panel(t.brand, with_slope=False, min_rows=130).select("date", "symbol", F.col("technical_score").alias("ts_weekly"))
    return a.join(b, ["date", "symbol"])


@query("tf26_risk_penalty", fin("date symbol penalty", f"SELECT date, symbol, CASE WHEN vol20 IS NOT NULL THEN least(18,greatest(0,(vol20-0.18)*25+abs(dd)*15)) END AS penalty FROM {_TP}"))
def _(t):
    return FA.technical_panel(t.brand).select("date", "symbol", F.col("risk_penalty").alias("penalty"))


@query("tf27_ema_trend_features", fin("date symbol ema_trend:i close_above_ema20:i ema4_ema6_spread dist_to_ema20 ema20_slope10", ema_sql(BRAND, [4, 6, 20]) + f""", g AS (SELECT date, symbol, close, CASE WHEN n>=4 THEN e4 END AS e4, CASE WHEN n>=6 THEN e6 END AS e6, CASE WHEN n>=20 THEN e20 END AS e20 FROM r)
 SELECT date, symbol, coalesce(e4>e6 AND e6>e20,false) AS ema_trend, coalesce(close>e20,false) AS close_above_ema20, e4/e6-1 AS ema4_ema6_spread, close/e20-1 AS dist_to_ema20, e20/lag(e20,10) OVER ({_S})-1 AS ema20_slope10 FROM g"""))
def _(t):
    return FA.ema_features(t.brand).select("date", "symbol", "ema_trend", "close_above_ema20", "ema4_ema6_spread", "dist_to_ema20", "ema20_slope10")
