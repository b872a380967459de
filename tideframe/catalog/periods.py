"""2.17 Period evaluation of selections."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.composites import DFEAT, _MOM, _WK, g
from tideframe.catalog.folds import PARKED, RISK_NAMES, SAFE_NAMES, sleeves
from tideframe.catalog.labels import CAND, candidates
from tideframe.catalog.metrics import SWQ
from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, ratio
from tideframe.operators import allocation as AL, asof as A, folds as FO, panel as P, periods as PF, sweep as SW, thresholds as TH, topk as T, xsec as S
from tideframe.plans import safe as SF, selection as SE
from tideframe.plans.fixtures import ETF, MARKET, RISK, WEEKDAYS, WEEKLY

_RN = "row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol)"
# Returns of the fixture are wild; periods use a tenth of the clipped weekly return.
_SC = "least(0.3,greatest(-0.3,ret_1w))*0.1"
WK = f"(SELECT date, symbol, grp, regime, score, prob, {_SC} AS r FROM {WEEKLY} WHERE ret_1w IS NOT NULL)"
TOP = f"(SELECT date, avg(r) FILTER (rn<=3) AS portfolio_return, avg(r) AS benchmark_return, count(*) AS names, string_agg(symbol, ',' ORDER BY rn) FILTER (rn<=3) AS selected FROM (SELECT *, {_RN} AS rn FROM {WK}) GROUP BY date HAVING count(*)>=3)"


def wk(t):
    return t.weekly.filter("ret_1w is not null").withColumn("r", clip("ret_1w", -0.3, 0.3) * 0.1)


def top(t):
    return PF.topk_periods(wk(t), "score", 3, "r")


@query("pf01_topk_period_returns", fin("date portfolio_return benchmark_return excess_return hit:i selected:s", f"SELECT *, portfolio_return-benchmark_return AS excess_return, round(portfolio_return-benchmark_return,12)>0 AS hit FROM {TOP}"))
def _(t):
    return top(t).select("date", "portfolio_return", "benchmark_return", "excess_return", (F.round("excess_return", 12) > 0).alias("hit"), "selected")


@query("pf02_flat_rows", fin("date portfolio_return invested:i", f"SELECT d.date, coalesce(portfolio_return,0) AS portfolio_return, portfolio_return IS NOT NULL AS invested FROM (SELECT max(date) AS date FROM {MARKET} GROUP BY {WEEKDAYS.format(d='date')}) d LEFT JOIN (SELECT date, avg(r) AS portfolio_return FROM (SELECT *, {_RN} AS rn FROM {WK} WHERE prob>=0.75) WHERE rn<=3 GROUP BY date) p ON p.date=d.date"))
def _(t):
    p = PF.topk_periods(wk(t).filter("prob >= 0.75"), "score", 3, "r", min_names=False).select("date", "portfolio_return")
    return PF.with_flat_rows(p, P.rebalance_dates(t.market, "W"), ["portfolio_return"])


def perf_sql(src, by="", ret="portfolio_return", bench="benchmark_return", n=52, inv="1"):
    p = f"PARTITION BY {by} " if by else ""
    b = f"{by}, " if by else ""
    return f"""(SELECT *, sqrt({n}.0)*avg_return/nullif(sd,0) AS Sharpe, sqrt({n}.0)*avg_return/nullif(dn,0) AS Sortino, sd*sqrt({n}.0) AS ann_vol, pow(tot,{n}.0/periods)-1 AS CAGR, tot-1 AS cumulative_return, invested_periods/periods::DOUBLE AS coverage, CASE WHEN MDD<0 THEN (pow(tot,{n}.0/periods)-1)/abs(MDD) END AS Calmar FROM
 (SELECT {b}count(*) AS periods, sum(i) AS invested_periods, avg(r) AS avg_return, stddev_samp(r) AS sd, sqrt(avg(pow(least(r,0),2))) AS dn, exp(sum(ln(1+r))) AS tot, exp(sum(ln(1+bb)))-1 AS bench_total, min(e/m-1) AS MDD, avg((round(r,12)>0)::INT) FILTER (i=1) AS hit_positive, avg((round(r-bb,12)>0)::INT) FILTER (i=1) AS hit_excess, avg(r-bb) FILTER (i=1) AS avg_excess FROM
 (SELECT *, max(e) OVER ({p}ORDER BY date) AS m FROM (SELECT *, coalesce({ret},0) AS r, coalesce({bench},0) AS bb, ({inv})::INT AS i, exp(sum(ln(1+coalesce({ret},0))) OVER ({p}ORDER BY date)) AS e FROM {src})) {f'GROUP BY {by}' if by else ''}))"""


_PC = "periods:i invested_periods:i cumulative_return CAGR ann_vol Sharpe Sortino Calmar MDD hit_positive coverage"


def pcols(d, *by):
    return d.select(*by, *[c.split(":")[0] for c in _PC.split()])


@query("pf03_performance_summary", fin(_PC + " bench_total hit_excess avg_excess", f"FROM {perf_sql(TOP)}", 5))
def _(t):
    d = PF.performance(top(t), [], "portfolio_return", 52, "benchmark_return")
    r5 = lambda c: c.split(":")[0] if ":i" in c else (F.floor(F.col(c) * 1e5 + 0.5) / 1e5).alias(c)
    return d.withColumnRenamed("benchmark_return", "bench_total").select(*[r5(c) for c in (_PC + " bench_total hit_excess avg_excess").split()])


@query("pf04_scores_by_k", fin("date score_col:s top_k:i portfolio_return universe_return", f"SELECT date, score_col, k AS top_k, avg(r) FILTER (rn<=k) AS portfolio_return, avg(r) AS universe_return FROM (SELECT date, symbol, r, score_col, row_number() OVER (PARTITION BY date, score_col ORDER BY v DESC, symbol) AS rn FROM (SELECT date, symbol, r, unnest(['score','prob']) AS score_col, unnest([score,prob]) AS v FROM {WK})), (SELECT unnest([1,3,5]) AS k) GROUP BY 1,2,3 HAVING count(*)>=k"))
def _(t):
    return PF.evaluate_scores(wk(t), ["score", "prob"], [1, 3, 5], "r").select("date", "score_col", "top_k", "portfolio_return", "universe_return")


_TO = "CASE WHEN b IS NULL THEN 1.0 ELSE (len(a)+len(b)-2*len(list_intersect(a,b)))::DOUBLE/(len(a)+len(b)-len(list_intersect(a,b))) END"


@query("pf05_net_of_cost", fin("date turnover cost net_return", f"SELECT date, {_TO} AS turnover, {_TO}*20/10000 AS cost, portfolio_return-{_TO}*20/10000 AS net_return FROM (SELECT date, portfolio_return, string_split(selected,',') AS a, lag(string_split(selected,',')) OVER (ORDER BY date) AS b FROM {TOP})"))
def _(t):
    return PF.net_of_cost(top(t), 20).select("date", "turnover", "cost", "net_return")


@query("pf05_regime_eligible_universe", fin("date n:i mean_score", f"""WITH u AS (SELECT *, prob>=0.7 AS hi, grp IN ('ASIA','EUROPE') AS sf, count(*) FILTER (prob>=0.7) OVER d AS nh, count(*) FILTER (grp IN ('ASIA','EUROPE')) OVER d AS ns FROM {WEEKLY} WINDOW d AS (PARTITION BY date)),
 e AS (SELECT *, count(*) FILTER (NOT sf) OVER (PARTITION BY date) AS o FROM u WHERE CASE WHEN nh>0 THEN hi WHEN ns>0 THEN sf ELSE true END) SELECT date, count(*) AS n, avg(score) AS mean_score FROM e WHERE regime='BUILDING' OR NOT sf OR o<3 GROUP BY date"""))
def _(t):
    d = t.weekly.withColumn("hi", F.col("prob") >= 0.7)
    e = PF.eligible(d, "hi", F.col("regime") == "BUILDING", F.col("grp").isin("ASIA", "EUROPE"), 5)
    return e.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


_TR = f"(SELECT p.*, r.score AS rs, CASE WHEN r.score<50 THEN 'Normal' WHEN r.score<60 THEN 'Watch' WHEN r.score<70 THEN 'De-risk' ELSE 'Cash' END AS st FROM {TOP} p ASOF LEFT JOIN {RISK} r ON p.date>=r.date)"


def traded(t):
    d = A.asof_join(top(t), t.risk.select("date", F.col("score").alias("rs")))
    return d.withColumn("st", TH.stage_of("rs", 50, 60, 70))


@query("pf06_risk_gate", fin("date invested:i strategy_return", f"SELECT date, ok AS invested, CASE WHEN ok THEN portfolio_return ELSE 0 END AS strategy_return FROM (SELECT *, coalesce(rs,0)/100<0.65 AND coalesce(st,'Normal') NOT IN ('De-risk','Cash') AS ok FROM {_TR})"))
def _(t):
    return PF.gated(traded(t), PF.risk_gate(F.col("rs") / 100, "st", 0.65, "derisk_cash")).select("date", "invested", "strategy_return")


@query("pf07_risk_block_overlay", fin("date blocks:i", f"SELECT date, coalesce((rs>=50)::INT,0)+coalesce((rs>=60)::INT,0)+coalesce((rs<20)::INT,0) AS blocks FROM {_TR}"))
def _(t):
    flags = t.risk.select("date", ((F.col("score") >= 50).cast("int") + (F.col("score") >= 60).cast("int") + (F.col("score") < 20).cast("int")).alias("blocks"))
    return A.asof_join(top(t).select("date"), flags).withColumn("blocks", F.coalesce("blocks", F.lit(0)))


_TG = [30.0, 40.0, 50.0, 60.0, 70.0]


@query("pf08_entry_threshold_choice", fin("threshold objective invested_periods:i", f"SELECT threshold, objective, invested_periods FROM (SELECT *, coalesce(Sharpe,-99)+1.2*coalesce(hit_excess,0)-0.35*abs(MDD) AS objective FROM {perf_sql(f'(SELECT date, threshold, coalesce(rs>=threshold,false) AS inv, CASE WHEN coalesce(rs>=threshold,false) THEN portfolio_return ELSE 0 END AS sr, benchmark_return FROM {_TR}, (SELECT unnest({_TG}) AS threshold))', 'threshold', 'sr', 'benchmark_return', 52, 'inv')}) WHERE invested_periods>=20 ORDER BY round(objective,8) DESC, threshold LIMIT 1"))
def _(t):
    gr = PF.threshold_grid(traded(t), "rs", _TG, "portfolio_return", 52, "benchmark_return")
    gr = gr.filter("invested_periods >= 20").withColumn("objective", PF.entry_objective())
    return gr.orderBy(F.desc(F.round("objective", 8)), "threshold").limit(1).select("threshold", "objective", "invested_periods")


@query("pf09_trade_normalisation", fin("date exit_date strategy:s horizon:s portfolio_return excess_return", f"SELECT date, date+7 AS exit_date, 'a' AS strategy, '1W' AS horizon, portfolio_return, portfolio_return-benchmark_return AS excess_return FROM {TOP} WHERE date<DATE '1998-01-01' UNION ALL SELECT date, date+31, 'b', '1M', portfolio_return, portfolio_return-names*0.0001 FROM {TOP} WHERE date>=DATE '1998-01-01'"))
def _(t):
    d = top(t).withColumn("nb", F.col("names") * 0.0001)
    a = (d.filter("date < date'1998-01-01'"), {"strategy": "a", "phase": "early", "horizon": "1W", "top_k": 3, "ret": "portfolio_return", "benchmark": "benchmark_return"})
    b = (d.filter("date >= date'1998-01-01'"), {"strategy": "b", "phase": "late", "horizon": "1M", "top_k": 3, "ret": "portfolio_return", "benchmark": "nb"})
    return PF.normalize_trades([a, b]).select("date", "exit_date", "strategy", "horizon", "portfolio_return", "excess_return")


_SAFE = f"(SELECT date, avg(r) FILTER (grp='ASIA') AS safe_return FROM {WK} GROUP BY date)"


@query("pf10_two_sleeve_return", fin("date w ret", f"""SELECT date, w, w*portfolio_return+least(0.6,1-w)*coalesce(safe_return,0) AS ret FROM (SELECT t.date, portfolio_return, safe_return, CASE st WHEN 'Normal' THEN CASE WHEN day(t.date)%2=0 THEN 0.6 ELSE 0.25 END WHEN 'Watch' THEN CASE WHEN day(t.date)%2=0 THEN 0.45 ELSE 0.15 END WHEN 'De-risk' THEN CASE WHEN day(t.date)%2=0 THEN 0.2 ELSE 0.05 END ELSE 0.05 END AS w FROM {_TR} t LEFT JOIN {_SAFE} s ON s.date=t.date)"""))
def _(t):
    s = wk(t).groupBy("date").agg(F.avg(F.when(F.col("grp") == "ASIA", F.col("r"))).alias("safe_return"))
    d = traded(t).join(s, "date", "left").withColumn("w", SF.gate_weight("st", F.dayofmonth("date") % 2 == 0, F.lit(False), F.lit(0)))
    return d.select("date", "w", SF.two_sleeve_return("w", "portfolio_return", F.coalesce("safe_return", F.lit(0.0))).alias("ret"))


_in = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"


@query("pf11_constraint_report", fin("date total_weight risk_total safe_total cash_weight max_single total_violation:i single_violation:i basket_violations:i", f"SELECT date, sum(weight) AS total_weight, coalesce(sum(weight) FILTER (basket IN {_in(RISK_NAMES)}),0) AS risk_total, coalesce(sum(weight) FILTER (basket IN {_in(SAFE_NAMES)}),0) AS safe_total, coalesce(sum(weight) FILTER (symbol='{AL.CASH}'),0) AS cash_weight, coalesce(max(weight) FILTER (symbol<>'{AL.CASH}'),0) AS max_single, 0 AS total_violation, 0 AS single_violation, 0 AS basket_violations FROM {PARKED} GROUP BY date"))
def _(t):
    return AL.constraint_report(AL.allocate_dates(sleeves(t))).select("date", "total_weight", "risk_total", "safe_total", "cash_weight", "max_single", "total_violation", "single_violation", "basket_violations")


@query("pf12_allocation_returns", fin("date portfolio_return n_positions:i risk_weight safe_weight cash_weight", f"SELECT date, sum(weight*coalesce(ret_1w,0)) AS portfolio_return, count(*) AS n_positions, coalesce(sum(weight) FILTER (segment='risk'),0) AS risk_weight, coalesce(sum(weight) FILTER (segment='safe'),0) AS safe_weight, coalesce(sum(weight) FILTER (segment='cash'),0) AS cash_weight FROM {PARKED} GROUP BY date"))
def _(t):
    return PF.allocation_returns(AL.allocate_dates(sleeves(t)), "ret_1w")


_PE = f"""(SELECT date, avg(r) FILTER (sf AND p<=2) AS picked, avg(r) FILTER (sf) AS safe_mean, avg(r) FILTER (NOT sf) AS risk_mean, avg(r) FILTER (sf AND a<=2) AS ideal, count(*) FILTER (sf AND p<=2 AND a<=2)/2.0 AS overlap, count(*) FILTER (sf AND p=1 AND a=1) AS top1_exact, count(*) FILTER (sf AND p<=2 AND a=1) AS best_in_picks
 FROM (SELECT *, row_number() OVER (PARTITION BY date, sf ORDER BY score DESC, symbol) AS p, row_number() OVER (PARTITION BY date, sf ORDER BY r DESC, symbol) AS a FROM (SELECT *, grp IN ('ASIA','EUROPE') AS sf FROM {WK})) GROUP BY date HAVING count(*) FILTER (sf)>0 AND count(*) FILTER (NOT sf)>0)"""


def picks(t):
    safe = F.col("grp").isin("ASIA", "EUROPE")
    return PF.pick_evaluation(wk(t), "score", "r", safe, ~safe, 2)


@query("pf13_safe_pick_evaluation", fin("date picked safe_mean risk_mean ideal overlap beat_risk:i", f"SELECT *, round(picked-risk_mean,12)>0 AS beat_risk FROM {_PE} WHERE date IN (SELECT date FROM {RISK} WHERE score>=50)"))
def _(t):
    d = picks(t).join(t.risk.filter("score >= 50").select("date"), "date", "left_semi")
    return d.select("date", "picked", "safe_mean", "risk_mean", "ideal", "overlap", (F.round(F.col("picked") - F.col("risk_mean"), 12) > 0).alias("beat_risk"))


_HZ = {"5": "lead(close,5) OVER s/close-1", "15": "lead(close,15) OVER s/close-1"}
_F14 = f"(SELECT date, symbol, {', '.join(f'{v} AS f{k}' for k, v in _HZ.items())} FROM {ETF} WINDOW s AS (PARTITION BY symbol ORDER BY date))"
_L14 = " UNION ALL ".join(f"SELECT w.date, w.symbol, {h} AS horizon, {k} AS top_k, score, grp IN ('ASIA','EUROPE') AS sf, least(0.3,greatest(-0.3,f{h}))*0.1 AS r FROM {WEEKLY} w JOIN {_F14} f ON f.date=w.date AND f.symbol=w.symbol WHERE f{h} IS NOT NULL" for h in _HZ for k in (1, 3))


@query("pf14_signal_dated_selector", fin("horizon:i top_k:i weeks:i top1_hit topk_hit avg_pick avg_safe", f"""WITH l AS ({_L14}), e AS (SELECT horizon, top_k, date, avg(r) FILTER (sf AND p<=top_k) AS picked, avg(r) FILTER (sf) AS safe_mean, count(*) FILTER (sf AND p=1 AND a=1) AS top1_exact, count(*) FILTER (sf AND p<=top_k AND a=1) AS best_in_picks
 FROM (SELECT *, row_number() OVER (PARTITION BY horizon, top_k, date, sf ORDER BY score DESC, symbol) AS p, row_number() OVER (PARTITION BY horizon, top_k, date, sf ORDER BY r DESC, symbol) AS a FROM l) GROUP BY 1,2,3 HAVING count(*) FILTER (sf)>0 AND count(*) FILTER (NOT sf)>0)
 SELECT horizon, top_k, count(*) AS weeks, avg(top1_exact) AS top1_hit, avg(best_in_picks) AS topk_hit, avg(picked) AS avg_pick, avg(safe_mean) AS avg_safe FROM e WHERE date IN (SELECT date FROM {RISK} WHERE score>=50) GROUP BY 1,2"""))
def _(t):
    """Safe picks on signal dates at both horizons (5 and 15 rows ahead) and both sizes."""
    ahead = t.etf.select("date", "symbol", *[R.forward_return("close", int(h), R.by_entity()).alias(f"f{h}") for h in _HZ])
    signals = t.risk.filter("score >= 50").select("date")
    d = t.weekly.join(ahead, ["date", "symbol"])
    safe = F.col("grp").isin("ASIA", "EUROPE")
    out = None
    for h in _HZ:
        rows = d.filter(F.col(f"f{h}").isNotNull()).withColumn("r", clip(f"f{h}", -0.3, 0.3) * 0.1)
        for k in (1, 3):
            e = PF.pick_evaluation(rows, "score", "r", safe, ~safe, k).join(signals, "date", "left_semi")
            e = e.agg(F.count(F.lit(1)).alias("weeks"), F.avg("top1_exact").alias("top1_hit"), F.avg("best_in_picks").alias("topk_hit"), F.avg("picked").alias("avg_pick"), F.avg("safe_mean").alias("avg_safe"))
            e = e.select(F.lit(int(h)).alias("horizon"), F.lit(k).alias("top_k"), "*")
            out = e if out is None else out.unionByName(e)
    return out


_P15 = f"""(WITH m AS (SELECT *, round(0.2*z5+0.35*z20+0.3*z60+0.15*z120-0.2*zv,10) AS sc FROM {_MOM}), w AS (SELECT m.date, symbol, round(sc*gate,10) AS s, st, gate, f1w, f1m FROM (SELECT *, 1-least(0.55,greatest(0,rs/140)) AS gate FROM (SELECT m.*, r.score AS rs, CASE WHEN r.score<50 THEN 'Normal' WHEN r.score<60 THEN 'Watch' WHEN r.score<70 THEN 'De-risk' ELSE 'Cash' END AS st FROM m JOIN {RISK} r ON r.date=m.date WHERE m.date IN ({_WK}) AND r.score<55)) m),
 l AS (SELECT date, symbol, s, st, gate, unnest(['1w','1m']) AS horizon, unnest([f1w,f1m]) AS f FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY s DESC, symbol) AS p, row_number() OVER (PARTITION BY date, horizon ORDER BY f DESC, symbol) AS a FROM l WHERE f IS NOT NULL)
 SELECT date, horizon, st AS regime, any_value(gate) AS risk_gate, count(*) AS names, avg(f) FILTER (p<=5) AS topk_return, avg(f) AS universe_return, avg(f) FILTER (a<=5) AS actual_topk_return, count(*) FILTER (p<=5 AND a<=5)/5.0 AS overlap, count(*) FILTER (p=1 AND a=1) AS top1_exact, count(*) FILTER (a=1 AND p<=5) AS actual_top1_in_topk FROM k GROUP BY 1,2,3 HAVING count(*)>=5)"""


def rank_rows(t):
    risk = t.risk.select("date", F.col("score").alias("risk"), TH.stage_of("score", 50, 60, 70).alias("regime"))
    return SE.weekly_rank_rows(t.etf, risk, 5)


@query("pf15_weekly_rank_rows", fin("date horizon:s regime:s risk_gate names:i topk_return universe_return actual_topk_return overlap top1_exact:i actual_top1_in_topk:i", f"FROM {_P15}"))
def _(t):
    return rank_rows(t)


@query("pf15_weekly_rank_evaluation", fin("horizon:s regime:s weeks:i avg_topk_return avg_universe_return avg_actual_topk_return topk_overlap_rate top1_exact_rate actual_top1_in_topk_rate", f"SELECT horizon, regime, count(*) AS weeks, avg(topk_return) AS avg_topk_return, avg(universe_return) AS avg_universe_return, avg(actual_topk_return) AS avg_actual_topk_return, avg(overlap) AS topk_overlap_rate, avg(top1_exact) AS top1_exact_rate, avg(actual_top1_in_topk) AS actual_top1_in_topk_rate FROM {_P15} GROUP BY 1,2"))
def _(t):
    return SE.weekly_rank_summary(rank_rows(t))


@query("pf16_basket_ranking", fin("weeks:i pred_return mean_return top1_hit in_top3 overlap3", f"""WITH b AS (SELECT date, grp, round(0.55*avg(score) FILTER (rn<=5)+0.45*avg(score),8) AS s, round(avg(r) FILTER (rn<=5),12) AS r FROM (SELECT *, row_number() OVER (PARTITION BY date, grp ORDER BY score DESC, symbol) AS rn FROM {WK}) GROUP BY 1,2),
 k AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY s DESC, grp) AS p, row_number() OVER (PARTITION BY date ORDER BY r DESC, grp) AS a FROM b)
 SELECT count(*) AS weeks, avg(x) AS pred_return, avg(m) AS mean_return, avg(h) AS top1_hit, avg(i3) AS in_top3, avg(o) AS overlap3 FROM (SELECT date, max(r) FILTER (p=1) AS x, avg(r) AS m, count(*) FILTER (p=1 AND a=1) AS h, count(*) FILTER (a=1 AND p<=3) AS i3, count(*) FILTER (p<=3 AND a<=3)/3.0 AS o FROM k WHERE n>=3 GROUP BY date)"""))
def _(t):
    return SE.basket_evaluation(SE.basket_scores(wk(t), "score", "grp", {"r": "r"}).withColumns({"basket": F.round("basket", 8), "r": F.round("r", 12)}), "basket", "r", "grp")


@query("pf17_selective_dynamic_run")
def _(t):
    from tideframe.plans.runs import selective_run
    return selective_run(candidates(t), "1998-06-01", "2000-01-01", ["prob", "score"])


@query("pf18_current_signal", fin("date score action:s", f"SELECT date, score, CASE WHEN score>=70 THEN 'cash' WHEN score>=60 THEN 'reduce' WHEN score>=50 THEN 'watch' ELSE 'hold' END AS action FROM {RISK} WHERE date=(SELECT max(date) FROM {RISK})"))
def _(t):
    from tideframe.functions.scalar import ladder
    s = F.col("score")
    return T.latest_batch(t.risk).select("date", "score", ladder([(s >= 70, "cash"), (s >= 60, "reduce"), (s >= 50, "watch")], "hold").alias("action"))


@query("pf19_leadership_train_and_evaluate")
def _(t):
    from tideframe.catalog.composites import panel
    from tideframe.plans.runs import leadership_run
    return leadership_run(panel(t), "1999-01-01", "2000-01-01", [1, 3])
