"""2.16 Evaluation and threshold search."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.labels import EVENTS
from tideframe.catalog.xsec import pctsql
from tideframe.functions import rolling as R
from tideframe.functions.scalar import ratio
from tideframe.operators import labels as L, metrics as M, pooled as PO, sweep as SW, thresholds as T
from tideframe.plans.fixtures import ETF, MARKET, RISK, WEEKLY

UP = f"(SELECT *, (ret_1w>0)::INT AS y FROM {WEEKLY} WHERE ret_1w IS NOT NULL)"


def up(t):
    return t.weekly.filter("ret_1w is not null").withColumn("y", (F.col("ret_1w") > 0).cast("int"))


@query("ev01_confusion_and_rates", fin("grp tp:i fp:i fn:i tn:i precision recall accuracy false_alarm_among_signals false_positive_rate", f"SELECT *, tp/nullif(tp+fp,0)::DOUBLE AS precision, tp/nullif(tp+fn,0)::DOUBLE AS recall, (tp+tn)/(tp+fp+fn+tn)::DOUBLE AS accuracy, fp/nullif(tp+fp,0)::DOUBLE AS false_alarm_among_signals, fp/nullif(fp+tn,0)::DOUBLE AS false_positive_rate FROM (SELECT grp, count(*) FILTER (prob>=0.5 AND y=1) AS tp, count(*) FILTER (prob>=0.5 AND y=0) AS fp, count(*) FILTER (prob<0.5 AND y=1) AS fn, count(*) FILTER (prob<0.5 AND y=0) AS tn FROM {UP} GROUP BY grp)"))
def _(t):
    return M.rates(up(t).withColumn("p", F.col("prob") >= 0.5).groupBy("grp").agg(*M.confusion("p", "y")))


@query("ev02_auc_and_average_precision", fin("grp auc ap", f"""WITH r AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY prob)+(count(*) OVER (PARTITION BY grp, prob)-1)/2.0 AS rk FROM {UP}),
 a AS (SELECT grp, (sum(rk) FILTER (y=1)-sum(y)*(sum(y)+1)/2.0)/nullif(sum(y)*(count(*)-sum(y)),0) AS auc FROM r GROUP BY grp),
 d AS (SELECT grp, prob, sum(y) AS p, count(*) AS n FROM {UP} GROUP BY 1,2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM d WINDOW w AS (PARTITION BY grp ORDER BY prob DESC))
 SELECT a.grp, auc, ap FROM a JOIN (SELECT grp, sum(p*tp/seen::DOUBLE)/nullif(sum(p),0) AS ap FROM c GROUP BY grp) b ON a.grp=b.grp"""))
def _(t):
    return PO.discrimination(up(t), ["grp"], "prob", "y")


_EDGES = "[" + ",".join(repr(e) + "::DOUBLE" for e in M.ECE_EDGES) + "]"


@query("ev03_calibration_error", fin("grp samples:i brier log_loss ece_10bin", f"SELECT grp, sum(n) AS samples, sum(sb)/sum(n) AS brier, sum(sl)/sum(n) AS log_loss, sum(abs(sp-sy))/sum(n) AS ece_10bin FROM (SELECT grp, least(10,len(list_filter({_EDGES}, lambda e: e<=prob))) AS b, count(*) AS n, sum(prob) AS sp, sum(y) AS sy, sum((prob-y)*(prob-y)) AS sb, sum(-(y*ln(prob)+(1-y)*ln(1-prob))) AS sl FROM {UP} GROUP BY 1,2) GROUP BY grp"))
def _(t):
    return M.calibration(up(t), ["grp"], "prob", "y")


@query("ev04_reliability_bins", fin("bin:i samples:i mean_pred realized_rate", f"SELECT bin, count(*) AS samples, avg(prob) AS mean_pred, avg(y) AS realized_rate FROM (SELECT *, greatest(0, ((r-1)*10+n-2)//(n-1)-1) AS bin FROM (SELECT *, row_number() OVER (ORDER BY prob, date, symbol) AS r, count(*) OVER () AS n FROM {UP})) GROUP BY bin"))
def _(t):
    return M.reliability_bins(up(t), "prob", "y")


@query("ev05_rank_ic", fin("dates:i rank_ic share_positive", f"SELECT count(ic) AS dates, avg(ic) AS rank_ic, avg((ic>0)::INT) AS share_positive FROM (SELECT date, CASE WHEN isnan(corr(a,b)) THEN NULL ELSE corr(a,b) END AS ic FROM (SELECT date, {pctsql('score')} AS a, {pctsql('ret_1w')} AS b FROM {UP}) GROUP BY date HAVING count(*)>=3)"))
def _(t):
    return M.rank_ic(t.weekly, "score", "ret_1w")


_LAB = f"(SELECT date, score, close, r20, coalesce(m20<=-0.05,false)::INT AS y, m20 FROM (SELECT date, score, close, lead(close,20) OVER w/close-1 AS r20, min(close) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)/close-1 AS m20 FROM {RISK} WINDOW w AS (ORDER BY date)) WHERE m20 IS NOT NULL)"


def labelled(t):
    d = t.risk.withColumns({"r20": R.forward_return("close", 20, R.day()), "m20": R.forward_min_any("close", 20, R.day())}).filter("m20 is not null")
    return d.withColumn("y", L.label(F.col("m20") <= -0.05))


SWQ = lambda src, grid, cond="true": f"(SELECT thr, count(*) FILTER (score>=thr) AS n, coalesce(sum(y) FILTER (score>=thr),0)::DOUBLE AS tp, count(*) AS na, sum(y)::DOUBLE AS pa FROM {src}, (SELECT unnest({grid}) AS thr) GROUP BY thr)"


@query("ev06_threshold_sweep", fin("threshold n:i tp:i precision recall signal_rate", f"SELECT thr AS threshold, n, tp, tp/greatest(n,1) AS precision, tp/greatest(pa,1) AS recall, n/na AS signal_rate FROM {SWQ(_LAB, [float(x) for x in range(15, 86, 5)])}"))
def _(t):
    s = T.sweep_rates(SW.sweep(labelled(t), [], "score", [float(x) for x in range(15, 86, 5)], SW.confusion("y")))
    return s.select("threshold", F.col("n").cast("long").alias("n"), F.col("tp").cast("long").alias("tp"), "precision", "recall", "signal_rate")


_G7 = [float(x) for x in range(35, 86)]


@query("ev07_threshold_by_objective", fin("threshold", f"SELECT coalesce((SELECT thr FROM (SELECT thr, 1.7*tp/greatest(pa,1)+0.8*tp/greatest(n,1)+0.2*least(tp/greatest(n,1)/greatest(pa/na,1e-9),5)-0.25*n/na AS o FROM {SWQ(_LAB, _G7)} WHERE n>=greatest(10,floor(na*0.03)) AND n/na<=0.35) ORDER BY round(o,10) DESC, thr LIMIT 1),60) AS threshold"))
def _(t):
    s = T.sweep_rates(SW.sweep(labelled(t), [], "score", _G7, SW.confusion("y")))
    return T.best_threshold(s, [], *T.recall_objective(), 60.0).select("threshold")


_G8 = [round(0.5 + 0.01 * i, 2) for i in range(41)]


@query("ev08_threshold_by_accuracy", fin("grp threshold fa", f"""WITH s AS (SELECT grp, thr, count(*) FILTER (prob>=thr) AS n, coalesce(sum(y) FILTER (prob>=thr),0)::DOUBLE AS tp, count(*) AS na, sum(y) AS pa FROM {UP}, (SELECT unnest({_G8}) AS thr) GROUP BY 1,2), a AS (SELECT *, CASE WHEN n>=greatest(10,floor(na*0.03)) THEN round(tp/n,10) END AS acc FROM s)
 SELECT grp, coalesce(min(thr) FILTER (acc>=0.55), arg_max(thr, (acc,n,-thr)) FILTER (acc IS NOT NULL), 0.5) AS threshold, coalesce(min(thr) FILTER (round((n-tp)/greatest(na-pa,1),10)<=0.3),0.9) AS fa FROM a GROUP BY grp"""))
def _(t):
    s = SW.sweep(up(t), ["grp"], "prob", _G8, SW.confusion("y"))
    return T.accuracy_threshold(s, ["grp"], 0.55).join(T.false_alarm_threshold(s, ["grp"], 0.3).withColumnRenamed("threshold", "fa"), "grp")


GRID_L = [round(3 + 89 * i / 179, 6) for i in range(180)]
GRID_C = [round(10 + 85 * i / 171, 6) for i in range(172)]


def loss_sql(grid):
    """Brute-force sweep: every threshold against every row and every episode start."""
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT r.date, r.score, e.y2 AS y, e.s2 AS sev, coalesce(f,0) AS f, row_number() OVER (ORDER BY r.date)-1 AS pos FROM {RISK} r JOIN {EVENTS} e ON e.date=r.date JOIN (SELECT date, lead(close,20) OVER (ORDER BY date)/close-1 AS f FROM {RISK}) g ON g.date=r.date),
 ed AS MATERIALIZED (SELECT date, pos FROM (SELECT *, lag(y) OVER (ORDER BY date) AS p FROM x) WHERE y=1 AND coalesce(p,0)=0), st AS (SELECT min(pos) AS pos FROM ed UNION ALL SELECT pos FROM (SELECT ed.pos FROM st JOIN ed ON ed.pos-st.pos>=15 ORDER BY ed.pos LIMIT 1)),
 wm AS MATERIALIZED (SELECT st.pos, max(x.score) AS m FROM st JOIN x ON x.pos BETWEEN st.pos-20 AND st.pos GROUP BY 1), g AS (SELECT unnest({grid}) AS thr),
 s AS (SELECT thr, count(*) FILTER (score>=thr) AS n, coalesce(sum(y) FILTER (score>=thr),0)::DOUBLE AS tp, count(*) AS na, sum(y) AS pa, coalesce(sum(coalesce(sev,0)*y) FILTER (score>=thr),0) AS loss, sum(coalesce(sev,0)*y) AS lossall, coalesce(avg(greatest(f,0)) FILTER (score>=thr AND y=0),0) AS cost FROM x, g GROUP BY thr),
 e AS (SELECT thr, avg((m>=thr)::INT) AS er FROM wm, g GROUP BY thr),
 m AS (SELECT s.thr, tp/greatest(pa,1) AS rc, tp/greatest(n,1) AS pr, (n-tp)/greatest(na-pa,1) AS fr, n/na::DOUBLE AS ar, er, loss/nullif(lossall,0) AS ca, 1-loss/nullif(lossall,0) AS mi, cost FROM s JOIN e ON e.thr=s.thr)"""


def _lo(a, e):
    return f"round(5.8*er+2.8*ca+1.1*rc+0.7*pr-fr-2.2*cost-4.0*greatest(ar-{a},0)-3.0*greatest({e}-er,0)-2.5*mi,10)"


def _best(a, e):
    return f"coalesce((SELECT thr FROM m WHERE ar<={a} ORDER BY {_lo(a, e)} DESC, thr LIMIT 1),(SELECT thr FROM m ORDER BY {_lo(a, e)} DESC, thr LIMIT 1))"


def loss_rows(t):
    from tideframe.catalog.composites import wide
    e = L.event_labels(wide(t).select("date", "VIX", "GOLD", "DXY"), ["VIX", "GOLD", "DXY"]).select("date", "label_event_loss_1m", "severity_1m")
    d = t.risk.withColumn("f", R.forward_return("close", 20, R.day()))
    return d.join(e, "date")


@query("ev09_loss_aware_sweep", fin("thr er ca cost obj", loss_sql(GRID_L) + f" SELECT thr, er, ca, cost, {_lo(0.78, 0.9)} AS obj FROM m"))
def _(t):
    s = T.loss_sweep(loss_rows(t), "score", "label_event_loss_1m", "severity_1m", "f", GRID_L)
    return s.select(F.col("threshold").alias("thr"), F.col("event_recall").alias("er"), F.col("caught").alias("ca"), "cost", F.round(T.loss_objective(0.78, 0.9), 10).alias("obj"))


_CASH = "round(2.2*pr+2.0*ca+er-1.5*fr-2.0*cost-5.0*greatest(ar-0.28,0)-1.2*mi,10)"
_STAGES = f"""SELECT watch, derisk, least(0.95, greatest(c, derisk+0.08)) AS cash FROM
 ({loss_sql(GRID_L)} SELECT {_best(0.78, 0.9)} AS watch, greatest({_best(0.5, 0.82)}, {_best(0.78, 0.9)}+0.02) AS derisk),
 ({loss_sql(GRID_C)} SELECT coalesce((SELECT thr FROM m ORDER BY {_CASH} DESC NULLS LAST, thr LIMIT 1), 0.5) AS c)"""


@query("ev10_three_stage_policy", fin("watch derisk cash", _STAGES))
def _(t):
    d = loss_rows(t)
    s = T.loss_sweep(d, "score", "label_event_loss_1m", "severity_1m", "f", GRID_L)
    c = T.loss_sweep(d, "score", "label_event_loss_1m", "severity_1m", "f", GRID_C)
    return T.stage_policy(s, c, "1m")


@query("ev11_expanding_thresholds", fin("date threshold", f"""WITH u AS MATERIALIZED (SELECT date, prob, y FROM {UP}), d AS (SELECT DISTINCT date FROM u), g AS (SELECT unnest({_G8}) AS thr),
 s AS (SELECT d.date, thr, count(u.y) AS a, count(*) FILTER (u.prob>=thr) AS n, coalesce(sum(u.y) FILTER (u.prob>=thr),0)::DOUBLE AS tp FROM d CROSS JOIN g LEFT JOIN u ON u.date<d.date GROUP BY 1,2),
 a AS (SELECT *, CASE WHEN a>=200 AND n>=greatest(20,floor(a*0.03)) THEN round(tp/n,10) END AS acc FROM s) SELECT date, coalesce(min(thr) FILTER (acc>=0.55), arg_max(thr,(acc,-thr)) FILTER (acc IS NOT NULL), 0.8) AS threshold FROM a GROUP BY date"""))
def _(t):
    return T.expanding_thresholds(up(t), "prob", "y", 200, _G8, target=0.55)


_WF = f"""WITH b AS MATERIALIZED (SELECT date, unnest(['score','inv']) AS score_name, unnest([score, 100-score]) AS score, y FROM {_LAB}), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY score_name ORDER BY date)-1 AS row FROM b),
 f AS (SELECT range AS a, least(range+200,n) AS b, range-15 AS te FROM (SELECT count(*) AS n FROM r WHERE score_name='score'), LATERAL (SELECT unnest(range(415, n, 200)) AS range)),
 q AS (SELECT score_name, a, unnest(list_distinct(quantile_cont(score, {[round(0.45 + 0.01 * i, 10) for i in range(51)]}::DOUBLE[]))) AS thr FROM r JOIN f ON row<te GROUP BY 1,2),
 s AS (SELECT q.score_name, q.a, thr, count(*) FILTER (score>=thr) AS n, coalesce(sum(y) FILTER (score>=thr),0)::DOUBLE AS tp, count(*) AS na, sum(y)::DOUBLE AS pa FROM q JOIN f ON f.a=q.a JOIN r ON r.score_name=q.score_name AND row<te GROUP BY 1,2,3),
 o AS (SELECT score_name, a, thr, row_number() OVER (PARTITION BY score_name, a ORDER BY round(1.9*tp/greatest(pa,1)+0.9*tp/greatest(n,1)+0.25*least(tp/greatest(n,1)/greatest(pa/na,1e-9),4)-0.35*n/na,10) DESC, thr) AS rn FROM s)
 SELECT r.date, r.score_name, thr AS threshold, (score>=thr)::INT AS signal FROM r JOIN f ON row>=f.a AND row<f.b JOIN o ON o.score_name=r.score_name AND o.a=f.a AND rn=1"""


@query("ev12_walkforward_thresholds", fin("date score_name:s threshold signal:i", _WF))
def _(t):
    d = labelled(t).withColumn("inv", 100 - F.col("score"))
    return T.walkforward_thresholds(d, ["score", "inv"], ["y"], 400, 200, 10, 5).select("date", "score_name", "threshold", "signal")


def _starts(gap):
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT date, y, score, m20, row_number() OVER (ORDER BY date)-1 AS pos FROM {_LAB}), ed AS MATERIALIZED (SELECT date, pos FROM (SELECT *, lag(y) OVER (ORDER BY date) AS p FROM x) WHERE y=1 AND coalesce(p,0)=0),
 st AS (SELECT min(date) AS date FROM ed UNION ALL SELECT date FROM (SELECT ed.date FROM st JOIN ed ON date_diff('day', st.date, ed.date)>={gap} ORDER BY ed.date LIMIT 1))"""


@query("ev13_episode_recall", fin("episodes:i detected:i episode_recall", _starts(30) + " SELECT count(*) AS episodes, sum(h) AS detected, avg(h) AS episode_recall FROM (SELECT st.date, max((x.score>=60)::INT) AS h FROM st JOIN x ON x.date BETWEEN st.date-35 AND st.date GROUP BY 1)"))
def _(t):
    return M.episode_recall(labelled(t).withColumn("p", F.col("score") >= 60), "y", "p", 30, days=35)


@query("ev14_warning_lead_days", fin("events:i warned_events:i median_lead_days", f"SELECT count(*) AS events, count(lead) AS warned_events, median(lead) AS median_lead_days FROM (SELECT e.date, CASE WHEN date_diff('day', w.date, e.date)<=20 THEN date_diff('day', w.date, e.date) END AS lead FROM (SELECT date FROM {_LAB} WHERE m20<-0.6) e ASOF LEFT JOIN (SELECT date FROM {_LAB} WHERE score>=70) w ON e.date>=w.date)"))
def _(t):
    d = labelled(t).withColumns({"e": F.col("m20") < -0.6, "w": F.col("score") >= 70})
    return M.warning_leads(d, "e", "w")


@query("ev15_crash_report", fin("row_type:s crash_start_date detected:i lead_days max_score", _starts(29) + f", ep AS (SELECT st.date AS crash_start_date, max((x.score>=60)::INT) AS detected, date_diff('day', min(x.date) FILTER (x.score>=60), st.date)::DOUBLE AS lead_days, max(x.score) AS max_score FROM st JOIN x ON x.date BETWEEN st.date-28 AND st.date GROUP BY st.date) SELECT 'episode' AS row_type, * FROM ep UNION ALL SELECT 'summary', NULL, sum(detected), median(lead_days), avg(max_score) FROM ep"))
def _(t):
    return M.crash_report(labelled(t).withColumn("w", F.col("score") >= 60), "y", "w", "score", 28)


_ST = f"(SELECT date, close, score, CASE WHEN score<50 THEN 'Normal' WHEN score<60 THEN 'Watch' WHEN score<70 THEN 'De-risk' ELSE 'Cash' END AS st FROM {RISK})"


@query("ev16_event_case_studies", fin("name:s max_score max_state:s first_watch_date first_derisk_date first_cash_date window_return max_drawdown", f"""SELECT name, max(score) AS max_score, ['Normal','Watch','De-risk','Cash'][max(list_position(['Normal','Watch','De-risk','Cash'],st))] AS max_state, min(date) FILTER (st<>'Normal') AS first_watch_date, min(date) FILTER (st IN ('De-risk','Cash')) AS first_derisk_date, min(date) FILTER (st='Cash') AS first_cash_date,
 arg_max(close,date)/arg_min(close,date)-1 AS window_return, min(close/mx-1) AS max_drawdown FROM (SELECT *, max(close) OVER (PARTITION BY name ORDER BY date) AS mx FROM {_ST} JOIN (VALUES ('spring', DATE '1996-02-01', DATE '1996-05-31'), ('long', DATE '1997-12-15', DATE '1998-12-20')) v(name,a,b) ON date BETWEEN a AND b) GROUP BY name"""))
def _(t):
    w = t.spark.createDataFrame([("spring", "1996-02-01", "1996-05-31"), ("long", "1997-12-15", "1998-12-20")], "name string, a string, b string").select("name", F.to_date("a").alias("valid_from"), F.to_date("b").alias("valid_to"))
    return M.window_studies(t.risk.withColumn("st", T.stage_of("score", 50, 60, 70)), w, "score", "st", "close")


@query("ev17_false_alarm_taxonomy", fin("bucket:s n:i avg_return avg_drawdown rate", f"SELECT bucket, n, a AS avg_return, b AS avg_drawdown, n/sum(n) OVER () AS rate FROM (SELECT CASE WHEN ya=0 AND r20 BETWEEN -0.01 AND 0.01 THEN 'sideways' WHEN ya=0 AND m20<=-0.01 THEN 'small_drawdown' WHEN ya=1 THEN 'true_positive' ELSE 'bad_false_alarm_up' END AS bucket, count(*) AS n, avg(r20) AS a, avg(m20) AS b FROM (SELECT *, (m20<=-0.5)::INT AS ya FROM {_LAB}) WHERE score>=55 AND r20 IS NOT NULL GROUP BY 1)"))
def _(t):
    d = labelled(t).withColumns({"s": (F.col("score") >= 55).cast("int"), "ya": (F.col("m20") <= -0.5).cast("int")})
    return M.false_alarm_taxonomy(d, "s", "ya", "r20", "m20")


@query("ev18_fixed_rule_validation", fin("rule:s target:s samples:i tp:i precision recall", f"SELECT rule, target, count(*) AS samples, count(*) FILTER (p AND a=1) AS tp, tp/nullif(count(*) FILTER (p),0)::DOUBLE AS precision, tp/nullif(sum(a),0)::DOUBLE AS recall FROM (SELECT unnest(['hot','cold','hot','cold']) AS rule, unnest(['loss','loss','deep','deep']) AS target, unnest([score>=65, score<35, score>=65, score<35]) AS p, unnest([y, y, (m20<=-0.5)::INT, (m20<=-0.5)::INT]) AS a FROM {_LAB}) GROUP BY 1,2"))
def _(t):
    d = labelled(t).withColumn("deep", (F.col("m20") <= -0.5).cast("int"))
    return M.rule_validation(d, {"hot": F.col("score") >= 65, "cold": F.col("score") < 35}, {"loss": "y", "deep": "deep"}).select("rule", "target", "samples", "tp", "precision", "recall")


_AUC = lambda x: f"(SELECT grp, (sum(rk) FILTER (y=1)-sum(y)*(sum(y)+1)/2.0)/nullif(sum(y)*(count(*)-sum(y)),0) AS auc FROM (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY {x})+(count(*) OVER (PARTITION BY grp, {x})-1)/2.0 AS rk FROM {UP}) GROUP BY grp)"


@query("ev19_model_vs_single_indicator", fin("grp model_auc single_auc single_score:s advantage_vs_single", f"SELECT a.grp, a.auc AS model_auc, greatest(b.auc,c.auc) AS single_auc, CASE WHEN b.auc>=c.auc THEN 'score' ELSE 'inverse' END AS single_score, a.auc-greatest(b.auc,c.auc) AS advantage_vs_single FROM {_AUC('prob')} a JOIN {_AUC('score')} b ON a.grp=b.grp JOIN {_AUC('-score')} c ON a.grp=c.grp"))
def _(t):
    d = up(t).select("grp", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), c.alias("v")) for n, c in (("prob", F.col("prob")), ("score", F.col("score")), ("inverse", -F.col("score")))])).alias("s")).select("grp", "y", "s.*")
    return M.compare_families(PO.roc_auc(d, ["grp", "score"], "v", "y"), {"model": ["prob"], "single": ["score", "inverse"]}, key="grp").select("grp", "model_auc", "single_auc", "single_score", "advantage_vs_single")


@query("ev20_grades", fin("symbol sharpe grade:s", f"SELECT symbol, sh AS sharpe, CASE WHEN sh>=3 AND h>=0.7 THEN 'A+' WHEN sh>=2 AND (h>=0.65 OR h>=0.75) THEN 'A' WHEN sh>=1.4 AND (h>=0.55 OR h>=0.65) THEN 'B+' WHEN sh>=0.8 AND (h>=0.5 OR h>=0.58) THEN 'B' ELSE 'C' END AS grade FROM (SELECT symbol, avg(ret_1w)/stddev_samp(ret_1w)*sqrt(52.0) AS sh, avg((ret_1w>0)::INT) AS h FROM {UP} GROUP BY symbol)"))
def _(t):
    g = up(t).groupBy("symbol").agg((ratio(F.avg("ret_1w"), F.stddev_samp("ret_1w")) * F.sqrt(F.lit(52.0))).alias("sharpe"), F.avg(F.col("y").cast("double")).alias("h"))
    return g.select("symbol", "sharpe", M.grade("sharpe", "h", "h", F.lit(-0.1)).alias("grade"))


@query("ev21_direction_diagnostics", fin("horizon:s samples:i accuracy pred_up actual_up false_up:i missed_up:i", f"SELECT horizon, count(*) AS samples, avg((u=r)::INT) AS accuracy, avg(u::INT) AS pred_up, avg(r::INT) AS actual_up, count(*) FILTER (u AND NOT r) AS false_up, count(*) FILTER (NOT u AND r) AS missed_up FROM (SELECT unnest(['1w','4w']) AS horizon, unnest([prob>=0.5, prob>=0.5]) AS u, unnest([ret_1w>0, ret_4w>0]) AS r FROM {WEEKLY}) WHERE r IS NOT NULL GROUP BY 1"))
def _(t):
    return M.direction_diagnostics(t.weekly, {"1w": ("prob", "ret_1w"), "4w": ("prob", "ret_4w")})


@query("ev22_phase_diagnosis", fin("strategy:s early_sharpe late_sharpe diagnosis:s", f"SELECT *, concat_ws('; ', CASE WHEN early_sharpe<late_sharpe THEN 'early weaker than late' END, CASE WHEN early_sharpe>=late_sharpe THEN 'early at least late' END, CASE WHEN early_sharpe<0 THEN 'early negative' END) AS diagnosis FROM (SELECT grp AS strategy, avg(ret_1w) FILTER (date<DATE '1998-06-01')/stddev_samp(ret_1w) FILTER (date<DATE '1998-06-01') AS early_sharpe, avg(ret_1w) FILTER (date>=DATE '1998-06-01')/stddev_samp(ret_1w) FILTER (date>=DATE '1998-06-01') AS late_sharpe FROM {UP} GROUP BY grp)"))
def _(t):
    ph = F.when(F.col("date") < F.lit("1998-06-01").cast("date"), "early").otherwise("late")
    g = up(t).groupBy(F.col("grp").alias("strategy"), ph.alias("phase")).agg(ratio(F.avg("ret_1w"), F.stddev_samp("ret_1w")).alias("sharpe"))
    return M.phase_table(g, ["early", "late"], ["sharpe"])


@query("ev23_comparison_table", fin("model:s horizon:s hit ret", f"SELECT model, horizon, avg(hit) AS hit, avg(ret) AS ret FROM (SELECT 'score' AS model, '1w' AS horizon, avg((ret_1w>0)::INT) AS hit, avg(ret_1w) AS ret FROM {UP} WHERE score>=55 GROUP BY grp UNION ALL SELECT 'prob', '1w', avg((ret_1w>0)::INT), NULL FROM {UP} WHERE prob>=0.55 GROUP BY grp) GROUP BY 1,2"))
def _(t):
    def part(name, cond, with_ret):
        aggs = [F.avg(F.col("y").cast("double")).alias("hit")] + ([F.avg("ret_1w").alias("ret")] if with_ret else [])
        return up(t).filter(cond).groupBy("grp").agg(*aggs).withColumns({"model": F.lit(name), "horizon": F.lit("1w")})
    return M.comparison_table([part("score", "score >= 55", True), part("prob", "prob >= 0.55", False)], ["model", "horizon"], ["hit", "ret"])
