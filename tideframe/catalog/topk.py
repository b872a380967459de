"""2.7 Sort, limit, top-k."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions.scalar import ratio
from tideframe.operators import panel as P, topk as T, xsec as S
from tideframe.plans.fixtures import BRAND, RISK, WEEKLY

RN = "row_number() OVER (PARTITION BY {p} ORDER BY {o})"


@query("tk01_top_k_per_date", fin("date symbol rn:i score", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM {WEEKLY}) WHERE rn<=5"))
def _(t):
    return T.top_k(t.weekly, "score", 5).select("date", "symbol", "rn", "score")


@query("tk02_group_leaders_then_top", fin("date symbol grp rn:i", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY date, grp ORDER BY score DESC, symbol)=1 AS ld FROM {WEEKLY}),
 b AS (SELECT *, sum(ld::INT) OVER (PARTITION BY date) AS n FROM a)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM b WHERE ld OR n<3) WHERE rn<=3"""))
def _(t):
    return T.leaders_then_top(t.weekly, "score", "grp", 3).select("date", "symbol", "grp", "rn")


@query("tk03_top_mean_blend", fin("date grp n:i basket prob", f"""SELECT date, grp, count(*) AS n, 0.55*avg(score) FILTER (rn<=5)+0.45*avg(score) AS basket, avg(prob) FILTER (rn<=5) AS prob
 FROM (SELECT *, row_number() OVER (PARTITION BY date, grp ORDER BY score DESC, symbol) AS rn FROM {WEEKLY}) GROUP BY 1,2"""))
def _(t):
    from tideframe.plans.selection import basket_scores
    return basket_scores(t.weekly, "score", "grp", {"prob": "prob"}).select("date", "grp", "n", "basket", "prob")


@query("tk04_latest_batch", fin("date symbol score", f"SELECT * FROM {WEEKLY} WHERE date=(SELECT max(date) FROM {WEEKLY})"))
def _(t):
    return T.latest_batch(t.weekly).select("date", "symbol", "score")


@query("tk05_best_candidate_per_date", fin("date symbol prob", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prob DESC, symbol) AS rn FROM {WEEKLY}) WHERE rn=1"))
def _(t):
    return T.best_rows(t.weekly, "prob", ["date"], ["symbol"]).select("date", "symbol", "prob")


@query("tk06_best_parameter_row", fin("threshold objective", f"""SELECT * FROM (SELECT thr AS threshold, avg(ret_1w) FILTER (prob>=thr) - 0.01*abs(avg((prob>=thr)::INT)-0.5) AS objective
 FROM {WEEKLY}, (SELECT unnest(range(10,90,5))/100.0 AS thr) WHERE ret_1w IS NOT NULL GROUP BY 1) ORDER BY round(objective,10) DESC, threshold LIMIT 1"""))
def _(t):
    from tideframe.operators.sweep import sweep
    s = sweep(t.weekly.filter("ret_1w is not null"), [], "prob", [i / 100 for i in range(10, 90, 5)], {"n": F.lit(1), "r": F.col("ret_1w")})
    obj = ratio("r", "n") - 0.01 * F.abs(ratio("n", "n_all") - 0.5)
    return s.select("threshold", obj.alias("objective")).orderBy(F.desc(F.round("objective", 10)), "threshold").limit(1)


@query("tk07_k_nearest_rows", fin("date close", f"SELECT date, close FROM (SELECT date, close, row_number() OVER (ORDER BY abs(close-(SELECT arg_max(close,date) FROM {RISK})), date) AS rn FROM {RISK}) WHERE rn<=10"))
def _(t):
    last = t.risk.agg(F.max_by("close", "date").alias("q"))
    return t.risk.join(last).orderBy(F.abs(F.col("close") - F.col("q")), "date").limit(10).select("date", "close")


@query("tk08_worst_mistakes", fin("date symbol prob ret_1w", f"SELECT * FROM {WEEKLY} WHERE prob>=0.6 AND ret_1w<0 ORDER BY round(prob*abs(ret_1w),10) DESC, date, symbol LIMIT 20"))
def _(t):
    bad = t.weekly.filter("prob >= 0.6 and ret_1w < 0")
    return bad.orderBy(F.desc(F.round(F.col("prob") * F.abs("ret_1w"), 10)), "date", "symbol").limit(20).select("date", "symbol", "prob", "ret_1w")


@query("tk09_period_end_row", fin("date symbol close", f"SELECT date, symbol, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month',date) ORDER BY date DESC) AS rn FROM {BRAND}) WHERE rn=1"))
def _(t):
    m = t.brand.withColumn("m", F.trunc("date", "month"))
    return T.latest_per_key(m, ["symbol", "m"]).select("date", "symbol", "close")


@query("tk10_best_row_per_group", fin("grp symbol avg_ret", f"""SELECT grp, symbol, m AS avg_ret FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(m,10) DESC, symbol) AS rn
 FROM (SELECT grp, symbol, avg(ret_1w) AS m FROM {WEEKLY} GROUP BY 1,2)) WHERE rn=1"""))
def _(t):
    g = t.weekly.groupBy("grp", "symbol").agg(F.avg("ret_1w").alias("avg_ret"))
    return T.best_rows(g, F.round("avg_ret", 10), ["grp"], ["symbol"])
