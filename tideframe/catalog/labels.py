"""2.13 Labels and targets."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.composites import WIDE, wide
from tideframe.catalog.rolling import lag, over
from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip
from tideframe.operators import aggregates as G, labels as L
from tideframe.plans.fixtures import BRAND, ETF, MARKET, WEEKLY

_o = "OVER (ORDER BY date)"
_f = lambda c, h: f"lead({c},{h}) {_o}/{c}-1"
_m = lambda c, h: f"min({c}) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)/{c}-1"
_b = lambda c: f"coalesce({c},false)"


@query("lb01_drop_labels", fin("date drop_1w_2pct:i correction_1m:i delayed_1m:i tail_1m:i", f"SELECT date, {_b('w<=-0.02')} AS drop_1w_2pct, {_b('m<=-0.035')} OR {_b('lo<=-0.055')} AS correction_1m, {_b('w>-0.01')} AND ({_b('m<=-0.03')} OR {_b('lo<=-0.055')}) AS delayed_1m, {_b('m<-0.05')} OR {_b('lo<-0.07')} AS tail_1m FROM (SELECT date, {_f('close', 5)} AS w, {_f('close', 20)} AS m, {_m('close', 20)} AS lo FROM {MARKET})"))
def _(t):
    d = L.forward_stats(t.market, "close", "f", R.day())
    return d.select("date", *[c.alias(k) for k, c in L.drop_labels("f_1w", "f_1m", "f_min_1m").items()])


_BI = f"(SELECT date, max(i) FILTER (grp='AMERICA') AS r, max(i) FILTER (grp='ASIA') AS s FROM (SELECT date, grp, exp(sum(ln(1+coalesce(ret,0))) OVER (PARTITION BY grp ORDER BY date)) AS i FROM (SELECT date, grp, avg(CASE WHEN x IS NOT NULL THEN least(0.0517,greatest(-0.0517,x)) END) AS ret FROM (SELECT date, grp, close/{lag('close', 1)}-1 AS x FROM {ETF}) GROUP BY 1,2)) GROUP BY date HAVING r IS NOT NULL AND s IS NOT NULL)"


def _pl(h, n):
    dd, ret, rel, rot, rdd, sret = L.PRACTICAL[h]
    return f"{_b(f'm{n}<={dd}')} OR {_b(f'r{n}<={ret}')} OR {_b(f'r{n}-s{n}<={rel}')} AS practical_loss_{h}, {_b(f'r{n}-s{n}<={rot}')} AND ({_b(f'm{n}<={rdd}')} OR {_b(f's{n}>{sret}')}) AS rotation_{h}"


@query("lb02_practical_loss_labels", fin("date practical_loss_1w:i rotation_1w:i practical_loss_1m:i rotation_1m:i", f"SELECT date, {_pl('1w', 5)}, {_pl('1m', 20)} FROM (SELECT date, " + ", ".join(f"{_f('r', n)} AS r{n}, {_f('s', n)} AS s{n}, {_m('r', n)} AS m{n}" for n in (5, 20)) + f" FROM {_BI})"))
def _(t):
    r = t.etf.select("date", "grp", clip(R.step_return("close", 1, R.by_entity()), -0.0517, 0.0517).alias("ret"))
    b = G.basket_index(r, ("grp",)).groupBy("date").pivot("grp", ["AMERICA", "ASIA"]).agg(F.first("index")).dropna()
    d = L.forward_stats(L.forward_stats(b, "AMERICA", "risk", R.day()), "ASIA", "safe", R.day())
    return L.practical_loss(d, "risk", "safe").select("date", "practical_loss_1w", "rotation_1w", "practical_loss_1m", "rotation_1m")


_PX = ["VIX", "GOLD", "DXY"]
_mean = lambda k: "(" + "+".join(f"coalesce({k}_{p},0)" for p in _PX) + ")/nullif(" + "+".join(f"({k}_{p} IS NOT NULL)::INT" for p in _PX) + ",0)"
_worst = lambda k: "least(" + ",".join(f"{k}_{p}" for p in _PX) + ")"
_EVQ = f"(SELECT *, {', '.join(f'{_mean(f'm{h}')} AS a{h}' for h in (5, 20, 40))}, {', '.join(f'{_worst(f'm{h}')} AS w{h}' for h in (5, 20))}, {', '.join(f'{_mean(f'r{h}')} AS f{h}' for h in (5, 20))} FROM (SELECT date, {', '.join(f'{_m(p, h)} AS m{h}_{p}' for p in _PX for h in (5, 20, 40))}, {', '.join(f'{_f(p, h)} AS r{h}_{p}' for p in _PX for h in (5, 20))} FROM {WIDE}))"
EVENTS = f"(SELECT date, ({_b('a5<=-0.025')} OR {_b('w5<=-0.045')} OR {_b('f5<=-0.03')})::INT AS y1, ({_b('a20<=-0.06')} OR {_b('w20<=-0.095')} OR {_b('f20<=-0.055')} OR {_b('a40<=-0.085')})::INT AS y2, CASE WHEN least(a5,w5,f5) IS NOT NULL THEN greatest(0,-least(a5,w5,f5)) END AS s1, CASE WHEN least(a20,w20,f20,a40) IS NOT NULL THEN greatest(0,-least(a20,w20,f20,a40)) END AS s2 FROM {_EVQ})"


@query("lb03_event_loss_labels", fin("date y1:i y2:i s1 s2", f"FROM {EVENTS}"))
def _(t):
    d = L.event_labels(wide(t).select("date", *_PX), _PX)
    return d.select("date", F.col("label_event_loss_1w").alias("y1"), F.col("label_event_loss_1m").alias("y2"), F.col("severity_1w").alias("s1"), F.col("severity_1m").alias("s2"))


@query("lb04_entry_labels", fin("date symbol a:i b:i", f"SELECT date, symbol, {_b('ret_1w>0 AND ret_1w-m>0')} AS a, {_b('ret_1w>0 AND ret_1w-m>0 AND ret_4w>-0.02')} AS b FROM (SELECT *, avg(ret_1w) OVER (PARTITION BY date) AS m FROM {WEEKLY})"))
def _(t):
    e = F.col("ret_1w") - F.avg("ret_1w").over(Window.partitionBy("date"))
    d = t.weekly.withColumn("e", e)
    return d.select("date", "symbol", L.entry_label("ret_1w", "e").alias("a"), L.entry_label("ret_1w", "e", "ret_4w").alias("b"))


@query("lb05_safe_target", fin("date symbol target", f"SELECT date, symbol, ret_4w-0.75*abs(CASE WHEN ret_4w<0 THEN ret_4w ELSE 0 END)-m AS target FROM (SELECT *, avg(ret_4w) FILTER (grp<>'ASIA') OVER (PARTITION BY date) AS m FROM {WEEKLY})"))
def _(t):
    return L.safe_target(t.weekly, "ret_4w", F.col("grp") != "ASIA").select("date", "symbol", "target")


CAND = f"""(SELECT q.*, names, universe_score_std, universe_score_iqr, top1_score-topk_score_min AS score_spread, excess_return+0.35*portfolio_return-0.65*greatest(0,-portfolio_return) AS utility, (excess_return>0 AND portfolio_return>0)::INT AS entry_label FROM
 (SELECT date, score_col, top_k, avg(ret_1w) AS portfolio_return, avg(x) AS excess_return, max(score) AS top1_score, avg(score) AS topk_score_mean, min(score) AS topk_score_min, stddev_pop(score) AS score_std, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY date, score_col ORDER BY score DESC, symbol) AS rn FROM (SELECT date, symbol, ret_1w, ret_1w-ret_4w/4 AS x, unnest(['score','prob']) AS score_col, unnest([score,prob]) AS score FROM {WEEKLY} WHERE ret_1w IS NOT NULL AND ret_4w IS NOT NULL)), (SELECT unnest([1,3,5]) AS top_k) WHERE rn<=top_k GROUP BY 1,2,3) q
 JOIN (SELECT date, score_col, count(*) AS names, stddev_pop(score) AS universe_score_std, quantile_cont(score,0.75::DOUBLE)-quantile_cont(score,0.25::DOUBLE) AS universe_score_iqr FROM (SELECT date, unnest(['score','prob']) AS score_col, unnest([score,prob]) AS score FROM {WEEKLY} WHERE ret_1w IS NOT NULL AND ret_4w IS NOT NULL) GROUP BY 1,2) u ON u.date=q.date AND u.score_col=q.score_col WHERE n=top_k)"""


def candidates(t):
    return L.candidate_panel(t.weekly.withColumn("x", F.col("ret_1w") - F.col("ret_4w") / 4), ["score", "prob"], [1, 3, 5], "ret_1w", "x")


@query("lb06_candidate_panel", fin("date score_col:s top_k:i portfolio_return excess_return utility entry_label:i score_spread universe_score_iqr names:i", f"FROM {CAND}"))
def _(t):
    return candidates(t).select("date", "score_col", "top_k", "portfolio_return", "excess_return", "utility", "entry_label", "score_spread", "universe_score_iqr", "names")


@query("lb07_crash_after_peak", fin("date symbol y:i", f"SELECT date, symbol, CASE WHEN len(f)<30 THEN 0 ELSE (list_min(f[p+1:])/list_max(f)-1<=-0.25 AND abs(day(date)-p)<=10)::INT END AS y FROM (SELECT *, list_position(f, list_max(f))-1 AS p FROM (SELECT date, symbol, {over('list(close)', 'ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING')} AS f FROM {BRAND}))"))
def _(t):
    return t.brand.select("date", "symbol", L.crash_after_peak("close", F.dayofmonth("date"), R.by_entity()).alias("y"))


@query("lb08_down_labels", fin("date down_1w:i down_1w_1pct:i down_1w_2pct:i down_1w_3pct:i down_1w_5pct:i down_1m_3pct:i down_1m_5pct:i", f"SELECT date, {_b('a<0')} AS down_1w, {', '.join(_b(f'a<-{n / 100}') + f' AS down_1w_{n}pct' for n in (1, 2, 3, 5))}, {', '.join(_b(f'b<-{n / 100}') + f' AS down_1m_{n}pct' for n in (3, 5))} FROM (SELECT date, avg(ret_1w) AS a, avg(ret_4w) AS b FROM {WEEKLY} WHERE grp<>'ASIA' GROUP BY date)"))
def _(t):
    d = t.weekly.filter("grp <> 'ASIA'").groupBy("date").agg(F.avg("ret_1w").alias("a"), F.avg("ret_4w").alias("b"))
    return d.select("date", *[c.alias(k) for k, c in L.down_labels("a", "b").items()])
