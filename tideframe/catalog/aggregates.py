"""2.4 Aggregations."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R
from tideframe.functions.scalar import ratio
from tideframe.operators import aggregates as G, asof as A, panel as P, pooled as PO, setops as O, topk as T, xsec as S
from tideframe.plans.fixtures import BARS, BRAND, ETF, HOLDINGS, MARKET, RISK, WEEKLY

UP = "(ret_1w>0)"


@query("ag01_group_summary", fin("grp n:i avg_score max_score", f"SELECT grp, count(*) AS n, avg(score) AS avg_score, max(score) AS max_score FROM {WEEKLY} GROUP BY grp"))
def _(t):
    return t.weekly.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))


@query("ag02_grouping_sets", fin("segment_type:s segment:s n:i acc mean_prob", f"""SELECT CASE WHEN grouping(grp)=0 THEN 'grp' WHEN grouping(regime)=0 THEN 'regime' ELSE '__ALL__' END AS segment_type, coalesce(grp, regime, '__ALL__') AS segment,
 count(*) AS n, avg(((prob>=0.5)=(ret_1w>0))::INT) AS acc, avg(prob) AS mean_prob FROM {WEEKLY} WHERE ret_1w IS NOT NULL GROUP BY GROUPING SETS ((),(grp),(regime))"""))
def _(t):
    d = t.weekly.filter("ret_1w is not null")
    hit = (F.col("prob") >= 0.5) == (F.col("ret_1w") > 0)
    return G.segment_metrics(d, [F.count(F.lit(1)).alias("n"), G.rate(hit).alias("acc"), F.avg("prob").alias("mean_prob")], ["grp", "regime"])


@query("ag03_two_level_aggregation", fin("weeks:i top_ret all_ret", f"SELECT count(*) AS weeks, avg(a) AS top_ret, avg(b) AS all_ret FROM (SELECT date, avg(ret_1w) FILTER (rn<=3) AS a, avg(ret_1w) AS b FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM {WEEKLY}) GROUP BY date)"))
def _(t):
    r = t.weekly.withColumn("rn", S.first_come_rank("score"))
    d = r.groupBy("date").agg(F.avg(F.when(F.col("rn") <= 3, F.col("ret_1w"))).alias("a"), F.avg("ret_1w").alias("b"))
    return d.agg(F.count(F.lit(1)).alias("weeks"), F.avg("a").alias("top_ret"), F.avg("b").alias("all_ret"))


@query("ag04_period_summary", fin("year:i half:i start_date end_date total_return max_score avg_score bad_days:i", f"SELECT year(date) AS year, CASE WHEN month(date)<=6 THEN 1 ELSE 2 END AS half, min(date) AS start_date, max(date) AS end_date, arg_max(close,date)/arg_min(close,date)-1 AS total_return, max(score) AS max_score, avg(score) AS avg_score, count(*) FILTER (score>=60) AS bad_days FROM {RISK} GROUP BY 1,2"))
def _(t):
    return G.period_summary(t.risk, "close", "score", F.col("score") >= 60, {"year": F.year("date"), "half": F.when(F.month("date") <= 6, 1).otherwise(2)})


@query("ag05_deterministic_mode", fin("grp regime:s n:i", f"SELECT grp, regime, n FROM (SELECT grp, regime, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, regime) AS rn FROM {WEEKLY} GROUP BY 1,2) WHERE rn=1"))
def _(t):
    return G.most_frequent(t.weekly, ["grp"], "regime")


@query("ag06_exact_quantiles", fin("grp q value", f"SELECT grp, unnest([0.1,0.25,0.5,0.95]) AS q, unnest(quantile_cont(ret_1w, [0.1::DOUBLE,0.25::DOUBLE,0.5::DOUBLE,0.95::DOUBLE])) AS value FROM {WEEKLY} GROUP BY grp"))
def _(t):
    return PO.exact_quantiles(t.weekly, ["grp"], "ret_1w", [0.1, 0.25, 0.5, 0.95])


@query("ag07_conditional_rates", fin("grp neg pos hit", f"SELECT grp, avg((ret_1w<0)::INT) AS neg, avg((ret_1w>0)::INT) AS pos, avg((ret_1w>0)::INT) FILTER (prob>=0.5) AS hit FROM {WEEKLY} WHERE ret_1w IS NOT NULL GROUP BY grp"))
def _(t):
    r = F.col("ret_1w")
    return t.weekly.filter(r.isNotNull()).groupBy("grp").agg(G.rate(r < 0).alias("neg"), G.rate(r > 0).alias("pos"),
                                                             F.avg(F.when(F.col("prob") >= 0.5, (r > 0).cast("double"))).alias("hit"))


@query("ag08_ordered_names", fin("date names:s", f"SELECT date, string_agg(symbol, ',' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM {WEEKLY}) WHERE rn<=5 GROUP BY date"))
def _(t):
    return O.selections(T.top_k(t.weekly, "score", 5)).select("date", F.array_join("selected", ",").alias("names"))


_LAD = f"(SELECT date, etf, component, CASE WHEN etf<'NATION_2' THEN weight ELSE 0 END AS actual, CASE WHEN etf>='NATION_3' AND etf<'NATION_5' THEN NULL ELSE ascii(component[7:7])::DOUBLE END AS cap, CASE WHEN etf='NATION_3' THEN 7.0+length(component) END AS adv FROM {HOLDINGS})"


@query("ag09_weight_ladder", fin("date etf:s component:s weight source:s", f"""SELECT date, etf, component, CASE WHEN a>0 THEN actual/a WHEN c>0 THEN coalesce(cap,0)/c WHEN v>0 THEN coalesce(adv,0)/v ELSE 1.0/n END AS weight,
 CASE WHEN a>0 THEN 'actual' WHEN c>0 THEN 'market_cap_pseudo' WHEN v>0 THEN 'adv_pseudo' ELSE 'equal_weight_fallback' END AS source
 FROM (SELECT *, sum(actual) OVER p AS a, sum(coalesce(cap,0)) OVER p AS c, sum(coalesce(adv,0)) OVER p AS v, count(*) OVER p AS n FROM {_LAD} WINDOW p AS (PARTITION BY date, etf))"""))
def _(t):
    e = F.col("etf")
    d = t.holdings.select("date", "etf", "component", F.when(e < "NATION_2", F.col("weight")).otherwise(0.0).alias("actual"),
                          F.when(~((e >= "NATION_3") & (e < "NATION_5")), F.ascii(F.substring("component", 7, 1)).cast("double")).alias("cap"),
                          F.when(e == "NATION_3", 7.0 + F.length("component")).alias("adv"))
    return G.weight_ladder(d, [("actual", "actual"), ("cap", "market_cap_pseudo"), ("adv", "adv_pseudo")]).select("date", "etf", "component", "weight", "source")


@query("ag10_average_daily_value", fin("symbol adv", f"SELECT symbol, avg(close*volume) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM {BARS}) WHERE rn<=60 GROUP BY symbol"))
def _(t):
    return G.average_daily_value(t.bars)


@query("ag11_holdings_collapse", fin("etf:s component:s weight first_date", f"SELECT etf, component, w/sum(w) OVER (PARTITION BY etf) AS weight, d AS first_date FROM (SELECT etf, component, sum(weight) AS w, min(date) AS d FROM {HOLDINGS} GROUP BY 1,2)"))
def _(t):
    return G.collapse_weights(t.holdings, ["etf", "component"], ["etf"], ["date"]).withColumnRenamed("date", "first_date")


_H = f"(SELECT h.date, etf, component, weight, r FROM {HOLDINGS} h LEFT JOIN (SELECT date, symbol, close/lag(close,20) OVER (PARTITION BY symbol ORDER BY date)-1 AS r FROM {BRAND}) b ON b.date=h.date AND b.symbol=h.component)"


def held(t):
    r = t.brand.select("date", F.col("symbol").alias("component"), R.step_return("close", 20, R.by_entity()).alias("r"))
    return t.holdings.join(r, ["date", "component"], "left")


@query("ag12_weighted_mean", fin("date etf:s m", f"SELECT date, etf, sum(weight*r)/nullif(sum(weight) FILTER (r IS NOT NULL),0) AS m FROM {_H} GROUP BY 1,2"))
def _(t):
    return held(t).groupBy("date", "etf").agg(G.weighted_mean("r", "weight").alias("m"))


@query("ag13_weighted_share", fin("date etf:s m", f"SELECT date, etf, coalesce(sum(weight) FILTER (r>0),0)/nullif(sum(weight) FILTER (r IS NOT NULL),0) AS m FROM {_H} GROUP BY 1,2"))
def _(t):
    return held(t).groupBy("date", "etf").agg(G.weighted_share(F.col("r") > 0, F.col("r").isNotNull(), "weight").alias("m"))


@query("ag14_tail_means", fin("date etf:s top bottom", f"""SELECT date, etf, avg(r) FILTER (hi<=greatest(1,ceil(0.2*n))) AS top, avg(r) FILTER (lo<=greatest(1,ceil(0.2*n))) AS bottom FROM
 (SELECT *, count(*) OVER (PARTITION BY date, etf) AS n, row_number() OVER (PARTITION BY date, etf ORDER BY r DESC NULLS LAST, component) AS hi, row_number() OVER (PARTITION BY date, etf ORDER BY r NULLS LAST, component) AS lo FROM {_H}) GROUP BY 1,2"""))
def _(t):
    g = Window.partitionBy("date", "etf")
    d = held(t).withColumns({"n": F.count(F.lit(1)).over(g), "hi": F.row_number().over(g.orderBy(F.desc_nulls_last("r"), "component")), "lo": F.row_number().over(g.orderBy(F.asc_nulls_last("r"), "component"))})
    n = G.tail_size(F.col("n"))
    return d.groupBy("date", "etf").agg(G.tail_mean("r", n, "hi").alias("top"), G.tail_mean("r", n, "lo").alias("bottom"))


@query("ag15_concentration", fin("date etf:s effective_n top5 top10", f"SELECT date, etf, 1/sum(weight*weight) AS effective_n, sum(weight) FILTER (rn<=5) AS top5, sum(weight) FILTER (rn<=10) AS top10 FROM (SELECT *, row_number() OVER (PARTITION BY date, etf ORDER BY weight DESC) AS rn FROM {HOLDINGS}) GROUP BY 1,2"))
def _(t):
    d = t.holdings.withColumn("rn", F.row_number().over(Window.partitionBy("date", "etf").orderBy(F.desc("weight"))))
    top = lambda k: F.sum(F.when(F.col("rn") <= k, F.col("weight")))
    return d.groupBy("date", "etf").agg(G.effective_number("weight").alias("effective_n"), top(5).alias("top5"), top(10).alias("top10"))


@query("ag16_contribution_share", fin("date etf:s share", f"SELECT date, etf, coalesce(sum(c) FILTER (rn<=5)/nullif(sum(c),0),0) AS share FROM (SELECT *, row_number() OVER (PARTITION BY date, etf ORDER BY c DESC NULLS LAST) AS rn FROM (SELECT date, etf, CASE WHEN r IS NOT NULL THEN greatest(weight*r,0) END AS c FROM {_H})) GROUP BY 1,2"))
def _(t):
    d = held(t).withColumn("c", F.when(F.col("r").isNotNull(), F.greatest(F.col("weight") * F.col("r"), F.lit(0.0))))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("date", "etf").orderBy(F.desc_nulls_last("c"))))
    return d.groupBy("date", "etf").agg(F.coalesce(ratio(F.sum(F.when(F.col("rn") <= 5, F.col("c"))), F.sum("c")), F.lit(0.0)).alias("share"))


_XV = f"""(SELECT date, symbol, grp, y, CASE WHEN count(r1) OVER f>=60 THEN stddev_samp(r1) OVER f*sqrt(252.0) END AS x FROM (SELECT date, symbol, grp, close/lag(close,126) OVER w-1 AS y, close/lag(close,1) OVER w-1 AS r1 FROM {ETF} WINDOW w AS (PARTITION BY symbol ORDER BY date))
 WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""


@query("ag17_weighted_slope", fin("date n:i slope", f"""WITH v AS (SELECT a.*, 1.0/k AS w FROM {_XV} a JOIN (SELECT grp, count(DISTINCT symbol) AS k FROM {ETF} GROUP BY grp) g ON a.grp=g.grp WHERE x IS NOT NULL AND y IS NOT NULL),
 m AS (SELECT date, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, count(*) AS n FROM v GROUP BY date)
 SELECT v.date, any_value(n) AS n, CASE WHEN any_value(n)>=12 THEN sum(w*(x-mx)*(y-my))/nullif(sum(w*(x-mx)*(x-mx)),0) END AS slope FROM v JOIN m ON v.date=m.date GROUP BY v.date"""))
def _(t):
    d = t.etf.withColumns({"y": R.step_return("close", 126, R.by_entity()), "r1": R.step_return("close", 1, R.by_entity())})
    d = d.withColumn("x", R.annual_vol("r1", 252, R.by_entity(), 60))
    return G.weighted_slope(d, "y", "x", "grp", 12)


@query("ag18_component_regression")
def _(t):
    px = t.brand.select("date", F.col("symbol").alias("component"), R.step_return("close", 20, R.by_entity()).alias("y"), ratio("close", R.high("close", 252, R.by_entity(), 120)).alias("hp"), R.step_return("close", 60, R.by_entity()).alias("ret60"))
    bench = t.market.select("date", R.step_return("close", 60, Window.partitionBy(F.lit(0)).orderBy("date")).alias("b60"))
    days = P.at_rebalance(t.etf, "W").select("date", F.col("symbol").alias("etf"))
    h = A.snapshot_join(days, t.holdings, "etf").join(px, ["date", "component"]).join(bench, "date").withColumn("rs60", F.col("ret60") - F.col("b60"))
    return G.component_regression(h)


@query("ag19_basket_index", fin("date grp ret index", f"SELECT date, grp, ret, exp(sum(ln(1+ret)) OVER (PARTITION BY grp ORDER BY date)) AS index FROM (SELECT date, grp, coalesce(avg(r),0) AS ret FROM (SELECT date, grp, CASE WHEN x IS NOT NULL THEN least(0.05,greatest(-0.05,x)) END AS r FROM (SELECT *, close/lag(close,1) OVER (PARTITION BY symbol ORDER BY date)-1 AS x FROM {ETF})) GROUP BY 1,2)", 4))
def _(t):
    from tideframe.functions.scalar import clip
    r = t.etf.select("date", "grp", clip(R.step_return("close", 1, R.by_entity()), -0.05, 0.05).alias("ret"))
    b = G.basket_index(r, ("grp",)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    r4 = lambda c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4
    return b.select("date", "grp", r4("ret").alias("ret"), r4("index").alias("index"))


@query("ag20_any_signal", fin("date s:i", f"SELECT date, (score>=70 OR day(date)=1)::INT AS s FROM {RISK}"))
def _(t):
    d = t.risk.withColumns({"a": F.when(F.col("score") >= 70, 1), "b": (F.dayofmonth("date") == 1).cast("int")})
    return d.select("date", G.any_signal(["a", "b"]).alias("s"))


@query("ag21_row_weighted_means", fin("date symbol zero skip", f"SELECT date, symbol, (coalesce(s,0)*0.6+p*0.4)/1.0 AS zero, (coalesce(s,0)*0.6+p*0.4)/(CASE WHEN s IS NULL THEN 0.4 ELSE 1.0 END) AS skip FROM (SELECT *, CASE WHEN day(date)%2=0 THEN score END AS s, prob*100 AS p FROM {WEEKLY})"))
def _(t):
    d = t.weekly.withColumns({"s": F.when(F.dayofmonth("date") % 2 == 0, F.col("score")), "p": F.col("prob") * 100})
    wts = {"s": 0.6, "p": 0.4, "absent": 2.0}
    return d.select("date", "symbol", G.row_weighted_mean(d, wts).alias("zero"), G.row_weighted_mean(d, wts, skip_null=True).alias("skip"))


@query("ag22_value_counts", fin("grp regime:s n:i share", f"SELECT grp, regime, n, n::DOUBLE/sum(n) OVER (PARTITION BY grp) AS share FROM (SELECT grp, regime, count(*) AS n FROM {WEEKLY} GROUP BY 1,2)"))
def _(t):
    return G.value_shares(t.weekly, ["grp"], "regime")


_BR = f"""(SELECT date, grp, r20, coalesce(close<CASE WHEN count(close) OVER f20>=10 THEN avg(close) OVER f20 END,false) AS b20, coalesce(close<CASE WHEN count(close) OVER f60>=20 THEN avg(close) OVER f60 END,false) AS b60 FROM (SELECT *, close/lag(close,20) OVER (PARTITION BY symbol ORDER BY date)-1 AS r20 FROM {ETF})
 WINDOW f20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), f60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING))"""


@query("ag23_breadth", fin("date below_ma60 below_ma20 loss20 large_loss20 risk_breadth risk_ret safe_ret", f"""SELECT date, 100*avg(b60::INT) AS below_ma60, 100*avg(b20::INT) AS below_ma20, 100*avg((coalesce(r20,0)<0)::INT) AS loss20, 100*avg((coalesce(r20,0)<-0.05)::INT) AS large_loss20,
 1-avg(b60::INT) FILTER (grp<>'ASIA') AS risk_breadth, avg(r20) FILTER (grp<>'ASIA') AS risk_ret, avg(r20) FILTER (grp='ASIA') AS safe_ret FROM {_BR} GROUP BY date"""))
def _(t):
    return G.breadth(t.etf, F.col("grp") != "ASIA", F.col("grp") == "ASIA")


@query("ag24_compounded_windows", fin("win:s r", f"""SELECT w AS win, exp(sum(ln(1+r)))-1 AS r FROM (SELECT date, least(0.02,greatest(-0.02,coalesce(close/lag(close,1) OVER (ORDER BY date)-1,0))) AS r FROM {MARKET})
 JOIN (VALUES ('1996', DATE '1996-01-01', DATE '1996-12-31'), ('mid', DATE '1997-03-05', DATE '1998-02-10'), ('late', DATE '2000-06-01', DATE '2001-12-31')) v(w,s,e) ON date BETWEEN s AND e GROUP BY w"""))
def _(t):
    from tideframe.functions.scalar import clip
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    r = t.market.select("date", clip(F.coalesce(R.step_return("close", 1, w), F.lit(0.0)), -0.02, 0.02).alias("r"))
    wins = t.spark.createDataFrame([("1996", "1996-01-01", "1996-12-31"), ("mid", "1997-03-05", "1998-02-10"), ("late", "2000-06-01", "2001-12-31")], "win string, s string, e string")
    wins = wins.select("win", F.to_date("s").alias("valid_from"), F.to_date("e").alias("valid_to"))
    return G.compounded(A.interval_join(r, wins, (), closed=True), ["win"], ["r"])


@query("ag25_item_scores", fin("symbol score gate:s", f"""SELECT symbol, round(s,2) AS score, CASE WHEN s IS NULL THEN 'research_required' WHEN round(s,2)>=60 THEN 'pass' ELSE 'fail' END AS gate FROM (SELECT symbol, 100.0*(coalesce((a>0)::INT,0)+coalesce((b>0)::INT,0)+(c>50)::INT)/(1+(a IS NOT NULL)::INT+(b IS NOT NULL)::INT) AS s FROM
 (SELECT symbol, arg_max_null(ret_1w, date) AS a, arg_max_null(ret_4w, date) AS b, arg_max(score, date) AS c FROM {WEEKLY} GROUP BY symbol))""", 2))
def _(t):
    last = T.latest_per_key(t.weekly.select("symbol", "date", "ret_1w", "ret_4w", "score"), ["symbol"])
    items = F.array(F.struct((F.col("ret_1w") > 0).alias("passed")), F.struct((F.col("ret_4w") > 0).alias("passed")), F.struct((F.col("score") > 50).alias("passed")))
    s = last.select("symbol", G.item_score(items).alias("score"))
    return s.withColumn("gate", G.gate("score"))
