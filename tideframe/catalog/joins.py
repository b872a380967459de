"""2.3 Joins."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R
from tideframe.functions.scalar import ratio
from tideframe.operators import asof as A, joins as J, panel as P, statements as ST, topk as T
from tideframe.plans.fixtures import BRAND, DRIVERS, ETF, HOLDINGS, MARKET, REGIME, RISK, WEEKLY

_MON = f"(SELECT max(date) AS date, arg_max(score,date) AS rs FROM {RISK} GROUP BY date_trunc('month',date))"


def monthly_risk(t):
    return P.at_rebalance(t.risk, "M").select("date", F.col("score").alias("rs"))


_LPPL = f"(SELECT date AS asof, symbol, close AS fit FROM {ETF} WHERE day(date) IN (1,15))"


def fits(t):
    return t.etf.filter("day(date) in (1, 15)").select(F.col("date").alias("asof"), "symbol", F.col("close").alias("fit"))


@query("jn01_date_join", fin("date symbol close close_mkt", f"SELECT b.date, symbol, b.close, m.close AS close_mkt FROM {BRAND} b LEFT JOIN {MARKET} m ON b.date=m.date"))
def _(t):
    return J.join_panels(t.brand, t.market, ["date"], "_mkt")


@query("jn02_date_symbol_join", fin("date symbol close score", f"SELECT e.date, e.symbol, close, score FROM {ETF} e LEFT JOIN {WEEKLY} w ON e.date=w.date AND e.symbol=w.symbol"))
def _(t):
    return J.join_panels(t.etf.select("date", "symbol", "close"), t.weekly.select("date", "symbol", "score"), ["date", "symbol"], "_w")


@query("jn03_horizon_wide", fin("date p1w p1m", f"SELECT coalesce(a.date,b.date) AS date, a.s AS p1w, b.s AS p1m FROM (SELECT date, score AS s FROM {RISK} WHERE day(date)%2=0) a FULL JOIN (SELECT date, score/2 AS s FROM {RISK} WHERE day(date)%3=0) b ON a.date=b.date"))
def _(t):
    a = t.risk.filter("day(date) % 2 = 0").select("date", F.lit("1w").alias("horizon"), F.col("score").alias("p"))
    b = t.risk.filter("day(date) % 3 = 0").select("date", F.lit("1m").alias("horizon"), (F.col("score") / 2).alias("p"))
    return a.unionByName(b).groupBy("date").pivot("horizon", ["1w", "1m"]).agg(F.first("p")).withColumnsRenamed({"1w": "p1w", "1m": "p1m"})


@query("jn04_asof_backward", fin("date symbol rs", f"SELECT w.date, symbol, rs FROM {WEEKLY} w ASOF LEFT JOIN {_MON} m ON w.date>=m.date"))
def _(t):
    return A.asof_join(t.weekly.select("date", "symbol"), monthly_risk(t))


@query("jn05_asof_with_tolerance", fin("date symbol rs", f"SELECT w.date, symbol, CASE WHEN date_diff('day', m.date, w.date)<=10 THEN rs END AS rs FROM {WEEKLY} w ASOF LEFT JOIN {_MON} m ON w.date>=m.date"))
def _(t):
    return A.asof_join(t.weekly.select("date", "symbol"), monthly_risk(t), tolerance_days=10)


@query("jn06_asof_per_key", fin("date symbol fit fit_date", f"SELECT w.date, w.symbol, fit, f.asof AS fit_date FROM {WEEKLY} w ASOF LEFT JOIN {_LPPL} f ON w.symbol=f.symbol AND w.date>=f.asof"))
def _(t):
    return A.asof_join(t.weekly.select("date", "symbol"), fits(t), by=("symbol",), right_on="asof", matched="fit_date")


@query("jn07_latest_holdings_snapshot", fin("date etf:s component:s weight snapshot_date", f"""SELECT d.date, d.etf, component, weight/sum(weight) OVER (PARTITION BY d.date, d.etf) AS weight, s.sd AS snapshot_date FROM
 (SELECT w.date, w.symbol AS etf, s.sd FROM {WEEKLY} w ASOF JOIN (SELECT DISTINCT etf, date AS sd FROM {HOLDINGS}) s ON w.symbol=s.etf AND w.date>=s.sd) d(date,etf,sd) JOIN {HOLDINGS} h ON h.etf=d.etf AND h.date=d.sd, (SELECT 1) x, LATERAL (SELECT d.sd) s(sd)"""))
def _(t):
    d = t.weekly.select("date", F.col("symbol").alias("etf"))
    s = A.snapshot_join(d, t.holdings, "etf")
    return s.select("date", "etf", "component", (F.col("weight") / F.sum("weight").over(Window.partitionBy("date", "etf"))).alias("weight"), "snapshot_date")


@query("jn08_validity_interval_join", fin("date symbol valid_from:t", f"""SELECT w.date, w.symbol, v.s AS valid_from FROM {WEEKLY} w JOIN (SELECT etf, date AS s, lead(date) OVER (PARTITION BY etf ORDER BY date) AS e FROM (SELECT DISTINCT etf, date FROM {HOLDINGS})) v
 ON v.etf=w.symbol AND w.date>=v.s AND (v.e IS NULL OR w.date<v.e)"""))
def _(t):
    v = A.validity(t.holdings.withColumnRenamed("etf", "symbol"), "symbol")
    return A.interval_join(t.weekly.select("date", "symbol"), v, ("symbol",)).select("date", "symbol", "valid_from")


@query("jn09_attach_daily_state", fin("date symbol rs warn:i", f"SELECT w.date, symbol, m.score AS rs, coalesce(m.score,0)>=60 AS warn FROM {WEEKLY} w ASOF LEFT JOIN {RISK} m ON w.date>=m.date"))
def _(t):
    d = A.asof_join(t.weekly.select("date", "symbol"), t.risk.select("date", F.col("score").alias("rs")))
    return d.withColumn("warn", F.coalesce("rs", F.lit(0.0)) >= 60)


_LONG = f"(SELECT date, symbol, unnest(['1w','1m','3m']) AS horizon FROM {WEEKLY})"
_RH = f"(SELECT date, '1w' AS horizon, score/100 AS p FROM {RISK} WHERE day(date)%5=0 UNION ALL SELECT date, '1m', score/200 FROM {RISK} WHERE day(date)%7=0)"


@query("jn10_asof_by_horizon", fin("date symbol horizon:s p", f"SELECT l.date, symbol, l.horizon, coalesce(p,0) AS p FROM {_LONG} l ASOF LEFT JOIN {_RH} r ON l.horizon=r.horizon AND l.date>=r.date"))
def _(t):
    l = t.weekly.select("date", "symbol", F.explode(F.array(F.lit("1w"), F.lit("1m"), F.lit("3m"))).alias("horizon"))
    r = t.risk.filter("day(date) % 5 = 0").select("date", F.lit("1w").alias("horizon"), (F.col("score") / 100).alias("p")).unionByName(
        t.risk.filter("day(date) % 7 = 0").select("date", F.lit("1m").alias("horizon"), (F.col("score") / 200).alias("p")))
    return A.asof_join(l, r, by=("horizon",)).withColumn("p", F.coalesce("p", F.lit(0.0)))


_BENCH = f"(SELECT date, grp, round(avg(close),8) AS close FROM {ETF} GROUP BY 1,2)"


@query("jn11_shared_dates", fin("date symbol benchmark:s a b rs shared:i", f"""SELECT *, (a/first_value(a) OVER w)/(b/first_value(b) OVER w) AS rs, count(*) OVER (PARTITION BY symbol) AS shared FROM
 (SELECT x.date, x.symbol, x.grp AS benchmark, x.close AS a, y.close AS b FROM {ETF} x JOIN {_BENCH} y ON x.date=y.date AND x.grp=y.grp WHERE x.close IS NOT NULL AND y.close IS NOT NULL) WINDOW w AS (PARTITION BY symbol ORDER BY date)"""))
def _(t):
    """Every symbol with its benchmark on the dates that both have, and the ratio of both since the first of them."""
    bench = t.etf.groupBy("date", F.col("grp").alias("benchmark")).agg(F.round(F.avg("close"), 8).alias("b"))
    return J.aligned(t.etf.select("date", "symbol", F.col("grp").alias("benchmark"), F.col("close").alias("a")), bench, "benchmark", "a", "b")


@query("jn12_semi_join", fin("date symbol close", f"SELECT * FROM {ETF} WHERE date IN (SELECT date FROM {_MON})"))
def _(t):
    return t.etf.select("date", "symbol", "close").join(monthly_risk(t).select("date"), "date", "left_semi")


@query("jn13_anti_join", fin("date symbol close", f"SELECT * FROM {ETF} WHERE (date,symbol) NOT IN (SELECT (date,symbol) FROM {WEEKLY})"))
def _(t):
    return t.etf.select("date", "symbol", "close").join(t.weekly.select("date", "symbol"), ["date", "symbol"], "left_anti")


@query("jn14_parameter_grid", fin("thr mode:s n:i avg_ret", f"""SELECT thr, mode, count(*) FILTER (ok) AS n, avg(CASE WHEN ok THEN r ELSE 0 END) AS avg_ret FROM (SELECT thr, mode, r, score<thr AND (mode='none' OR score<70) AS ok FROM
 (SELECT w.date, avg(coalesce(ret_1w,0)) AS r, any_value(m.score) AS score FROM {WEEKLY} w JOIN {RISK} m ON w.date=m.date GROUP BY 1), (SELECT unnest([30.0,40,50,60,80]) AS thr), (SELECT unnest(['none','cash']) AS mode)) GROUP BY 1,2"""))
def _(t):
    from tideframe.operators.sweep import over_grid
    d = t.weekly.groupBy("date").agg(F.avg(F.coalesce("ret_1w", F.lit(0.0))).alias("r")).join(t.risk, "date")
    g = over_grid(d, {"thr": [30.0, 40.0, 50.0, 60.0, 80.0], "mode": ["none", "cash"]})
    ok = (F.col("score") < F.col("thr")) & ((F.col("mode") == "none") | (F.col("score") < 70))
    return g.groupBy("thr", "mode").agg(F.count_if(ok).alias("n"), F.avg(F.when(ok, F.col("r")).otherwise(0.0)).alias("avg_ret"))


_IDX = f"(SELECT date, close, score, row_number() OVER (ORDER BY date)-1 AS i FROM {RISK})"


@query("jn15_nearest_history", fin("date near_date gap", f"""SELECT date, near_date, gap FROM (SELECT c.date, h.date AS near_date, abs(c.close-h.close) AS gap, row_number() OVER (PARTITION BY c.date ORDER BY abs(c.close-h.close), h.i) AS rn
 FROM {_IDX} c JOIN {_IDX} h ON h.i<c.i-20 WHERE c.i%5=0) WHERE rn=1"""))
def _(t):
    from tideframe.operators.analogs import nearest_history
    d = t.risk.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    nn = nearest_history(d.filter("idx % 5 = 0").select("idx", F.array("close").alias("x")), d.select("idx", F.array("close").alias("x")), k=1, exclude=20)
    a = d.select("idx", "date")
    b = d.select(F.col("idx").alias("hist_idx"), F.col("date").alias("near_date"))
    return nn.join(a, "idx").join(b, "hist_idx").select("date", "near_date", F.col("distance").alias("gap"))


@query("jn16_dimension_lookup", fin("date symbol close region:s", f"SELECT e.date, e.symbol, e.close, r_name AS region FROM {ETF} e JOIN nation ON n_name=e.symbol JOIN region ON n_regionkey=r_regionkey"))
def _(t):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("region"))
    return J.join_panels(t.etf.select("date", "symbol", "close"), dim, ["symbol"], "_d", "inner")


_SEG = f"""(SELECT 'group' AS st, grp AS sg, round(avg(prob),4) AS v FROM {WEEKLY} WHERE grp<>'ASIA' GROUP BY grp UNION ALL SELECT 'regime', regime, round(avg(prob),4) FROM {WEEKLY} WHERE regime='BUILDING' GROUP BY regime)"""


@query("jn17_segment_lookup_ladder", fin("date symbol threshold", f"SELECT date, symbol, coalesce(a.v, b.v, 0.65) AS threshold FROM {WEEKLY} w LEFT JOIN {_SEG} a ON a.st='regime' AND a.sg=w.regime LEFT JOIN {_SEG} b ON b.st='group' AND b.sg=w.grp", 4))
def _(t):
    seg = lambda kind, c, f: t.weekly.filter(f).groupBy(F.col(c).alias("segment")).agg(F.round(F.avg("prob"), 4).alias("threshold")).withColumn("segment_type", F.lit(kind))
    table = seg("group", "grp", "grp <> 'ASIA'").unionByName(seg("regime", "regime", "regime = 'BUILDING'"))
    return J.lookup_ladder(t.weekly, table, [("regime", "regime"), ("group", "grp"), ("ALL", None)], "threshold", 0.65).select("date", "symbol", "threshold")


@query("jn18_positional_join", fin("date symbol pos:i score", f"SELECT date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY date)-1 AS pos, score FROM {WEEKLY}"))
def _(t):
    pos = F.row_number().over(R.by_entity()) - 1
    a = t.weekly.select("date", "symbol", pos.alias("pos"))
    return a.join(t.weekly.select("date", "symbol", pos.alias("pos"), "score"), ["date", "symbol", "pos"])


@query("jn19_proxy_prices", fin("etf:s component:s n:i proxied:i avg_close", f"""WITH h AS (SELECT DISTINCT etf, component, component IN ('Brand#3','Brand#8') AS proxied FROM {HOLDINGS}),
 p AS (SELECT symbol, close FROM {BRAND} UNION ALL SELECT symbol, close FROM {ETF})
 SELECT etf, component, count(*) AS n, bool_or(proxied) AS proxied, avg(close) AS avg_close FROM h JOIN p ON p.symbol=CASE WHEN proxied THEN etf ELSE component END GROUP BY 1,2"""))
def _(t):
    h = t.holdings.select("etf", "component").distinct()
    bad = t.part.filter("p_brand in ('Brand#3', 'Brand#8')").select(F.col("p_brand").alias("component"))
    px = t.brand.select("symbol", "close").unionByName(t.etf.select("symbol", "close"))
    stats = px.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("avg_close"))
    return J.substitute_proxy(h, bad, stats).select("etf", "component", "n", "proxied", "avg_close")


@query("jn20_precedence_map", fin("nm:s code:s n:i", "SELECT p_name AS nm, CASE WHEN min(p_partkey)%2=0 THEN 'C'||p_name ELSE 'R'||p_name END AS code, count(*) AS n FROM part GROUP BY p_name HAVING min(p_partkey)%5<>1"))
def _(t):
    d = t.part.groupBy(F.col("p_name").alias("nm")).agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("n"))
    known = d.filter("k % 5 <> 1")
    cached = known.filter("k % 2 = 0").select("nm", F.concat(F.lit("C"), "nm").alias("code"))
    registry = known.select("nm", F.concat(F.lit("R"), "nm").alias("code"))
    return J.map_names(d, [cached, registry], "nm").select("nm", "code", "n")


@query("jn21_asof_change", fin("symbol now ago chg", f"SELECT symbol, arg_max(close,date) FILTER (date<=DATE '1999-06-30') AS now, arg_max(close,date) FILTER (date<=DATE '1999-03-30') AS ago, now-ago AS chg FROM {BRAND} GROUP BY symbol"))
def _(t):
    asof = F.lit("1999-06-30").cast("date")
    at = lambda d: F.max_by("close", F.when(F.col("date") <= d, F.col("date")))
    g = t.brand.groupBy("symbol").agg(at(asof).alias("now"), at(F.add_months(asof, -3)).alias("ago"))
    return g.withColumn("chg", F.col("now") - F.col("ago"))


_FY = "(SELECT n_name AS symbol, year(o_orderdate) AS fiscal, CASE quarter(o_orderdate) WHEN 4 THEN 'annual' WHEN 1 THEN 'q1' WHEN 2 THEN 'half' ELSE 'q3' END AS kind, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100 AS revenue FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE NOT (year(o_orderdate)=1996 AND quarter(o_orderdate)=2) GROUP BY 1,2,3)"


@query("jn22_prior_report_pairing", fin("symbol fiscal:i kind:s revenue revenue_prior", f"SELECT c.symbol, c.fiscal, c.kind, c.revenue, coalesce(p.revenue, a.revenue) AS revenue_prior FROM {_FY} c LEFT JOIN {_FY} p ON p.symbol=c.symbol AND p.fiscal=c.fiscal-1 AND p.kind=c.kind LEFT JOIN {_FY} a ON a.symbol=c.symbol AND a.fiscal=c.fiscal-1 AND a.kind='annual'"))
def _(t):
    q = F.quarter("o_orderdate")
    kind = F.when(q == 4, "annual").when(q == 1, "q1").when(q == 2, "half").otherwise("q3")
    j = t.orders.filter("not (year(o_orderdate) = 1996 and quarter(o_orderdate) = 2)").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = j.groupBy(F.col("n_name").alias("symbol"), F.year("o_orderdate").alias("fiscal"), kind.alias("kind")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("revenue"))
    return ST.prior_report(s)


@query("jn23_sector_benchmark", fin("symbol bench:s r63", f"""SELECT q.symbol, bench, r AS r63 FROM (SELECT n_name AS symbol, CASE r_name WHEN 'ASIA' THEN 'Brand#1' WHEN 'EUROPE' THEN 'Brand#2' ELSE 'Brand#3' END AS bench FROM nation JOIN region ON n_regionkey=r_regionkey) q LEFT JOIN
 (SELECT symbol, (max(close) FILTER (rn=1)/max(close) FILTER (rn=63)-1)*100 AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM {BRAND}) GROUP BY 1) b ON b.symbol=bench"""))
def _(t):
    pick = F.when(F.col("r_name") == "ASIA", "Brand#1").when(F.col("r_name") == "EUROPE", "Brand#2").otherwise("Brand#3")
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), pick.alias("bench"))
    r = T.last_rows(t.brand, 64).groupBy(F.col("symbol").alias("bench")).agg(T.sessions_return("close", 63).alias("r63"))
    return d.join(r, "bench", "left").select("symbol", "bench", "r63")


@query("jn24_predicted_dates_filled", fin("date close lvl", f"SELECT date, close, last_value(l IGNORE NULLS) OVER (ORDER BY date) AS lvl FROM (SELECT m.date, m.close, CASE WHEN day(r.date)%3=0 THEN r.score END AS l FROM {MARKET} m JOIN {RISK} r ON m.date=r.date)"))
def _(t):
    d = t.market.join(t.risk.select("date", F.when(F.dayofmonth("date") % 3 == 0, F.col("score")).alias("l")), "date")
    return d.select("date", "close", R.padded("l", Window.partitionBy(F.lit(0)).orderBy("date")).alias("lvl"))


@query("jn25_safe_rows_with_risk", fin("date symbol ret_1w rs", f"SELECT w.date, symbol, ret_1w, m.score AS rs FROM {WEEKLY} w LEFT JOIN {RISK} m ON w.date=m.date WHERE grp IN ('ASIA','EUROPE')"))
def _(t):
    d = t.weekly.filter(F.col("grp").isin("ASIA", "EUROPE")).select("date", "symbol", "ret_1w")
    return d.join(t.risk.select("date", F.col("score").alias("rs")), "date", "left")
