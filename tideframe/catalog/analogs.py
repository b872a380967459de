"""2.14 Similar-history search."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.composites import WIDE, wide
from tideframe.functions import rolling as R
from tideframe.operators import analogs as A
from tideframe.plans.fixtures import ETF, MARKET

FEATS = ["VIX", "HY_OAS", "NASDAQ100", "DXY", "WTI", "GOLD"]
_P = f"p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date)-1 AS idx, {', '.join(f'avg({f}) OVER h AS m_{f}, stddev_pop({f}) OVER h AS s_{f}, count({f}) OVER h AS c_{f}' for f in FEATS)} FROM {WIDE} WINDOW h AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 22 PRECEDING))"
_ok = lambda f: f"(q.{f} IS NOT NULL AND q.c_{f}/(q.idx-21.0)>0.8 AND q.s_{f}>1e-12)"
_used = "+".join(f"{_ok(f)}::INT" for f in FEATS)
_d2 = "+".join(f"CASE WHEN {_ok(f)} THEN pow(coalesce((h.{f}-q.m_{f})/q.s_{f},0)-(q.{f}-q.m_{f})/q.s_{f},2) ELSE 0 END" for f in FEATS)
NEAR = f"""WITH {_P}, n AS MATERIALIZED (SELECT * FROM (SELECT q.idx, q.date, h.idx AS hist_idx, sqrt(({_d2})/({_used})) AS distance, row_number() OVER (PARTITION BY q.idx ORDER BY ({_d2})/({_used}), h.idx) AS rn FROM p q JOIN p h ON h.idx<q.idx-21
 WHERE q.idx>=504 AND q.idx%5=0 AND {_used}>=4) WHERE rn<=100)"""


def near(t):
    return A.point_in_time_analogs(wide(t), FEATS, 100, 504, 21, 5, 4)


@query("nn01_point_in_time_neighbours", fin("idx:i hist_idx:i distance rn:i", NEAR + " SELECT * FROM n"))
def _(t):
    return near(t)


_OUT = f"(SELECT date, idx AS hist_idx, r1, r2, lo, coalesce(r1<0,false)::INT AS d1, coalesce(r2<0,false)::INT AS d2, (coalesce(r2<-0.05,false) OR coalesce(lo<-0.07,false))::INT AS tl FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS idx, lead(close,5) OVER (ORDER BY date)/close-1 AS r1, lead(close,20) OVER (ORDER BY date)/close-1 AS r2, min(close) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)/close-1 AS lo FROM {MARKET}))"


@query("nn02_neighbour_outcomes", fin("idx:i k:i neighbours:i distance_mean down_prob_1w tail_prob_1m avg_return_1m tail_return_p10_1m", NEAR + f" SELECT idx, k, count(*) AS neighbours, avg(distance) AS distance_mean, avg(d1) AS down_prob_1w, avg(tl) AS tail_prob_1m, avg(r2) AS avg_return_1m, quantile_cont(least(r2,lo),0.1::DOUBLE) AS tail_return_p10_1m FROM n JOIN {_OUT} o ON o.hist_idx=n.hist_idx, (SELECT unnest([20,50,100]) AS k) WHERE rn<=k GROUP BY 1,2"))
def _(t):
    lab = lambda c: F.coalesce(c, F.lit(False))
    o = t.market.select((F.row_number().over(R.day()) - 1).cast("bigint").alias("hist_idx"), R.forward_return("close", 5, R.day()).alias("ret_1w"), R.forward_return("close", 20, R.day()).alias("ret_1m"), R.forward_min_any("close", 20, R.day()).alias("min_1m"))
    o = o.withColumns({"down_1w": lab(F.col("ret_1w") < 0).cast("int"), "down_1m": lab(F.col("ret_1m") < 0).cast("int"), "tail": (lab(F.col("ret_1m") < -0.05) | lab(F.col("min_1m") < -0.07)).cast("int")})
    return A.neighbour_stats(near(t), o, [20, 50, 100]).select("idx", "k", "neighbours", "distance_mean", "down_prob_1w", "tail_prob_1m", "avg_return_1m", "tail_return_p10_1m")


_SIM = f"""(SELECT date, distance, 100/(1+distance) AS similarity FROM (SELECT h.date, sqrt(({'+'.join(f'CASE WHEN q.{f} IS NOT NULL AND s.s_{f}>1e-12 THEN pow(coalesce((h.{f}-s.m_{f})/s.s_{f},0)-(q.{f}-s.m_{f})/s.s_{f},2) ELSE 0 END' for f in FEATS)})/({'+'.join(f'(q.{f} IS NOT NULL AND s.s_{f}>1e-12)::INT' for f in FEATS)})) AS distance
 FROM {WIDE} h, (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATS)} FROM {WIDE} WHERE date<DATE '2000-06-30'-35) s, (SELECT * FROM {WIDE} WHERE date=DATE '2000-06-30') q WHERE h.date<DATE '2000-06-30'-35) ORDER BY distance, date LIMIT 25)"""


def similar(t):
    return A.similar_days(wide(t), FEATS, "2000-06-30", 35, 25)


@query("nn03_similar_days", fin("date distance similarity", f"FROM {_SIM}"))
def _(t):
    return similar(t)


@query("nn04_outcome_table", fin("symbol horizon:s n:i mean up_share p10 worst best", f"SELECT symbol, horizon, count(*) AS n, avg(r) AS mean, avg((r>0)::INT) AS up_share, quantile_cont(r,0.1::DOUBLE) AS p10, min(r) AS worst, max(r) AS best FROM (SELECT date, symbol, unnest(['w','m']) AS horizon, unnest([lead(close,5) OVER w/close-1, lead(close,20) OVER w/close-1]) AS r FROM {ETF} WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE r IS NOT NULL AND date IN (SELECT date FROM {_SIM}) GROUP BY 1,2"))
def _(t):
    return A.outcome_table(similar(t), t.etf, {"w": 5, "m": 20}).drop("down_share")
