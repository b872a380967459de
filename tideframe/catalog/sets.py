"""2.8 Set operations."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.operators import panel as P, setops as O, topk as T
from tideframe.plans.fixtures import BRAND, ETF, HOLDINGS, WEEKDAYS, WEEKLY

_K = f"(SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rp, row_number() OVER (PARTITION BY date ORDER BY ret_1w DESC NULLS LAST, symbol) AS ra FROM {WEEKLY})"


@query("st01_union_of_panels", fin("date symbol close grp src:s", f"SELECT date, symbol, close, NULL AS grp, 'brand' AS src FROM {BRAND} UNION ALL SELECT date, symbol, close, grp, 'nation' FROM {ETF}"))
def _(t):
    return t.brand.withColumn("src", F.lit("brand")).unionByName(t.etf.withColumn("src", F.lit("nation")), allowMissingColumns=True)


@query("st02_distinct_key_union", fin("symbol", f"SELECT DISTINCT symbol FROM {ETF} UNION SELECT component FROM {HOLDINGS}"))
def _(t):
    return t.etf.select("symbol").union(t.holdings.select("component")).distinct()


@query("st03_top_k_overlap", fin("date overlap", f"SELECT date, count(*) FILTER (rp<=5 AND ra<=5)/5.0 AS overlap FROM {_K} GROUP BY date"))
def _(t):
    a = O.selections(T.top_k(t.weekly, "score", 5)).withColumnRenamed("selected", "a")
    b = O.selections(T.top_k(t.weekly, "ret_1w", 5)).withColumnRenamed("selected", "b")
    return a.join(b, "date").select("date", O.overlap_rate("a", "b", 5).alias("overlap"))


@query("st04_turnover", fin("date turnover", f"""WITH s AS (SELECT date, list(symbol) AS a FROM {_K} WHERE rp<=5 GROUP BY date),
 p AS (SELECT date, a, lag(a) OVER (ORDER BY date) AS b FROM s)
 SELECT date, CASE WHEN b IS NULL THEN 1.0 ELSE (len(a)+len(b)-2*len(list_intersect(a,b)))::DOUBLE/(len(a)+len(b)-len(list_intersect(a,b))) END AS turnover FROM p"""))
def _(t):
    s = O.selections(T.top_k(t.weekly, "score", 5))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return s.select("date", O.turnover("selected", F.lag("selected").over(w)).alias("turnover"))


@query("st05_missing_keys", fin("symbol", f"SELECT DISTINCT p_brand AS symbol FROM part EXCEPT SELECT DISTINCT symbol FROM {BRAND} WHERE date<DATE '1995-01-03'"))
def _(t):
    return t.part.select(F.col("p_brand").alias("symbol")).distinct().exceptAll(t.brand.filter("date < date'1995-01-03'").select("symbol").distinct())


@query("st06_ordered_dedup", fin("symbol first_date grp", f"SELECT symbol, min(date) AS first_date, arg_min(grp, date) AS grp FROM {ETF} GROUP BY symbol"))
def _(t):
    return O.first_occurrence(t.etf.select("symbol", F.col("date").alias("first_date"), "grp"), "symbol", ["first_date"])


@query("st07_work_list", fin("symbol last_date", f"SELECT symbol, max(date) AS last_date FROM {ETF} WHERE grp='ASIA' GROUP BY symbol"))
def _(t):
    return O.work_list(t.etf.filter("grp = 'ASIA'"))


@query("st08_weekly_and_monthly_dates", fin("date", f"SELECT max(date) AS date FROM {BRAND} GROUP BY {WEEKDAYS.format(d='date')} UNION SELECT max(date) FROM {BRAND} GROUP BY date_trunc('month',date)"))
def _(t):
    d = t.brand.select("date")
    return P.rebalance_dates(d, "W").union(P.rebalance_dates(d, "M")).distinct()
