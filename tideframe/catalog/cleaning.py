"""2.2 Projections, filters, cleaning."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R, text as X
from tideframe.functions.scalar import finite, number
from tideframe.operators import panel as P, quality as Q, topk as T
from tideframe.plans.fixtures import BARS, BRAND, ETF, HOLDINGS, MARKET, REGIME, WEEKLY



@query("prj01_numeric_coercion", fin("id:i v", "SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_totalprice END AS v FROM orders"))
def _(t):
    txt = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return Q.coerce_numbers(t.orders.select(F.col("o_orderkey").alias("id"), txt.alias("v")), ["v"])


@query("prj02_non_finite_to_null", fin("symbol m", f"SELECT symbol, avg(CASE WHEN day(date)%3=0 THEN NULL ELSE close END) AS m FROM {BRAND} GROUP BY symbol"))
def _(t):
    bad = F.when(F.dayofmonth("date") % 6 == 0, F.lit(float("nan"))).when(F.dayofmonth("date") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("close"))
    return Q.nullify(t.brand.withColumn("close", bad), ["close"]).groupBy("symbol").agg(F.avg("close").alias("m"))


@query("prj03_ohlcv_normalisation", fin("date symbol open high low close volume", f"SELECT * FROM {BARS} WHERE day(date)<>13"))
def _(t):
    raw = t.bars.select(F.col("date").cast("timestamp").alias("Date"), "symbol", *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")], F.lit(1).alias("Adj"))
    return P.normalize_bars(raw.withColumn("Close", F.when(F.dayofmonth("Date") != 13, F.col("Close"))))


@query("prj04_duplicate_dates_keep_last", fin("symbol date:t close", f"SELECT symbol, date, close FROM {BRAND}"))
def _(t):
    twice = t.brand.withColumn("seq", F.lit(2)).unionByName(t.brand.withColumns({"seq": F.lit(1), "close": F.lit(-1.0)}))
    return P.keep_last(twice, ["symbol", "date"], "seq").select("symbol", "date", "close")


@query("prj05_wide_and_long", fin("date symbol close", f"SELECT * FROM {ETF}"))
def _(t):
    names = [f"NATION_{i}" for i in range(25)]
    return P.to_long(P.to_wide(t.etf, "close", names), "close")


@query("prj06_alias_columns", fin("date symbol last", f"SELECT date, symbol, coalesce(CASE WHEN day(date)>5 THEN close END, low) AS last FROM {BARS}"))
def _(t):
    d = t.bars.select("date", "symbol", F.when(F.dayofmonth("date") > 5, F.col("close")).alias("close"), "low")
    return Q.fill_from_aliases(d, {"last": ["close", "adj", "low"]}).select("date", "symbol", "last")


@query("prj07_fallback_chain", fin("date symbol p", f"SELECT date, symbol, coalesce(ret_4w, ret_1w, 0.5) AS p FROM {WEEKLY}"))
def _(t):
    return t.weekly.select("date", "symbol", Q.first_present(t.weekly, ["meta_prob", "ret_4w", "ret_1w"], 0.5).alias("p"))


@query("prj08_quality_filter", fin("date symbol", f"""SELECT date, symbol FROM (SELECT *, count(*) OVER (PARTITION BY date, grp) AS n FROM (SELECT w.*, h.k FROM {WEEKLY} w JOIN (SELECT etf, count(DISTINCT component) AS k FROM {HOLDINGS} GROUP BY etf) h ON symbol=etf)
 WHERE date>=DATE '1996-01-01' AND k>=10 AND ret_4w IS NOT NULL) WHERE n>=3"""))
def _(t):
    k = t.holdings.groupBy(F.col("etf").alias("symbol")).agg(F.count_distinct("component").alias("k"))
    return Q.quality_rows(t.weekly.join(k, "symbol"), "ret_4w", "1996-01-01", "k", 10, "grp", 3).select("date", "symbol")


@query("prj09_coverage_filter", fin("symbol n:i", f"SELECT symbol, count(*) AS n FROM {ETF} WHERE symbol IN (SELECT symbol FROM {ETF} WHERE date>=DATE '1997-01-01' GROUP BY symbol HAVING count(*)>=0.6*(SELECT count(DISTINCT date) FROM {ETF} WHERE date>=DATE '1997-01-01')) GROUP BY symbol"))
def _(t):
    return Q.covered(t.etf, "1997-01-01", 0.6).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("prj10_long_lived_universe", fin("symbol first_price_date price_obs:i", f"SELECT symbol, min(date) AS first_price_date, count(*) FILTER (date>=DATE '1998-01-01') AS price_obs FROM {ETF} GROUP BY symbol HAVING min(date)<=DATE '1995-01-08' AND price_obs>=800"))
def _(t):
    return Q.long_lived(t.etf, "1995-01-08", "1998-01-01", 800)


@query("prj11_coverage_profile", fin("symbol rows:i start_date end_date exists:i needs_repair:i".replace("rows:i", "nrows:i").replace("exists:i", "found:i"), f"""SELECT r.symbol, count(close) AS nrows, min(date) AS start_date, max(date) AS end_date, count(close)>0 AS found,
 count(close)<900 OR min(date) IS NULL OR min(date)>DATE '1995-01-01'+INTERVAL 120 DAY AS needs_repair FROM (SELECT n_name AS symbol FROM nation UNION SELECT 'GHOST') r LEFT JOIN {ETF} e ON r.symbol=e.symbol GROUP BY 1"""))
def _(t):
    req = t.nation.select(F.col("n_name").alias("symbol")).union(t.region.select(F.lit("GHOST"))).distinct()
    return Q.coverage(req, t.etf, "1995-01-01", 900).withColumnsRenamed({"rows": "nrows", "exists": "found"})


@query("prj12_valid_feature_dates", fin("date symbol", f"""WITH c AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {ETF}))
 SELECT e.date, symbol FROM {ETF} e JOIN c ON e.date=c.date WHERE pos>=260 AND pos+20<n"""))
def _(t):
    return Q.valid_feature_dates(t.etf, t.market).select("date", "symbol")


PRJ13_SHARE = 0.99


@query("prj13_feature_coverage", fin("name:s share kept:i", f"SELECT *, share>={PRJ13_SHARE} AS kept FROM (SELECT 'ret_1w' AS name, avg((ret_1w IS NOT NULL)::INT) AS share FROM {WEEKLY} UNION ALL SELECT 'ret_4w', avg((ret_4w IS NOT NULL)::INT) FROM {WEEKLY} UNION ALL SELECT 'score', 1.0)"))
def _(t):
    cols = ["ret_1w", "ret_4w", "score"]
    kept = Q.covered_columns(t.weekly, cols, PRJ13_SHARE)
    return Q.column_coverage(t.weekly, cols).withColumn("kept", F.col("name").isin(kept))


@query("prj14_sanitise_cell", fin("event_id:i k", "SELECT event_id, CASE WHEN event_id%4=0 THEN NULL ELSE CAST(json_extract_string(props,'$.k') AS DOUBLE) END AS k FROM events"))
def _(t):
    raw = F.when(F.col("event_id") % 8 == 0, "inf").when(F.col("event_id") % 4 == 0, "NaN").otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", number(raw).alias("k"))


@query("prj15_first_present", fin("symbol v", f"SELECT symbol, coalesce(max(ret_4w) FILTER (regime='NONE'), max(ret_1w) FILTER (regime='BUILDING'), max(score)) AS v FROM {WEEKLY} GROUP BY symbol"))
def _(t):
    pick = lambda c, r: F.max(F.when(F.col("regime") == r, F.col(c)))
    return t.weekly.groupBy("symbol").agg(F.coalesce(pick("ret_4w", "NONE"), pick("ret_1w", "BUILDING"), F.max("score")).alias("v"))


@query("prj16_fund_name_filter", fin("id:i nm:s", "SELECT p_partkey AS id, p_name||CASE WHEN p_partkey%7=0 THEN ' etf' ELSE '' END AS nm FROM part WHERE p_partkey%7<>0 AND NOT regexp_matches(upper(p_name),'^(SMALL|LARGE)')"))
def _(t):
    d = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, " etf").otherwise("")).alias("nm"))
    return d.filter(~X.fund_name("nm", ["SMALL", "LARGE"]))


@query("prj17_cash_name_filter", fin("id:i", "SELECT p_partkey AS id FROM part WHERE p_partkey%5 NOT IN (0,1)"))
def _(t):
    k = F.col("p_partkey") % 5
    d = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(k == 0, " USD Deposit").when(k == 1, " 선물 2412").otherwise("")).alias("nm"))
    return d.filter(~X.cash_or_future("nm")).select("id")


@query("prj18_median_imputation", fin("date symbol r", f"SELECT date, symbol, coalesce(r, median(r) OVER (PARTITION BY date, grp), 0) AS r FROM (SELECT *, CASE WHEN score>50 THEN ret_4w END AS r FROM {WEEKLY})"))
def _(t):
    return Q.impute_median(t.weekly.withColumn("r", F.when(F.col("score") > 50, F.col("ret_4w"))), ["r"], ("date", "grp")).select("date", "symbol", "r")


@query("prj19_expanding_mean_imputation", fin("date c", f"SELECT date, coalesce(c, avg(c) OVER (ORDER BY date), 0) AS c FROM (SELECT date, CASE WHEN day(date)%4<>0 THEN close END AS c FROM {MARKET})"))
def _(t):
    return Q.impute_expanding(t.market.select("date", F.when(F.dayofmonth("date") % 4 != 0, F.col("close")).alias("c")), ["c"])


@query("prj20_feature_selection_by_name", fin("date ret_lag score_z", f"SELECT date, avg(ret_1w) AS ret_lag, avg(score) AS score_z FROM {WEEKLY} GROUP BY date"))
def _(t):
    g = t.weekly.groupBy("date").agg(F.avg("ret_1w").alias("ret_lag"), F.avg("score").alias("score_z"), F.avg("ret_4w").alias("forward_lag"), F.avg("prob").alias("prob"))
    return g.select("date", *Q.feature_columns(g.columns, suffixes=("_lag", "_z")))


@query("prj21_latest_report_rows", fin("date symbol grp score", f"SELECT date, symbol, grp, score FROM {WEEKLY} WHERE date=(SELECT max(date) FROM {WEEKLY}) ORDER BY score DESC, symbol LIMIT 10"))
def _(t):
    return T.latest_batch(t.weekly).select("date", "symbol", "grp", "score").orderBy(F.desc("score"), "symbol").limit(10)


@query("prj22_feature_matrix", fin("date symbol ret_1w ret_4w grp_ASIA:i", f"SELECT date, symbol, coalesce(ret_1w,0) AS ret_1w, coalesce(ret_4w,0) AS ret_4w, (grp='ASIA')::INT AS grp_ASIA FROM {WEEKLY}"))
def _(t):
    from tideframe.operators.learn import feature_matrix
    return feature_matrix(t.weekly, ["ret_1w", "ret_4w"], {"grp": ["ASIA"]}).select("date", "symbol", "ret_1w", "ret_4w", "grp_ASIA")


@query("prj23_from_first_known_regime", fin("date symbol", f"SELECT date, symbol FROM {WEEKLY} WHERE date>=(SELECT min(date) FROM {REGIME})"))
def _(t):
    return Q.from_first_known(t.weekly, t.regime).select("date", "symbol")
