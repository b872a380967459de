"""2.1 Sources and sinks, and the derived panels themselves."""

from pyspark.sql import functions as F

from tideframe.catalog import fin, query
from tideframe.operators import joins as J
from tideframe.plans import fixtures as X
from tideframe.plans.fixtures import BRAND, DRIVERS, ETF, HOLDINGS, MARKET, WEEKLY
from tideframe.sources import tables as S

for _n, _c in {"brand": "date symbol close", "bars": "date symbol open high low close volume", "etf": "date symbol grp close",
               "drivers": "date driver:s level", "regime": "date regime:s", "holdings": "date etf:s component:s weight",
               "weekly": "date symbol grp score prob ret_1w ret_4w regime:s", "risk": "date close score"}.items():
    query(f"fixture_{_n}", fin(_c, f"FROM {getattr(X, _n.upper())}"))(lambda t, n=_n: getattr(t, n))


@query("src01_csv_scan", fin("date symbol close", f"FROM {BRAND}"))
def _(t):
    p = S.scratch(t.spark, "csv")
    S.write_csv(t.brand, p)
    return S.read_csv(t.spark, p, dates=("date",), numbers=("close",), required=("date", "symbol", "close"))


@query("src02_symbol_files_scan", fin("date symbol close", f"FROM {BRAND}"))
def _(t):
    p = S.scratch(t.spark, "symbols")
    t.brand.repartition("symbol").write.partitionBy("symbol").option("header", True).csv(p)
    return S.read_symbol_files(t.spark, f"{p}/*/*.csv", r"symbol=([^/]+)/").withColumn("symbol", F.url_decode(F.url_decode("symbol")))


@query("src03_optional_source", fin("date symbol close", f"FROM {ETF} WHERE close>0"))
def _(t):
    p = S.scratch(t.spark, "optional")
    S.write_store(t.etf, p)
    return S.read_optional(t.spark, [p + "-absent", p], "date date, symbol string, close double").select("date", "symbol", "close")


@query("src04_series_scan", fin("date driver:s level", f"SELECT date, 'MKT' AS driver, close AS level FROM {MARKET} WHERE close<1500"))
def _(t):
    p = S.scratch(t.spark, "series")
    S.write_csv(t.market.select(F.col("date").alias("observation_date"), F.when(F.col("close") < 1500, F.col("close").cast("string")).otherwise(".").alias("MKT")), p)
    return S.read_series(t.spark, p, "MKT")


@query("src05_parquet_store", fin("date role:s symbol close", f"SELECT date, 'etf' AS role, symbol, close FROM {ETF} UNION ALL SELECT date, 'component', symbol, close FROM {BRAND}"))
def _(t):
    p = S.scratch(t.spark, "store")
    d = t.etf.select("date", F.lit("etf").alias("role"), "symbol", "close").unionByName(t.brand.select("date", F.lit("component").alias("role"), "symbol", "close"))
    S.write_store(d, p, "role")
    return t.spark.read.parquet(p).select("date", "role", "symbol", "close")


@query("src06_json_documents", fin("symbol available:t weight", f"SELECT etf AS symbol, date AS available, weight FROM {HOLDINGS} WHERE date<=DATE '1998-12-31'"))
def _(t):
    p = S.scratch(t.spark, "json")
    docs = t.holdings.groupBy(F.col("etf").alias("symbol"), F.year("date").alias("y")).agg(F.collect_list(F.struct(F.col("date").cast("string").alias("available"), "weight")).alias("list"))
    docs.write.json(p)
    return S.read_records(t.spark, p, "list", "available", "1998-12-31").select("symbol", "available", "weight")


@query("src07_csv_sink", fin("date n:i", f"SELECT date, count(*) AS n FROM {WEEKLY} GROUP BY date"))
def _(t):
    p = S.scratch(t.spark, "sink")
    S.write_csv(t.weekly, p)
    return S.read_csv(t.spark, p, dates=("date",)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("src08_flat_and_nested_sink", fin("symbol value_hi value_lo score_hi nested_hi", f"SELECT symbol, max(close) AS value_hi, min(close) AS value_lo, max(close)/1000 AS score_hi, max(close) AS nested_hi FROM {BRAND} GROUP BY symbol"))
def _(t):
    p = S.scratch(t.spark, "records")
    g = t.brand.groupBy("symbol").agg(F.max("close").alias("hi"), F.min("close").alias("lo"))
    rec = g.select("symbol", F.create_map(F.lit("hi"), "hi", F.lit("lo"), "lo").alias("values"), F.create_map(F.lit("hi"), F.col("hi") / 1000).alias("scores"))
    S.write_results(rec, p + "/flat", p + "/nested", "values", "scores", ["hi", "lo"])
    flat = S.read_csv(t.spark, p + "/flat", numbers=("value_hi", "value_lo", "score_hi")).select("symbol", "value_hi", "value_lo", "score_hi")
    return flat.join(t.spark.read.json(p + "/nested").select("symbol", F.col("values.hi").alias("nested_hi")), "symbol")


@query("src09_incremental_load", fin("date etf:s component:s weight", f"SELECT * FROM {HOLDINGS} WHERE etf<'NATION_2' OR etf>='NATION_2'"))
def _(t):
    stored = t.holdings.filter("etf < 'NATION_2'")
    return J.append_missing(stored, t.holdings, "etf")


@query("src10_merge_old_and_new", fin("date symbol close volume", f"""SELECT coalesce(n.date,o.date) AS date, coalesce(n.symbol,o.symbol) AS symbol, coalesce(n.close,o.close) AS close, n.volume FROM
 (SELECT date, symbol, CASE WHEN day(date)<>1 THEN close*2 END AS close, volume FROM {X.BARS} WHERE date>=DATE '1998-01-01') n
 FULL JOIN (SELECT * FROM {BRAND} WHERE date<DATE '1999-01-01') o ON n.date=o.date AND n.symbol=o.symbol"""))
def _(t):
    new = t.bars.filter("date >= date'1998-01-01'").select("date", "symbol", F.when(F.dayofmonth("date") != 1, F.col("close") * 2).alias("close"), "volume")
    return J.merge_tables(t.brand.filter("date < date'1999-01-01'"), new, ["date", "symbol"])


@query("src11_two_feeds_one_series", fin("date driver:s level feed:i", f"""SELECT coalesce(a.date,b.date) AS date, coalesce(a.driver,b.driver) AS driver, coalesce(a.level,b.level) AS level, CASE WHEN a.level IS NOT NULL THEN 0 ELSE 1 END AS feed FROM
 (SELECT * FROM {DRIVERS} WHERE date>=DATE '1997-01-01' AND day(date)%3<>0) a FULL JOIN (SELECT date, driver, level*1.5 AS level FROM {DRIVERS} WHERE date<DATE '2000-01-01') b ON a.date=b.date AND a.driver=b.driver"""))
def _(t):
    a = t.drivers.filter("date >= date'1997-01-01' and day(date) % 3 <> 0").withColumn("feed", F.lit(0))
    b = t.drivers.filter("date < date'2000-01-01'").withColumns({"level": F.col("level") * 1.5, "feed": F.lit(1)})
    return J.lead_source(a.unionByName(b), ["date", "driver"], "feed", "level").select("date", "driver", "level", "feed")


@query("src12_availability_report", fin("driver:s last_date points:i available:i", f"""SELECT s.driver, max(date) AS last_date, count(level) AS points, count(level)>0 AS available FROM
 (SELECT DISTINCT p_type AS driver FROM part UNION SELECT 'ABSENT') s LEFT JOIN {DRIVERS} d ON s.driver=d.driver GROUP BY 1"""))
def _(t):
    specs = t.part.select(F.col("p_type").alias("driver")).union(t.region.select(F.lit("ABSENT"))).distinct()
    return S.availability(specs, t.drivers)


@query("src13_packed_codes_universe", fin("symbol group_name:s", f"""SELECT symbol, arg_min(p_type, p_type) AS group_name FROM
 (SELECT p_type, CASE WHEN contains(c,'.') THEN c ELSE c||'.KS' END AS symbol FROM (SELECT p_type, regexp_replace(upper(replace(p_brand,'#','')),'^A','') AS c FROM part)) GROUP BY symbol"""))
def _(t):
    packed = t.part.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set(F.regexp_replace("p_brand", "#", ""))), " ").alias("codes"))
    packed = packed.select(F.col("p_type").alias("group"), F.lit("us_equity").alias("driver_template"), "codes", F.col("p_type").alias("row"))
    return S.unpack_universe(packed).select("symbol", F.col("group").alias("group_name"))


@query("src14_universe_validation", fin("etf_ticker:s market:s benchmark_ticker:s", "SELECT n_name AS etf_ticker, CASE WHEN n_regionkey=2 THEN 'KR' ELSE 'US' END AS market, r_name AS benchmark_ticker FROM nation JOIN region ON n_regionkey=r_regionkey"))
def _(t):
    u = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    u = u.select(F.concat(F.lit("  "), "n_name").alias("etf_ticker"), F.when(F.col("n_regionkey") == 2, " kr").otherwise("us ").alias("market"), F.col("r_name").alias("benchmark_ticker"))
    return S.valid_universe(u.union(u).union(u.select(F.lit(" "), "market", "benchmark_ticker")))


@query("src15_holdings_validation", fin("date etf:s component:s weight", f"SELECT * FROM {HOLDINGS} WHERE weight<=1 AND component<>'Brand#7'"))
def _(t):
    return S.valid_holdings(t.holdings.withColumn("weight", F.when(F.col("component") == "Brand#7", "n/a").otherwise(F.col("weight").cast("string"))))


@query("src16_stacked_universe", fin("symbol source:s", "SELECT symbol, CASE WHEN symbol IN (SELECT n_name FROM nation WHERE n_regionkey<2) THEN 'first' ELSE 'second' END AS source FROM (SELECT DISTINCT n_name AS symbol FROM nation)"))
def _(t):
    a = t.nation.filter("n_regionkey < 2").select(F.col("n_name").alias("symbol"), F.lit("first").alias("source"))
    return S.stacked_universe([a, t.nation.select(F.col("n_name").alias("symbol"), F.lit("second").alias("source"))])


@query("src17_asof_snapshot", fin("date symbol score", f"SELECT * FROM {WEEKLY} WHERE date=(SELECT max(date) FROM {WEEKLY} WHERE date<=DATE '1999-06-30')"))
def _(t):
    return S.snapshot(t.weekly, "1999-06-30").select("date", "symbol", "score")
