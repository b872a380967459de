"""Panels derived from the driver's star-schema tables.

Prices are ratios of exact integer sums (cents over units), so a rebuilt panel is
identical on every run and on every engine whatever the summation order.  Each
panel is a partial-then-final aggregation of the facts; nothing is sampled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, ratio


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def unit_price() -> Column:
    return F.sum(cents("l_extendedprice")).cast("double") / 100 / F.sum(F.col("l_quantity").cast("long")).cast("double")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def facts(self) -> DataFrame:
        return self.lineitem.withColumn("date", F.to_date("l_shipdate"))

    @cached_property
    def brand(self) -> DataFrame:
        """date, symbol, close — components."""
        j = self.facts.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return j.groupBy("date", F.col("p_brand").alias("symbol")).agg(unit_price().alias("close"))

    @cached_property
    def bars(self) -> DataFrame:
        """date, symbol, open, high, low, close, volume."""
        px = F.col("l_extendedprice") / F.col("l_quantity")
        seq = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
        j = self.facts.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return j.groupBy("date", F.col("p_brand").alias("symbol")).agg(
            F.min_by(px, seq).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
            F.max_by(px, seq).alias("close"), F.sum("l_quantity").cast("long").cast("double").alias("volume"),
        )

    @cached_property
    def etf(self) -> DataFrame:
        """date, symbol (nation), grp (region), close."""
        j = (self.facts.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy("date", "s_nationkey").agg(unit_price().alias("close")))
        return (j.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select("date", F.col("n_name").alias("symbol"), F.col("r_name").alias("grp"), "close"))

    @cached_property
    def market(self) -> DataFrame:
        """date, close — one row per day over all facts."""
        return self.facts.groupBy("date").agg(unit_price().alias("close"))

    @cached_property
    def drivers(self) -> DataFrame:
        """date, driver, level — economic series."""
        j = self.facts.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return j.groupBy("date", F.col("p_type").alias("driver")).agg(unit_price().alias("level"))

    @cached_property
    def regime(self) -> DataFrame:
        """date, regime — the segment with the largest order value of the day."""
        j = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        g = j.groupBy(F.to_date("o_orderdate").alias("date"), "c_mktsegment").agg(F.sum(cents("o_totalprice")).alias("v"))
        return g.groupBy("date").agg(F.max_by("c_mktsegment", F.struct("v", "c_mktsegment")).alias("regime"))

    @cached_property
    def holdings(self) -> DataFrame:
        """date (quarter start), etf, component, weight — share of the previous quarter's revenue."""
        j = (self.facts.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
             .join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
             .join(self.part, F.col("l_partkey") == F.col("p_partkey")))
        q = F.add_months(F.trunc("date", "quarter"), 3)
        g = j.groupBy(q.alias("date"), F.col("n_name").alias("etf"), F.col("p_brand").alias("component")).agg(
            F.sum(cents("l_extendedprice")).alias("v"))
        t = F.sum("v").over(Window.partitionBy("date", "etf"))
        return g.select("date", "etf", "component", (F.col("v").cast("double") / t.cast("double")).alias("weight"))

    @cached_property
    def weekly(self) -> DataFrame:
        """Scored weekly panel: date, symbol, grp, score (1 decimal, ties), prob, ret_1w, ret_4w, regime."""
        w = R.by_entity()
        p = self.etf.select("date", "symbol", "grp", "close", R.step_return("close", 5, w).alias("r5"),
                            R.step_return("close", 20, w).alias("r20"),
                            R.forward_return("close", 5, w).alias("ret_1w"), R.forward_return("close", 20, w).alias("ret_4w"))
        # Week ends come from the facts' dates alone, not from the joined panel.
        wk = F.date_add(F.date_trunc("week", F.date_add("date", 2)).cast("date"), 4)
        days = self.facts.groupBy(wk.alias("wk")).agg(F.max("date").alias("date")).select("date")
        p = p.join(days, "date", "left_semi").filter(F.col("r20").isNotNull())
        d = Window.partitionBy("date")
        z = F.coalesce(ratio(F.col("r20") - F.avg("r20").over(d), F.stddev_samp("r20").over(d)), F.lit(0.0))
        p = p.withColumn("z", F.round(z, 8))
        p = p.select("date", "symbol", "grp", F.round(50 + 18 * F.tanh(F.col("z") / 2), 1).alias("score"),
                     F.round(1 / (1 + F.exp(-(0.4 * F.col("z") + 1.5 * clip("r5", -0.5, 0.5)))), 3).alias("prob"),
                     "ret_1w", "ret_4w")
        return p.join(self.regime, "date", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))

    @cached_property
    def risk(self) -> DataFrame:
        """date, close, score — date-level stress score in 0..100 (2 decimals)."""
        w = Window.partitionBy(F.lit(0)).orderBy("date")
        z = R.zscore("close", 20, w)
        return (self.market.select("date", "close", F.round(clip(50 - 20 * z, 0, 100), 2).alias("score"))
                .filter(F.col("score").isNotNull()))


# The same panels as DuckDB subqueries, for the oracles.
_PX = "CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100/CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)"
_D = "CAST(l_shipdate AS DATE)"
BRAND = f"(SELECT {_D} AS date, p_brand AS symbol, {_PX} AS close FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)"
BARS = f"""(SELECT {_D} AS date, p_brand AS symbol,
 arg_min(l_extendedprice/l_quantity, (l_orderkey,l_linenumber,l_extendedprice)) AS open,
 max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
 arg_max(l_extendedprice/l_quantity, (l_orderkey,l_linenumber,l_extendedprice)) AS close,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
 FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)"""
ETF = f"""(SELECT {_D} AS date, n_name AS symbol, any_value(r_name) AS grp, {_PX} AS close FROM lineitem
 JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2)"""
MARKET = f"(SELECT {_D} AS date, {_PX} AS close FROM lineitem GROUP BY 1)"
DRIVERS = f"(SELECT {_D} AS date, p_type AS driver, {_PX} AS level FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)"
REGIME = """(SELECT date, arg_max(seg, (v, seg)) AS regime FROM (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS seg,
 CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2) GROUP BY 1)"""
HOLDINGS = f"""(SELECT date, etf, component, CAST(v AS DOUBLE)/CAST(sum(v) OVER (PARTITION BY date, etf) AS DOUBLE) AS weight FROM
 (SELECT CAST(date_trunc('quarter', {_D}) AS DATE) + INTERVAL 3 MONTH AS dt, CAST(dt AS DATE) AS date, n_name AS etf, p_brand AS component,
 sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS v FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
 JOIN nation ON s_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey GROUP BY ALL))"""
WEEKDAYS = "CAST(date_trunc('week', {d} + INTERVAL 2 DAY) AS DATE) + INTERVAL 4 DAY"
_W = "OVER (PARTITION BY symbol ORDER BY date)"
WEEKLY = f"""(SELECT q.date, symbol, grp, round(50+18*tanh(z/2),1) AS score,
 round(1/(1+exp(-(0.4*z+1.5*least(0.5,greatest(-0.5,r5))))),3) AS prob, ret_1w, ret_4w, coalesce(regime,'unknown') AS regime FROM
 (SELECT *, round(coalesce((r20-avg(r20) OVER (PARTITION BY date))/nullif(stddev_samp(r20) OVER (PARTITION BY date),0),0),8) AS z FROM
 (SELECT date, symbol, grp, close/lag(close,5) {_W}-1 AS r5, close/lag(close,20) {_W}-1 AS r20,
  lead(close,5) {_W}/close-1 AS ret_1w, lead(close,20) {_W}/close-1 AS ret_4w FROM {ETF})
 WHERE date IN (SELECT max(date) FROM {MARKET} GROUP BY {WEEKDAYS.format(d='date')}) AND r20 IS NOT NULL) q
 LEFT JOIN {REGIME} rg ON q.date=rg.date)"""
RISK = f"""(SELECT * FROM (SELECT date, close, round(least(100,greatest(0,CASE WHEN count(close) OVER f>=20 THEN
 50-20*((close-avg(close) OVER f)/nullif(stddev_samp(close) OVER f,0)) END)),2) AS score, count(close) OVER f AS n FROM {MARKET}
 WINDOW f AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n>=20 AND score IS NOT NULL)"""
