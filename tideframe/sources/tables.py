"""Readers and writers of tables, universes, holdings and result records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideframe.functions.scalar import number
from tideframe.functions.text import asset_symbol
from tideframe.session import checkpoint_root

MARKETS = ["KR", "US"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint root of the session."""
    return f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path, dates: tuple[str, ...] = (), numbers: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """Header CSV as text with named dates and numbers coerced; a BOM in the first header is dropped."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    check_columns(df, required)
    return df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c))) for c in dates if c in df.columns}
                          | {c: number(c) for c in numbers if c in df.columns})


def check_columns(df: DataFrame, required) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_symbol_files(spark: SparkSession, pattern: str, symbol_regex: str = r"([^/]+)\.csv$", date: str = "date", numbers: tuple[str, ...] = ("close",)) -> DataFrame:
    """One CSV per symbol as one long table; the symbol comes from the file path."""
    df = spark.read.option("header", True).csv(pattern)
    return df.select(F.to_date(date).alias("date"), F.regexp_extract(F.col("_metadata.file_path"), symbol_regex, 1).alias("symbol"),
                     *[number(c).alias(c) for c in numbers])


def read_optional(spark: SparkSession, paths: list[str], schema: str, required: bool = False) -> DataFrame:
    """First existing parquet candidate, else an empty frame of the schema or an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            return spark.read.parquet(p)
    if required:
        raise FileNotFoundError(f"none of {paths} exists")
    return spark.createDataFrame([], schema)


def read_series(spark: SparkSession, path: str, series: str, date_headers: tuple[str, ...] = ("DATE", "observation_date")) -> DataFrame:
    """date, driver, level from a two-column file whose date header varies; unreadable rows dropped."""
    df = read_csv(spark, path)
    header = next((h for h in date_headers if h in df.columns), None)
    if header is None:
        raise ValueError(f"no date column among {date_headers}")
    value = next(c for c in df.columns if c != header)
    out = df.select(F.to_date(F.try_to_timestamp(header)).alias("date"), F.lit(series).alias("driver"), number(value).alias("level"))
    return out.filter(F.col("date").isNotNull() & F.col("level").isNotNull())


def write_store(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def read_records(spark: SparkSession, path: str, array: str, available: str, asof) -> DataFrame:
    """List-of-records JSON documents to rows usable at ``asof``."""
    docs = spark.read.json(path)
    rows = docs.select("symbol", F.explode(array).alias("__r")).select("symbol", "__r.*")
    return rows.withColumn(available, F.to_date(available)).filter(F.col(available) <= F.lit(asof).cast("date"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def flatten_record(df: DataFrame, values: str, scores: str, keys: list[str]) -> DataFrame:
    """Map columns of factors as wide ``value_*`` and ``score_*`` columns for a flat sink."""
    return df.select(*[c for c in df.columns if c not in (values, scores)],
                     *[F.col(values)[k].alias(f"value_{k}") for k in keys], *[F.col(scores)[k].alias(f"score_{k}") for k in keys])


def write_results(df: DataFrame, flat_path: str, nested_path: str, values: str, scores: str, keys: list[str]) -> None:
    write_csv(flatten_record(df, values, scores, keys), flat_path)
    df.write.mode("overwrite").json(nested_path)


def availability(specs: DataFrame, series: DataFrame, name: str = "driver") -> DataFrame:
    """Per listed series: available flag, last date, number of points."""
    g = series.groupBy(name).agg(F.max("date").alias("last_date"), F.count("level").alias("points"))
    return specs.join(g, name, "left").withColumns({"points": F.coalesce("points", F.lit(0)), "available": F.coalesce(F.col("points") > 0, F.lit(False))})


def unpack_universe(df: DataFrame, codes: str = "codes", order: str = "row") -> DataFrame:
    """Space-separated codes to one row per symbol; the first occurrence in file order wins."""
    long = df.select("group", "driver_template", order, F.posexplode(F.split(F.trim(codes), r"\s+")).alias("pos", "token"))
    long = long.withColumn("symbol", asset_symbol("token"))
    return long.groupBy("symbol").agg(F.min_by(F.struct("group", "driver_template", "token"), F.struct(order, "pos")).alias("r")).select("symbol", "r.*")


def valid_universe(df: DataFrame) -> DataFrame:
    """Trimmed keys, upper-case market, no blanks or duplicates; an unknown market raises."""
    check_columns(df, ("etf_ticker", "market", "benchmark_ticker"))
    d = df.withColumns({"etf_ticker": F.trim("etf_ticker"), "market": F.upper(F.trim("market")), "benchmark_ticker": F.trim("benchmark_ticker")})
    d = d.filter(F.col("etf_ticker") != "").dropDuplicates(["etf_ticker"])
    bad = F.raise_error(F.concat(F.lit("market must be KR or US: "), F.col("market"))).cast("string")
    return d.withColumn("market", F.when(F.col("market").isin(MARKETS), F.col("market")).otherwise(bad))


def valid_holdings(df: DataFrame) -> DataFrame:
    """Typed (date, etf, component, weight) with 0 < weight <= 1; incomplete rows dropped."""
    d = df.select(F.to_date(F.try_to_timestamp(F.col("date").cast("string"))).alias("date"), F.trim("etf").alias("etf"), F.trim("component").alias("component"),
                  number(F.col("weight").cast("string")).alias("weight"))
    return d.dropna().filter((F.col("weight") > 0) & (F.col("weight") <= 1))


def stacked_universe(lists: list[DataFrame]) -> DataFrame:
    """Union of symbol lists; a symbol belongs to the first list that has it."""
    tagged = [l.withColumn("__p", F.lit(i)) for i, l in enumerate(lists)]
    u = tagged[0]
    for x in tagged[1:]:
        u = u.unionByName(x, allowMissingColumns=True)
    u = u.withColumn("symbol", F.trim("symbol")).filter(F.col("symbol") != "")
    rest = [c for c in u.columns if c not in ("symbol", "__p")]
    return u.groupBy("symbol").agg(F.min_by(F.struct(*rest), F.struct("__p", *rest)).alias("r")).select("symbol", "r.*")


def snapshot(df: DataFrame, asof, date: str = "date") -> DataFrame:
    """Last batch at or before ``asof``."""
    past = df.filter(F.col(date) <= F.lit(asof).cast("date"))
    return past.join(past.agg(F.max(date).alias(date)), date, "left_semi")
