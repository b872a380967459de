"""Equi-joins, lookups with fallback, merges of old and new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col


def join_panels(left: DataFrame, right: DataFrame, on: list[str], suffix: str, how: str = "left") -> DataFrame:
    """Equi-join in which columns present on both sides get ``suffix`` on the right.

    No hint is given: Spark broadcasts a side only when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise."""
    taken = set(left.columns) - set(on)
    return left.join(right.select(*on, *[F.col(c).alias(c + suffix if c in taken else c) for c in right.columns if c not in on]), on, how)


def merge_tables(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of keys and columns; new values win, old values fill the gaps."""
    cols = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o = old.select(*keys, F.struct(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in cols]).alias("__o"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in cols]).alias("__n"))
    return o.join(n, keys, "full").select(*keys, *[F.coalesce(F.col(f"__n.{c}"), F.col(f"__o.{c}")).alias(c) for c in cols])


def append_missing(stored: DataFrame, incoming: DataFrame, done_key: str) -> DataFrame:
    """Stored rows plus incoming rows whose key is not stored yet, without exact duplicates."""
    fresh = incoming.join(stored.select(done_key).distinct(), done_key, "left_anti")
    return stored.unionByName(fresh).dropDuplicates()


def lead_source(sources: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """One value per key from several feeds: the best-ranked feed that has one."""
    return (sources.filter(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank)))


def lookup_ladder(df: DataFrame, table: DataFrame, levels: list[tuple[str, str | None]], value: str, default: float,
                  segment_type: str = "segment_type", segment: str = "segment", extra: tuple[str, ...] = ()) -> Column | DataFrame:
    """Value of the first level with an entry: levels are (segment type, column of df or None for ALL)."""
    out = df
    for i, (kind, c) in enumerate(levels):
        part = table.filter(F.col(segment_type) == kind).select(*extra, F.col(segment).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.withColumn(f"__k{i}", F.col(c).cast("string") if c else F.lit("__ALL__")).join(part, [*extra, f"__k{i}"], "left")
    found = F.coalesce(*[F.col(f"__v{i}") for i in range(len(levels))], F.lit(default))
    return out.withColumn(value, found).drop(*[f"__{k}{i}" for i in range(len(levels)) for k in "kv"])


def map_names(df: DataFrame, maps: list[DataFrame], name: str, code: str = "code") -> DataFrame:
    """Name to code by the first map that knows it (each map: name, code); unknown names are dropped."""
    out = df
    for i, m in enumerate(maps):
        out = out.join(m.select(F.col(name), F.col(code).alias(f"__c{i}")), name, "left")
    return out.withColumn(code, F.coalesce(*[f"__c{i}" for i in range(len(maps))])).drop(*[f"__c{i}" for i in range(len(maps))]).filter(
        F.col(code).isNotNull() & (F.col(code) != ""))


def substitute_proxy(rows: DataFrame, unresolved: DataFrame, prices: DataFrame, component: str = "component", fund: str = "etf") -> DataFrame:
    """Component prices per (row, date); unresolved components use the prices of their fund.

    The price key is chosen first, so one equi-join on (key, date source) serves both cases."""
    flagged = rows.join(unresolved.select(F.col(component)).distinct().withColumn("__u", F.lit(True)), component, "left")
    key = F.when(F.col("__u"), F.col(fund)).otherwise(F.col(component))
    return flagged.withColumns({"symbol": key, "proxied": F.coalesce("__u", F.lit(False))}).drop("__u").join(prices, "symbol")


def aligned(series: DataFrame, benchmarks: DataFrame, by: str, value: str, benchmark: str, date: str = "date", entity: str = "symbol") -> DataFrame:
    """Each entity and its benchmark on the dates on which both have a value, with their ratio since the first
    such date (``rs``) and the number of such dates (``shared``)."""
    d = series.where(F.col(value).isNotNull()).join(benchmarks.where(F.col(benchmark).isNotNull()), [date, by])
    w = Window.partitionBy(entity)
    since = lambda c: F.col(c) / F.first(c).over(w.orderBy(date))
    return d.withColumns({"rs": since(value) / since(benchmark), "shared": F.count(F.lit(1)).over(w)})
