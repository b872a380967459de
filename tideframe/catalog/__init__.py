"""Registered queries: each survey operator run over the driver's tables.

A registration pairs a Spark query with the equivalent DuckDB SQL where the operator
is SQL-expressible.  ``tidy`` and ``fin`` give both sides one output convention:
doubles rounded to 6 places (half up by floor, equal bit for bit on both engines), integers as BIGINT, dates and booleans as text / 0-1.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

MODULES = [
    "sources", "cleaning", "joins", "aggregates", "rolling", "xsec", "topk", "sets", "scalars",
    "folds", "factors", "composites", "labels", "analogs", "learning", "metrics", "periods",
]


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""
    def wrap(fn):
        from tideframe.plans.fixtures import Tables
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(lambda spark, sf_dir: tidy(fn(Tables(spark, sf_dir))), sql)
        return fn
    return wrap


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.floor(c.cast("double") * 10.0**digits + 0.5) / 10.0**digits
        elif kind in ("int", "bigint", "smallint", "tinyint", "boolean"):
            c = c.cast("int").cast("bigint") if kind == "boolean" else c.cast("bigint")
        elif kind in ("date", "timestamp"):
            c = c.cast("date").cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def fin(cols: str, body: str, digits: int = 6) -> str:
    """Final projection of an oracle: names with an optional type, double by default.

    ``date`` and ``*_date`` are dates; ``:s`` text, ``:i`` integer or boolean, ``:t`` date.
    """
    out = []
    for item in cols.split():
        name, _, kind = item.partition(":")
        if not kind:
            kind = "t" if name == "date" or name.endswith("_date") else "s" if name in ("symbol", "grp") else "d"
        out.append({
            "t": f"CAST(CAST({name} AS DATE) AS VARCHAR)",
            "s": name,
            "i": f"CAST({name} AS BIGINT)",
            "d": f"floor(CAST({name} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}",
        }[kind] + f" AS {name}")
    return f"SELECT {', '.join(out)} FROM ({body})"


def load() -> dict[str, Entry]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
