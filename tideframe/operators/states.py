"""Expanding statistics of pooled groups (states, thresholds, regimes).

A state may hold a large share of all rows, so nothing is ordered inside a state.
Rows are first summed per (state, date); the running totals then run over at most one
row per date, and the rows of the current date are added from a window of that date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideframe.functions.scalar import ratio


def prior_state_stats(df: DataFrame, state: str, target: str, entity: str = "symbol", date: str = "date") -> DataFrame:
    """Mean, hit rate and row count of ``target`` over all rows of the same state that sort
    before the current row by (date, entity)."""
    y = F.col(target)
    measures = {"s": F.coalesce(y, F.lit(0.0)), "h": F.when(y > 0, 1.0).otherwise(0.0),
                "n": y.isNotNull().cast("double"), "c": F.lit(1.0)}
    daily = df.groupBy(state, date).agg(*[F.sum(m).alias(f"__d{k}") for k, m in measures.items()])
    run = Window.partitionBy(state).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    before = daily.select(state, date, *[F.coalesce(F.sum(f"__d{k}").over(run), F.lit(0.0)).alias(f"__b{k}") for k in measures])
    today = Window.partitionBy(state, date).orderBy(entity).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(before, [state, date], "left")
    tot = {k: F.col(f"__b{k}") + F.coalesce(F.sum(m).over(today), F.lit(0.0)) for k, m in measures.items()}
    return out.withColumns({
        f"{target}_state_mean_prior": ratio(tot["s"], tot["n"]),
        f"{target}_state_hit_prior": ratio(tot["h"], tot["n"]),
        f"{target}_state_count_prior": tot["c"].cast("long"),
    }).drop(*[f"__b{k}" for k in measures])
