"""Capped greedy allocation as cumulative windows.

Walking the ranked rows and giving each min(row cap, room of its basket, rest of the target)
has a closed form: inside a basket the k-th row can take clip(cap - (k-1) row_cap, 0, row_cap);
the target then cuts the running sum of those amounts.  Only the first ceil(cap / row_cap)
rows of a basket can get weight, so each (date, basket) is limited to them before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col

# Caps of the constrained portfolio.
ROW_CAP = 0.20
RISK_CAP, SAFE_CAP = 0.70, 1.00
RISK_BASKETS = {"국내지수": 0.30, "국내섹터": 0.15, "해외지수": 0.30, "해외섹터": 0.10, "FX및 원자재": 0.20}
SAFE_BASKETS = {"국내채권_종합": 0.50, "국내채권_회사채": 0.30, "해외채권_종합": 0.50, "해외채권_회사채": 0.30, "금리연계형 및 초단기채권": 0.50}
SHORT_RATE = "금리연계형 및 초단기채권"
CASH = "CASH_KRW"


def cap_of(basket: str, caps: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for b, c in caps.items():
        out = F.when(F.col(basket) == b, F.lit(float(c))).otherwise(out)
    return out


def allocate(df: DataFrame, target: str, caps: dict[str, float], order: list[Column], keys=("date",), basket: str = "basket", row_cap: float = ROW_CAP) -> DataFrame:
    """Rows with a positive ``weight``; baskets without a cap get nothing."""
    d = df.withColumn("__cap", cap_of(basket, caps)).filter(F.col("__cap").isNotNull())
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, basket).orderBy(*order)))
    most = max(math.ceil(c / row_cap - 1e-9) for c in caps.values())
    d = d.filter(F.col("__k") <= most)
    part = F.greatest(F.lit(0.0), F.least(F.lit(row_cap), F.col("__cap") - (F.col("__k") - 1) * row_cap))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__part", part)
    w = F.greatest(F.lit(0.0), F.least(F.col("__part"), F.col(target) - F.coalesce(F.sum("__part").over(before), F.lit(0.0))))
    return d.withColumn("weight", w).filter(F.col("weight") > 1e-9).drop("__cap", "__k", "__part")


def park_residual(alloc: DataFrame, order: list[Column], basket_cap: float, parking: str = SHORT_RATE, keys=("date",), basket: str = "basket", row_cap: float = ROW_CAP) -> DataFrame:
    """Unallocated weight topped up on the short-rate rows in rank order, within row and basket caps."""
    day = Window.partitionBy(*keys)
    short = F.col(basket) == parking
    total = F.sum("weight").over(day)
    room = basket_cap - F.sum(F.when(short, F.col("weight")).otherwise(0.0)).over(day)
    fill = F.when(total < 0.999, F.greatest(F.lit(0.0), F.least(1.0 - total, room))).otherwise(0.0)
    d = alloc.withColumns({"__fill": fill, "__gap": F.when(short, F.greatest(F.lit(0.0), row_cap - F.col("weight"))).otherwise(0.0)})
    before = day.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    add = F.greatest(F.lit(0.0), F.least(F.col("__gap"), F.col("__fill") - F.coalesce(F.sum("__gap").over(before), F.lit(0.0))))
    return d.withColumn("weight", F.col("weight") + add).drop("__fill", "__gap")


def cash_rows(alloc: DataFrame, keys=("date",)) -> DataFrame:
    """Dates that cannot be filled get one explicit cash row with the rest."""
    left = alloc.groupBy(*keys).agg((1.0 - F.sum("weight")).alias("weight")).filter(F.col("weight") > 1e-6)
    cash = left.withColumns({"symbol": F.lit(CASH), "basket": F.lit("현금"), "segment": F.lit("cash")})
    return alloc.unionByName(cash, allowMissingColumns=True)


def risk_budget(stage, prob, alert, top: float = RISK_CAP) -> Column:
    """Risk weight of a date by stage, then by probability."""
    s, p = col(stage), col(prob)
    return (F.when(s == "Cash", 0.15).when(s == "De-risk", 0.35).when(s == "Watch", 0.50)
            .when(p >= 0.65, 0.15).when(p >= 0.50, 0.35).when((p >= 0.38) | (col(alert) == 1), 0.50).otherwise(top))


def constraint_report(alloc: DataFrame, risk: dict[str, float] = RISK_BASKETS, safe: dict[str, float] = SAFE_BASKETS, keys=("date",)) -> DataFrame:
    """Totals, largest row and violation flags per date, in one aggregate."""
    s = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(0.0))
    in_risk, in_safe, cash = F.col("basket").isin(list(risk)), F.col("basket").isin(list(safe)), F.col("symbol") == CASH
    caps = list({**risk, **safe}.items())
    g = alloc.groupBy(*keys).agg(
        F.sum("weight").alias("total_weight"), s(in_risk).alias("risk_total"), s(in_safe).alias("safe_total"), s(cash).alias("cash_weight"),
        F.coalesce(F.max(F.when(~cash, F.col("weight"))), F.lit(0.0)).alias("max_single"),
        *[s(F.col("basket") == b).alias(f"__b{i}") for i, (b, _) in enumerate(caps)])
    over = [(F.col(f"__b{i}") > c + 1e-8).cast("int") for i, (_, c) in enumerate(caps)]
    basket_bad = over[0]
    for o in over[1:]:
        basket_bad = basket_bad + o
    return g.withColumns({
        "total_violation": F.abs(F.col("total_weight") - 1) > 1e-8, "single_violation": F.col("max_single") > ROW_CAP + 1e-8,
        "risk_violation": F.col("risk_total") > RISK_CAP + 1e-8, "safe_violation": F.col("safe_total") > SAFE_CAP + 1e-8,
        "basket_violations": basket_bad}).drop(*[f"__b{i}" for i in range(len(caps))])


def allocate_dates(panel: DataFrame) -> DataFrame:
    """Risk and safe sleeves of every date, residual parking and the cash row.

    ``panel``: date, symbol, basket, segment, score, score_pct, risk_off_prob, risk_off_alert, risk_off_stage.
    """
    day = Window.partitionBy("date")
    severity = F.array_position(F.array(*[F.lit(x) for x in ("Normal", "Watch", "De-risk", "Cash")]), F.col("risk_off_stage"))
    stage = F.element_at(F.array(*[F.lit(x) for x in ("Normal", "Watch", "De-risk", "Cash")]), F.greatest(F.lit(1), F.max(severity).over(day)).cast("int"))
    d = panel.withColumns({"__stage": stage, "__prob": F.max("risk_off_prob").over(day), "__alert": F.max("risk_off_alert").over(day)})
    d = d.withColumn("risk_target", F.least(F.lit(RISK_CAP), risk_budget("__stage", "__prob", "__alert")))
    d = d.withColumn("safe_target", F.least(F.lit(SAFE_CAP), 1.0 - F.col("risk_target"))).drop("__stage", "__prob", "__alert")
    order = [F.desc("score_pct"), F.desc("score"), F.asc("symbol")]
    both = allocate(d.filter("segment = 'risk'"), "risk_target", RISK_BASKETS, order).unionByName(
        allocate(d.filter("segment = 'safe'"), "safe_target", SAFE_BASKETS, order))
    return cash_rows(park_residual(both, order, SAFE_BASKETS[SHORT_RATE]))
