"""Feature sets of the correction and similar-history models, long form (date, driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import ratio


def correction_features(drivers: DataFrame) -> DataFrame:
    """Returns, z-scores, distances to highs and average, volatility of every driver."""
    w = R.by_entity("driver")
    d = drivers.filter(F.col("level") != 0).withColumn("r1", R.step_return("level", 1, w))
    return d.select("date", "driver", *[R.step_return("level", n, w).alias(f"r{n}") for n in (5, 10, 20, 60)],
                    *[R.zscore("level", n, w, R.loose_min_periods(n, 10)).alias(f"z{n}") for n in (60, 252)],
                    (ratio("level", R.high("level", 60, w, 20)) - 1).alias("dh60"), (ratio("level", R.high("level", 120, w, 40)) - 1).alias("dh120"),
                    (ratio("level", R.mean("level", 60, w, 20)) - 1).alias("dm60"), R.std("r1", 20, w, 10).alias("v20"))


def analog_features(drivers: DataFrame) -> DataFrame:
    """Level, 5- and 20-row returns and 60-row z of every driver."""
    w = R.by_entity("driver")
    return drivers.select("date", "driver", "level", R.step_return("level", 5, w).alias("r5"), R.step_return("level", 20, w).alias("r20"),
                          R.zscore("level", 60, w, R.loose_min_periods(60, 10)).alias("z60"))


def cross_terms(features: DataFrame, vector: DataFrame) -> DataFrame:
    """Eleven terms per date that set drivers against each other and against the risk vector.

    ``features``: output of ``correction_features``; ``vector``: date and columns of the risk vector.  A missing
    column counts as 0, a missing value makes the terms that use it null."""
    at = lambda driver, c: F.max(F.when(F.col("driver") == driver, F.col(c))).alias(f"{driver}_{c}")
    used = [("NASDAQ100", "r20"), ("SOX", "r20"), ("SP500", "r20"), ("RUSSELL2000", "r20"), ("HYG_IEF", "r20"), ("NASDAQ100", "r5"), ("VIX", "r5"), ("VIX", "z252"), ("NASDAQ100", "dh60")]
    wide = features.groupBy("date").agg(*[at(d, c) for d, c in used])
    names = ["peak_fragility", "risk_off_score", "analog_history_risk", "fx_external_stress", "liquidity_credit_stress", "rai_appetite_stress", "universe_breadth_stress", "safe_rotation_stress"]
    have = [n for n in names if n in vector.columns]
    d = wide.join(vector.select("date", *have), "date", "left")
    v = lambda n: F.col(n) if n in have else F.lit(0.0)
    nas, sox, sp, small, credit = (F.col(f"{k}_r20") for k in ("NASDAQ100", "SOX", "SP500", "RUSSELL2000", "HYG_IEF"))
    # Weights of the pressure terms.
    return d.select(
        "date", (nas - sox).alias("nasdaq_sox_rs_20d"), (nas - sp).alias("nasdaq_sp500_rs_20d"), (nas - small).alias("nasdaq_russell_rs_20d"), (sox - sp).alias("sox_sp500_rs_20d"),
        (nas - credit).alias("credit_equity_divergence"), (-F.col("VIX_z252") - F.abs("NASDAQ100_dh60")).alias("vol_complacency_reversal"), (v("peak_fragility") - v("risk_off_score")).alias("peak_without_riskoff"),
        (0.5 * v("analog_history_risk") + 0.5 * v("peak_fragility")).alias("analog_peak_combo"),
        (F.greatest(F.col("VIX_r5"), F.when(F.col("VIX_r5").isNotNull(), 0.0)) - F.col("NASDAQ100_r5")).alias("breakdown_acceleration"),
        (0.35 * v("peak_fragility") + 0.25 * v("analog_history_risk") + 0.20 * v("fx_external_stress") + 0.20 * v("liquidity_credit_stress")).alias("late_cycle_pressure"),
        (0.40 * v("rai_appetite_stress") + 0.35 * v("universe_breadth_stress") + 0.25 * v("safe_rotation_stress")).alias("rai_breadth_collapse_pressure"))
