"""Log-periodic bubble fits, one per (symbol, window end), and lagged-regression tests.

A window is one row (an array column), so the fits are independent rows spread over the
cluster by hash; numpy runs inside the tasks on one window at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, ladder

FIT_SCHEMA = "symbol string, asof date, fit int, lppl_a double, lppl_b double, lppl_c double, lppl_tc double, lppl_phi double, lppl_omega double, lppl_beta double, lppl_rmse double, lppl_dtc double"


def _least_squares(y: np.ndarray, tc: np.ndarray, beta: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear coefficients and error of every candidate at once (batched normal equations)."""
    log_tau = np.log(np.maximum(tc[:, None] - np.arange(len(y))[None, :], 1e-6))
    f, ang = np.exp(beta[:, None] * log_tau), omega[:, None] * log_tau
    x = np.stack([np.ones_like(f), f, f * np.cos(ang), f * np.sin(ang)], axis=1)
    scale = np.maximum(np.abs(x).max(axis=2), 1e-12)
    xs = x / scale[:, :, None]
    gram = xs @ xs.transpose(0, 2, 1) + 1e-10 * len(y) * np.eye(4)
    coef = np.linalg.solve(gram, (xs @ y)[:, :, None])[:, :, 0]
    err = np.sqrt(((y - (coef[:, None, :] @ xs)[:, 0, :]) ** 2).mean(axis=1))
    coef = coef / scale
    # A bubble accelerates upwards: a non-negative power coefficient is penalised.
    return coef, err + np.where(coef[:, 1] >= 0, np.abs(coef[:, 1]) + 0.05, 0.0)


def fit_window(prices: np.ndarray, fits: int, population: int, generations: int, seed: int, patience: int = 8) -> list[dict]:
    """The best distinct fits of one window: a population around elites with shrinking spread.  It
    ends when ``patience`` generations in a row have not improved the best error by a ten-thousandth,
    and after ``generations`` at the latest."""
    y, n = np.log(prices), len(prices)
    lo, hi = np.array([n + 1.0, 0.1, 6.0]), np.array([n * 1.8, 1.0, 13.0])
    rng = np.random.default_rng(seed)
    pop = rng.uniform(lo, hi, (population, 3))
    rows = np.zeros((0, 8))
    best, idle = math.inf, 0
    for g in range(generations + 1):
        coef, err = _least_squares(y, *pop.T)
        new = np.column_stack([err, pop, coef])
        rows = np.vstack([rows, new[np.isfinite(new).all(axis=1)]])
        if not len(rows):
            break
        idle = 0 if rows[:, 0].min() < best * (1 - 1e-4) else idle + 1
        best = min(best, rows[:, 0].min())
        # distinct fits only, and no more than are wanted: the archive does not grow with the generations
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        _, first = np.unique(np.round(rows[:, :4], 3), axis=0, return_index=True)
        rows = rows[np.sort(first)[:max(fits, population)]]
        if idle >= patience:
            break
        keep = pop[np.argsort(err)[:max(4, population // 5)]]
        spread = (hi - lo) * 0.15 * max(0.8 ** g, 1e-3)
        pop = np.clip(keep[rng.integers(0, len(keep), population)] + rng.normal(0, 1, (population, 3)) * spread, lo, hi)
    out = []
    for i, (err, tc, beta, omega, a, b, bc, bs) in enumerate(rows[:fits]):
        c = math.hypot(bc, bs) / b if abs(b) > 1e-8 else 0.0
        out.append({"fit": i, "lppl_a": a, "lppl_b": b, "lppl_c": float(np.clip(c, -1, 1)), "lppl_tc": tc, "lppl_phi": math.atan2(-bs, bc) % (2 * math.pi), "lppl_omega": omega,
                    "lppl_beta": beta, "lppl_rmse": err, "lppl_dtc": float(np.clip((n - 1) / tc, 0, 1))})
    return out


def price_windows(prices: DataFrame, n: int, step: int) -> DataFrame:
    """symbol, asof, closes: the last n closes at every ``step``-th row and at the last row."""
    w = R.by_entity()
    d = prices.filter(F.col("close") > 0).withColumns({"closes": F.collect_list("close").over(w.rowsBetween(-(n - 1), 0)), "__p": F.row_number().over(w),
                                                       "__last": F.lead("date").over(w).isNull()})
    return d.filter((F.size("closes") == n) & ((F.col("__p") % step == 0) | F.col("__last"))).select("symbol", F.col("date").alias("asof"), "closes")


def bubble_fits(windows: DataFrame, fits: int = 500, population: int = 200, generations: int = 700) -> DataFrame:
    """Best fits of every window; the seed is the hash of the key, so a lost task refits the same."""
    def run(batches):
        for pdf in batches:
            rows = []
            for s, d, seed, closes in zip(pdf["symbol"], pdf["asof"], pdf["seed"], pdf["closes"]):
                rows += [{"symbol": s, "asof": d, **f} for f in fit_window(np.asarray(closes, float), fits, population, generations, int(seed))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])
    keyed = windows.withColumn("seed", F.pmod(F.xxhash64("symbol", "asof"), F.lit(2**31)))
    # a window is few bytes and much work: a stated number of tasks, which adaptive execution doesn't merge
    spark = windows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return keyed.repartition(tasks, "symbol", "asof").mapInPandas(run, FIT_SCHEMA)


def reliability(rmse, c, beta, omega) -> Column:
    """Closed-form reliability of a fit, used when there are too few labelled fits to learn one."""
    # The coefficients below must match.
    shape = 0.35 + 0.25 * F.least(F.abs(col(c)), F.lit(1.0)) + 0.20 * (1 - F.abs(col(beta) - 0.5)) + 0.20 * (1 - F.least(F.abs(col(omega) - 9.5) / 5.0, F.lit(1.0)))
    return clip(shape * F.exp(-8 * F.greatest(col(rmse) - 0.015, F.lit(0.0))), 0, 1)


def ensemble(fits: DataFrame) -> DataFrame:
    """Per (symbol, asof): 95% quantile, maximum and median of confidence x closeness, and a label."""
    d = fits.withColumn("lppl_reliability", F.coalesce("lppl_reliability", reliability("lppl_rmse", "lppl_c", "lppl_beta", "lppl_omega")) if "lppl_reliability" in fits.columns
                        else reliability("lppl_rmse", "lppl_c", "lppl_beta", "lppl_omega"))
    d = d.withColumn("dtcai", clip(F.col("lppl_dtc") * F.col("lppl_reliability"), 0, 1))
    g = d.groupBy("symbol", "asof").agg(F.percentile("dtcai", 0.95).alias("dtcai_p95"), F.max("dtcai").alias("dtcai_max"), F.median("dtcai").alias("dtcai_median"), F.avg("lppl_reliability").alias("reliability_mean"),
                                        F.count(F.lit(1)).alias("ensemble_size"), F.min_by("lppl_tc", "lppl_rmse").alias("best_tc"))
    x = F.col("dtcai_p95")
    return g.withColumn("label", ladder([(x > 0.6, "crash-alert"), (x >= 0.3, "caution")], "stable"))


def learned_reliability(fits: DataFrame, label: str, min_rows: int = 40, min_positives: int = 3, train_rows: int = 5_000, trees: int = 400, depth: int = 8, hidden: tuple[int, ...] = (64, 32), rounds: int = 700) -> DataFrame:
    """Reliability of every fit from the best of forest, logistic and perceptron models on labelled
    fits (by recall, then precision, then AUC on a held-out hash quarter); the training rows are
    balanced with synthetic ones.  Models are trained and compared on about ``train_rows`` labelled
    fits, drawn by a hash of their keys.  With fewer than ``min_rows`` labelled fits or
    ``min_positives`` positive ones no model can be learnt and the closed form is used; the column
    ``lppl_model`` says which it was."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from tideframe.operators import learn as LE, metrics as M
    from tideframe.session import checkpointed
    cols = ["lppl_a", "lppl_b", "lppl_c", "lppl_tc", "lppl_phi", "lppl_omega", "lppl_beta"]
    closed = fits.withColumns({"lppl_reliability": reliability("lppl_rmse", "lppl_c", "lppl_beta", "lppl_omega"), "lppl_model": F.lit("closed form")})
    labelled = fits.filter(F.col(label).isNotNull())
    n = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p")).first()
    if n["n"] < min_rows or (n["p"] or 0) < min_positives or n["p"] == n["n"]:
        return closed
    drawn = labelled.filter(F.pmod(F.xxhash64("symbol", "asof", "fit", F.lit("draw")), F.lit(1_000_000)) < min(1_000_000, math.ceil(1e6 * train_rows / n["n"])))
    d = checkpointed(LE.assembled(drawn, cols).withColumn("__h", F.pmod(F.xxhash64("symbol", "asof", "fit"), F.lit(4))))
    if d.filter("__h < 3").select(label).distinct().count() < 2:
        return closed
    plain = d.filter("__h < 3").select(label, vector_to_array("features").alias("__v"), "symbol", "asof", "fit")
    made = LE.oversample(plain, label, "__v", ["symbol", "asof", "fit"]).withColumn("features", array_to_vector("__v"))
    train, test = checkpointed(LE.class_weights(made, label)), d.filter("__h = 3")
    mlp = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="__scaled", withMean=True),
                           MultilayerPerceptronClassifier(featuresCol="__scaled", labelCol=label, layers=[len(cols), *hidden, 2], maxIter=rounds, seed=42, probabilityCol="__prob", rawPredictionCol="__raw_prob", predictionCol="__pred_prob")])
    fitted, scores = {}, {}
    for name, est in {"forest": LE.forest(label, trees=trees, depth=depth), "logistic": LE.logistic(label), "perceptron": mlp}.items():
        fitted[name] = est.fit(train)
        p = LE.up_probability(fitted[name].transform(test)).withColumn("__y", F.col("prob") >= 0.5)
        r = M.rates(p.agg(*M.confusion("__y", label))).first()
        scores[name] = (r["recall"] or 0.0, r["precision"] or 0.0, BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol=label).evaluate(p), name)
    name = max(scores.values())[3]
    best = fitted[name]
    return LE.up_probability(best.transform(LE.assembled(fits, cols)), "prob").withColumnRenamed("prob", "lppl_reliability").drop("features").withColumn("lppl_model", F.lit(name))


# --- driver screening ---------------------------------------------------------------------

def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (d * num + 1 if abs(d * num + 1) > tiny else tiny)
        c = num / c + 1 if abs(num / c + 1) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def f_tail(stat: float, dfn: int, dfd: int) -> float:
    """P(F > stat)."""
    return _beta_tail(dfd / 2, dfn / 2, dfd / (dfd + dfn * max(stat, 0.0)))


def lag_test(y: np.ndarray, x: np.ndarray, lags: int) -> float:
    """p-value of adding ``lags`` lags of x to an autoregression of y."""
    n = len(y) - lags
    if n <= 2 * lags + 1:
        return float("nan")
    lag = lambda v: np.column_stack([v[lags - i:len(v) - i] for i in range(1, lags + 1)])
    t = y[lags:]
    small = np.column_stack([np.ones(n), lag(y)])
    big = np.column_stack([small, lag(x)])
    sse = lambda m: float(((t - m @ np.linalg.lstsq(m, t, rcond=None)[0]) ** 2).sum())
    s0, s1 = sse(small), sse(big)
    dfd = n - big.shape[1]
    return f_tail((s0 - s1) / lags / (s1 / dfd), lags, dfd) if s1 > 0 and dfd > 0 else float("nan")


def driver_screen(monthly: DataFrame, max_lag: int = 6, min_rows: int = 48, recent: int = 60) -> DataFrame:
    """Per driver: correlation of target and driver (all and recent months) and the smallest lag-test
    p-value.  ``monthly``: date, driver, value, target - one row per month and driver."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna().sort_values("date")
        out = {"driver": pdf["driver"].iloc[0], "observations": len(d), "corr_full": None, "corr_recent": None, "min_pvalue": None}
        if len(d) >= min_rows:
            y, x = d["target"].to_numpy(float), d["value"].to_numpy(float)
            out["corr_full"] = float(np.corrcoef(y, x)[0, 1])
            out["corr_recent"] = float(np.corrcoef(y[-recent:], x[-recent:])[0, 1]) if len(d) >= recent else None
            out["min_pvalue"] = float(np.nanmin([lag_test(y, x, k) for k in range(1, max_lag + 1)]))
        return pd.DataFrame([out])
    g = monthly.select("date", "driver", "value", "target").groupBy("driver").applyInPandas(run, "driver string, observations int, corr_full double, corr_recent double, min_pvalue double")
    c = F.coalesce("corr_recent", "corr_full")
    return g.withColumn("selected", F.coalesce((F.abs(c) >= 0.20) & (F.col("min_pvalue") <= 0.10), F.lit(False)))
