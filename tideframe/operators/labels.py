"""Forward labels and targets.  A missing forward value counts as 0 (``null_label='zero'``, the
comparison rule of the source jobs) or stays missing (``'null'``, for training)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, ratio, total
from tideframe.operators import xsec as S


def label(*conds: Column, null_label: str = "zero") -> Column:
    """1 when any condition holds."""
    any_true = F.greatest(*[F.coalesce(c, F.lit(False)) for c in conds]) if len(conds) > 1 else F.coalesce(conds[0], F.lit(False))
    if null_label == "zero":
        return any_true.cast("int")
    known = total([c.isNotNull().cast("int") for c in conds]) == len(conds)
    return F.when(any_true | known, any_true.cast("int"))


def drop_labels(ret_1w, ret_1m, min_1m, null_label: str = "zero") -> dict[str, Column]:
    """Drop, correction, delayed-correction and tail labels of one index."""
    w, m, lo = col(ret_1w), col(ret_1m), col(min_1m)
    corr = [m <= -0.035, lo <= -0.055]
    delayed = (w > -0.01) & (F.coalesce(m <= -0.03, F.lit(False)) | F.coalesce(lo <= -0.055, F.lit(False)))
    return {"drop_1w_2pct": label(w <= -0.02, null_label=null_label), "correction_1m": label(*corr, null_label=null_label),
            "delayed_1m": label(delayed, null_label=null_label), "tail_1m": label(m < -0.05, lo < -0.07, null_label=null_label)}


def forward_stats(df: DataFrame, price: str, prefix: str, w, strict: bool = False) -> DataFrame:
    fmin = R.forward_min_strict if strict else R.forward_min_any
    return df.withColumns({f"{prefix}_1w": R.forward_return(price, 5, w), f"{prefix}_1m": R.forward_return(price, 20, w),
                           f"{prefix}_min_1w": fmin(price, 5, w), f"{prefix}_min_1m": fmin(price, 20, w)})


# Thresholds of the practical-loss and rotation labels (1 week, 1 month).
PRACTICAL = {"1w": (-0.020, -0.012, -0.020, -0.015, -0.010, 0.002), "1m": (-0.050, -0.030, -0.040, -0.030, -0.025, 0.006)}


def practical_loss(df: DataFrame, risk: str, safe: str, null_label: str = "zero") -> DataFrame:
    """Loss and rotation labels from forward columns of a risk and a safe basket index."""
    out = df
    for h, (dd, ret, rel, rot, rdd, sret) in PRACTICAL.items():
        r, lo, s = F.col(f"{risk}_{h}"), F.col(f"{risk}_min_{h}"), F.col(f"{safe}_{h}")
        gap = r - s
        rotation = (gap <= rot) & (F.coalesce(lo <= rdd, F.lit(False)) | F.coalesce(s > sret, F.lit(False)))
        out = out.withColumns({f"practical_loss_{h}": label(lo <= dd, r <= ret, gap <= rel, null_label=null_label), f"rotation_{h}": label(rotation, null_label=null_label)})
    return out


def event_labels(df: DataFrame, proxies: list[str], keys: tuple[str, ...] = (), null_label: str = "zero") -> DataFrame:
    """Event-loss labels and severities from forward minima of several proxies (mean and worst)."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    d = df.withColumns({f"__m{h}_{p}": R.forward_min_any(p, h, w) for p in proxies for h in (5, 20, 40)} | {f"__r{h}_{p}": R.forward_return(p, h, w) for p in proxies for h in (5, 20)})
    known = lambda k: total([F.col(f"{k}_{p}").isNotNull().cast("int") for p in proxies])
    mean = lambda k: ratio(total([F.coalesce(F.col(f"{k}_{p}"), F.lit(0.0)) for p in proxies]), known(k))
    worst = lambda k: F.least(*[F.col(f"{k}_{p}") for p in proxies]) if len(proxies) > 1 else F.col(f"{k}_{proxies[0]}")
    d = d.withColumns({f"__a{h}": mean(f"__m{h}") for h in (5, 20, 40)} | {f"__w{h}": worst(f"__m{h}") for h in (5, 20)} | {f"__f{h}": mean(f"__r{h}") for h in (5, 20)})
    c = F.col
    sev = lambda *xs: clip(-F.least(*xs), 0)
    d = d.withColumns({
        "label_event_loss_1w": label(c("__a5") <= -0.025, c("__w5") <= -0.045, c("__f5") <= -0.030, null_label=null_label),
        "label_event_loss_1m": label(c("__a20") <= -0.060, c("__w20") <= -0.095, c("__f20") <= -0.055, c("__a40") <= -0.085, null_label=null_label),
        "severity_1w": sev(c("__a5"), c("__w5"), c("__f5")), "severity_1m": sev(c("__a20"), c("__w20"), c("__f20"), c("__a40"))})
    return d.drop(*[x for x in d.columns if x.startswith("__")])


def entry_label(ret, excess, path_min=None, floor: float = -0.02) -> Column:
    """Positive return and excess (and a path that never falls below the floor)."""
    ok = (col(ret) > 0) & (col(excess) > 0)
    return label(ok & (col(path_min) > floor) if path_min is not None else ok)


def safe_target(df: DataFrame, ret: str, risk: Column, k: float = 0.75, out: str = "target") -> DataFrame:
    """Return less k x its loss less the mean return of risk assets on the date."""
    m = F.avg(F.when(risk, F.col(ret))).over(Window.partitionBy("date"))
    return df.withColumn(out, F.col(ret) - k * F.abs(clip(ret, None, 0)) - m)


def candidate_panel(df: DataFrame, scores: list[str], ks: list[int], ret: str, excess: str, tie: str = "symbol") -> DataFrame:
    """Portfolio statistics and utility per (date, score column, k) with enough names.

    Each score is ranked once; only the rows within the largest k are repeated per k.
    """
    long = df.filter(F.col(ret).isNotNull() & F.col(excess).isNotNull()).select("date", tie, ret, excess, F.explode(F.array(
        *[F.struct(F.lit(s).alias("score_col"), F.col(s).cast("double").alias("score")) for s in scores])).alias("s")).select("date", tie, ret, excess, "s.*").filter(F.col("score").isNotNull())
    uni = long.groupBy("date", "score_col").agg(F.count(F.lit(1)).alias("names"), F.stddev_pop("score").alias("universe_score_std"),
                                                (F.percentile("score", 0.75) - F.percentile("score", 0.25)).alias("universe_score_iqr"))
    w = Window.partitionBy("date", "score_col").orderBy(F.desc("score"), tie)
    top = long.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(ks))
    top = top.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rn") <= F.col("top_k"))
    g = top.groupBy("date", "score_col", "top_k").agg(
        F.avg(ret).alias("portfolio_return"), F.avg(excess).alias("excess_return"), F.max("score").alias("top1_score"), F.avg("score").alias("topk_score_mean"),
        F.min("score").alias("topk_score_min"), F.stddev_pop("score").alias("score_std"), F.count(F.lit(1)).alias("__n"))
    g = g.join(uni, ["date", "score_col"]).filter(F.col("__n") == F.col("top_k")).drop("__n")
    r, e = F.col("portfolio_return"), F.col("excess_return")
    return g.withColumns({"score_spread": F.col("top1_score") - F.col("topk_score_min"), "hit_excess": (e > 0).cast("int"), "hit_positive": (r > 0).cast("int"),
                          "utility": e + 0.35 * r - 0.65 * F.greatest(F.lit(0.0), -r), "entry_label": ((e > 0) & (r > 0)).cast("int")})


def crash_after_peak(close: str, predicted_peak: Column, w, ahead: int = 60, min_rows: int = 30, drop: float = -0.25, tolerance: int = 10) -> Column:
    """1 when the next ``ahead`` rows fall by ``drop`` after their maximum and the predicted peak
    position lies within the tolerance of it."""
    f = F.collect_list(F.col(close)).over(w.rowsBetween(0, ahead))
    peak = F.array_position(f, F.array_max(f)) - 1
    after = F.slice(f, peak.cast("int") + 1, F.size(f))
    hit = (F.array_min(after) / F.array_max(f) - 1 <= drop) & (F.abs(predicted_peak - peak) <= tolerance)
    return F.when(F.size(f) < min_rows, 0).otherwise(hit.cast("int"))


def down_labels(ret_1w, ret_1m) -> dict[str, Column]:
    w, m = col(ret_1w), col(ret_1m)
    return {"down_1w": label(w < 0), **{f"down_1w_{n}pct": label(w < -n / 100) for n in (1, 2, 3, 5)}, **{f"down_1m_{n}pct": label(m < -n / 100) for n in (3, 5)}}
