"""Classification, calibration, ranking and episode metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import clip, col, ladder, ratio, total
from tideframe.operators import asof as A, folds, pooled, sweep as SW, xsec as S


def confusion(pred, actual) -> list[Column]:
    """Aggregates tp, fp, fn, tn."""
    p, y = col(pred).cast("int") == 1, col(actual).cast("int") == 1
    return [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, accuracy and both false-alarm rates from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn),
                           "false_alarm_among_signals": ratio(fp, tp + fp), "false_positive_rate": ratio(fp, fp + tn)})


ECE_EDGES = [i / 10 for i in range(11)]


def calibration(df: DataFrame, by: list[str], prob: str, actual: str, eps: float = 1e-15) -> DataFrame:
    """Brier score, log loss and 10-bin calibration error; two combined aggregates."""
    p, y = F.col(prob), F.col(actual).cast("double")
    q = clip(p, eps, 1 - eps)
    d = df.filter(p.isNotNull() & y.isNotNull()).withColumn("__b", F.least(SW.reached(p, ECE_EDGES), F.lit(10)))
    g = d.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("sb"),
                                  F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("sl"))
    n = F.sum("n")
    return g.groupBy(*by).agg(n.alias("samples"), (F.sum("sb") / n).alias("brier"), (F.sum("sl") / n).alias("log_loss"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece_10bin"))


def reliability_bins(df: DataFrame, prob: str, actual: str, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-count bins by first-come rank: samples, mean prediction, realised rate."""
    r = pooled.row_ranks(df.filter(F.col(actual).isNotNull()), list(by), prob)
    up = (F.col("rank") - 1) * bins
    b = F.greatest(F.lit(0), F.floor((up + F.col("pool") - 2) / (F.col("pool") - 1)) - 1)
    return r.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("samples"), F.avg(prob).alias("mean_pred"), F.avg(F.col(actual).cast("double")).alias("realized_rate"))


def rank_ic(df: DataFrame, score: str, target: str, by: tuple[str, ...] = (), min_names: int = 3) -> DataFrame:
    """Mean over dates of the Spearman correlation of score and target."""
    d = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    k = (*by, "date")
    d = d.withColumns({"__a": S.pct_rank(score, k), "__b": S.pct_rank(target, k)})
    g = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.corr("__a", "__b").alias("ic")).filter(F.col("n") >= min_names)
    g = g.withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))
    return g.groupBy(*by).agg(F.count("ic").alias("dates"), F.avg("ic").alias("rank_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"))


def lookback_max(df: DataFrame, score: str, days: int | None = None, rows: int | None = None, out: str = "window_max", order: str = "date") -> DataFrame:
    """Largest score of the look-back window of each row (calendar days or rows) of a date-level series."""
    if days is not None:
        w = Window.partitionBy(F.lit(0)).orderBy(F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))).rangeBetween(-days, 0)
    else:
        w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-rows, 0)
    return df.withColumn(out, F.max(score).over(w))


def episode_recall(df: DataFrame, label: str, pred: str, min_gap: int, days: int | None = None, rows: int | None = None) -> DataFrame:
    """Share of episode starts with an alert in the look-back window."""
    d = lookback_max(df.withColumn("__p", F.col(pred).cast("int")), "__p", days, rows)
    starts = folds.episode_starts(d, label, min_gap, by_rows=days is None).select("date")
    return d.join(starts, "date", "left_semi").agg(F.count(F.lit(1)).alias("episodes"), F.sum("window_max").alias("detected"), F.avg(F.col("window_max").cast("double")).alias("episode_recall"))


def warning_leads(df: DataFrame, label: str, warning: str, tolerance: int = 20) -> DataFrame:
    """Median days from each event day back to its nearest warning within the tolerance."""
    events = df.filter(F.col(label)).select("date")
    warns = df.filter(F.col(warning)).select("date", F.col("date").alias("warned"))
    j = A.asof_join(events, warns, tolerance_days=tolerance)
    lead = F.datediff("date", "warned")
    return j.agg(F.count(F.lit(1)).alias("events"), F.count("warned").alias("warned_events"), F.median(lead).cast("double").alias("median_lead_days"))


def crash_report(df: DataFrame, label: str, warning: str, score: str, lookback: int) -> DataFrame:
    """Per crash episode: detection, first warning, lead, largest score; plus one summary row.
    Episodes are more than ``lookback`` days apart (measured from the last accepted start)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-lookback, 0)
    d = df.withColumns({"first_warning": F.min(F.when(F.col(warning), F.col("date"))).over(w), "max_score": F.max(score).over(w)})
    starts = folds.episode_starts(df, label, lookback + 1).select("date")
    e = d.join(starts, "date", "left_semi").select(F.lit("episode").alias("row_type"), F.col("date").alias("crash_start_date"), F.col("first_warning").isNotNull().cast("int").alias("detected"),
                                                   F.datediff("date", "first_warning").cast("double").alias("lead_days"), "max_score")
    s = e.agg(F.lit("summary").alias("row_type"), F.lit(None).cast("date").alias("crash_start_date"), F.sum("detected").cast("int").alias("detected"),
              F.median("lead_days").alias("lead_days"), F.avg("max_score").alias("max_score"))
    return s.unionByName(e)


def window_studies(df: DataFrame, windows: DataFrame, score: str, state: str, price: str) -> DataFrame:
    """Per named window (valid_from, valid_to): largest score, worst state, first state dates,
    first-to-last return and maximum drawdown."""
    j = A.interval_join(df, windows, (), closed=True)
    order = F.array(*[F.lit(x) for x in ("Normal", "Watch", "De-risk", "Cash")])
    run = Window.partitionBy("name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__dd", F.col(price) / F.max(price).over(run) - 1)
    first = lambda *states: F.min(F.when(F.col(state).isin(*states), F.col("date")))
    return j.groupBy("name").agg(
        F.max(score).alias("max_score"), F.element_at(order, F.max(F.array_position(order, F.col(state))).cast("int")).alias("max_state"),
        first("Watch", "De-risk", "Cash").alias("first_watch_date"), first("De-risk", "Cash").alias("first_derisk_date"), first("Cash").alias("first_cash_date"),
        (ratio(F.max_by(price, "date"), F.min_by(price, "date")) - 1).alias("window_return"), F.min("__dd").alias("max_drawdown"))


def false_alarm_taxonomy(df: DataFrame, signal: str, actual: str, ret: str, drawdown: str) -> DataFrame:
    """Buckets of signalled rows; the later rule wins over the earlier."""
    d = df.filter((F.col(signal) == 1) & F.col(ret).isNotNull() & F.col(drawdown).isNotNull())
    no = F.col(actual) == 0
    b = ladder([(no & F.col(ret).between(-0.01, 0.01), "sideways"), (no & (F.col(drawdown) <= -0.01), "small_drawdown"), (F.col(actual) == 1, "true_positive")], "bad_false_alarm_up")
    g = d.withColumn("bucket", b).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("avg_return"), F.avg(drawdown).alias("avg_drawdown"))
    return g.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def rule_validation(df: DataFrame, rules: dict[str, Column], targets: dict[str, str]) -> DataFrame:
    """Confusion and rates of every rule against every target, from one pass."""
    d = df.withColumns({f"__{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in rules.items()})
    pairs = [F.struct(F.lit(r).alias("rule"), F.lit(n).alias("target"), F.col(f"__{r}").alias("pred"), F.col(c).cast("int").alias("actual")) for r in rules for n, c in targets.items()]
    long = d.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter(F.col("actual").isNotNull())
    return rates(long.groupBy("rule", "target").agg(F.count(F.lit(1)).alias("samples"), *confusion("pred", "actual")))


def compare_families(df: DataFrame, families: dict[str, list[str]], key: str = "target", name: str = "score", metric: str = "auc") -> DataFrame:
    """Best score of each family per target and the advantage of the first family over the others."""
    aggs = []
    for f, names in families.items():
        inside = F.col(name).isin(names)
        aggs += [F.max(F.when(inside, F.col(metric))).alias(f"{f}_{metric}"), F.max_by(F.when(inside, F.col(name)), F.when(inside, F.col(metric))).alias(f"{f}_{name}")]
    g = df.groupBy(key).agg(*aggs)
    first = next(iter(families))
    return g.withColumns({f"advantage_vs_{f}": F.col(f"{first}_{metric}") - F.col(f"{f}_{metric}") for f in list(families)[1:]})


def grade(sharpe, hit_excess, hit_positive, mdd) -> Column:
    s, e, p, m = (col(c) for c in (sharpe, hit_excess, hit_positive, mdd))
    return ladder([((s >= 3.0) & (e >= 0.70) & (m >= -0.12), "A+"), ((s >= 2.0) & ((e >= 0.65) | (p >= 0.75)) & (m >= -0.18), "A"),
                   ((s >= 1.4) & ((e >= 0.55) | (p >= 0.65)), "B+"), ((s >= 0.8) & ((e >= 0.50) | (p >= 0.58)), "B")], "C")


def direction_diagnostics(df: DataFrame, horizons: dict[str, tuple[str, str]], cut: float = 0.5) -> DataFrame:
    """Per horizon (probability, return): accuracy, predicted and actual up shares, two error counts."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(p) >= cut).alias("up"), (F.col(r) > 0).alias("real")) for h, (p, r) in horizons.items()])).alias("x")).select("x.*")
    d = long.filter(F.col("up").isNotNull() & F.col("real").isNotNull())
    m = lambda c: F.avg(c.cast("double"))
    return d.groupBy("horizon").agg(F.count(F.lit(1)).alias("samples"), m(F.col("up") == F.col("real")).alias("accuracy"), m(F.col("up")).alias("pred_up"), m(F.col("real")).alias("actual_up"),
                                    F.count_if(F.col("up") & ~F.col("real")).alias("false_up"), F.count_if(~F.col("up") & F.col("real")).alias("missed_up"))


def phase_table(df: DataFrame, phases: list[str], metrics: list[str], key: str = "strategy", phase: str = "phase") -> DataFrame:
    """Metrics of each phase side by side with a reason text."""
    g = df.groupBy(key).agg(*[F.max(F.when(F.col(phase) == p, F.col(m))).alias(f"{p}_{m}") for p in phases for m in metrics])
    a, b = (F.col(f"{p}_{metrics[0]}") for p in phases[:2])
    why = F.concat_ws("; ", F.when(a < b, f"{phases[0]} weaker than {phases[1]}"), F.when(a >= b, f"{phases[0]} at least {phases[1]}"), F.when(a < 0, f"{phases[0]} negative"))
    return g.withColumn("diagnosis", why)


def comparison_table(tables: list[DataFrame], keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per model and horizon with averaged metrics over stacked result tables."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    return u.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
