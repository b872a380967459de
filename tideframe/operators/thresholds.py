"""Stages and threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col, ratio

# Stages in order of severity.
STAGES = ["Normal", "Watch", "De-risk", "Cash"]


def stage_of(p, watch: float, derisk: float, cash: float) -> Column:
    """Half-open bins [watch, derisk), [derisk, cash), [cash, inf)."""
    p = col(p)
    return F.when(p < watch, STAGES[0]).when(p < derisk, STAGES[1]).when(p < cash, STAGES[2]).when(p.isNotNull(), STAGES[3])


def sweep_rates(s: DataFrame) -> DataFrame:
    """Rates per threshold from a sweep with measures ``n`` and ``tp`` (denominators of at least one)."""
    one = F.lit(1.0)
    n, tp, na, pa = F.col("n"), F.col("tp"), F.col("n_all"), F.col("tp_all")
    fp, fn, tn = n - tp, pa - tp, (na - pa) - (n - tp)
    return s.withColumns({"precision": tp / F.greatest(n, one), "recall": tp / F.greatest(pa, one), "false_positive_rate": fp / F.greatest(fp + tn, one),
                          "false_alarm_among_signals": fp / F.greatest(n, one), "signal_rate": ratio(n, na), "base_rate": ratio(pa, na),
                          "accuracy": ratio(tp + tn, na), "fn": fn})


def best_threshold(s: DataFrame, by: list[str], objective: Column, admissible: Column, default: float) -> DataFrame:
    """Threshold with the largest objective among the admissible ones (the smallest on ties),
    the default when none is admissible."""
    d = s.withColumn("__o", F.when(admissible, F.round(objective, 10)))
    g = d.groupBy(*by) if by else d.groupBy()
    pick = F.max_by(F.when(F.col("__o").isNotNull(), F.col("threshold")), F.when(F.col("__o").isNotNull(), F.struct("__o", (-F.col("threshold")).alias("t"))))
    return g.agg(F.coalesce(pick, F.lit(float(default))).alias("threshold"), F.max("__o").alias("objective"))


def recall_objective() -> tuple[Column, Column]:
    """Objective and admissibility of the recall-weighted choice."""
    lift = F.col("precision") / F.greatest(F.col("base_rate"), F.lit(1e-9))
    obj = 1.7 * F.col("recall") + 0.8 * F.col("precision") + 0.2 * F.least(lift, F.lit(5.0)) - 0.25 * F.col("signal_rate")
    ok = (F.col("n") >= F.greatest(F.lit(10.0), F.floor(F.col("n_all") * 0.03))) & (F.col("signal_rate") <= 0.35)
    return obj, ok


def benchmark_objective() -> Column:
    lift = F.col("precision") / F.greatest(F.col("base_rate"), F.lit(1e-9))
    return 1.9 * F.col("recall") + 0.9 * F.col("precision") + 0.25 * F.least(lift, F.lit(4.0)) - 0.35 * F.col("signal_rate")


def accuracy_threshold(s: DataFrame, by: list[str], target: float, min_share: float = 0.03, floor: float = 10, default: float = 0.5) -> DataFrame:
    """First grid value whose hit rate reaches the target with enough signals; else the best hit
    rate (larger coverage, then smaller threshold on ties); else the default."""
    ok = F.col("n") >= F.greatest(F.lit(float(floor)), F.floor(F.col("n_all") * min_share))
    acc = F.when(ok, F.round(ratio("tp", "n"), 10))
    d = s.withColumn("__a", acc)
    first = F.min(F.when(F.col("__a") >= target, F.col("threshold")))
    best = F.max_by(F.when(F.col("__a").isNotNull(), F.col("threshold")), F.when(F.col("__a").isNotNull(), F.struct("__a", "n", (-F.col("threshold")).alias("t"))))
    g = d.groupBy(*by) if by else d.groupBy()
    return g.agg(F.coalesce(first, best, F.lit(default)).alias("threshold"))


def false_alarm_threshold(s: DataFrame, by: list[str], target: float, default: float = 0.9) -> DataFrame:
    """First grid value whose false-positive rate is at most the target."""
    fpr = (F.col("n") - F.col("tp")) / F.greatest(F.col("n_all") - F.col("tp_all"), F.lit(1.0))
    g = s.withColumn("__f", F.round(fpr, 10))
    g = g.groupBy(*by) if by else g.groupBy()
    return g.agg(F.coalesce(F.min(F.when(F.col("__f") <= target, F.col("threshold"))), F.lit(default)).alias("threshold"))


def loss_sweep(df: DataFrame, score: str, label: str, severity: str, forward: str, grid: list[float], min_gap: int = 15, lookback: int = 20, order: str = "date") -> DataFrame:
    """Sweep of a date-level score with caught loss, opportunity cost and episode recall.

    An episode is caught at a threshold when the largest score of its look-back window reaches
    it, so episode recall for the whole grid is a second sweep over the episode starts alone.
    """
    from tideframe.operators import folds, metrics as M, sweep as SW
    y = F.coalesce(F.col(label), F.lit(0)).cast("double")
    sev, fwd = F.coalesce(F.col(severity), F.lit(0.0)), F.coalesce(F.col(forward), F.lit(0.0))
    s = SW.sweep(df, [], score, grid, {"n": F.lit(1.0), "tp": y, "loss": sev * y, "up": F.greatest(fwd, F.lit(0.0)) * (1 - y)})
    d = M.lookback_max(df, score, rows=lookback, order=order)
    starts = d.join(folds.episode_starts(df, label, min_gap, order=order, by_rows=True).select(order), order, "left_semi")
    e = SW.sweep(starts, [], "window_max", grid, {"hit": F.lit(1.0)}).select("threshold", "hit", "hit_all")
    s = sweep_rates(s.join(e, "threshold", "left"))
    total = F.when(F.col("loss_all") == 0, 1.0).otherwise(F.col("loss_all"))
    return s.withColumns({"event_recall": F.coalesce(ratio("hit", "hit_all"), F.col("recall")), "caught": F.col("loss") / total, "missed": (F.col("loss_all") - F.col("loss")) / total,
                          "cost": F.coalesce(ratio("up", F.col("n") - F.col("tp")), F.lit(0.0))})


def loss_objective(max_alert: float, min_event: float) -> Column:
    c = F.col
    return (5.8 * c("event_recall") + 2.8 * c("caught") + 1.1 * c("recall") + 0.7 * c("precision") - c("false_positive_rate") - 2.2 * c("cost")
            - 4.0 * F.greatest(c("signal_rate") - max_alert, F.lit(0.0)) - 3.0 * F.greatest(min_event - c("event_recall"), F.lit(0.0)) - 2.5 * c("missed"))


def cash_objective(max_alert: float) -> Column:
    c = F.col
    return (2.2 * c("precision") + 2.0 * c("caught") + c("event_recall") - 1.5 * c("false_positive_rate") - 2.0 * c("cost")
            - 5.0 * F.greatest(c("signal_rate") - max_alert, F.lit(0.0)) - 1.2 * c("missed"))


def loss_threshold(s: DataFrame, max_alert: float, min_event: float) -> DataFrame:
    """Best loss-aware threshold within the alert budget, else the best of all."""
    a = best_threshold(s, [], loss_objective(max_alert, min_event), F.col("signal_rate") <= max_alert, float("nan")).select(F.col("threshold").alias("a"))
    b = best_threshold(s, [], loss_objective(max_alert, min_event), F.lit(True), 0.5).select(F.col("threshold").alias("b"))
    return a.join(b).select(F.when(F.isnan("a"), F.col("b")).otherwise(F.col("a")).alias("threshold"))


# Alert budgets and recall floors of the three stages per horizon.
STAGE_LIMITS = {"1w": ((0.72, 0.90), (0.43, 0.78), 0.24), "1m": ((0.78, 0.90), (0.50, 0.82), 0.28)}


def stage_policy(s: DataFrame, cash_sweep: DataFrame, horizon: str) -> DataFrame:
    """watch < derisk (+0.02) < cash (+0.08) thresholds: one row."""
    (wa, we), (da, de), ca = STAGE_LIMITS[horizon]
    w = loss_threshold(s, wa, we).withColumnRenamed("threshold", "watch")
    d = loss_threshold(s, da, de).withColumnRenamed("threshold", "__d")
    c = best_threshold(cash_sweep, [], cash_objective(ca), F.lit(True), 0.5).select(F.col("threshold").alias("__c"))
    p = w.join(d).join(c).withColumn("derisk", F.greatest(F.col("__d"), F.col("watch") + 0.02))
    return p.select("watch", "derisk", F.least(F.greatest(F.col("__c"), F.col("derisk") + 0.08), F.lit(0.95)).alias("cash"))


def expanding_thresholds(df: DataFrame, prob: str, label: str, min_train: int, grid: list[float], target: float = 0.80, default: float = 0.80) -> DataFrame:
    """Per date the threshold learnt from earlier dates only.

    Counts per (date, grid bin) are summed map-side; running totals over the dates and a suffix
    over the bins then give every (date, threshold) at once, with at most |dates| x |grid| rows.
    """
    from tideframe.operators.sweep import reached
    d = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    b = d.groupBy("date", reached(prob, grid).alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("tp"))
    day = b.groupBy("date").agg(F.sum("n").alias("all"), F.collect_list(F.struct("__b", "n", "tp")).alias("p"))
    long = day.select("date", "all", "p", F.posexplode(F.array(*[F.lit(float(x)) for x in grid])).alias("i", "threshold"))
    add = lambda k: F.aggregate(F.filter("p", lambda x: x["__b"] > F.col("i")), F.lit(0).cast("bigint"), lambda s, x: s + x[k])
    w = Window.partitionBy("i").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    t = long.select("date", "i", "threshold", "all", add("n").alias("n"), add("tp").alias("tp"))
    t = t.select("date", "threshold", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("all", "n", "tp")])
    ok = (F.col("all") >= min_train) & (F.col("n") >= F.greatest(F.lit(20), F.floor(F.col("all") * 0.03)))
    t = t.withColumn("__a", F.when(ok, F.round(ratio("tp", "n"), 10)))
    first = F.min(F.when(F.col("__a") >= target, F.col("threshold")))
    best = F.max_by(F.when(F.col("__a").isNotNull(), F.col("threshold")), F.when(F.col("__a").isNotNull(), F.struct("__a", (-F.col("threshold")).alias("t"))))
    return t.groupBy("date").agg(F.coalesce(first, best, F.lit(default)).alias("threshold"))


def train_folds(row, n, min_train: int, step: int, purge: int, embargo: int) -> Column:
    """Folds that train on a row of a date-level series: fold k tests rows from
    min_train + purge + embargo + k step and trains on the rows before min_train + k step."""
    start = min_train + purge + embargo
    last = F.floor((col(n) - 1 - start) / step).cast("int")
    first = F.greatest(F.lit(0), F.floor((col(row) - min_train) / step).cast("int") + 1)
    return F.when((last >= 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def test_fold(row, min_train: int, step: int, purge: int, embargo: int) -> Column:
    """The fold that tests a row, null before the first one."""
    start = min_train + purge + embargo
    return F.when(col(row) >= start, F.floor((col(row) - start) / step).cast("int"))


def walkforward_thresholds(df: DataFrame, scores: list[str], targets: list[str], min_train: int, step: int, purge: int, embargo: int) -> DataFrame:
    """Score x target matrix of thresholds chosen on purged earlier rows and applied to the next
    step, for a date-level table.  Returns date, score_name, target_name, score, target, threshold, signal.

    Each fold has its own grid (51 quantiles of its training scores); training rows are binned
    against it and swept.  A training row is copied once per fold that holds it, so the work
    grows with rows x folds: it is for series of one row per day.
    """
    from tideframe.operators import sweep as SW
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.lit(t).alias("target_name"), F.col(s).cast("double").alias("score"), F.col(t).cast("int").alias("target")) for s in scores for t in targets]))
    long = df.select("date", pairs.alias("p")).select("date", "p.*").filter(F.col("score").isNotNull() & F.col("target").isNotNull())
    key = ["score_name", "target_name"]
    w = Window.partitionBy(*key).orderBy("date")
    long = long.withColumns({"row": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    cut = (min_train, step, purge, embargo)
    train = long.withColumn("fold", F.explode(train_folds("row", "n", *cut)))
    qs = F.array(*[F.lit(0.45 + 0.01 * i) for i in range(51)])
    grids = train.groupBy(*key, "fold").agg(F.array_sort(F.array_distinct(F.percentile("score", qs))).alias("grid"))
    t = train.drop("n").join(grids, [*key, "fold"])
    s = sweep_rates(SW.sweep(t, [*key, "fold"], "score", "grid", {"n": F.lit(1.0), "tp": F.col("target").cast("double")}))
    best = best_threshold(s, [*key, "fold"], benchmark_objective(), F.lit(True), float("inf")).drop("objective")
    test = long.withColumn("fold", test_fold("row", *cut)).filter(F.col("fold").isNotNull())
    out = test.join(best, [*key, "fold"])
    return out.withColumn("signal", (F.col("score") >= F.col("threshold")).cast("int")).drop("row", "n")
