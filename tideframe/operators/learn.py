"""Feature matrices and learning steps, on MLlib and on the passes of ``trees``, ``folds_fit`` and ``isotone``."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import clip, ratio
from tideframe.operators import folds_fit, pooled, trees
from tideframe.session import checkpointed


def one_hot(df: DataFrame, name: str, levels: list[str]) -> DataFrame:
    """0/1 columns for the levels known at training time; other values give all zeros."""
    return df.withColumns({f"{name}_{v.replace(' ', '_')}": F.coalesce(F.col(name) == v, F.lit(False)).cast("int") for v in levels})


def interactions(df: DataFrame, flags: list[str], axes: list[str]) -> DataFrame:
    return df.withColumns({f"{f}_x_{a}": F.col(f) * F.coalesce(F.col(a), F.lit(0.0)) for f in flags for a in axes})


def feature_matrix(df: DataFrame, numeric: list[str], dummies: dict[str, list[str]] | None = None) -> DataFrame:
    """Numeric features with null as 0 and the dummy columns of training time."""
    out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric})
    for name, levels in (dummies or {}).items():
        out = one_hot(out, name, levels)
    return out


# --- splits and folds -------------------------------------------------------------------

def time_split(df: DataFrame, train_end, valid_end, date: str = "date") -> DataFrame:
    """split = train (date <= a) / valid (a < date <= b) / test."""
    d, a, b = F.col(date), F.lit(train_end).cast("date"), F.lit(valid_end).cast("date")
    return df.withColumn("split", F.when(d <= a, "train").when(d <= b, "valid").otherwise("test"))


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 n_class) per row, from one aggregate joined back."""
    n = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("double")).alias("__p"))
    w = F.when(F.col(label) == 1, F.col("__n") / (2 * F.greatest(F.col("__p"), F.lit(1.0)))).otherwise(F.col("__n") / (2 * F.greatest(F.col("__n") - F.col("__p"), F.lit(1.0))))
    return df.join(n).withColumn(out, w).drop("__n", "__p")


def logistic(label: str, features: str = "features", reg: float = 0.01, mix: float = 0.0, weight: str | None = "weight", prob: str = "prob") -> Pipeline:
    """Scaled, optionally class-balanced logistic model (L2, or elastic net with ``mix``)."""
    kw = {"weightCol": weight} if weight else {}
    scale = StandardScaler(inputCol=features, outputCol="__scaled", withMean=True)
    return Pipeline(stages=[scale, LogisticRegression(featuresCol="__scaled", labelCol=label, regParam=reg, elasticNetParam=mix, maxIter=50, probabilityCol=f"__{prob}", rawPredictionCol=f"__raw_{prob}", predictionCol=f"__pred_{prob}", **kw)])


def forest(label: str, features: str = "features", trees: int = 60, depth: int = 5, weight: str | None = "weight", seed: int = 42, prob: str = "prob") -> RandomForestClassifier:
    kw = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol=f"__{prob}", rawPredictionCol=f"__raw_{prob}", predictionCol=f"__pred_{prob}", **kw)


def histogram_boosted(train: DataFrame, features: list[str], label: str, rounds: int = 180, rate: float = 0.035, leaves: int = 9, min_rows: int = 35, l2: float = 0.6) -> trees.Ensemble:
    """Boosted classification trees on binned features, missing ones apart."""
    bins = trees.quantile_bins(train, features)
    return trees.boost(trees.chunks(train, bins, F.col(label)), bins, trees.Logistic(), rounds, rate, trees.Shape(leaves=leaves, min_rows=min_rows, l2=l2))


def gradient_boosted(train: DataFrame, features: list[str], label: str, rounds: int, regression: bool = False, rate: float = 0.035, depth: int = 2) -> trees.Ensemble:
    """Boosted trees of a fixed depth, without a penalty."""
    bins = trees.quantile_bins(train, features)
    objective = trees.Squared() if regression else trees.Logistic()
    return trees.boost(trees.chunks(train, bins, F.col(label)), bins, objective, rounds, rate, trees.Shape(leaves=2**depth, depth=depth, min_rows=1, l2=0.0))


def extra_trees(train: DataFrame, features: list[str], label: str, count: int = 18, depth: int = 5, min_rows: int = 32, seed: int = 42) -> trees.Forest:
    bins = trees.quantile_bins(train, features)
    return trees.extra_trees(trees.chunks(train, bins, F.col(label)), bins, count, depth, min_rows, seed=seed)


def up_probability(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Probability of the positive class as a plain column, helper columns dropped."""
    d = df.withColumn(prob, vector_to_array(F.col(f"__{prob}"))[1])
    return d.drop(f"__{prob}", f"__raw_{prob}", f"__pred_{prob}", "__scaled")


def ensemble_probability(train: DataFrame, test: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean of logistic, forest, extra-tree and histogram-boosted probabilities."""
    known = checkpointed(train.filter(F.col(label).isNotNull()))
    tr = class_weights(assembled(known, features), label).persist()
    out = assembled(test, features)
    for name, est in {"p_log": logistic(label, prob="p_log"), "p_rf": forest(label, prob="p_rf")}.items():
        out = up_probability(est.fit(tr).transform(out), name)
    tr.unpersist()
    out = out.withColumns({"p_et": extra_trees(known, features, label).probability(), "p_hgb": histogram_boosted(known, features, label).probability()})
    return out.withColumn("prob", (F.col("p_log") + F.col("p_rf") + F.col("p_et") + F.col("p_hgb")) / 4).drop("features")


def fold_rows(df: DataFrame, folds: list[tuple], order: str = "row") -> DataFrame:
    """Rows once for every fold that tests them, with the fold's number."""
    spans = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).alias("a"), F.lit(z).alias("z")) for i, (_, a, z) in enumerate(folds)])
    hits = F.filter(spans, lambda s: (s["a"] <= F.col(order)) & (F.col(order) < s["z"]))
    return df.withColumn("fold", F.explode(F.transform(hits, lambda s: s["fold"])))


def walk_forward(df: DataFrame, features: list[str], label: str, folds: list[tuple], keep: list[str], order: str = "row", models: tuple[str, ...] = ("logistic",), c: float = 0.45, count: int = 18, depth: int = 5, min_rows: int = 32) -> DataFrame:
    """Out-of-sample probabilities: for each (train_to, test_from, test_to) models of the rows with order <
    train_to are applied to [test_from, test_to), and their mean is taken.  Order is a number.

    All folds are fitted together (``folds_fit``, ``trees.extra_trees``): passes over the data, not folds, are what a
    longer walk costs."""
    base = checkpointed(df.select(*dict.fromkeys([*keep, label, order, *features])))
    if not folds:
        return base.limit(0).select(*keep, label, F.lit(0).alias("fold"), F.lit(0.0).alias("prob"))
    limits, parts = [float(f[0]) for f in folds], []
    test = fold_rows(base, folds, order)
    if "logistic" in models:
        parts.append(folds_fit.fit_folds(folds_fit.row_blocks(base, features, F.col(label), F.col(order)), features, limits, c).probability(F.col("fold")))
    if "extra" in models:
        filled = base.withColumns({f: F.coalesce(trees.finite(f), F.lit(0.0)) for f in features})
        bins = trees.quantile_bins(filled, features)
        forest_ = trees.extra_trees(trees.chunks(filled, bins, F.col(label), order=F.col(order)), bins, count, depth, min_rows, limits=limits)
        test = test.withColumns({f: F.coalesce(trees.finite(f), F.lit(0.0)) for f in features})
        parts.append(forest_.probability(F.col("fold")))
    out = test.select(*keep, label, "fold", (sum(parts[1:], parts[0]) / len(parts)).alias("prob"))
    return out.where(~F.isnan("prob"))


def month_folds(first: int, last: int, train_months: int = 24, purge: int = 1) -> list[tuple[int, int, int]]:
    """Folds that test every month (yyyyMM) from ``first`` to ``last`` after the first ``train_months``
    and the purged ones: (train_to, test_from, test_to)."""
    month = lambda k: k // 12 * 100 + k % 12 + 1
    a, z = (m // 100 * 12 + m % 100 - 1 for m in (first, last))
    return [(month(k - purge), month(k), month(k + 1)) for k in range(a + train_months + purge, z + 1)]


def step_folds(n: int, min_train: int, step: int, purge: int, embargo: int) -> list[tuple[int, int, int]]:
    """Row folds of a series of n rows: (train_to, test_from, test_to)."""
    start = min_train + purge + embargo
    return [(s - purge - embargo, s, min(s + step, n)) for s in range(start, n, step)]


def year_folds(years: list[int], valid_years: int, embargo_days: int, min_train_years: int) -> list[dict]:
    """Per test year: training end, validation span, test span as ISO dates with a day embargo."""
    out = []
    for y in years[min_train_years + valid_years:]:
        v = y - valid_years
        cut = (datetime.date(v, 1, 1) - datetime.timedelta(days=embargo_days)).isoformat()
        out.append({"year": y, "train_to": cut, "valid_from": f"{v}-01-01", "valid_to": (datetime.date(y, 1, 1) - datetime.timedelta(days=embargo_days)).isoformat(), "test_from": f"{y}-01-01", "test_to": f"{y + 1}-01-01"})
    return out


# --- calibration -------------------------------------------------------------------------

def isotonic(train: DataFrame, test: DataFrame, prob: str, label: str, out: str = "calibrated") -> DataFrame:
    """Isotonic calibration learnt on ``train``; predictions outside its range are clipped by the model."""
    m = IsotonicRegression(featuresCol=prob, labelCol=label, predictionCol=out).fit(train.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")))
    return m.transform(test).withColumn(out, clip(out, 0, 1))


def platt(train: DataFrame, test: DataFrame, score: str, label: str, out: str = "calibrated") -> DataFrame:
    """Logistic calibration on one score."""
    m = logistic(label, features="__v", reg=0.0, weight=None, prob=out).fit(assembled(train.filter(F.col(label).isNotNull()), [score], "__v"))
    return up_probability(m.transform(assembled(test, [score], "__v")), out).drop("__v")


def binned_calibration(train: DataFrame, test: DataFrame, prob: str, label: str, group: str | None = None, bins: int = 8, min_group: int = 40, full: int = 180, out: str = "calibrated") -> DataFrame:
    """Quantile-bin event rates shrunk to the base rate by bin count / ``full``; the group's bin
    replaces the pooled bin when it holds ``min_group`` rows.

    Edges are exact pooled quantiles (range-partitioned), bins are (edge, edge]; all lookups are
    small per-bin tables joined by equality.
    """
    tr = train.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    q = pooled.exact_quantiles(tr, [], prob, [i / bins for i in range(1, bins)])
    edges = q.agg(F.array_sort(F.array_distinct(F.collect_list("value"))).alias("__e"))
    base = tr.agg(F.avg(F.col(label).cast("double")).alias("__base"))
    put = lambda d: d.join(edges).withColumn("__b", F.when(F.col(prob).isNotNull(), F.size(F.filter("__e", lambda e: e < F.col(prob))))).drop("__e")
    y = F.col(label).cast("double")
    trb = put(tr)
    g = trb.groupBy("__b").agg(F.avg(y).alias("__m"), F.count(F.lit(1)).alias("__c"))
    d = put(test).join(g, "__b", "left").join(base)
    if group:
        gg = trb.groupBy(group, "__b").agg(F.avg(y).alias("__gm"), F.count(F.lit(1)).alias("__gc")).filter(F.col("__gc") >= min_group)
        d = d.join(gg, [group, "__b"], "left").withColumns({"__m": F.coalesce("__gm", "__m"), "__c": F.coalesce("__gc", "__c")}).drop("__gm", "__gc")
    s = F.least(F.coalesce(F.col("__c"), F.lit(0)) / full, F.lit(1.0))
    v = F.when(F.col("__b").isNull(), F.col("__base")).otherwise(s * F.coalesce("__m", "__base") + (1 - s) * F.col("__base"))
    return d.withColumn(out, clip(v, 0.02, 0.98)).drop("__b", "__m", "__c", "__base")


def probability_blend(model, rule, peak, axis) -> Column:
    z = lambda c, top: clip(F.coalesce(c, F.lit(0.0)), 0, top) / top
    return clip(0.46 * model + 0.32 * z(rule, 1.0) + 0.12 * z(peak, 100.0) + 0.10 * z(axis, 100.0), 0, 1)


# --- ranking -----------------------------------------------------------------------------

def date_medians(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Missing features as the median of their group, 0 where the group has none."""
    w = Window.partitionBy(*keys)
    return df.withColumns({f: F.coalesce(trees.finite(f), F.median(trees.finite(f)).over(w), F.lit(0.0)) for f in features})


def ranker(df: DataFrame, features: list[str], grade: str, split: str = "split", keys: tuple[str, ...] = ("date",), tie: str = "symbol", rounds: int = 500, rate: float = 0.03, leaves: int = 15, depth: int = 4, min_rows: int = 20, columns: float = 0.8, l1: float = 1.0, l2: float = 5.0, k: int = 3, patience: int = 50, out: str = "rank_score") -> tuple[DataFrame, trees.Ensemble]:
    """Learning to rank within ``keys``: boosted trees on pairwise gradients weighted by the change of NDCG, fitted on the
    ``train`` rows and stopped by NDCG@k of the ``valid`` rows.  Returns all rows with ``out``, and the model."""
    d = checkpointed(date_medians(df, features, keys))
    graded = d.filter(F.col(grade).isNotNull() & F.col(split).isin("train", "valid"))
    bins = trees.quantile_bins(graded.filter(F.col(split) == "train"), features)
    data = trees.chunks(graded, bins, F.col(grade), valid=F.col(split) == "valid", groups=list(keys), ties=[tie])
    model = trees.boost(data, bins, trees.LambdaRank(k=k), rounds, rate, trees.Shape(leaves, depth, min_rows, l2, l1), columns, patience)
    return d.withColumn(out, model.margin()), model


def ndcg(df: DataFrame, score: str, grade: str, k: int, keys=("date",), tie: str = "symbol") -> DataFrame:
    """NDCG@k per group from two ranks; both sums are conditional aggregates."""
    w = Window.partitionBy(*keys)
    d = df.filter(F.col(grade).isNotNull()).withColumns({"__p": F.row_number().over(w.orderBy(F.desc(score), tie)), "__i": F.row_number().over(w.orderBy(F.desc(grade), tie))})
    gain = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(r) + 1)).otherwise(0.0))
    return d.groupBy(*keys).agg(ratio(gain("__p"), gain("__i")).alias("ndcg"))


def ridge_and_forest(train: DataFrame, test: DataFrame, features: list[str], target: str, out: str = "predicted") -> DataFrame:
    """Mean of a ridge and a forest regression."""
    tr = assembled(train.filter(F.col(target).isNotNull()), features)
    d = assembled(test, features)
    d = LinearRegression(featuresCol="features", labelCol=target, regParam=0.1, elasticNetParam=0.0, predictionCol="__a").fit(tr).transform(d)
    d = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=60, maxDepth=4, seed=42, predictionCol="__b").fit(tr).transform(d)
    return d.withColumn(out, (F.col("__a") + F.col("__b")) / 2).drop("__a", "__b", "features")


# --- states, embeddings ---------------------------------------------------------------------

def mixture_regimes(df: DataFrame, features: list[str], k: int = 4, seed: int = 42, starts: int = 10) -> DataFrame:
    """Gaussian-mixture state and probabilities on standardised, clipped features; of ``starts`` fits with
    seeds of their own the one with the best log-likelihood."""
    d = df.dropna(subset=features).withColumns({f: clip(f, -5, 5) for f in features})
    d = assembled(d, features, "__raw")
    z = StandardScaler(inputCol="__raw", outputCol="__z", withMean=True).fit(d).transform(d)
    fits = [GaussianMixture(featuresCol="__z", k=k, seed=seed + s, predictionCol="state", probabilityCol="__p").fit(z) for s in range(starts)]
    return max(fits, key=lambda m: m.summary.logLikelihood).transform(z).withColumn("probabilities", vector_to_array("__p")).drop("__raw", "__z", "__p")


def robust_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """One row of median and spread per feature: IQR, else the deviation, else 1.  Quantiles come
    from the range-partitioned pool of (feature, value) pairs."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])).alias("r")).select("r.*").filter("v is not null")
    q = pooled.exact_quantiles(long, ["f"], "v", [0.25, 0.5, 0.75])
    sd = long.groupBy("f").agg(F.stddev_samp("v").alias("sd"))
    at = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    g = q.groupBy("f").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("iqr")).join(sd, "f")
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    g = g.withColumn("spread", F.coalesce(nz("iqr"), nz("sd"), F.lit(1.0)))
    pick = lambda f, c: F.max(F.when(F.col("f") == f, F.col(c)))
    return g.agg(*[pick(f, "mid").alias(f"__mid_{f}") for f in features], *[pick(f, "spread").alias(f"__spread_{f}") for f in features])


def robust_scale(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """(x - median) / spread, missing as 0, clipped to +-8."""
    d = df.join(stats)
    return d.withColumns({f: clip(F.coalesce((F.col(f) - F.col(f"__mid_{f}")) / F.col(f"__spread_{f}"), F.lit(0.0)), -8, 8) for f in features}).drop(*[c for f in features for c in (f"__mid_{f}", f"__spread_{f}")])


def sliding_windows(df: DataFrame, features: list[str], n: int, keys: tuple[str, ...] = ("symbol",), order: str = "date", out: str = "window") -> DataFrame:
    """The last n feature vectors of every (entity, date) with a full history, flattened oldest first."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w.rowsBetween(-(n - 1), 0))
    d = df.withColumns({out: rows, "row_position": F.row_number().over(w) - 1})
    return d.filter(F.size(out) == n).withColumn(out, F.flatten(out))


def window_components(df: DataFrame, features: list[str], n: int, k: int, train: Column, keys: tuple[str, ...] = ("symbol",), order: str = "date") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of the flattened windows of n rows that end on a ``train`` row; training rows of an entity
    come before its others.  Window entries run oldest first, features within a row.

    No window is built.  A cell of the covariance multiplies one feature i rows before a window's end with another j rows before;
    that is the product with a lag of j - i, summed over the ends, and the ends of an entity are its positions from n - 1 to its last
    training row.  So one pass over the rows with n lags gives all cells, whose number depends on n and the features only."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumns({"__pos": F.row_number().over(w) - 1, "__last": F.sum(F.coalesce(train, F.lit(False)).cast("int")).over(Window.partitionBy(*keys)) - 1})
    d = d.withColumns({f"__{b}_{lag}": F.lag(F.col(f).cast("double"), lag).over(w) for b, f in enumerate(features) for lag in range(n)})
    inside = lambda i: (F.col("__pos") >= n - 1 - i) & (F.col("__pos") <= F.col("__last") - i)
    entries = [(age, a) for age in range(n - 1, -1, -1) for a in range(len(features))]
    sums = {f"m{p}": F.sum(F.when(inside(i), F.col(f"__{a}_0"))) for p, (i, a) in enumerate(entries)}
    for p, (i, a) in enumerate(entries):
        for q, (j, b) in enumerate(entries[: p + 1]):  # the entry q is older: j >= i
            sums[f"c{p}_{q}"] = F.sum(F.when(inside(i), F.col(f"__{a}_0") * F.col(f"__{b}_{j - i}")))
    row = d.agg(F.sum(F.when(inside(0), 1)).alias("n"), *[c.alias(name) for name, c in sums.items()]).first()
    size, count = len(entries), row["n"] or 0
    if not count:
        return np.zeros(size), np.zeros((k, size))
    mean = np.array([row[f"m{p}"] for p in range(size)]) / count
    cov = np.array([[row[f"c{max(p, q)}_{min(p, q)}"] for q in range(size)] for p in range(size)]) / count - np.outer(mean, mean)
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    return mean, vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]


def embed(df: DataFrame, features: list[str], n: int, components: np.ndarray, keys: tuple[str, ...] = ("symbol",), order: str = "date", out: str = "embedding") -> DataFrame:
    """Projections of each row's window onto ``components``, as weighted sums of lags; rows with a full window only."""
    w = Window.partitionBy(*keys).orderBy(order)
    entries = [(age, f) for age in range(n - 1, -1, -1) for f in features]
    d = df.withColumns({"__pos": F.row_number().over(w) - 1} | {f"__{f}_{lag}": F.lag(F.col(f).cast("double"), lag).over(w) for f in features for lag in range(n)})
    parts = [sum((F.col(f"__{f}_{lag}") * float(x) for x, (lag, f) in zip(v[1:], entries[1:])), F.col(f"__{entries[0][1]}_{entries[0][0]}") * float(v[0])) for v in components]
    return d.where(F.col("__pos") >= n - 1).withColumn(out, F.array(*parts)).select(*df.columns, out)


def quantise(train: DataFrame, df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """k-means state and the distance to its centre, fitted on the training rows."""
    v = lambda d: d.withColumn("__v", array_to_vector(vector))
    m = KMeans(featuresCol="__v", predictionCol="vq_state", k=k, seed=seed, maxIter=20).fit(v(train))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m.clusterCenters()])
    d = m.transform(v(df)).drop("__v")
    sq = F.zip_with(F.col(vector), centres[F.col("vq_state")], lambda a, b: (a - b) * (a - b))
    return d.withColumn("vq_distance", F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x)))


def gaussian_confidence(train: DataFrame, df: DataFrame, vector: str, shrink: float = 0.1) -> DataFrame:
    """Gaussian log-likelihood of a vector under the training mean and shrunk covariance, and its
    percentile against the training rows (x 100).

    Only the d x d moments reach the driver (d = embedding size); rows are scored by expression.
    """
    t = train.withColumn("__v", array_to_vector(vector))
    row = t.select(Summarizer.metrics("mean", "count").summary(F.col("__v")).alias("s")).first()["s"]
    mean = np.asarray(row["mean"].toArray())
    d = len(mean)
    centred = t.select(F.array(*[F.col(vector)[i] - float(mean[i]) for i in range(d)]).alias("c"))
    cells = centred.agg(*[F.avg(F.col("c")[i] * F.col("c")[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[cells[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    cov = (1 - shrink) * cov + shrink * np.trace(cov) / d * np.eye(d) + 1e-6 * np.eye(d)
    inv, logdet = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
    diff = [F.col(vector)[i] - float(mean[i]) for i in range(d)]
    quad = sum((diff[i] * sum((diff[j] * float(inv[i, j]) for j in range(1, d)), diff[0] * float(inv[i, 0])) for i in range(1, d)), diff[0] * sum((diff[j] * float(inv[0, j]) for j in range(1, d)), diff[0] * float(inv[0, 0])))
    ll = lambda x: x.withColumn("loglik", F.round(-0.5 * (d * float(np.log(2 * np.pi)) + logdet + quad), 10))
    scored, ref = ll(df), ll(train)
    both = ref.select(F.col("loglik").alias("v"), F.lit(1).alias("n")).unionByName(scored.select(F.col("loglik").alias("v"), F.lit(0).alias("n")))
    counts = pooled.running(both.groupBy("v").agg(F.sum("n").alias("n")), [], ["n"])
    pct = counts.select(F.col("v").alias("loglik"), ((F.col("n_below") + F.col("n")) / F.greatest(F.col("n_all"), F.lit(1)) * 100).alias("confidence"))
    return scored.join(pct, "loglik")


# --- sampling, importance, adoption ------------------------------------------------------------

def dense_index(df: DataFrame, key: Column, out: str = "__i") -> DataFrame:
    """0-based index of rows in the order of a unique hash key, without sorting the pool in one task."""
    d = df.withColumn("__h", key)
    r = pooled.running(pooled.value_counts(d, [], "__h", {"n": F.lit(1)}), [], ["n"])
    return d.join(r.select(F.col("v").alias("__h"), F.col("n_below").alias(out), F.col("n_all").alias("__m")), "__h").drop("__h")


def oversample(df: DataFrame, label: str, vector: str, ids: list[str], seed: int = 42) -> DataFrame:
    """Synthetic minority rows until the classes balance: points on the segment between two
    distinct minority rows chosen by hash.  Adds ``synthetic``."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__z"))
    m = checkpointed(dense_index(df.filter(F.col(label) == 1).select(label, vector, *ids), F.xxhash64(F.lit(seed), *ids)))
    need = m.join(n.select((F.col("__z") - F.col("__p")).alias("__need"))).filter("__need > 0 and __m > 1")
    copies = need.filter("__i < __need").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__need") - 1 - F.col("__i")) / F.col("__m"))))).filter(F.col("__i") + F.col("__s") * F.col("__m") < F.col("__need"))
    h = lambda k: F.xxhash64(F.lit(seed + k), "__i", "__s")
    copies = copies.withColumns({"__j": F.pmod(F.col("__i") + 1 + F.pmod(h(1), F.col("__m") - 1), F.col("__m")), "__l": F.pmod(h(2), F.lit(1000000)) / 1e6})
    other = m.select(F.col("__i").alias("__j"), F.col(vector).alias("__o"))
    syn = copies.join(other, "__j").select(label, F.col(vector).alias("__a"), "__o", "__l", *ids)
    syn = syn.select(label, F.transform(F.arrays_zip("__a", "__o"), lambda p: p["__a"] + F.col("__l") * (p["__o"] - p["__a"])).alias(vector), *ids, F.lit(1).alias("synthetic"))
    return df.select(label, vector, *ids).withColumn("synthetic", F.lit(0)).unionByName(syn)


def log_loss(prob, label) -> Column:
    p = clip(prob, 1e-15, 1 - 1e-15)
    y = F.col(label).cast("double")
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def permutation_importance(model, df: DataFrame, features: list[str], label: str, ids: list[str], seed: int = 7) -> DataFrame:
    """Rise of the log loss when one feature is shuffled over the rows (dense hash index + equi-join)."""
    base = checkpointed(dense_index(df.select(*ids, label, *features), F.xxhash64(F.lit(seed), *ids)))
    score = lambda d, name: up_probability(model.transform(assembled(d, features))).agg(log_loss(F.col("prob"), label).alias("loss")).withColumn("feature", F.lit(name))
    out = score(base, "__base__")
    for f in features:
        moved = base.select(F.pmod(F.col("__i") + F.floor(F.col("__m") / 2) + 1, F.col("__m")).alias("__i"), F.col(f).alias("__x"))
        out = out.unionByName(score(base.drop(f).join(moved, "__i").withColumnRenamed("__x", f), f))
    b = out.filter("feature = '__base__'").select(F.col("loss").alias("__b"))
    return out.filter("feature <> '__base__'").join(b).select("feature", (F.col("loss") - F.col("__b")).alias("loss_increase"))


def adoption(results: DataFrame, key: str, model: str, primary: str, secondary: str, min_gain: float, max_loss: float, baseline: str = "baseline") -> DataFrame:
    """Best challenger per task against the baseline: adopt on enough gain without too much loss."""
    base = results.filter(F.col(model) == baseline).select(key, F.col(primary).alias("base_primary"), F.col(secondary).alias("base_secondary"))
    best = results.filter(F.col(primary).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(model).alias("best_model"), F.col(primary).alias("best_primary"), F.col(secondary).alias("best_secondary")), F.struct(F.col(primary), F.col(model))).alias("b")).select(key, "b.*")
    d = base.join(best, key).withColumns({"delta_primary": F.col("best_primary") - F.col("base_primary"), "delta_secondary": F.col("best_secondary") - F.col("base_secondary")})
    ok = (F.col("best_model") != baseline) & (F.col("delta_primary") >= min_gain) & (F.col("delta_secondary") >= max_loss)
    return d.withColumn("decision", F.when(ok, "adopt").otherwise("keep_baseline"))
