"""Similar-history search over date-level feature vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.scalar import col, ratio
from tideframe.operators.pooled import with_halo


def distance(a, b) -> Column:
    """Euclidean distance of two arrays."""
    sq = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))


def embedding_drift(df: DataFrame, pos: str, vector: str, n: int, width: int = 4096) -> DataFrame:
    """Distance to the vector one position before and its trailing mean over n positions.

    The series may be arbitrarily long: it is cut into chunks with a halo.
    """
    c = with_halo(df.select(pos, vector), pos, width, n)
    w = Window.partitionBy("chunk").orderBy(pos)
    prev = F.last(vector).over(w.rangeBetween(-1, -1))
    c = c.withColumn("step", distance(F.col(vector), prev)).drop(vector)
    f = w.rangeBetween(-(n - 1), 0)
    return c.select(pos, "home", "step", F.when(F.count("step").over(f) >= n, F.avg("step").over(f)).alias("drift")).filter("home").drop("home")


def _block_nearest(k: int, exclude: int):
    def run(queries: pd.DataFrame, history: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(history):
            h = np.stack(history["hx"].to_numpy()).astype(float)
            hi = history["hist_idx"].to_numpy()
            for qi, q, m, s in zip(queries["idx"].to_numpy(), *(np.stack(queries[c].to_numpy()).astype(float) for c in ("x", "mean", "scale"))):
                ok, used = hi < qi - exclude, ~np.isnan(s)
                if not ok.any() or not used.any():
                    continue
                z = np.nan_to_num((h[ok][:, used] - m[used]) / s[used], nan=0.0)
                dist = np.sqrt(((z - (q[used] - m[used]) / s[used]) ** 2).mean(axis=1))
                near = np.lexsort((hi[ok], dist))[:k]
                rows += [(int(qi), int(hi[ok][j]), float(dist[j])) for j in near]
        return pd.DataFrame(rows, columns=["idx", "hist_idx", "distance"])
    return run


def nearest_history(queries: DataFrame, history: DataFrame, k: int, exclude: int, block: int = 2048) -> DataFrame:
    """Exact k nearest earlier rows by RMS distance of scaled vectors: idx, hist_idx, distance, rn.

    ``queries``: idx, x[, mean, scale] arrays, a NaN scale leaves a feature out of that query;
    ``history``: idx, x, a NaN value counts as the mean.  Eligible rows have
    ``hist_idx < idx - exclude``.  Both sides are cut into index blocks; a pair of blocks is one
    task with at most ``block`` rows on either side and hands on k rows per query, never the
    pairs.  The second step keeps the best k over the blocks.
    """
    for c, v in (("mean", 0.0), ("scale", 1.0)):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.transform("x", lambda _: F.lit(v)))
    qb = F.floor(F.col("idx") / block)
    q = queries.select("idx", "x", "mean", "scale", qb.alias("qb")).withColumn("hb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qb"))))
    span = queries.agg(F.max(qb).alias("__top"))
    h = history.select(F.col("idx").alias("hist_idx"), F.col("x").alias("hx"), qb.alias("hb")).join(span).filter(F.col("hb") <= F.col("__top"))
    h = h.withColumn("qb", F.explode(F.sequence(F.col("hb"), F.col("__top")))).drop("__top")
    local = q.groupBy("qb", "hb").cogroup(h.groupBy("qb", "hb")).applyInPandas(
        _block_nearest(k, exclude), "idx bigint, hist_idx bigint, distance double")
    w = Window.partitionBy("idx").orderBy("distance", "hist_idx")
    return local.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def history_vectors(df: DataFrame, features: list[str], exclude: int, min_share: float = 0.8) -> DataFrame:
    """idx, x, mean, scale, used per date: a feature's mean and population deviation come from the
    rows before idx - exclude only; features unknown today, too sparse or constant are left out."""
    day = Window.partitionBy(F.lit(0)).orderBy("date")
    past = day.rowsBetween(Window.unboundedPreceding, -(exclude + 1))
    nan = F.lit(float("nan"))
    d = df.withColumn("idx", (F.row_number().over(day) - 1).cast("bigint"))
    d = d.withColumns({f"__m_{f}": F.avg(f).over(past) for f in features} | {f"__s_{f}": F.stddev_pop(f).over(past) for f in features} | {f"__c_{f}": F.count(f).over(past) for f in features})
    ok = lambda f: F.col(f).isNotNull() & (F.col(f"__c_{f}") / (F.col("idx") - exclude) > min_share) & (F.col(f"__s_{f}") > 1e-12)
    scale = [F.when(ok(f), F.col(f"__s_{f}")).otherwise(nan) for f in features]
    return d.select("date", "idx", F.array(*[F.coalesce(F.col(f), nan) for f in features]).alias("x"), F.array(*[F.coalesce(f"__m_{f}", nan) for f in features]).alias("mean"),
                    F.array(*scale).alias("scale"), F.size(F.filter(F.array(*scale), lambda v: ~F.isnan(v))).alias("used"))


def point_in_time_analogs(df: DataFrame, features: list[str], k: int, min_history: int, exclude: int, step: int, min_features: int) -> DataFrame:
    """Nearest earlier days of every ``step``-th day: idx, hist_idx, distance, rn."""
    v = history_vectors(df, features, exclude)
    q = v.filter((F.col("idx") >= min_history) & (F.col("idx") % step == 0) & (F.col("idx") - exclude > min_history // 2) & (F.col("used") >= min_features))
    return nearest_history(q.select("idx", "x", "mean", "scale"), v.select("idx", "x"), k, exclude)


def neighbour_stats(near: DataFrame, outcomes: DataFrame, ks: list[int]) -> DataFrame:
    """Per query and k: neighbours, mean distance, down and tail shares, mean returns, 10% quantile
    of the worse of return and minimum.  ``outcomes``: hist_idx, ret_1w, ret_1m, min_1m, down_1w, down_1m, tail."""
    n = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rn") <= F.col("k")).join(outcomes, "hist_idx")
    return n.groupBy("idx", "k").agg(F.count(F.lit(1)).alias("neighbours"), F.avg("distance").alias("distance_mean"), F.min("distance").alias("distance_min"),
                                     F.avg("down_1w").alias("down_prob_1w"), F.avg("down_1m").alias("down_prob_1m"), F.avg("tail").alias("tail_prob_1m"), F.avg("ret_1w").alias("avg_return_1w"),
                                     F.avg("ret_1m").alias("avg_return_1m"), F.percentile(F.least("ret_1m", "min_1m"), 0.10).alias("tail_return_p10_1m"))


def similar_days(df: DataFrame, features: list[str], asof, cut_days: int, n: int) -> DataFrame:
    """The n days most like the as-of row by RMS z distance on history older than the cut-off.

    One aggregate row of means, deviations and current values is joined; the n best come from a
    top-n, not a sort."""
    day = F.lit(asof).cast("date")
    hist = df.filter(F.col("date") < F.date_sub(day, cut_days))
    now = df.filter(F.col("date") == day).select(*[F.col(f).alias(f"__q_{f}") for f in features])
    st = hist.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    d = hist.join(st.join(now))
    sq, used = F.lit(0.0), F.lit(0)
    for f in features:
        ok = F.col(f"__q_{f}").isNotNull() & (F.col(f"__s_{f}") > 1e-12)
        zh = F.coalesce((F.col(f) - F.col(f"__m_{f}")) / F.col(f"__s_{f}"), F.lit(0.0))
        sq = sq + F.when(ok, F.pow(zh - (F.col(f"__q_{f}") - F.col(f"__m_{f}")) / F.col(f"__s_{f}"), 2)).otherwise(0.0)
        used = used + ok.cast("int")
    d = d.withColumn("distance", F.sqrt(ratio(sq, used)))
    d = d.orderBy("distance", "date").limit(n)
    return d.select("date", "distance", (100 / (1 + F.col("distance"))).alias("similarity"))


def outcome_table(days: DataFrame, prices: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Forward outcomes after the given days per asset and horizon."""
    from tideframe.functions import rolling as R
    w = R.by_entity()
    f = prices.select("date", "symbol", *[R.forward_return("close", h, w).alias(n) for n, h in horizons.items()])
    long = f.join(days.select("date"), "date", "left_semi").unpivot(["date", "symbol"], list(horizons), "horizon", "ret").filter("ret is not null")
    r = F.col("ret")
    return long.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.avg((r > 0).cast("double")).alias("up_share"), F.avg((r < 0).cast("double")).alias("down_share"),
                                                 F.percentile(r, 0.10).alias("p10"), F.min(r).alias("worst"), F.max(r).alias("best"))
