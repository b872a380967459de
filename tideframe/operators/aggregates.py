"""Group aggregates: weighted means and shares, tails, concentration, breadth, regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, ratio, total


def rate(cond) -> Column:
    """Share of rows on which a condition holds (null counts as no)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def segment_metrics(df: DataFrame, aggs: list[Column], segments: list[str]) -> DataFrame:
    """The same aggregates for all rows and for every value of each segment column, from one
    pass: GROUPING SETS ((), (a), (b), ...) with (segment_type, segment)."""
    d = df.withColumns({f"__s_{s}": F.col(s).cast("string") for s in segments})
    keys = [F.col(f"__s_{s}") for s in segments]
    sets = [[]] + [[k] for k in keys]
    out = d.groupingSets(sets, *keys).agg(F.grouping_id().alias("__g"), *aggs)
    n = len(segments)
    kind, seg = F.lit("__ALL__"), F.lit("__ALL__")
    for i, s in enumerate(segments):
        bit = (2 ** n - 1) - 2 ** (n - 1 - i)
        kind = F.when(F.col("__g") == bit, s).otherwise(kind)
        seg = F.when(F.col("__g") == bit, F.col(f"__s_{s}")).otherwise(seg)
    return out.withColumns({"segment_type": kind, "segment": seg}).drop("__g", *[f"__s_{s}" for s in segments])


def period_summary(df: DataFrame, value: str, score: str, bad: Column, keys: dict[str, Column]) -> DataFrame:
    """Span, first-to-last return, maximum and mean score and bad days per calendar period."""
    d = F.col("date")
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.min(d).alias("start_date"), F.max(d).alias("end_date"),
        (ratio(F.max_by(value, d), F.min_by(value, d)) - 1).alias("total_return"),
        F.max(score).alias("max_score"), F.avg(score).alias("avg_score"), F.count_if(bad).alias("bad_days"))


def most_frequent(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per group, alphabetical on ties: counts are combined before any choice."""
    n = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(label), F.max("__n").alias("n"))


def weighted_mean(x, w) -> Column:
    """Sum w x / sum w over the rows where x is present; null when that weight is 0."""
    x, w = col(x), col(w)
    return ratio(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def weighted_share(cond: Column, valid: Column, w) -> Column:
    """Weight share of the valid rows on which the condition holds."""
    w = col(w)
    return ratio(F.sum(F.when(valid & cond, w).otherwise(0.0)), F.sum(F.when(valid, w).otherwise(0.0)))


def tail_mean(x, n: Column, rank: str) -> Column:
    """Mean of the rows whose precomputed rank is within the first n."""
    return F.avg(F.when(F.col(rank) <= n, col(x)))


def tail_size(count: Column, share: float = 0.2) -> Column:
    return F.greatest(F.lit(1), F.ceil(count * share))


def effective_number(w) -> Column:
    w = col(w)
    return ratio(F.lit(1.0), F.sum(w * w))


def weight_ladder(df: DataFrame, candidates: list[tuple[str, str]], keys=("date", "etf"), out: str = "weight") -> DataFrame:
    """Weights of each group from the first candidate column with a positive group total,
    normalised to 1; equal weights when none has.  ``source`` names the choice."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({f"__t{i}": F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(w) for i, (c, _) in enumerate(candidates)} | {"__n": F.count(F.lit(1)).over(w)})
    weight, source = 1.0 / F.col("__n"), F.lit("equal_weight_fallback")
    for i, (c, name) in reversed(list(enumerate(candidates))):
        use = F.col(f"__t{i}") > 0
        weight = F.when(use, F.coalesce(F.col(c), F.lit(0.0)) / F.col(f"__t{i}")).otherwise(weight)
        source = F.when(use, F.lit(name)).otherwise(source)
    return d.withColumns({out: weight, "source": source}).drop("__n", *[f"__t{i}" for i in range(len(candidates))])


def average_daily_value(bars: DataFrame, n: int = 60) -> DataFrame:
    """Mean close x volume of the last n bars per symbol."""
    v = bars.select("symbol", "date", (F.col("close") * F.col("volume")).alias("v")).filter(F.col("v").isNotNull())
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return v.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).groupBy("symbol").agg(F.avg("v").alias("adv"))


def collapse_weights(df: DataFrame, keys: list[str], group: list[str], names: list[str]) -> DataFrame:
    """Weights summed per key, first label by sort order, renormalised inside the group."""
    g = df.groupBy(*keys).agg(F.sum("weight").alias("weight"), *[F.min(n).alias(n) for n in names])
    t = F.sum("weight").over(Window.partitionBy(*group))
    return g.withColumn("weight", F.when(t > 0, F.col("weight") / t).otherwise(F.col("weight")))


def weighted_slope(df: DataFrame, y: str, x: str, group: str, min_names: int, keys=("date",)) -> DataFrame:
    """Per date WLS slope of y on x; a name weighs 1 / size of its group.

    Sums only: one combined aggregate, no date is gathered.  x is centred on a constant of the
    table so that the moment form keeps its digits.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sizes = df.select(group, "symbol").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("__k"))
    d = d.join(sizes, group).withColumn("__w", 1.0 / F.col("__k"))
    ref = d.agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy"))
    d = d.join(ref).withColumns({"__x": F.col(x) - F.col("__cx"), "__y": F.col(y) - F.col("__cy")})
    w, a, b = F.col("__w"), F.col("__x"), F.col("__y")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"),
                             F.sum(w * a * b).alias("sxy"), F.sum(w * a * a).alias("sxx"))
    slope = ratio(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"))
    return g.select(*keys, "n", F.when(F.col("n") >= min_names, slope).alias("slope"))


REGRESSION_SCHEMA = "date date, etf string, coef_hp double, coef_ret60 double, coef_rs60 double, r2 double, residual_dispersion double"


def _wls(pdf: pd.DataFrame) -> pd.DataFrame:
    out = {"date": pdf["date"].iloc[0], "etf": pdf["etf"].iloc[0], "coef_hp": None, "coef_ret60": None, "coef_rs60": None, "r2": None, "residual_dispersion": None}
    d = pdf.dropna()
    if len(d) >= 5 and d["y"].std() != 0:
        x = d[["hp", "ret60", "rs60"]].to_numpy(float)
        sd = x.std(axis=0)
        x = np.column_stack([np.ones(len(d)), (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)])
        y, w = d["y"].to_numpy(float), d["weight"].to_numpy(float)
        w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
        # Minimum-norm solution: rs60 is ret60 minus a constant, so the columns are collinear.
        beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        sse = float((w * (y - x @ beta) ** 2).sum())
        sst = float((w * (y - (w * y).sum()) ** 2).sum())
        out.update(coef_hp=beta[1], coef_ret60=beta[2], coef_rs60=beta[3], r2=1 - sse / sst if sst > 0 else None, residual_dispersion=max(sse, 0) ** 0.5)
    return pd.DataFrame([out])


def component_regression(df: DataFrame) -> DataFrame:
    """Per (date, etf) weighted regression of y on standardised hp, ret60, rs60.

    ``df``: date, etf, y, hp, ret60, rs60, weight; a group is one fund's holdings on one day.
    """
    return df.select("date", "etf", "y", "hp", "ret60", "rs60", "weight").groupBy("date", "etf").applyInPandas(_wls, REGRESSION_SCHEMA)


def basket_index(returns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Equal-weight mean return per date, compounded."""
    g = returns.groupBy(*keys, "date").agg(F.avg("ret").alias("ret"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    return g.withColumn("index", R.equity("ret", w))


def any_signal(cols: list[str]) -> Column:
    return F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols]) if len(cols) > 1 else F.coalesce(F.col(cols[0]).cast("int"), F.lit(0))


def row_weighted_mean(df: DataFrame, weights: dict[str, float], skip_null: bool = False, bound: tuple[float, float] | None = (0, 100)) -> Column:
    """Weighted mean over the columns that exist.

    ``skip_null`` False counts null as 0 with its weight; True leaves the column out of both sums.
    """
    have = {c: w for c, w in weights.items() if c in df.columns}
    if not have:
        return F.lit(None).cast("double") if skip_null else F.lit(0.0)
    val = lambda c: clip(c, *bound) if bound else F.col(c)
    if skip_null:
        num = total([F.coalesce(val(c), F.lit(0.0)) * w for c, w in have.items()])
        den = total([F.when(F.col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in have.items()])
        out = ratio(num, den)
    else:
        out = total([F.coalesce(val(c), F.lit(0.0)) * w for c, w in have.items()]) / max(sum(have.values()), 1e-9)
    return clip(out, *bound) if bound else out


def value_shares(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Counts and shares of each label inside the group."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    return n.withColumn("share", F.col("n") / F.sum("n").over(w))


def breadth(prices: DataFrame, risk: Column, safe: Column) -> DataFrame:
    """Per date: share below MA20 and MA60, share with a 20-row loss and a loss beyond 5%,
    mean 20-row return of risk and of safe names, share of risk names above MA60."""
    w = R.by_entity()
    below = lambda n, m: F.coalesce(F.col("close") < R.mean("close", n, w, m), F.lit(False))
    d = prices.withColumns({"b20": below(20, 10), "b60": below(60, 20), "r20": R.step_return("close", 20, w)})
    return d.groupBy("date").agg(
        (100 * rate(F.col("b60"))).alias("below_ma60"), (100 * rate(F.col("b20"))).alias("below_ma20"),
        (100 * rate(F.col("r20") < 0)).alias("loss20"), (100 * rate(F.col("r20") < -0.05)).alias("large_loss20"),
        (1 - F.avg(F.when(risk, F.col("b60").cast("double")))).alias("risk_breadth"),
        F.avg(F.when(risk, F.col("r20"))).alias("risk_ret"), F.avg(F.when(safe, F.col("r20"))).alias("safe_ret"))


def compounded(df: DataFrame, keys: list, returns: list[str]) -> DataFrame:
    """prod(1 + r) - 1 of each return column per group."""
    return df.groupBy(*keys).agg(*[R.compound(c).alias(c) for c in returns])


def item_score(items, value: str = "passed") -> Column:
    """Share of passed among the known items of an array of structs, 0..100, null when none is known."""
    known = F.filter(col(items), lambda i: i[value].isNotNull())
    return F.round(ratio(F.size(F.filter(known, lambda i: i[value])), F.size(known)) * 100, 2)


def gate(score) -> Column:
    s = col(score)
    return F.when(s.isNull(), "research_required").when(s >= 60, "pass").otherwise("fail")
