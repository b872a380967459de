"""2.15 Learning steps; rows-only except where SQL expresses the step."""

import datetime

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.catalog.composites import ROLES, WIDE, riskon, wide
from tideframe.catalog.metrics import UP, labelled, up
from tideframe.catalog.xsec import pctsql
from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip
from tideframe.operators import bubble as B, folds_fit as FL, isotone as IS, labels as LB, learn as LE, metrics as M, panel as P, pooled as PO, thresholds as TH, topk as T, trees as TR, xsec as S
from tideframe.plans.fixtures import BRAND, RISK, WEEKLY
from tideframe.session import staged

FEATS = [r[0] for r in ROLES.values()]
A, Z = "1998-06-01", "2000-01-01"


def risk_panel(t):
    """Date-level features and label with a row number."""
    d = labelled(t).withColumn("deep", (F.col("m20") <= -0.5).cast("int")).join(riskon(t), "date")
    return d.withColumn("row", F.row_number().over(R.day()) - 1)


RF = ["score"] + [f"r_{f}" for f in FEATS]


def scored(t):
    d = LE.time_split(up(t).withColumn("s100", F.col("score") / 100), A, Z)
    return d


@query("ml01_time_split", fin("date symbol split:s", f"SELECT date, symbol, CASE WHEN date<=DATE '{A}' THEN 'train' WHEN date<=DATE '{Z}' THEN 'valid' ELSE 'test' END AS split FROM {WEEKLY}"))
def _(t):
    return LE.time_split(t.weekly, A, Z).select("date", "symbol", "split")


@query("ml02_walk_forward_by_step")
def _(t):
    d = risk_panel(t)
    n = (d.agg(F.max("row")).first()[0] or 0) + 1
    p = LE.walk_forward(d, RF, "deep", LE.step_folds(n, 504, 126, 20, 5), ["date"], models=("logistic", "extra"))
    return PO.roc_auc(p, ["fold"], "prob", "deep")


@query("ml03_walk_forward_by_date")
def _(t):
    d, folds = by_month(t)
    p = LE.walk_forward(d, ["score", "base"], "y", folds, ["date", "symbol"])
    return M.calibration(p, ["fold"], "prob", "y")


def by_month(t):
    d = up(t).withColumn("row", F.date_format("date", "yyyyMM").cast("int")).withColumnRenamed("prob", "base")
    return d, LE.month_folds(*d.agg(F.min("row"), F.max("row")).first())


@query("ml03_fold_fits", fin("fold:i train_rows:i solved:i", f"""WITH r AS (SELECT year(date)*12+month(date)-1 AS m, y FROM {UP}), f AS (SELECT unnest(range(min(m)+25, max(m)+1)) AS k, min(m)+25 AS first FROM r)
 SELECT k-first AS fold, count(y) AS train_rows, CASE WHEN min(y)<max(y) THEN true END AS solved FROM f LEFT JOIN r ON r.m<k-1 GROUP BY k, first"""))
def _(t):
    """Rows of every fold, and whether its score equations hold."""
    d, folds = by_month(t)
    fs = ["score", "base"]
    model = FL.fit_folds(FL.row_blocks(d, fs, F.col("y"), F.col("row")), fs, [float(f[0]) for f in folds])
    rows = [(i, int(n), None if g != g else bool(g < 1e-6)) for i, (n, g) in enumerate(zip(model.rows, model.gradient))]
    return t.spark.createDataFrame(rows, "fold int, train_rows long, solved boolean")


@query("ml04_yearly_walk_forward")
def _(t):
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    d = risk_panel(t).withColumn("row", day(F.col("date")))
    span = d.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    folds = LE.year_folds(list(range(span[0], span[1] + 1)), 1, 30, 3)
    number = lambda text: (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days
    p = LE.walk_forward(d, RF, "deep", [(number(f["train_to"]), number(f["valid_from"]), number(f["test_to"])) for f in folds], ["date", "score"], models=("extra",), count=60, min_rows=16)
    years = {i: f for i, f in enumerate(folds)}
    test_from = F.create_map(*[F.lit(x) for i, f in years.items() for x in (i, f["test_from"])])[F.col("fold")]
    p = p.withColumn("part", F.when(F.col("date") >= test_from.cast("date"), "test").otherwise("valid"))
    from tideframe.operators import sweep as SW
    s = TH.sweep_rates(SW.sweep(p.filter("part = 'valid'"), ["fold"], "prob", [i / 50 for i in range(5, 46)], SW.confusion("deep")))
    thr = TH.best_threshold(s, ["fold"], TH.benchmark_objective(), F.lit(True), 0.5).drop("objective")
    q = p.filter("part = 'test'").join(thr, "fold").withColumn("alert", F.col("prob") >= F.col("threshold"))
    return M.rates(q.groupBy("fold").agg(F.count(F.lit(1)).alias("samples"), *M.confusion("alert", "deep")))


@query("ml05_logistic_classifier")
def _(t):
    d = scored(t)
    tr = LE.class_weights(LE.assembled(d.filter("split = 'train'"), ["score", "prob"]), "y")
    out = LE.up_probability(LE.logistic("y", reg=0.05, mix=0.5, prob="p").fit(tr).transform(LE.assembled(d.filter("split = 'test'"), ["score", "prob"])), "p")
    return out.select("date", "symbol", "p", "y")


@query("ml06_tree_ensembles")
def _(t):
    d = scored(t)
    out = LE.ensemble_probability(d.filter("split = 'train'").withColumnRenamed("prob", "base"), d.filter("split = 'test'").withColumnRenamed("prob", "base"), "y", ["score", "base"])
    return M.calibration(out, ["grp"], "prob", "y")


@query("ml07_ridge_and_forest")
def _(t):
    d = scored(t)
    return LE.ridge_and_forest(d.filter("split = 'train'"), d.filter("split = 'test'"), ["score", "prob"], "ret_1w").select("date", "symbol", "predicted", "ret_1w")


_SPLIT_ROWS = f"(SELECT floor(score/4) AS a, CASE WHEN prob>=0.3 THEN round(prob,1) END AS b, y FROM {UP} WHERE date<=DATE '{A}')"
_SPLITS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {'1' if m else '0'} AS missing_left, v AS cut, count(*) FILTER ({c}) AS nl, coalesce(sum(p-y) FILTER ({c}),0) AS gl, count(*) AS n, sum(p-y) AS g, any_value(p*(1-p)) AS h FROM r, (SELECT DISTINCT {f} AS v FROM r WHERE {f} IS NOT NULL) GROUP BY v" for f in ("a", "b") for m in (False, True) for c in [f"{f}<=v" + (f" OR {f} IS NULL" if m else " AND TRUE")])


@query("ml06_first_split", fin("rows:i gain", f"""WITH r AS (SELECT *, avg(y) OVER () AS p FROM {_SPLIT_ROWS}), s AS ({_SPLITS})
 SELECT n AS rows, round(max(gl*gl/(nl*h+0.8)+(g-gl)*(g-gl)/((n-nl)*h+0.8)-g*g/(n*h+0.8)),3) AS gain FROM s WHERE nl>=45 AND n-nl>=45 GROUP BY n"""))
def _(t):
    """The first split of a boosted tree has the highest gain of all cuts, missing values on either side."""
    d = up(t).filter(F.col("date") <= F.lit(A).cast("date")).select(F.floor(F.col("score") / 4).alias("a"), F.when(F.col("prob") >= 0.3, F.round("prob", 1)).alias("b"), "y")
    m = LE.histogram_boosted(d, ["a", "b"], "y", rounds=1, leaves=2, min_rows=45, l2=0.8)
    return d.agg(F.count(F.lit(1)).alias("rows")).withColumn("gain", F.round(F.lit(m.trees[0].gain[0] if m.trees else None).cast("double"), 3)).where("gain IS NOT NULL")


@query("ml06_extra_trees")
def _(t):
    """Discrimination of extra trees and of a forest on the same later rows."""
    d = scored(t).withColumnRenamed("prob", "base")
    fs = ["score", "base"]
    tr, te = d.filter("split = 'train'"), d.filter("split = 'valid'")
    p = staged(up_probability_of(tr, te, fs).withColumn("p_et", LE.extra_trees(tr, fs, "y").probability()))
    return PO.roc_auc(p, ["split"], "p_et", "y").withColumnRenamed("auc", "auc_extra").join(PO.roc_auc(p, ["split"], "p_rf", "y").withColumnRenamed("auc", "auc_forest"), "split")


def up_probability_of(train, test, features):
    fit = LE.forest("y", prob="p_rf").fit(LE.class_weights(LE.assembled(train, features), "y"))
    return LE.up_probability(fit.transform(LE.assembled(test, features)), "p_rf")


def graded(t):
    return t.weekly.withColumn("pct", S.pct_rank("ret_4w")).withColumn("grade", S.grade_ceil("pct")).filter("grade is not null")


@query("ml08_learning_to_rank")
def _(t):
    d = LE.time_split(graded(t), A, Z)
    out, _ = LE.ranker(d, ["score", "prob"], "grade")
    return LE.ndcg(out.filter("split = 'test'"), "rank_score", "grade", 5)


_GRADED = f"(SELECT *, {pctsql('ret_4w')} AS pct FROM {WEEKLY} WHERE ret_4w IS NOT NULL)"


@query("ml08_lambda_gradients", fin("date symbol gradient second", f"""WITH d AS (SELECT date, symbol, score/10 AS s, least(4,greatest(0,ceil(pct*5)-1)) AS y FROM {_GRADED}),
 r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, symbol) AS k, row_number() OVER (PARTITION BY date ORDER BY y DESC) AS b, max(s) OVER (PARTITION BY date)<>min(s) OVER (PARTITION BY date) AS spread FROM d),
 m AS (SELECT date, sum((pow(2,y)-1)/log2(b+1)) FILTER (b<=30) AS best FROM r GROUP BY date),
 p AS (SELECT x.date, x.symbol AS hi, z.symbol AS lo, abs(pow(2,x.y)-pow(2,z.y))*abs(1/log2(x.k+1)-1/log2(z.k+1))/m.best/(CASE WHEN x.spread THEN 0.01+abs(x.s-z.s) ELSE 1 END) AS delta, 1/(1+exp(x.s-z.s)) AS q FROM r x JOIN r z ON x.date=z.date AND x.y>z.y AND least(x.k,z.k)<=30 JOIN m ON m.date=x.date),
 t AS (SELECT date, 2*sum(q*delta) AS total FROM p GROUP BY date),
 e AS (SELECT date, hi AS symbol, -q*delta AS g, q*(1-q)*delta AS h FROM p UNION ALL SELECT date, lo, q*delta, q*(1-q)*delta FROM p)
 SELECT r.date, r.symbol, coalesce(sum(g)*any_value(log2(1+total)/total),0) AS gradient, coalesce(sum(h)*any_value(log2(1+total)/total),0) AS second FROM r LEFT JOIN e ON e.date=r.date AND e.symbol=r.symbol LEFT JOIN t ON t.date=r.date GROUP BY r.date, r.symbol"""))
def _(t):
    return TR.lambda_gradients(graded(t).withColumn("s", F.col("score") / 10), "s", "grade")


_WAS = "(SELECT a.t, p.x, sum(p.n) AS n, sum(p.s) AS s FROM (SELECT DISTINCT date AS t FROM u) a JOIN (SELECT date, x, count(*) AS n, sum(y) AS s FROM u GROUP BY 1,2) p ON p.date<a.t GROUP BY 1,2)"


@query("ml09_expanding_isotonic", fin("date symbol x calibrated", f"""WITH u AS (SELECT date, symbol, floor(prob*100)/100 AS x, y FROM {UP}), w AS {_WAS}, c AS (SELECT *, sum(n) OVER o AS cn, sum(s) OVER o AS cs FROM w WINDOW o AS (PARTITION BY t ORDER BY x)),
 i AS (SELECT a.t, a.x AS lo, b.x AS hi, min((b.cs-a.cs+a.s)/(b.cn-a.cn+a.n)::DOUBLE) OVER (PARTITION BY a.t, a.x ORDER BY b.x DESC) AS least FROM c a JOIN c b ON a.t=b.t AND a.x<=b.x),
 f AS (SELECT t, hi AS x, max(least) AS v FROM i GROUP BY 1,2), k AS (SELECT t, sum(n) AS n, sum(s) AS s FROM w GROUP BY t),
 q AS (SELECT DISTINCT date AS t, x FROM u), e AS (SELECT q.t, q.x, max(f.x) FILTER (f.x<=q.x) AS x1, min(f.x) FILTER (f.x>=q.x) AS x2 FROM q JOIN f ON f.t=q.t GROUP BY 1,2),
 v AS (SELECT e.t, e.x, CASE WHEN x1 IS NULL THEN b.v WHEN x2 IS NULL OR x1=x2 THEN a.v ELSE a.v+(b.v-a.v)*(e.x-x1)/(x2-x1) END AS v FROM e LEFT JOIN f a ON a.t=e.t AND a.x=x1 LEFT JOIN f b ON b.t=e.t AND b.x=x2)
 SELECT u.date, symbol, u.x, CASE WHEN k.n>=260 AND k.s>0 AND k.s<k.n THEN v.v ELSE u.x END AS calibrated FROM u LEFT JOIN k ON k.t=u.date LEFT JOIN v ON v.t=u.date AND v.x=u.x"""))
def _(t):
    d = up(t).withColumn("x", F.floor(F.col("prob") * 100.0) / 100.0)
    return IS.expanding_isotonic(d, "x", "y").select("date", "symbol", "x", "calibrated")


@query("ml09_isotonic_calibration", fin("date symbol prob calibrated", f"""WITH w AS (SELECT prob AS x, count(*) AS n, sum(y) AS s FROM {UP} WHERE date<=DATE '{A}' GROUP BY 1), c AS (SELECT *, sum(n) OVER o AS cn, sum(s) OVER o AS cs FROM w WINDOW o AS (ORDER BY x)),
 i AS (SELECT a.x AS lo, b.x AS hi, min((b.cs-a.cs+a.s)/(b.cn-a.cn+a.n)::DOUBLE) OVER (PARTITION BY a.x ORDER BY b.x DESC) AS least FROM c a JOIN c b ON a.x<=b.x), f AS (SELECT hi AS x, max(least) AS v FROM i GROUP BY 1),
 e AS (SELECT q.x, max(f.x) FILTER (f.x<=q.x) AS x1, min(f.x) FILTER (f.x>=q.x) AS x2 FROM (SELECT DISTINCT prob AS x FROM {UP} WHERE date>DATE '{A}') q, f GROUP BY 1)
 SELECT u.date, symbol, prob, CASE WHEN x1 IS NULL THEN b.v WHEN x2 IS NULL OR x1=x2 THEN a.v ELSE a.v+(b.v-a.v)*(prob-x1)/(x2-x1) END AS calibrated FROM {UP} u JOIN e ON e.x=u.prob LEFT JOIN f a ON a.x=x1 LEFT JOIN f b ON b.x=x2 WHERE u.date>DATE '{A}'"""))
def _(t):
    d = scored(t)
    return LE.isotonic(d.filter("split = 'train'"), d.filter("split <> 'train'"), "prob", "y").select("date", "symbol", "prob", "calibrated")


@query("ml10_binned_shrinkage_calibration", fin("date symbol c", f"""WITH tr AS MATERIALIZED (SELECT * FROM {UP} WHERE date<=DATE '{A}'), e AS (SELECT list_distinct(quantile_cont(prob, {[i / 8 for i in range(1, 8)]}::DOUBLE[])) AS ee, avg(y) AS base FROM tr),
 b AS (SELECT date, symbol, grp, y, len(list_filter(ee, lambda x: x<prob)) AS b, base, date<=DATE '{A}' AS t FROM {UP}, e), g AS (SELECT b, avg(y) AS m, count(*) AS c FROM b WHERE t GROUP BY b), gg AS (SELECT grp, b, avg(y) AS m, count(*) AS c FROM b WHERE t GROUP BY 1,2 HAVING count(*)>=40)
 SELECT date, symbol, least(0.98,greatest(0.02,least(coalesce(gg.c,g.c,0)/180.0,1)*coalesce(gg.m,g.m,base)+(1-least(coalesce(gg.c,g.c,0)/180.0,1))*base)) AS c FROM b LEFT JOIN g ON g.b=b.b LEFT JOIN gg ON gg.grp=b.grp AND gg.b=b.b WHERE NOT t"""))
def _(t):
    d = scored(t)
    return LE.binned_calibration(d.filter("split = 'train'"), d.filter("split <> 'train'"), "prob", "y", "grp", out="c").select("date", "symbol", "c")


@query("ml11_platt_calibration")
def _(t):
    d = scored(t)
    return LE.platt(d.filter("split = 'train'"), d.filter("split <> 'train'"), "score", "y").select("date", "symbol", "score", "calibrated")


@query("ml12_probability_blend", fin("date symbol p", f"SELECT date, symbol, least(1,greatest(0,0.46*prob+0.32*least(1,greatest(0,coalesce(ret_1w,0)))+0.12*score/100+0.10*score/100)) AS p FROM {WEEKLY}"))
def _(t):
    c = F.col
    return t.weekly.select("date", "symbol", LE.probability_blend(c("prob"), c("ret_1w"), c("score"), c("score")).alias("p"))


@query("ml13_mixture_regimes")
def _(t):
    from tideframe.plans.assets import label_clusters
    f = [f"r_{x}" for x in FEATS]
    m = LE.mixture_regimes(riskon(t), f)
    return m.groupBy("state").agg(F.count(F.lit(1)).alias("days"), F.avg(F.array_max("probabilities")).alias("confidence")).join(label_clusters(m, "state", f), "state")


def returns(t):
    d = t.brand.select("date", "symbol", clip(R.step_return("close", 1, R.by_entity()), -1, 1).alias("r1"), clip(R.step_return("close", 5, R.by_entity()), -1, 1).alias("r5")).dropna()
    st = LE.robust_stats(d.filter(F.col("date") <= F.lit(A).cast("date")), ["r1", "r5"])
    return LE.robust_scale(d, st, ["r1", "r5"])


def windows(t, n=10):
    return LE.sliding_windows(returns(t), ["r1", "r5"], n)


@query("ml14_vector_quantisation")
def _(t):
    w = windows(t)
    q = LE.quantise(w.filter(F.col("date") <= F.lit(A).cast("date")), w, "window", 6)
    return q.groupBy("vq_state").agg(F.count(F.lit(1)).alias("n"), F.avg("vq_distance").alias("mean_distance"))


def embedded(t):
    d = staged(returns(t))
    _, components = LE.window_components(d, ["r1", "r5"], 10, 4, F.col("date") <= F.lit(A).cast("date"))
    return LE.embed(d, ["r1", "r5"], 10, components)


@query("ml15_gaussian_confidence")
def _(t):
    e = embedded(t)
    return LE.gaussian_confidence(e.filter(F.col("date") <= F.lit(A).cast("date")), e, "embedding").select("date", "symbol", "loglik", "confidence")


_RSQ = lambda c: f"least(8,greatest(-8,coalesce(({c}-m_{c})/coalesce(nullif(q_{c},0),nullif(sd_{c},0),1),0)))"


@query("ml16_robust_scaling", fin("date VIX GOLD", f"SELECT date, {_RSQ('VIX')} AS VIX, {_RSQ('GOLD')} AS GOLD FROM {WIDE}, (SELECT {', '.join(f'median({c}) AS m_{c}, quantile_cont({c},0.75::DOUBLE)-quantile_cont({c},0.25::DOUBLE) AS q_{c}, stddev_samp({c}) AS sd_{c}' for c in ('VIX', 'GOLD'))} FROM {WIDE} WHERE date<=DATE '{A}')"))
def _(t):
    d = wide(t).select("date", "VIX", "GOLD")
    return LE.robust_scale(d, LE.robust_stats(d.filter(F.col("date") <= F.lit(A).cast("date")), ["VIX", "GOLD"]), ["VIX", "GOLD"])


@query("ml17_sliding_windows", fin("date symbol row_position:i first_v last_v size:i", f"SELECT date, symbol, p-1 AS row_position, f AS first_v, close AS last_v, 10 AS size FROM (SELECT *, row_number() OVER w AS p, lag(close,4) OVER w AS f FROM {BRAND} WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE p>=5"))
def _(t):
    w = LE.sliding_windows(t.brand.withColumn("c2", F.col("close") / 2), ["close", "c2"], 5)
    return w.select("date", "symbol", "row_position", F.col("window")[0].alias("first_v"), F.col("window")[8].alias("last_v"), F.size("window").alias("size"))


@query("ml18_window_embedding")
def _(t):
    return embedded(t).select("date", "symbol", *[F.col("embedding")[i].alias(f"e{i}") for i in range(4)])


@query("ml19_minority_oversampling", fin("y:i n:i inside:i fresh:i", f"SELECT y, max(count(*)) OVER () AS n, true AS inside, true AS fresh FROM (SELECT (ret_1w>0.5)::INT AS y FROM {WEEKLY} WHERE ret_1w IS NOT NULL) GROUP BY y"))
def _(t):
    """Besides the counts: synthetic points lie within the bounds of their class, and few repeat."""
    d = up(t).withColumns({"y": (F.col("ret_1w") > 0.5).cast("int"), "v": F.array("score", "prob")})
    o = LE.oversample(d, "y", "v", ["date", "symbol"])
    of = lambda f, s, k: f(F.when(F.col("synthetic") == s, F.col("v")[k]))
    inside = F.lit(True)
    for k in (0, 1):
        inside = inside & F.coalesce((of(F.min, 1, k) >= of(F.min, 0, k)) & (of(F.max, 1, k) <= of(F.max, 0, k)), F.lit(True))
    made = F.count_if(F.col("synthetic") == 1)
    fresh = F.count_distinct(F.when(F.col("synthetic") == 1, F.col("v"))) * 2 >= made
    return o.groupBy("y").agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), fresh.alias("fresh"))


def fits(t):
    return B.bubble_fits(B.price_windows(t.brand, 504, 21))


@query("ml20_bubble_fits")
def _(t):
    return fits(t)


@query("ml21_fit_reliability_and_ensemble")
def _(t):
    y = t.brand.select("symbol", F.col("date").alias("asof"), LB.crash_after_peak("close", F.dayofmonth("date"), R.by_entity()).cast("int").alias("y"))
    f = staged(fits(t).join(y, ["symbol", "asof"]))
    return B.ensemble(B.learned_reliability(f, "y"))


@query("ml22_driver_screening")
def _(t):
    m = P.at_rebalance(t.drivers, "M").select("date", "driver", F.col("level").alias("value"))
    tg = P.at_rebalance(t.market, "M").select("date", R.step_return("close", 12, R.day()).alias("target"))
    return B.driver_screen(m.join(tg, "date"))


@query("ml23_feature_importance")
def _(t):
    d = scored(t).withColumnRenamed("prob", "base")
    fs = ["score", "base"]
    tr = LE.class_weights(LE.assembled(d.filter("split = 'train'"), fs), "y")
    rf, lg = LE.forest("y").fit(tr), LE.logistic("y").fit(tr)
    perm = LE.permutation_importance(rf, d.filter("split = 'valid'"), fs, "y", ["date", "symbol"])
    gains = t.spark.createDataFrame([(f, float(rf.featureImportances[i]), abs(float(lg.stages[-1].coefficients[i]))) for i, f in enumerate(fs)], "feature string, gain double, coefficient double")
    return gains.join(perm, "feature")


@query("ml24_score_current_batch")
def _(t):
    from pyspark.ml import PipelineModel
    from tideframe.sources.tables import scratch
    d = scored(t).withColumnRenamed("prob", "base")
    fs = ["score", "base"]
    path = scratch(t.spark, "model")
    LE.logistic("y").fit(LE.class_weights(LE.assembled(d.filter("split = 'train'"), fs), "y")).write().overwrite().save(path)
    now = T.latest_batch(t.weekly).withColumnRenamed("prob", "base")
    p = LE.up_probability(PipelineModel.load(path).transform(LE.assembled(now, fs)))
    return p.select("date", "symbol", "prob", TH.stage_of("prob", 0.45, 0.50, 0.55).alias("stage"))


@query("ml25_champion_challenger", fin("grp best_model:s base_primary best_primary delta_secondary decision:s", f"""WITH r AS (SELECT grp, m AS model, avg((ret_1w>0)::INT) AS p, avg(ret_1w) AS s FROM (SELECT grp, ret_1w, unnest(['baseline','high','prob']) AS m, unnest([true, score>=55, prob>=0.6]) AS k FROM {UP}) WHERE k GROUP BY 1,2), b AS (SELECT * FROM r WHERE model='baseline'), x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, model DESC) AS rn FROM r)
 SELECT b.grp, x.model AS best_model, b.p AS base_primary, x.p AS best_primary, x.s-b.s AS delta_secondary, CASE WHEN x.model<>'baseline' AND x.p-b.p>=0.01 AND x.s-b.s>=-0.5 THEN 'adopt' ELSE 'keep_baseline' END AS decision FROM b JOIN x ON x.grp=b.grp AND rn=1"""))
def _(t):
    rows = up(t).select("grp", "ret_1w", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("k")) for n, c in (("baseline", F.lit(True)), ("high", F.col("score") >= 55), ("prob", F.col("prob") >= 0.6))])).alias("m")).select("grp", "ret_1w", "y", "m.*").filter("k")
    res = rows.groupBy("grp", "model").agg(F.avg(F.col("y").cast("double")).alias("p"), F.avg("ret_1w").alias("s"))
    return LE.adoption(res, "grp", "model", "p", "s", 0.01, -0.5).select("grp", "best_model", "base_primary", "best_primary", "delta_secondary", "decision")
