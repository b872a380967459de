"""2.10 Order-dependent operators."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip
from tideframe.operators import allocation as AL, asof as A, folds as FO, xsec as S
from tideframe.operators.thresholds import stage_of
from tideframe.plans.fixtures import BARS, BRAND, MARKET, RISK, WEEKLY

def ema_sql(src, spans, key="symbol", x="close"):
    """Recursive EMA over (key, date, x) of ``src``."""
    first = ", ".join(f"{x} AS e{s}" for s in spans)
    step = ", ".join(f"b.{x}*(2.0/{s + 1})+r.e{s}*(1-2.0/{s + 1}) AS e{s}" for s in spans)
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS n FROM {src}),
 r AS (SELECT {key}, date, n, {x}, {first} FROM base WHERE n=1 UNION ALL SELECT b.{key}, b.date, b.n, b.{x}, {step} FROM r JOIN base b ON b.{key}=r.{key} AND b.n=r.n+1)"""


@query("sf01_exponential_mean", fin("date symbol e3 e20", ema_sql(BRAND, [3, 20]) + " SELECT date, symbol, e3, CASE WHEN n>=20 THEN e20 END AS e20 FROM r", 5))
def _(t):
    d = FO.ema(FO.ema(t.brand, "close", 3, "e3"), "close", 20, "e20", min_periods=20)
    r5 = lambda c: (F.floor(F.col(c) * 1e5 + 0.5) / 1e5).alias(c)
    return d.select("date", "symbol", r5("e3"), r5("e20"))


_HY = f"""WITH RECURSIVE base AS MATERIALIZED (SELECT date, score AS v, row_number() OVER (ORDER BY date) AS n FROM {RISK}),
 r(date, n, st) AS (SELECT date, n, CASE WHEN v>=70 THEN 'Cash' WHEN v>=60 THEN 'De-risk' WHEN v>=50 THEN 'Watch' ELSE 'Normal' END FROM base WHERE n=1
 UNION ALL SELECT b.date, b.n, CASE WHEN r.st='Cash' AND b.v>=55 THEN 'Cash' WHEN b.v>=70 THEN 'Cash' WHEN b.v>=60 THEN 'De-risk' WHEN r.st='De-risk' AND b.v>=45 THEN 'De-risk' WHEN b.v>=50 THEN 'Watch' ELSE 'Normal' END
 FROM r JOIN base b ON b.n=r.n+1)"""


@query("sf02_hysteresis_states", fin("date state:s", _HY + " SELECT date, st AS state FROM r"))
def _(t):
    return FO.hysteresis(t.risk, "score", 50, 60, 70).select("date", "state")


_ST = f"(SELECT date, CASE WHEN score<50 THEN 'Normal' WHEN score<60 THEN 'Watch' WHEN score<70 THEN 'De-risk' ELSE 'Cash' END AS st FROM {RISK})"


@query("sf03_contiguous_runs", fin("start_date end_date st:s days:i", f"""SELECT min(date) AS start_date, max(date) AS end_date, any_value(st) AS st, count(*) AS days FROM
 (SELECT *, row_number() OVER (ORDER BY date)-row_number() OVER (PARTITION BY st ORDER BY date) AS g FROM {_ST}) GROUP BY st, g"""))
def _(t):
    return FO.runs(t.risk.select("date", stage_of("score", 50, 60, 70).alias("st")), "st")


def _greedy(gap, pos):
    at = "pos" if pos else "date"
    diff = f"e.pos-r.pos>={gap}" if pos else f"date_diff('day', r.date, e.date)>={gap}"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT date, pos FROM (SELECT date, score>=60 AS y, lag(score>=60) OVER (ORDER BY date) AS p, row_number() OVER (ORDER BY date)-1 AS pos FROM {RISK}) WHERE y AND NOT coalesce(p,false)),
 r AS (SELECT arg_min(date,pos) AS date, min(pos) AS pos FROM e UNION ALL SELECT date, pos FROM (SELECT e.date, e.pos FROM r JOIN e ON {diff} ORDER BY e.pos LIMIT 1))
 SELECT date, pos FROM r"""


@query("sf04_episode_starts_days", fin("date pos:i", _greedy(30, False)))
def _(t):
    return FO.episode_starts(t.risk.withColumn("y", F.col("score") >= 60), "y", 30)


@query("sf04_episode_starts_rows", fin("date pos:i", _greedy(15, True)))
def _(t):
    return FO.episode_starts(t.risk.withColumn("y", F.col("score") >= 60), "y", 15, by_rows=True)


@query("sf05_episodes_with_warning", fin("episode_date detected:i first_warning:t lead_days:i max_score", f"""SELECT date AS episode_date, fw IS NOT NULL AS detected, fw AS first_warning, date_diff('day', fw, date) AS lead_days, ms AS max_score FROM
 (SELECT *, lag(y) OVER (ORDER BY date) AS p, min(date) FILTER (score>=60) OVER w AS fw, max(score) OVER w AS ms FROM (SELECT date, score, close/lag(close,5) OVER (ORDER BY date)-1<-0.05 AS y FROM {RISK}) WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND CURRENT ROW)) WHERE y AND NOT coalesce(p,false)"""))
def _(t):
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = t.risk.withColumns({"y": F.coalesce(R.step_return("close", 5, w) < -0.05, F.lit(False)), "warn": F.col("score") >= 60})
    return FO.episodes_with_warning(d, "y", "warn", "score", 28)


RISK_NAMES, SAFE_NAMES = list(AL.RISK_BASKETS), list(AL.SAFE_BASKETS)


def sleeves(t):
    """Weekly panel with baskets, segments, scores and the risk stage of the date."""
    n = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    seg = F.when(n % 2 == 0, "risk").otherwise("safe")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % 5 + 1).cast("int"))
    d = t.weekly.withColumns({"segment": seg, "basket": F.when(seg == "risk", pick(RISK_NAMES)).otherwise(pick(SAFE_NAMES))})
    d = A.asof_join(d, t.risk.select("date", F.col("score").alias("rs")))
    d = d.withColumns({"score_pct": S.pct_rank("score", ("date", "segment")), "risk_off_prob": F.coalesce(F.col("rs") / 100, F.lit(0.0)), "risk_off_alert": F.lit(0),
                       "risk_off_stage": F.coalesce(stage_of("rs", 50, 60, 70), F.lit("Normal"))})
    return d


_CAPS = "CASE basket " + " ".join(f"WHEN '{b}' THEN {c}" for b, c in {**AL.RISK_BASKETS, **AL.SAFE_BASKETS}.items()) + " END"
SLEEVES = f"""(SELECT *, (rank() OVER (PARTITION BY date, segment ORDER BY score)+(count(*) OVER (PARTITION BY date, segment, score)-1)/2.0)/count(*) OVER (PARTITION BY date, segment) AS score_pct,
 CASE WHEN rs>=70 THEN 0.15 WHEN rs>=60 THEN 0.35 WHEN rs>=50 THEN 0.5 WHEN coalesce(rs,0)>=38 THEN 0.5 ELSE 0.7 END AS risk_target FROM
 (SELECT w.*, r.score AS rs, CASE WHEN w.n%2=0 THEN 'risk' ELSE 'safe' END AS segment, CASE WHEN w.n%2=0 THEN {RISK_NAMES}[w.n%5+1] ELSE {SAFE_NAMES}[w.n%5+1] END AS basket
 FROM (SELECT *, CAST(regexp_extract(symbol,'([0-9]+)$',1) AS INT) AS n FROM {WEEKLY}) w ASOF LEFT JOIN {RISK} r ON w.date>=r.date))"""
# Closed-form check of the greedy walk: k-th row of a basket takes what is left of the cap, then the target cuts.
ALLOC = f"""(SELECT *, greatest(0,least(part, target-coalesce(sum(part) OVER (PARTITION BY date, segment ORDER BY score_pct DESC, score DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))) AS weight FROM
 (SELECT *, greatest(0,least(0.2, cap-(k-1)*0.2)) AS part FROM (SELECT *, {_CAPS} AS cap, CASE WHEN segment='risk' THEN risk_target ELSE 1-risk_target END AS target,
 row_number() OVER (PARTITION BY date, segment, basket ORDER BY score_pct DESC, score DESC, symbol) AS k FROM {SLEEVES})))"""


@query("sf06_capped_allocation", fin("date symbol basket:s weight", f"SELECT * FROM {ALLOC} WHERE weight>1e-9"))
def _(t):
    order = [F.desc("score_pct"), F.desc("score"), F.asc("symbol")]
    d = sleeves(t).withColumn("risk_target", AL.risk_budget("risk_off_stage", "risk_off_prob", "risk_off_alert"))
    d = d.withColumn("safe_target", 1 - F.col("risk_target"))
    a = AL.allocate(d.filter("segment = 'risk'"), "risk_target", AL.RISK_BASKETS, order).unionByName(AL.allocate(d.filter("segment = 'safe'"), "safe_target", AL.SAFE_BASKETS, order))
    return a.select("date", "symbol", "basket", "weight")


PARKED = f"""(WITH a AS (SELECT * FROM {ALLOC} WHERE weight>1e-9),
 f AS (SELECT *, CASE WHEN sum(weight) OVER d<0.999 THEN greatest(0,least(1-sum(weight) OVER d, 0.5-coalesce(sum(weight) FILTER (basket='{AL.SHORT_RATE}') OVER d,0))) ELSE 0 END AS fill, CASE WHEN basket='{AL.SHORT_RATE}' THEN 0.2-weight ELSE 0 END AS gap FROM a WINDOW d AS (PARTITION BY date)),
 p AS (SELECT date, symbol, segment, basket, ret_1w, rs, weight+greatest(0,least(gap, fill-coalesce(sum(gap) OVER (PARTITION BY date ORDER BY score_pct DESC, score DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))) AS weight FROM f)
 SELECT * FROM p UNION ALL SELECT date, '{AL.CASH}', 'cash', '현금', NULL, NULL, 1-sum(weight) FROM p GROUP BY date HAVING 1-sum(weight)>1e-6)"""


@query("sf07_parking_and_cash", fin("date symbol basket:s weight", f"SELECT * FROM {PARKED}"))
def _(t):
    return AL.allocate_dates(sleeves(t)).select("date", "symbol", "basket", "weight")


@query("sf08_refit_marks", fin("date st:s refit:i fit:i", f"""SELECT date, st, refit, sum(refit::INT) OVER (ORDER BY date) AS fit FROM (SELECT *, (pos-max(CASE WHEN flip THEN pos END) OVER (ORDER BY date))%5=0 AS refit FROM
 (SELECT *, coalesce(st<>lag(st) OVER (ORDER BY date), true) AS flip FROM (SELECT *, row_number() OVER (ORDER BY date)-1 AS pos FROM {_ST}) WHERE pos>=50))"""))
def _(t):
    return FO.refit_marks(t.risk.select("date", stage_of("score", 50, 60, 70).alias("st")), 5, "st", start=50).select("date", "st", "refit", "fit")


@query("sf09_obv", fin("date symbol obv", f"SELECT date, symbol, sum(v) OVER (PARTITION BY symbol ORDER BY date) AS obv FROM (SELECT *, coalesce(sign(close-lag(close) OVER (PARTITION BY symbol ORDER BY date)),0)*volume AS v FROM {BARS})"))
def _(t):
    return FO.obv(t.bars).select("date", "symbol", "obv")
