"""2.6 Cross-sectional windows."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R
from tideframe.functions.scalar import ratio, tanh_score
from tideframe.operators import xsec as S
from tideframe.plans.fixtures import ETF, WEEKLY

_R20 = f"(SELECT date, symbol, grp, close/lag(close,20) OVER (PARTITION BY symbol ORDER BY date)-1 AS r FROM {ETF})"


def r20(t):
    return t.etf.select("date", "symbol", "grp", R.step_return("close", 20, R.by_entity()).alias("r"))


def zsql(x="r", part="date", fn="stddev_samp"):
    return f"coalesce(({x}-avg({x}) OVER (PARTITION BY {part}))/nullif({fn}({x}) OVER (PARTITION BY {part}),0),0)"


def wins(min_group):
    keep = f"n>={min_group}" if min_group else "true"
    return f"""SELECT date, symbol, {zsql('c')} AS z_r FROM (SELECT *, CASE WHEN r IS NOT NULL AND {keep} THEN least(greatest(r,lo),hi) ELSE r END AS c
 FROM (SELECT a.*, q.* EXCLUDE (date) FROM {_R20} a LEFT JOIN (SELECT date, quantile_cont(r,0.01) AS lo, quantile_cont(r,0.99) AS hi, count(r) AS n FROM {_R20} GROUP BY date) q ON a.date=q.date))"""


@query("xs01_winsorized_zscore_gated", fin("date symbol z_r", wins(20)))
def _(t):
    return S.winsorized_z(r20(t), ["r"], 20).select("date", "symbol", "z_r")


@query("xs02_winsorized_zscore", fin("date symbol z_r", wins(None)))
def _(t):
    return S.winsorized_z(r20(t), ["r"], None).select("date", "symbol", "z_r")


@query("xs03_zscore", fin("date symbol z", f"SELECT date, symbol, {zsql()} AS z FROM {_R20}"))
def _(t):
    return r20(t).select("date", "symbol", S.z("r", S.by_date()).alias("z"))


@query("xs04_zscore_population", fin("date symbol z", f"SELECT date, symbol, {zsql(fn='stddev_pop')} AS z FROM {_R20}"))
def _(t):
    return r20(t).select("date", "symbol", S.z("r", S.by_date(), population=True).alias("z"))


@query("xs05_grouped_zscore_with_fallback", fin("date symbol z", f"SELECT date, symbol, CASE WHEN count(r) OVER (PARTITION BY date, grp)>=3 THEN {zsql(part='date, grp')} ELSE {zsql()} END AS z FROM {_R20}"))
def _(t):
    return r20(t).select("date", "symbol", S.grouped_z("r", "grp").alias("z"))


@query("xs06_first_come_rank", fin("date symbol rk:i rk_grp:i", f"""SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, symbol) AS rk,
 row_number() OVER (PARTITION BY date, grp ORDER BY score DESC NULLS LAST, symbol) AS rk_grp FROM {WEEKLY}"""))
def _(t):
    return t.weekly.select("date", "symbol", S.first_come_rank("score").alias("rk"), S.first_come_rank("score", ("date", "grp")).alias("rk_grp"))


def pctsql(x, part="date"):
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST)"
            f"+(count({x}) OVER (PARTITION BY {part}, {x})-1)/2.0)/count({x}) OVER (PARTITION BY {part}) END")


@query("xs07_percent_rank_average_ties", fin("date symbol pct", f"SELECT date, symbol, {pctsql('score')} AS pct FROM {WEEKLY}"))
def _(t):
    return t.weekly.select("date", "symbol", S.pct_rank("score").alias("pct"))


@query("xs08_rank_label_floor", fin("date symbol label:i", f"SELECT date, symbol, least(4, floor(coalesce(p,0)*5)) AS label FROM (SELECT date, symbol, {pctsql('ret_4w')} AS p FROM {WEEKLY})"))
def _(t):
    return t.weekly.withColumn("p", S.pct_rank("ret_4w")).select("date", "symbol", S.grade_floor("p").alias("label"))


@query("xs09_rank_label_ceil", fin("date symbol label:i", f"SELECT date, symbol, greatest(0, least(4, ceil(p*5)-1)) AS label FROM (SELECT date, symbol, {pctsql('ret_4w', 'date, grp')} AS p FROM {WEEKLY}) WHERE p IS NOT NULL"))
def _(t):
    return (t.weekly.withColumn("p", S.pct_rank("ret_4w", ("date", "grp"))).filter("p is not null")
            .select("date", "symbol", S.grade_ceil("p").alias("label")))


@query("xs10_score_context", fin("date symbol s_rank:i s_size:i s_rank_pct s_z s_gap s_std", f"""SELECT date, symbol, s_rank, s_size,
 coalesce(1-(s_rank-1)::DOUBLE/nullif(s_size-1,0),1) AS s_rank_pct, {zsql('score', 'date, grp')} AS s_z, mx-score AS s_gap,
 coalesce(stddev_samp(score) OVER (PARTITION BY date, grp),0) AS s_std
 FROM (SELECT *, row_number() OVER (PARTITION BY date, grp ORDER BY score DESC, symbol) AS s_rank, count(*) OVER (PARTITION BY date, grp) AS s_size,
 max(score) OVER (PARTITION BY date, grp) AS mx FROM {WEEKLY})"""))
def _(t):
    return S.score_context(t.weekly, "score", "grp", "s").select("date", "symbol", "s_rank", "s_size", "s_rank_pct", "s_z", "s_gap", "s_std")


@query("xs11_inverted_percentile_score", fin("date symbol up down", f"SELECT date, symbol, least(100,greatest(0,p*100)) AS up, least(100,greatest(0,101-p*100)) AS down FROM (SELECT date, symbol, {pctsql('score')} AS p FROM {WEEKLY})"))
def _(t):
    return t.weekly.withColumn("p", S.pct_rank("score")).select("date", "symbol", S.inverted_score("p", False).alias("up"), S.inverted_score("p", True).alias("down"))


@query("xs12_group_size_filter", fin("date symbol grp", f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date, grp) AS n FROM {WEEKLY}) WHERE n>=4"))
def _(t):
    return S.min_names(t.weekly, 4, ("date", "grp")).select("date", "symbol", "grp")


@query("xs13_tanh_scaling", fin("date symbol s100", f"SELECT date, symbol, 50+18*tanh({zsql('score', fn='stddev_pop')}/2) AS s100 FROM {WEEKLY}"))
def _(t):
    return t.weekly.select("date", "symbol", tanh_score(S.z("score", S.by_date(), population=True)).alias("s100"))
