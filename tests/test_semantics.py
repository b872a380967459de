"""Hand frames for the rules that are easy to get wrong, and properties that must hold."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tideframe.functions import rolling as R, scalar as C, text as X
from tideframe.operators import allocation as AL, asof as A, bubble as B, factors as FA, folds as FO, labels as L, learn as LE, metrics as M, panel as P, pooled as PO, quality as Q, states, sweep as SW, thresholds as TH, topk as T, xsec as S
from tideframe.sources import tables as SRC

D0 = dt.date(2020, 1, 6)


def day(i):
    return D0 + dt.timedelta(days=i)


def series(spark, values, symbol="A", name="close"):
    return spark.createDataFrame([(day(i), symbol, None if v is None else float(v)) for i, v in enumerate(values)], f"date date, symbol string, {name} double")


def values(df, col, order="date"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_padded_change_differs_from_shift_ratio(spark):
    w = R.by_entity()
    d = series(spark, [10, None, 20, 30])
    raw = values(d.select("date", R.step_return("close", 1, w).alias("r")), "r")
    pad = values(d.withColumn("f", R.padded("close", w)).select("date", R.step_return("f", 1, w).alias("r")), "r")
    assert raw == [None, None, None, 0.5] and pad == [None, 0.0, 1.0, 0.5]


def test_forward_minimum_forms(spark):
    w = R.by_entity()
    d = series(spark, [10, 8, 9, 12, 6]).select("date", R.forward_min_strict("close", 4, w).alias("s"), R.forward_min_any("close", 4, w).alias("a"))
    assert values(d, "s") == pytest.approx([-0.4, -0.25, None, None, None], nan_ok=True) or values(d, "s")[2:] == [None, None, None]
    assert values(d, "a")[3] == pytest.approx(-0.5) and values(d, "a")[4] is None


def test_limited_fill_stops_after_the_limit(spark):
    a = series(spark, [1] + [None] * 7 + [2], "A").filter("close is not null")
    b = series(spark, range(1, 10), "B")
    got = P.on_calendar(a.unionByName(b), "close", limit=5).filter("symbol = 'A'")
    assert values(got, "close") == [1, 1, 1, 1, 1, 1, None, None, 2]


def test_asof_equality_tolerance_and_key(spark):
    left = spark.createDataFrame([(day(5), "A"), (day(30), "A"), (day(5), "B")], "date date, symbol string")
    right = spark.createDataFrame([(day(5), "A", 1), (day(6), "A", 2)], "date date, symbol string, v int")
    got = {(r["date"], r["symbol"]): r["v"] for r in A.asof_join(left, right, by=("symbol",), tolerance_days=10).collect()}
    assert got == {(day(5), "A"): 1, (day(30), "A"): None, (day(5), "B"): None}


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(1)
    left = [(day(rng.randrange(400)), rng.choice("AB")) for _ in range(80)]
    iv = [(k, day(s), day(s + n) if n else None) for k in "AB" for s, n in [(0, 40), (40, 150), (190, 0)]]
    l = spark.createDataFrame(left, "date date, k string")
    r = spark.createDataFrame(iv, "k string, valid_from date, valid_to date")
    got = sorted((x["date"], x["k"], x["valid_from"]) for x in A.interval_join(l, r, ("k",)).collect())
    want = sorted((d, k, s) for d, k in left for kk, s, e in iv if k == kk and s <= d and (e is None or d < e))
    assert got == want


def test_percent_rank_is_average_tied_and_grades_differ_at_edges(spark):
    d = spark.createDataFrame([(D0, s, v) for s, v in zip("ABCDE", [1.0, 2.0, 2.0, 3.0, None])], "date date, symbol string, v double")
    d = d.withColumn("p", S.pct_rank("v"))
    got = {r["symbol"]: (r["p"], r["f"], r["c"]) for r in d.select("symbol", "p", S.grade_floor("p").alias("f"), S.grade_ceil("p").alias("c")).collect()}
    assert got["B"][0] == got["C"][0] == 2.5 / 4 and got["E"] == (None, 0, None)
    assert got["D"] == (1.0, 4, 4) and got["A"][:1] == (0.25,)


def test_nan_is_nullified(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    assert Q.nullify(d, ["v"]).agg(F.avg("v")).first()[0] == 1.0


def test_ema_equals_recursion_on_a_long_series(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(100, 20, 3000)
    pdf = pd.DataFrame({"date": pd.date_range("2000-01-01", periods=3000).date, "symbol": "A", "close": x})
    d = spark.createDataFrame(pdf)
    for span in (3, 26, 200):
        got = np.array(values(FO.ema(d, "close", span, "e").select("date", "e"), "e"))
        want = pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()
        assert np.allclose(got, want, rtol=1e-12)


def test_hysteresis_equals_the_row_loop(spark):
    rng = random.Random(3)
    v = [rng.uniform(30, 80) for _ in range(600)]
    prev, want = "Normal", []
    for x in v:
        st = "Cash" if x >= 70 else "De-risk" if x >= 60 else "Watch" if x >= 50 else "Normal"
        if prev == "Cash" and x >= 55:
            st = "Cash"
        elif prev == "De-risk" and x >= 45 and st != "Cash":
            st = "De-risk"
        want.append(st)
        prev = st
    assert values(FO.hysteresis(series(spark, v, name="s"), "s", 50, 60, 70), "state") == want


def test_episode_gap_runs_from_the_last_accepted_start(spark):
    y = [0] * 80
    for i in (2, 12, 22, 34, 60):
        y[i] = 1
    got = values(FO.episode_starts(series(spark, y, name="y"), "y", 20), "date")
    assert got == [day(2), day(22), day(60)]


def greedy(rows, target, caps, row_cap=0.2):
    used, left, out = {}, target, {}
    for sym, b in rows:
        w = min(row_cap, caps.get(b, 0) - used.get(b, 0), left)
        if w > 1e-9:
            out[sym] = w
            used[b] = used.get(b, 0) + w
            left -= w
        if left <= 1e-9:
            break
    return out


def test_allocation_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    caps = {"a": 0.30, "b": 0.15, "c": 0.50}
    data, want = [], {}
    for t in range(30):
        rows = [(f"S{i:02d}", rng.choice("abcx")) for i in range(25)]
        target = rng.choice([0.15, 0.35, 0.7, 1.0])
        data += [(day(t), s, b, float(-i), target) for i, (s, b) in enumerate(rows)]
        want[day(t)] = greedy(rows, target, caps)
    d = spark.createDataFrame(data, "date date, symbol string, basket string, score double, target double")
    got = {}
    for r in AL.allocate(d, "target", caps, [F.desc("score"), F.asc("symbol")]).collect():
        got.setdefault(r["date"], {})[r["symbol"]] = r["weight"]
    assert got.keys() == want.keys()
    for t in want:
        assert got[t].keys() == want[t].keys() and all(abs(got[t][s] - want[t][s]) < 1e-12 for s in want[t])


def test_null_forward_is_a_zero_label_or_missing(spark):
    d = spark.createDataFrame([(-0.1,), (0.1,), (None,)], "r double")
    assert [r[0] for r in d.select(L.label(F.col("r") < 0)).collect()] == [1, 0, 0]
    assert [r[0] for r in d.select(L.label(F.col("r") < 0, null_label="null")).collect()] == [1, 0, None]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one score value hold about half of all rows."""
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        g = "hot" if i % 2 else rng.choice("abc")
        p = 0.5 if rng.random() < 0.4 else round(rng.random(), 4)
        rows.append((day(i % 50), f"S{i:05d}", g, p, int(rng.random() < p)))
    return spark.createDataFrame(rows, "date date, symbol string, g string, p double, y int"), pd.DataFrame(rows, columns=["date", "symbol", "g", "p", "y"])


def test_pooled_statistics_under_skew(skewed):
    df, pdf = skewed
    auc = {r["g"]: r["auc"] for r in PO.roc_auc(df, ["g"], "p", "y").collect()}
    quant = {(r["g"], r["q"]): r["value"] for r in PO.exact_quantiles(df, ["g"], "p", [0.1, 0.5, 0.95]).collect()}
    for g, part in pdf.groupby("g"):
        r = part["p"].rank()
        n1, n0 = part["y"].sum(), (1 - part["y"]).sum()
        assert auc[g] == pytest.approx((r[part["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
        for q in (0.1, 0.5, 0.95):
            assert quant[(g, q)] == pytest.approx(part["p"].quantile(q))


def test_row_ranks_are_a_permutation(skewed):
    df, pdf = skewed
    got = PO.row_ranks(df, ["g"], "p").toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["p", "date", "symbol"])
        assert list(part["rank"]) == list(range(1, len(part) + 1))


def test_prior_state_stats_match_a_row_loop(skewed):
    df, pdf = skewed
    got = states.prior_state_stats(df.withColumn("t", F.col("p") - 0.5), "g", "t").toPandas().sort_values(["date", "symbol"])
    for g, part in got.groupby("g"):
        want = part["t"].expanding().mean().shift(1)
        assert np.allclose(part["t_state_mean_prior"].astype(float), want.astype(float), equal_nan=True)
        assert list(part["t_state_count_prior"]) == list(range(len(part)))


def test_sweep_equals_brute_force(skewed):
    df, pdf = skewed
    grid = [0.1, 0.5, 0.5001, 0.9, 1.5]
    for r in SW.sweep(df, ["g"], "p", grid, SW.confusion("y")).collect():
        part = pdf[(pdf["g"] == r["g"])]
        hit = part[part["p"] >= r["threshold"]]
        assert (r["n"], r["tp"], r["n_all"], r["tp_all"]) == (len(hit), hit["y"].sum(), len(part), part["y"].sum())


def test_halo_chunks_equal_one_window(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=500))], "pos long, v double")
    c = PO.with_halo(d, "pos", 64, 10)
    f = Window.partitionBy("chunk").orderBy("pos").rangeBetween(-9, 0)
    got = [r[0] for r in c.select("pos", "home", F.sum("v").over(f).alias("s")).filter("home").orderBy("pos").select("s").collect()]
    v = [r["v"] for r in d.orderBy("pos").collect()]
    want = [sum(v[max(0, i - 9):i + 1]) for i in range(500)]
    assert np.allclose(got, want)


def test_features_have_no_look_ahead(spark):
    rng = np.random.default_rng(4)
    d = series(spark, list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 320)))))
    cut = day(300)
    cols = ["ret_20", "vol20", "dd252", "technical_score", "risk_penalty"]
    full = FA.technical_panel(d).filter(F.col("date") <= F.lit(cut)).orderBy("date").select(cols).toPandas()
    part = FA.technical_panel(d.filter(F.col("date") <= F.lit(cut))).orderBy("date").select(cols).toPandas()
    pd.testing.assert_frame_equal(full, part)


def test_component_regression_handles_collinear_columns(spark):
    rng = np.random.default_rng(9)
    hp, r60 = rng.normal(size=12), rng.normal(size=12)
    y = 0.3 * hp + 0.5 * r60 + rng.normal(0, 0.01, 12)
    pdf = pd.DataFrame({"date": D0, "etf": "E", "y": y, "hp": hp, "ret60": r60, "rs60": r60 - 0.1, "weight": 1 / 12})
    from tideframe.operators.aggregates import component_regression
    r = component_regression(spark.createDataFrame(pdf)).first()
    assert r["r2"] > 0.99 and r["coef_ret60"] == pytest.approx(r["coef_rs60"], rel=1e-6)


def pivot_points(lows, highs, ind, order, recent):
    ok = [i for i, v in enumerate(ind) if v is not None]
    lows, highs, ind = [lows[i] for i in ok], [highs[i] for i in ok], [ind[i] for i in ok]
    if len(ind) < 8:
        return 0, 0
    rng = range(order, len(ind) - order)
    pair = lambda ps: (ps[-2], ps[-1]) if len(ps) > 1 and len(ind) - 1 - ps[-1] <= recent + order else None
    lo = pair([i for i in rng if lows[i] == min(lows[i - order:i + order + 1])])
    hi = pair([i for i in rng if highs[i] == max(highs[i - order:i + order + 1])])
    bull = bear = 0
    if lo:
        a, b = lo
        bull += 25 * (lows[b] < lows[a] and ind[b] > ind[a]) + 15 * (lows[b] > lows[a] and ind[b] < ind[a])
    if hi:
        a, b = hi
        bear += 25 * (highs[b] > highs[a] and ind[b] < ind[a]) + 15 * (highs[b] < highs[a] and ind[b] > ind[a])
    return bull, bear


def test_divergence_points_match_a_row_loop(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s in range(12):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 60)))
        for i in range(60):
            rows.append((day(7 * i), f"S{s}", float(c[i]), float(c[i] * (1 + abs(rng.normal(0, 0.02)))), float(c[i] * (1 - abs(rng.normal(0, 0.02)))), float(c[i]), float(rng.integers(50, 500))))
    bars = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double")
    got = {r["symbol"]: (r["x_bullish_divergence_score"], r["x_bearish_divergence_score"]) for r in FA.divergence(bars, 2, 5, "x").collect()}
    ind = FA.macd_hist(FA.daily(bars)).orderBy("symbol", "date").toPandas().astype(object).where(lambda d: d.notna(), None)
    for s, part in ind.groupby("symbol"):
        pts = [pivot_points(list(part["low"]), list(part["high"]), list(part[i]), 2, 5) for i in FA.INDICATORS]
        assert got[s] == (min(100, sum(p[0] for p in pts)), min(100, sum(p[1] for p in pts)))


def test_oversampling_balances_with_points_between_minority_rows(spark):
    d = spark.createDataFrame([(f"r{i}", int(i < 7), [float(i), float(i * i)]) for i in range(40)], "id string, y int, v array<double>")
    got = LE.oversample(d, "y", "v", ["id"]).toPandas()
    assert got.groupby("y").size().to_dict() == {0: 33, 1: 33}
    syn = got[got["synthetic"] == 1]["v"].apply(lambda v: v[0])
    assert len(syn) == 26 and syn.between(0, 6).all()


def test_bubble_fit_finds_the_critical_time():
    n, tc, beta, omega = 150, 170.0, 0.5, 8.0
    t = np.arange(n)
    tau = tc - t
    y = 8 - 0.3 * tau ** beta * (1 - 0.1 * np.cos(omega * np.log(tau)))
    best = B.fit_window(np.exp(y), 3, 120, 20, 1)[0]
    assert best["lppl_rmse"] < 0.02 and abs(best["lppl_tc"] - tc) < 25 and best["lppl_b"] < 0


def test_every_step_and_the_last_row_have_a_window_and_its_fits(spark):
    d = spark.range(70).select(F.lit("A").alias("symbol"), F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("date"), (100 + F.col("id") + 3 * F.sin("id")).alias("close"))
    w = B.price_windows(d, 30, 21)
    assert [str(r.asof) for r in w.orderBy("asof").collect()] == ["2020-02-11", "2020-03-03", "2020-03-10"]
    fits = B.bubble_fits(w, fits=20, population=40, generations=700).groupBy("asof").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fit").alias("k")).collect()
    assert [(r.n, r.k) for r in fits] == [(20, 20)] * 3


def test_lag_test_p_values():
    assert B.f_tail(4.0, 2, 20) == pytest.approx(0.0346, abs=5e-4)
    rng = np.random.default_rng(0)
    x = rng.normal(size=120)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + rng.normal(0, 0.3, 120)
    assert B.lag_test(y, x, 2) < 1e-6 and B.lag_test(rng.normal(size=120), x, 2) > 0.01


def test_ndcg_of_a_perfect_order_is_one(spark):
    d = spark.createDataFrame([(D0, s, float(g), g) for s, g in zip("ABCDE", [4, 3, 2, 1, 0])], "date date, symbol string, score double, g int")
    assert LE.ndcg(d, "score", "g", 3).first()["ndcg"] == pytest.approx(1.0)


def test_unknown_market_raises(spark):
    d = spark.createDataFrame([("E1", "JP", "B")], "etf_ticker string, market string, benchmark_ticker string")
    with pytest.raises(Exception, match="market must be KR or US"):
        SRC.valid_universe(d).collect()


def test_series_header_and_bom(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿observation_date,X\n2020-01-01,1.5\n2020-01-02,.\nbad,2\n".encode())
    got = SRC.read_series(spark, str(tmp_path / "s.csv"), "X").collect()
    assert [(r["date"], r["level"]) for r in got] == [(dt.date(2020, 1, 1), 1.5)]


def test_text_rules(spark):
    d = spark.createDataFrame([("(1,234.5)", "A005930", "500hk"), ("-", "7203T", "BRK/B")], "a string, b string, c string")
    r = d.select(X.amount("a"), X.component_ticker("b"), X.component_code("c")).collect()
    assert tuple(r[0]) == (-1234.5, "005930.KS", "500HK") and tuple(r[1]) == (None, "7203.T", "BRK-B")


def test_winsorised_z_gate(spark):
    d = spark.createDataFrame([(D0, f"S{i}", float(i)) for i in range(5)], "date date, symbol string, v double")
    z = [r["z_v"] for r in S.winsorized_z(d, ["v"], 20).orderBy("symbol").collect()]
    assert z == pytest.approx([(i - 2) / math.sqrt(2.5) for i in range(5)])
