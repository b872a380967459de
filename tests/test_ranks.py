"""Frame ranks and as-of joins against plain loops."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import asof, ranks


def plain(values, n, current):
    out = []
    for i, v in enumerate(values):
        frame = [x for x in values[(0 if n is None else max(0, i + current - n)) : i + current] if not np.isnan(x)]
        out.append((sum(x < v for x in frame), sum(x <= v for x in frame), len(frame)))
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 37, 300])
def test_counts_equal_a_loop(size):
    rng = np.random.default_rng(size)
    values = np.where(rng.random(size) < 0.1, np.nan, np.round(rng.normal(size=size), 1))
    for n in (1, 5, 64, 1_000, None):
        for current in (True, False):
            below, upto, known = ranks.frame_counts(values, n, current)
            for k, (v, want) in enumerate(zip(values, plain(values.tolist(), n, current))):
                assert known[k] == want[2]
                if not np.isnan(v):
                    assert (below[k], upto[k]) == want[:2]


@pytest.mark.parametrize("run", [16, 8_192])
def test_runs_of_a_series_fit_together(spark, run):
    rnd = random.Random(4)
    rows = [(k, s, None if rnd.random() < 0.1 else round(rnd.gauss(0, 1), 1)) for s, m in (("a", 150), ("b", 1), (None, 40)) for k in range(m)]
    d = spark.createDataFrame(rows, "date int, symbol string, v double").where("symbol IS NOT NULL")
    got = ranks.ranked(d, {"t": ("v", 12, True), "p": ("v", 9, False), "e": ("v", None, False)}, ("symbol",), run=run).collect()
    assert len(got) == d.count()
    for symbol in "ab":
        series = [float("nan") if r[2] is None else r[2] for r in rows if r[1] == symbol]
        mine = sorted((r for r in got if r.symbol == symbol), key=lambda r: r.date)
        for name, n, current in (("t", 12, True), ("p", 9, False), ("e", None, False)):
            for r, want in zip(mine, plain(series, n, current)):
                assert r[f"{name}_known"] == want[2] and (r.v is None or (r[f"{name}_below"], r[f"{name}_upto"]) == want[:2])
    assert ranks.ranked(d.limit(0), {"t": ("v", 12, True)}, ("symbol",)).count() == 0


def test_asof_takes_one_right_row_per_date_and_spreads_over_months(spark):
    rnd = random.Random(8)
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k)
    right = [(day(rnd.randrange(900)), rnd.randrange(5), f"x{k}") for k in range(120)] + [(None, 1, "never")]
    left = [(day(rnd.randrange(-20, 1_000)), k) for k in range(300)] + [(None, -1)]
    r = spark.createDataFrame(right, "date date, a int, b string")
    joined = asof.asof_join(spark.createDataFrame(left, "date date, id int"), r).collect()
    assert len(joined) == len(left)
    for row in joined:
        before = [x for x in right if row.date and x[0] and x[0] <= row.date]
        want = max(before) if before else (None, None, None)
        assert (row.a, row.b) == want[1:]
    near = asof.asof_join(spark.createDataFrame(left, "date date, id int"), r, tolerance_days=3, matched="at").collect()
    assert all(row.at is None or 0 <= (row.date - row.at).days <= 3 for row in near)


def test_asof_of_a_long_side_runs_in_many_tasks(spark):
    right = spark.range(1_000_000).select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 4_000).cast("int")).alias("date"), F.col("id").alias("v"))
    left = spark.range(4_200).select(F.date_add(F.lit("1999-12-01").cast("date"), F.col("id").cast("int")).alias("date"))
    hit = asof.asof_keys(left, right)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "__m" in plan and "hashpartitioning(__m" in plan
    got = {str(r.date): r["__r"] for r in hit.collect()}
    assert got["1999-12-31"] is None and got["2000-01-01"].v == 996_000 and got["2011-05-20"].v == 999_999
