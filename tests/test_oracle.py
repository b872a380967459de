"""Registered queries against their DuckDB oracle, at a size at which frames of 252 rows are filled."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, norm

DIR = "/root/testdata/sf0.01"
# One or two of each section; check_oracle.py runs all of them.
NAMES = ["src09_incremental_load", "prj09_coverage_filter", "jn06_asof_per_key", "jn08_validity_interval_join", "ag02_grouping_sets", "wn05_forward_min_strict", "xs07_percent_rank_average_ties",
         "tk02_group_leaders_then_top", "st04_turnover", "fn17_resample_bars", "sf08_refit_marks", "tf12_pivots", "cp08_driver_features", "lb03_event_loss_labels", "ml12_probability_blend", "ev06_threshold_sweep", "pf06_risk_gate",
         "wn14_rolling_percentile_rank", "jn04_asof_backward", "jn11_shared_dates", "cp24_rule_regime", "ml03_fold_fits", "ml06_first_split", "ml08_lambda_gradients", "ml09_expanding_isotonic", "nn02_neighbour_outcomes", "ev02_auc_and_average_precision"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert "weeks" in df.columns and df.count() > 0


def test_registry_loads_without_a_session_and_covers_the_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
