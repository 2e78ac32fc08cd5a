"""What the plans of the contract queries may and may not contain."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fieldglass.plans import QUERIES

SF = "/root/testdata/sf0.001"

#: Queries whose core is a stream of Arrow batches or a model fit.
PYTHON = {"pairwise_ratings", "tune_ratings", "current_ratings", "logistic_grid", "calibrators", "isotonic", "evaluate_holdout", "governance_report"}
#: Queries that run jobs or fit models while they are built.
EAGER = PYTHON | {"ratings_by_round", "fit_logistic", "backtest_logistic", "backtest_ridge", "oof_residuals", "ridge_coefficients", "gbt_time_cv", "tree_splits", "stream_archive", "archive_append"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pair_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "InPandas" not in text and "PythonUDF" not in text and "EvalPython" not in text


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(oracle_sql()) >= 100


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "best_unit_price" in df.columns


def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["rolling_prior"](spark, SF))
    assert "o_orderpriority" not in text and "o_orderstatus" not in text
    text = plan(QUERIES["asof_strict"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text


def test_top_rows_are_limited_before_the_exchange(spark):
    text = plan(QUERIES["top1_filtered"](spark, SF))
    assert text.count("WindowGroupLimit") == 2
