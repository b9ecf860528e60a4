"""Every registered query with SQL gives the rows DuckDB gives."""

from __future__ import annotations

import pytest
from compare import compare, duck
from paths import SMALL_DIR

from clickward.plans.queries import oracle_sql, queries

SQL = oracle_sql()
# Families with ordered or grouped work, run again with every group split.
SPLIT = [
    "src_row_cap",
    "stratified_sample",
    "tree_frame",
    "trust_features",
    "prior_counts",
    "prior_unique_single",
    "prior_unique_pair",
    "total_counts",
    "total_uniques",
    "cumcount_aliases",
    "prev_delta_ip",
    "prev_delta_ip_app",
    "next_delta_ip",
    "rule_uniqueness",
    "global_index",
    "temporal_split",
    "row_window_select",
    "bag_subsample",
    "oof_te_single",
    "oof_te_pair",
    "holdout_te",
    "rate_features",
    "pr_auc",
    "roc_points",
    "top_decile",
    "calibration_bins",
    "leaderboard",
    "merkle_root",
    "audit_chunks",
    "audit_verify",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    ok, note = compare(spark, con, SMALL_DIR, name, queries()[name], SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", SPLIT)
def test_same_rows_with_split_groups(spark, con, tight, name):
    ok, note = compare(spark, con, SMALL_DIR, name, queries()[name], SQL[name])
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())
