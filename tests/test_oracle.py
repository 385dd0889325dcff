"""Registered jobs against their DuckDB SQL on the driver tables.

By default a representative subset runs on sf0.001; set
TILLROLL_FULL_ORACLE=1 to run every registered job (the same comparison the
correctness gate makes; ``tests/oracle_check.py`` runs it at sf0.01).
"""

from __future__ import annotations

import os

import pytest

from given_tables import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E
from tillroll.registry import all_jobs, all_oracle_sql

SUBSET = [
    "v_customer_rfm", "v_sales_vs_target", "kpi_summary", "category_scorecard", "subcat_pareto",
    "state_market_class", "monthly_growth", "fiscal_quarter", "day_of_week", "category_month_pivot",
    "revenue_concentration", "top_customers", "ntile_artefact", "order_sequence", "first_vs_latest",
    "top3_per_state", "margin_quartiles", "target_half_trend", "category_mix",
    "dq_missing_scan", "dq_numeric_validity", "exc_breakdown", "build_fact_target",
    "assert_identity_unique", "val_results", "val_verdict",
]
NAMES = sorted(all_oracle_sql()) if os.environ.get("TILLROLL_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_sql():
    assert set(all_jobs()) == set(all_oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    problems, _ = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    first = df.schema
    assert df.count() == 8  # categories
    assert E.entry(spark).schema == first
