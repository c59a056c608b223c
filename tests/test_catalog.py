"""The registry, and a few cheap queries against their reference SQL on the smallest folder."""

import os

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHEAP = ("a3_tag_fiscal_year", "b9_dedup_latest", "b15_dedup_accounting", "d7_churn_label", "d23_column_profile",
         "j8_facet_values", "k3_sales_trend_weekly", "l9_yoy_customers", "n3_assignment_history")


def test_every_reference_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    ours = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert ours <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
@pytest.mark.parametrize("name", CHEAP)
def test_matches_reference(spark, name):
    message, rows, _ = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert message == "" and rows > 0
