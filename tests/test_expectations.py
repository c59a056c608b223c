"""Expectations from what was noted while a table was written, and the finer levels of matching categories."""

from pyspark.sql import functions as F

from orderlens.operators import evaluation as ev
from orderlens.operators import products as pr
from orderlens.operators import profiling as pf
from orderlens.params import ModelParams
from orderlens.session import stage_observed


def test_noted_metrics_equal_a_scan(spark):
    df = spark.range(100).select(F.when(F.col("id") < 60, "small").otherwise("mid").alias("size_tier"), (F.col("id") % 3 - 1).cast("int").alias("churn_label"))
    table, noted = stage_observed(df, "noted", ev.table_metrics(df, ModelParams()))
    assert table.count() == 100 and noted["n_rows"] == 100
    assert noted["size_tier small"] == 60 and noted["size_tier large"] == 0
    rows = ev.expect_row_counts(spark, {"t": noted}, {"t": (1, 99)}).collect()
    assert [(r.rule, r.n_rows, r.passed) for r in rows] == [("t rows", 100, 0)]
    churn = ev.expect_churn_band(spark, noted, 5, 50).head()
    assert churn.churn_pct == 50.0 and churn.passed == 1
    shares = {r.rule: (r.share_pct, r.passed) for r in ev.expect_noted_shares(spark, noted, "size_tier", {"small": (0.1, 50), "mid": (0.1, 50)}).collect()}
    assert shares == {"size_tier small": (60.0, 0), "size_tier mid": (40.0, 1)}


def test_an_empty_table_fails_its_band(spark):
    df = spark.createDataFrame([], "size_tier string, churn_label int")
    _, noted = stage_observed(df, "none", ev.table_metrics(df, ModelParams()))
    assert ev.expect_churn_band(spark, noted, 5, 50).head().passed == 0
    assert ev.expect_noted_shares(spark, noted, "size_tier", {"small": (0, 100)}).head().passed == 0


def test_finer_category_levels(spark):
    items = spark.createDataFrame([(1, "a", "s", "g"), (2, "a", None, "g"), (3, "a", None, None), (4, None, None, None)],
                                  "item_id int, category string, sub_category string, category_group string").withColumn("item_dsc", F.lit("GAUZE"))
    got = {r.item_id: r.matching_category for r in pr.parsed_items(items).collect()}
    assert got == {1: "s", 2: "g", 3: "a", 4: "UNKNOWN_CATEGORY"}
    assert pr.parsed_items(items.drop("sub_category", "category_group")).filter("item_id = 1").head().matching_category == "a"


def test_profiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (1, None, "x"), (3, None, None), (3, None, "y")], "a int, b double, c string")
    got = {r.column_name: (r.n_rows, r.null_count, r.min_value, r.median_value) for r in pf.numeric_profile(df, ["a", "b"]).collect()}
    assert got == {"a": (4, 0, 1.0, 2.0), "b": (4, 3, 2.0, 2.0)}
    top = [(r.column_name, r.value, r.n, r["rank"]) for r in pf.top_values(df, ["a", "c"], 2).collect()]
    assert sorted(top) == [("a", "1", 2, 1), ("a", "3", 2, 2), ("c", "x", 2, 1), ("c", "y", 1, 2)]
    none = pf.numeric_profile(df.limit(0), ["a"]).head()
    assert (none.n_rows, none.median_value) == (0, None)
