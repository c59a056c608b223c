"""Grouped summaries over the merged lines and per-column table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import flag, half_up
from ..functions.distinct import with_distinct_counts
from .joins import lines_for

# merged lines carry is_return as 0/1; "sold" lines are those with 0


def _named(keys: Sequence[str]) -> list:
    return [F.coalesce(F.col(k).cast("string"), F.lit("Unknown")).alias(k) for k in keys]


def sold(merged: DataFrame) -> DataFrame:
    return merged.filter("is_return = 0")


def summary(lines: DataFrame, keys: Sequence[str], count: Sequence[str] = ("cust_id", "order_id")) -> DataFrame:
    """Distinct counts, lines and revenue per group."""
    names = {"cust_id": "unique_customers", "item_id": "unique_products", "order_id": "unique_orders"}
    rows = lines.select(*_named(keys), *[c for c in names if c not in keys], "amount")
    return with_distinct_counts(rows, keys, {names[c]: c for c in count},
                                F.count(F.lit(1)).alias("total_order_lines"), F.round(F.sum("amount"), 2).alias("total_revenue"))


def with_share(df: DataFrame, value: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Share of the total in percent; the totals come from a second small aggregate, not a one-task window."""
    if within:
        totals = df.groupBy(*within).agg(F.sum(value).alias("_t"))
        df = df.join(totals, list(within))
    else:
        df = df.withColumn("_t", df.agg(F.sum(value).alias("t")).scalar())
    return df.withColumn(out, F.round(F.col(value) * 100.0 / F.col("_t"), 2)).drop("_t")


def data_overview(merged: DataFrame) -> DataFrame:
    """One row per metric."""
    distinct = {"unique_customers": "cust_id", "unique_products": "item_id", "unique_orders": "order_id",
                "unique_specialties": "specialty", "unique_states": "state", "unique_families": "family"}
    wide = with_distinct_counts(
        merged, [], distinct, F.count(F.lit(1)).cast("double").alias("total_rows"), F.sum("is_return").cast("double").alias("return_rows"),
        F.round(F.sum(F.when(F.col("is_return") == 0, F.col("amount"))), 2).alias("revenue_without_returns"),
        F.date_format(F.min("order_date"), "yyyyMMdd").cast("double").alias("first_date"),
        F.date_format(F.max("order_date"), "yyyyMMdd").cast("double").alias("last_date"))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns])))


def customers_by_type(merged: DataFrame) -> DataFrame:
    out = summary(sold(merged), ["cust_type"])
    return with_share(with_share(out, "unique_customers", "pct_customers"), "total_revenue", "pct_revenue")


def products_by(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_share(summary(sold(merged), keys, ("item_id", "cust_id")), "total_revenue", "pct_revenue")


def sales_by_month(merged: DataFrame) -> DataFrame:
    return with_distinct_counts(
        sold(merged), ["fy", "order_year", "order_month"], {"unique_customers": "cust_id", "unique_orders": "order_id"},
        F.count(F.lit(1)).alias("total_order_lines"), F.round(F.sum("amount"), 2).alias("total_revenue"),
        half_up(F.round(F.sum("amount"), 2) / F.count(F.lit(1))).alias("avg_line_revenue"))


def sales_by_fy_and(merged: DataFrame, keys: Sequence[str], count: Sequence[str] = ("cust_id", "order_id")) -> DataFrame:
    return with_share(summary(sold(merged), ["fy", *keys], count), "total_revenue", "pct_of_fy_revenue", ["fy"])


def yoy_overall(merged: DataFrame) -> DataFrame:
    out = summary(merged, ["fy"], ("cust_id", "item_id", "order_id"))
    returns = merged.groupBy("fy").agg(F.sum("is_return").alias("return_lines"))
    return out.join(returns, "fy").withColumns({
        "avg_line_revenue": half_up(F.col("total_revenue") / F.col("total_order_lines")),
        "return_pct": F.round(F.col("return_lines") * 100.0 / F.col("total_order_lines"), 2)})


def yoy_by_family(merged: DataFrame, years: Sequence[str]) -> DataFrame:
    by = sold(merged).groupBy(F.coalesce("family", F.lit("Unknown")).alias("family")).pivot("fy", list(years)).agg(
        F.round(F.sum("amount"), 2))
    return by.select("family", *[F.col(y).alias(f"revenue_{y.lower()}") for y in years])


def yoy_customers(merged: DataFrame, first: str, second: str) -> DataFrame:
    """Customers new in, retained in and lost in the second year."""
    per = sold(merged).groupBy("cust_id").agg(F.max(flag(F.col("fy") == first)).alias("a"), F.max(flag(F.col("fy") == second)).alias("b"))
    status = F.when(F.col("a") == 0, "new").when(F.col("b") == 0, "lost").otherwise("retained")
    return per.filter("a = 1 OR b = 1").groupBy(status.alias("customer_status")).agg(F.count(F.lit(1)).alias("customer_count"))


def returns_summary(merged: DataFrame) -> DataFrame:
    return merged.filter("is_return = 1").groupBy("fy", *_named(["cust_type", "family"])).agg(
        F.count(F.lit(1)).alias("return_lines"), F.round(F.sum(F.abs("qty")), 0).alias("total_return_qty"),
        F.round(F.sum(F.abs("amount")), 2).alias("total_return_value"))


def revenue_outliers(sales: DataFrame, customers: DataFrame, items: DataFrame, q: float = 0.999,
                     limit: int = 500) -> DataFrame:
    """Lines above an exact quantile of line revenue, largest first; only those meet the dimensions."""
    lines = sold(sales).filter(F.col("amount").isNotNull())
    threshold = rk.exact_quantiles(lines.select("amount"), "amount", {"t": q}).scalar()
    top = lines.filter(F.col("amount") > threshold).orderBy(F.desc("amount"), "order_id", "line_no").limit(limit)
    return lines_for(top, customers, items, ("item_dsc", "cust_type", "specialty")).select(
        "fy", "order_id", "line_no", "item_dsc", "cust_type", "specialty", "qty", "amount", "order_date")


# ---- table profile ----

def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs, range, mean and exact median of numeric columns.

    One pass makes the typed summaries of all columns, which merge; each median is a selection in the histogram of
    its column, which reads that column alone. Rows are never turned into one row per column.
    """
    sums = df.agg(*[F.struct(F.count(F.lit(1)).alias("n_rows"), F.sum(flag(F.col(c).isNull())).alias("null_count"),
                             F.min(F.col(c).cast("double")).alias("min_value"), F.max(F.col(c).cast("double")).alias("max_value"),
                             F.round(F.avg(F.col(c).cast("double")), 4).alias("mean_value")).alias(c) for c in columns])
    medians = {c: rk.exact_quantiles(df.select(c), c, {"m": 0.5}, digits=4).scalar() for c in columns}
    for c in columns:
        sums = sums.withColumn(f"_m_{c}", medians[c])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}`.{f}").alias(f) for f in (
        "n_rows", "null_count", "min_value", "max_value", "mean_value")], F.col(f"_m_{c}").alias("median_value")) for c in columns])
    return sums.select(F.inline(cells))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column with their counts, ties by the value as text.

    Every column is counted by itself in its own type, so a scan reads it alone and equal values meet in the map-side combine;
    only the groups are cast to text.
    """
    def top(c: str) -> DataFrame:
        by = df.select(F.col(c).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        best = by.select(F.col("v").cast("string").alias("value"), "n").orderBy(F.desc("n"), "value").limit(k)
        place = F.row_number().over(W.orderBy(F.desc("n"), "value"))  # of k rows
        return best.select(F.lit(c).alias("column_name"), "value", "n", place.alias("rank"))
    return reduce(lambda a, b: a.unionByName(b), [top(c) for c in columns])
