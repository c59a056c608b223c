"""Sales, engine and lifecycle reports. Reports take "now" as an argument and never the clock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import flag, half_up, lookup
from ..functions.distinct import with_distinct_counts

# purchases: purchase_id, cust_id, item_id, quantity, unit_price, sold_by_seller_id, sold_at, source


def _revenue() -> Column:
    return F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2)


def is_recommendation(source: str = "source") -> Column:
    return flag(F.col(source).startswith("recommendation_"))


def since(df: DataFrame, now: str, days: int | None, ts: str = "sold_at") -> DataFrame:
    """Rows from ``days`` days before now on; no upper bound."""
    return df if days is None else df.filter(F.col(ts) >= F.date_sub(F.lit(now).cast("date"), days))


def overview_kpis(customers: DataFrame, accounts: DataFrame, items: DataFrame, cart: DataFrame) -> DataFrame:
    """One row of population, account, assortment and cart figures."""
    def one(df, expr):
        return df.agg(expr.alias("x")).scalar()
    rows = F.count(F.lit(1))
    opened = cart.filter("status = 'in_cart'")
    return customers.agg(rows.alias("n_customers")).withColumns({
        "n_accounts": one(accounts, F.countDistinct("cust_id")),
        "n_products": one(items, rows),
        "private_brand_pct": one(items, F.round(F.avg("is_private_brand") * 100, 2)),
        "active_carts": one(opened, F.countDistinct("cust_id")),
        "cart_lines": one(opened, rows),
        "cart_value": one(opened, _revenue())})


def sales_period(purchases: DataFrame, now: str, days: int) -> DataFrame:
    return with_distinct_counts(
        since(purchases, now, days), [], {"customers": "cust_id", "sellers": "sold_by_seller_id"},
        F.count(F.lit(1)).alias("transactions"), F.coalesce(_revenue(), F.lit(0.0)).alias("revenue"),
        F.sum("quantity").alias("quantity"))


def bucket_start(granularity: str, ts: str = "sold_at") -> Column:
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[granularity]
    return F.to_date(F.date_trunc(unit, F.col(ts)))


def bucket_label(start: Column, granularity: str) -> Column:
    if granularity == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    if granularity == "monthly":
        return F.date_format(start, "yyyy-MM")
    # the year of an ISO week is the year of its Thursday
    year = F.year(F.date_add(start, 3)).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))


def sales_trend(purchases: DataFrame, granularity: str, now: str, days: int | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    start = bucket_start(granularity)
    out = since(purchases, now, days).groupBy(*keys, start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("order_count"), _revenue().alias("revenue"), F.sum("quantity").alias("quantity"))
    return out.withColumn("bucket", bucket_label(F.col("bucket_start"), granularity))


def conversion_by_signal(cart: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds, checkouts, abandons and conversion per source; optionally per seller."""
    sold = F.col("status") == "sold"
    out = cart.groupBy(*keys, F.coalesce("source", F.lit("manual")).alias("source")).agg(
        F.count(F.lit(1)).alias("cart_adds"), F.sum(flag(sold)).alias("checkouts"),
        F.sum(flag(F.col("status").isin("not_sold", "in_cart"))).alias("abandons"),
        F.round(F.sum(F.when(sold, F.col("quantity") * F.col("unit_price")).otherwise(0.0)), 2).alias("revenue"),
        F.sum(F.when(sold, F.col("quantity")).otherwise(0)).alias("quantity_sold"))
    return out.withColumn("conversion_rate_pct", half_up(F.col("checkouts") / F.col("cart_adds") * 100))


def segment_distribution(segments: DataFrame, name: Column) -> DataFrame:
    by = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("n_customers"))
    total = F.sum("n_customers").over(W.partitionBy(F.lit(0)))  # one row per segment
    return by.withColumn("pct", F.round(F.col("n_customers") / total * 100, 2)).withColumn("display_name", name)


def top_sellers(purchases: DataFrame, users: DataFrame, accounts: DataFrame, now: str, days: int | None, limit: int) -> DataFrame:
    sales = since(purchases, now, days).groupBy(F.col("sold_by_seller_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_sales"), _revenue().alias("total_revenue"), F.sum("quantity").alias("total_quantity"))
    managed = accounts.groupBy(F.col("seller_id").alias("user_id")).agg(F.count(F.lit(1)).alias("customers_managed"))
    top = sales.join(users, "user_id").orderBy(F.desc("total_revenue"), "user_id").limit(limit)
    return top.join(managed, "user_id", "left").fillna(0, ["customers_managed"]).withColumn(
        "avg_order_value", half_up(F.col("total_revenue") / F.col("total_sales")))


def recent_sales(purchases: DataFrame, customers: DataFrame, items: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """Newest sales with names and whether a recommendation led to them."""
    newest = purchases.orderBy(F.desc("sold_at"), F.desc("purchase_id")).limit(limit)
    return (newest.join(customers.select("cust_id", "cust_name"), "cust_id", "left")
            .join(items.select("item_id", "item_dsc", "family"), "item_id", "left")
            .join(users.select(F.col("user_id").alias("sold_by_seller_id"), F.col("full_name").alias("seller_name")),
                  "sold_by_seller_id", "left")
            .withColumn("line_total", F.round(F.col("quantity") * F.col("unit_price"), 2))
            .withColumn("from_recommendation", is_recommendation()))


def drilldown_summary(purchases: DataFrame, key: str) -> DataFrame:
    out = purchases.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_orders"), _revenue().alias("total_revenue"), F.sum("quantity").alias("total_items"),
        F.countDistinct("item_id").alias("distinct_products"), F.to_date(F.min("sold_at")).alias("first_order_date"),
        F.to_date(F.max("sold_at")).alias("last_order_date"))
    return out.withColumn("avg_order_value", half_up(F.col("total_revenue") / F.col("total_orders")))


def drilldown_top(purchases: DataFrame, items: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """Best products or families per customer or seller, with the share of its revenue."""
    df = purchases if by == "item_id" else purchases.join(items.select("item_id", by), "item_id", "left")
    sums = df.groupBy(key, by).agg(_revenue().alias("revenue"), F.sum("quantity").alias("quantity"),
                                   F.count(F.lit(1)).alias("order_count"))
    # the total per key sums products (or families), not lines
    totals = sums.groupBy(key).agg(F.sum("revenue").alias("_t"))
    top = rk.top_k(sums, [key], [F.desc("revenue"), by], limit)
    return top.join(totals, key).withColumn("pct_of_revenue", F.round(F.col("revenue") / F.col("_t") * 100, 2)).drop("_t")


def top_customers(purchases: DataFrame, customers: DataFrame, now: str, days: int | None, limit: int) -> DataFrame:
    """Unlike the other reports the range ends at midnight of now."""
    df = since(purchases, now, days).filter(F.col("sold_at") <= F.lit(now).cast("date"))
    top = df.groupBy("cust_id").agg(F.count(F.lit(1)).alias("total_orders"), _revenue().alias("total_revenue")).orderBy(
        F.desc("total_revenue"), "cust_id").limit(limit)
    return top.join(customers.select("cust_id", "cust_name"), "cust_id", "left")


def engine_effectiveness(cart: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds, sales, declines and rejections per recommendation source, and the total."""
    sold = F.col("status") == "sold"
    adds = cart.filter(is_recommendation() == 1).groupBy("source").agg(
        F.count(F.lit(1)).alias("cart_adds"), F.sum(flag(sold)).alias("sold"),
        F.sum(flag(F.col("status") == "not_sold")).alias("not_sold_cart"),
        F.round(F.sum(F.when(sold, F.col("quantity") * F.col("unit_price")).otherwise(0.0)), 2).alias("revenue"))
    rejected = outcomes.filter("outcome = 'rejected'").filter(is_recommendation() == 1).groupBy("source").agg(
        F.count(F.lit(1)).alias("rejected"))
    both = adds.join(rejected, "source", "full").fillna(0, ["cart_adds", "sold", "not_sold_cart", "revenue", "rejected"])
    out = both.rollup("source").agg(*[F.sum(c).alias(c) for c in ("cart_adds", "sold", "not_sold_cart", "rejected")],
                                    F.round(F.sum("revenue"), 2).alias("revenue"))
    engaged = F.col("cart_adds") + F.col("rejected")
    pct = lambda a, b: F.coalesce(half_up(F.try_divide(a, b) * 100), F.lit(0.0))
    return out.withColumns({
        "source": F.coalesce("source", F.lit("TOTAL")), "engaged": engaged,
        "conversion_rate_pct": pct(F.col("sold"), F.col("cart_adds")),
        "acceptance_rate_pct": pct(F.col("cart_adds"), engaged), "rejection_rate_pct": pct(F.col("rejected"), engaged)})


def rejection_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("outcome = 'rejected' AND reason_code IS NOT NULL").groupBy("reason_code").agg(
        F.count(F.lit(1)).alias("n"))


# Lifecycle stages in display order.
LIFECYCLE = {"cold_start": "Cold Start", "stable_warm": "Stable", "declining_warm": "Declining", "churned_warm": "Churned"}


def lifecycle_funnel(customers: DataFrame) -> DataFrame:
    """Customers per stage with an Other bucket, so that the shares add up."""
    stage = F.when(F.col("status").isin(*LIFECYCLE), F.col("status")).otherwise("other")
    by = customers.groupBy(stage.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # at most five stages
    return by.withColumns({"pct": F.round(F.col("n") / total * 100, 2), "label": lookup("status", LIFECYCLE, "Other"),
                           "position": lookup("status", {s: i for i, s in enumerate(LIFECYCLE)}, 4),
                           "is_at_risk": flag(F.col("status").isin("declining_warm", "churned_warm"))})


def reorder_heatmap(purchases: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Dense days per customer with counts and an intensity of 0 to 4 against the customer's busiest day."""
    end = F.lit(now).cast("date")
    day = F.to_date("sold_at")
    counts = purchases.filter((day > F.date_sub(end, days)) & (day <= end)).groupBy("cust_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = purchases.select("cust_id").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    out = grid.join(counts, ["cust_id", "day"], "left").fillna(0, ["n"])
    out = out.withColumn("busiest", F.max("n").over(W.partitionBy("cust_id")))  # `days` rows per customer
    ratio = F.col("n") / F.col("busiest")
    level = (F.when(F.col("n") == 0, 0).when(F.col("busiest") <= 1, 4).when(ratio <= 0.25, 1).when(ratio <= 0.5, 2)
             .when(ratio <= 0.75, 3).otherwise(4))
    return out.withColumn("intensity", level).drop("busiest")


def category_mix(purchases: DataFrame, items: DataFrame, top: int, min_other_pct: float = 0.5) -> DataFrame:
    """Top families per customer and the remainder as one more row."""
    sums = purchases.join(items.select("item_id", "family"), "item_id", "left").groupBy(
        "cust_id", F.coalesce("family", F.lit("Unknown")).alias("family")).agg(_revenue().alias("revenue"))
    total = F.sum("revenue").over(W.partitionBy("cust_id"))  # one row per family
    ranked = sums.filter("revenue > 0").withColumn("_t", total).withColumn(
        "_r", F.row_number().over(W.partitionBy("cust_id").orderBy(F.desc("revenue"), "family")))
    is_other = flag(F.col("_r") > top)
    out = ranked.groupBy("cust_id", "_t", F.when(is_other == 1, "Other categories").otherwise(F.col("family")).alias("family"),
                         is_other.alias("is_other")).agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    out = out.withColumn("pct", F.round(F.col("revenue") / F.col("_t") * 100, 2)).drop("_t")
    return out.filter((F.col("is_other") == 0) | (F.col("pct") > min_other_pct))


def low_stock_in_top_family(purchases: DataFrame, items: DataFrame, inventory: DataFrame, threshold: int = 30, k: int = 5) -> DataFrame:
    """The lowest stocked items, still in stock, of each customer's top family."""
    sums = purchases.join(items.select("item_id", "family"), "item_id").groupBy("cust_id", "family").agg(_revenue().alias("r"))
    family = rk.first_per_key(sums, ["cust_id"], [F.desc("r"), "family"]).select("cust_id", "family")
    low = items.select("item_id", "family").join(inventory.select("item_id", "units"), "item_id").filter(
        (F.col("units") > 0) & (F.col("units") < threshold))
    lowest = rk.top_k(low, ["family"], ["units", "item_id"], k, "position")  # the same for all customers of a family
    return family.join(lowest, "family")


def product_leaderboard(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy("item_id").agg(
        F.sum("quantity").alias("units"), _revenue().alias("revenue"), F.count(F.lit(1)).alias("transactions"),
        F.max("sold_at").alias("last_sold"), F.sum(is_recommendation()).alias("rec_driven"))


def names(column: str, mapping: Mapping) -> Column:
    return lookup(column, mapping, F.col(column))
