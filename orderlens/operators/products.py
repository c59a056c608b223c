"""Product features: buyers, prices, buyer mix, concentration, affordability, specialties, rankings.

Tables here hold one row per catalogue item (or per customer and item before that), so
windows over items see catalogue-sized input; anything per customer goes through
aggregates with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions import text
from ..functions.columns import bands, flag, half_up
from ..functions.distinct import with_distinct_counts
from ..params import EXCLUDED_FAMILIES, ProductParams
from ..session import stage


def cust_item_agg(eligible: DataFrame) -> DataFrame:
    return eligible.groupBy("cust_id", "item_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.round(F.sum("amount"), 2).alias("total_spend"),
        half_up(F.round(F.sum("amount"), 2) / F.count(F.lit(1)), 6).alias("avg_unit_price"),
        F.round(F.stddev_pop("amount"), 4).alias("std_unit_price"),
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


def min_buyers(cust_items: DataFrame, n: int) -> DataFrame:
    """Rows of items with at least n distinct buyers (cust_items has one row per pair)."""
    enough = cust_items.groupBy("item_id").agg(F.count(F.lit(1)).alias("_b")).filter(F.col("_b") >= n)
    return cust_items.join(enough.select("item_id"), "item_id", "left_semi")


def with_context(cust_items: DataFrame, segments: DataFrame, features: DataFrame) -> DataFrame:
    ctx = segments.join(features.select("cust_id", "median_monthly_spend", "affordability_ceiling",
                                        "active_months_last_12", "specialty"), "cust_id", "left")
    return cust_items.join(ctx, "cust_id", "left")


def tenure_adjusted_frequency(pairs: DataFrame) -> DataFrame:
    months = F.greatest(F.coalesce("active_months_last_12", F.lit(6)), F.lit(3))
    return pairs.withColumn("annual_rate", half_up(F.col("line_count") * 12 / months, 6))


def product_measures(pairs: DataFrame, latest: DataFrame, p: ProductParams) -> DataFrame:
    """pairs: stored customer-item rows with context; latest: one row with the newest date ``d``."""
    newest = latest.select("d").scalar()
    rated = tenure_adjusted_frequency(pairs)
    sums = rated.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_buyers"), F.sum("line_count").alias("total_transactions"),
        F.round(F.sum("total_spend"), 2).alias("total_spend"),
        F.round(F.coalesce(F.try_divide(F.stddev_samp("avg_unit_price"), F.avg("avg_unit_price")), F.lit(0.0)), 4).alias("unit_price_cv"),
        F.round(F.avg(flag(F.col("line_count") > 1)), 6).alias("repeat_purchase_rate"),
        F.round(F.avg("annual_rate"), 4).alias("avg_purchases_per_buyer_per_year"),
        F.sum(flag(F.col("last_date") >= F.date_sub(newest, p.recent_days))).alias("recent_buyer_count_6mo"),
        F.max("last_date").alias("_last"))
    sums = sums.withColumn("months_since_last_buyer", half_up(F.datediff(newest, "_last") / 30, 1)).drop("_last")
    mids = rk.quantiles(rated, {
        "median_line_value": ("total_spend", 0.5), "median_unit_price": ("avg_unit_price", 0.5),
        "median_purchases_per_buyer_per_year": ("annual_rate", 0.5)}, ["item_id"])
    return sums.join(mids, "item_id")


def buyer_mix(pairs: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Share of an item's buyers in each value of the column, wide."""
    total = F.count(column)
    return pairs.groupBy("item_id").agg(*[
        F.round(F.coalesce(F.try_divide(F.sum(flag(F.col(column) == v)), total), F.lit(0.0)), 6).alias(f"pct_buyers_{v}")
        for v in values])


def market_concentration(mix: DataFrame, markets: Sequence[str]) -> DataFrame:
    cols = [F.col(f"pct_buyers_{m}") for m in markets]
    best = F.greatest(*cols)
    first = None
    for m in sorted(markets):
        cond = F.col(f"pct_buyers_{m}") == best
        first = F.when(cond, m) if first is None else first.when(cond, m)
    hhi = sum((c * c for c in cols[1:]), cols[0] * cols[0])
    return mix.select("item_id", F.round(hhi, 6).alias("market_hhi"), first.alias("primary_market"),
                      best.alias("primary_market_pct"))


def _shares(pairs: DataFrame, column: str) -> DataFrame:
    by = pairs.filter(F.col(column).isNotNull()).groupBy("item_id", column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("item_id"))
    return by.withColumn("pct", F.round(F.col("n") / total, 6))


def top_wide(pairs: DataFrame, column: str, k: int, prefix: str, min_share: float = 0.0,
             fill: bool = False) -> DataFrame:
    """The k largest shares of an item as columns prefix_1, prefix_1_pct, ..."""
    shares = _shares(pairs, column).filter(F.col("pct") >= min_share)
    top = rk.top_k(shares, ["item_id"], [F.desc("pct"), column], k)
    aggs = []
    for i in range(1, k + 1):
        name, pct = F.max(F.when(F.col("rank") == i, F.col(column))), F.max(F.when(F.col("rank") == i, F.col("pct")))
        aggs += [(F.coalesce(name, F.lit("")) if fill else name).alias(f"{prefix}_{i}"),
                 (F.coalesce(pct, F.lit(0.0)) if fill else pct).alias(f"{prefix}_{i}_pct")]
    return top.groupBy("item_id").agg(*aggs)


def share_hhi(pairs: DataFrame, column: str, out: str) -> DataFrame:
    return _shares(pairs, column).groupBy("item_id").agg(F.round(F.sum(F.col("pct") * F.col("pct")), 6).alias(out))


def affordability_percentiles(pairs: DataFrame) -> DataFrame:
    return rk.quantiles(pairs, {
        "buyer_affordability_p10": ("affordability_ceiling", 0.10),
        "buyer_affordability_p50": ("affordability_ceiling", 0.50),
        "buyer_affordability_p90": ("affordability_ceiling", 0.90),
        "buyer_monthly_spend_p50": ("median_monthly_spend", 0.50)}, ["item_id"])


def adoption_and_price_rank(measures: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """Adoption rate and average-rank price percentile within the family."""
    n = segments.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = measures.select("item_id", "n_buyers", "median_unit_price").join(
        items.select("item_id", "family"), "item_id", "left")
    w = W.partitionBy("family")
    ties = F.count(F.lit(1)).over(W.partitionBy("family", "median_unit_price"))
    pct = (F.rank().over(w.orderBy("median_unit_price")) + (ties - 1) / 2) / F.count("median_unit_price").over(w)
    return df.select("item_id", F.round(F.col("n_buyers") / n, 6).alias("adoption_rate"),
                     F.when(F.col("family").isNull() | F.col("median_unit_price").isNull(), 0.5)
                     .otherwise(F.round(pct, 6)).alias("price_percentile_in_family"))


def product_features(pairs: DataFrame, latest: DataFrame, items: DataFrame, segments: DataFrame,
                     markets: Sequence[str], sizes: Sequence[str], p: ProductParams) -> DataFrame:
    measures = product_measures(pairs, latest, p)
    mix = buyer_mix(pairs, "market_clean", markets)
    out = (measures.join(mix, "item_id").join(market_concentration(mix, markets), "item_id")
           .join(buyer_mix(pairs, "size_tier", sizes), "item_id")
           .join(top_wide(pairs, "segment", p.top_segments, "top_segment"), "item_id", "left")
           .join(share_hhi(pairs, "segment", "segment_hhi"), "item_id", "left")
           .join(affordability_percentiles(pairs), "item_id")
           .join(adoption_and_price_rank(measures, items, segments), "item_id")
           .join(items.select("item_id", "item_dsc", "family", "category", "is_private_brand", "is_discontinued"),
                 "item_id", "left"))
    return out.withColumn("specialty_score", F.round(F.col("market_hhi") * F.sqrt("adoption_rate"), 6))


def product_specialty(pairs: DataFrame, p: ProductParams) -> DataFrame:
    wide = top_wide(pairs, "specialty", p.specialty_top, "top_specialty", p.specialty_share, fill=True)
    return wide.join(share_hhi(pairs, "specialty", "specialty_hhi"), "item_id", "left")


def volume_tercile(measures: DataFrame) -> DataFrame:
    ranked = rk.global_row_number(measures.select("item_id", "n_buyers"), "n_buyers", "item_id", "r")
    n = measures.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.withColumn("_n", n).withColumn(
        "volume_tier", F.when(F.col("r") * 3 > F.col("_n") * 2, "high")
        .when(F.col("r") * 3 > F.col("_n"), "mid").otherwise("low")).drop("r", "_n")


def product_economics(merged: DataFrame, competitors: Sequence[str],
                      excluded: Sequence[str] = EXCLUDED_FAMILIES) -> DataFrame:
    """Median line price, buyers and exclusion flags per item."""
    paid = merged.filter((F.col("amount") > 0) & F.col("item_id").isNotNull())
    sums = paid.groupBy("item_id").agg(
        F.countDistinct("cust_id").alias("n_buyers"),
        F.max(flag(F.upper(F.coalesce("supplier", F.lit(""))).isin(*[c.upper() for c in competitors]))).alias("is_competitor"),
        F.max(flag(F.coalesce("family", F.lit("Unknown")).isin(*excluded))).alias("is_excluded_family"))
    return sums.join(rk.quantiles(paid.select("item_id", "amount"), {"median_unit_price": ("amount", 0.5)}, ["item_id"]), "item_id")


def parsed_items(items: DataFrame) -> DataFrame:
    """Matching keys of items. ``sub_category`` and ``category_group``, the finer levels, count where the items have them."""
    level = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    return (items.withColumn("matching_category", text.matching_category(level("sub_category"), level("category_group"), "category"))
            .withColumn("product_type", text.product_type("item_dsc"))
            .withColumn("form_code", text.form_code("item_dsc")))


def variant_groups(items: DataFrame, stock: DataFrame) -> DataFrame:
    """Variants collapsed by group key, represented by the best-stocked item."""
    keyed = items.join(stock, "item_id", "left").select(
        text.variant_group_key("item_id", "item_dsc", "family", "category", "is_private_brand").alias("group_key"),
        "item_id", F.coalesce("units", F.lit(0)).alias("units"))
    best = F.max(F.struct((F.col("units") > 0).cast("int").alias("in_stock"), "units", (-F.col("item_id")).alias("neg")))
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_variants"), best.alias("b")).select(
        "group_key", "n_variants", (-F.col("b.neg")).alias("representative"), F.col("b.units").alias("units"))


def drop_carted_variants(suggestions: DataFrame, cart: DataFrame, items: DataFrame) -> DataFrame:
    """Suggestions whose variant group is not in the customer's cart yet."""
    key = text.variant_group_key("item_id", "item_dsc", "family", "category", "is_private_brand").alias("group_key")
    keys = items.select("item_id", key)
    in_cart = cart.join(keys, "item_id").select("cust_id", "group_key").distinct()
    return suggestions.join(keys, "item_id").join(in_cart, ["cust_id", "group_key"], "left_anti")


BANDS = {
    "months_since_last_buyer": [(0.5000001, "very_active"), (3.0000001, "active"), (6.0000001, "slow"), (1e18, "stale")],
    "unit_price_cv": [(0.2, "stable"), (0.5, "moderate"), (1e18, "variable")],
    "market_hhi": [(0.30, "universal"), (0.55, "broad"), (1e18, "specialty")],
    "specialty_score": [(0.2000001, "ordinary"), (1e18, "high_specialty")],
}


def product_bands(features: DataFrame, column: str) -> DataFrame:
    """Items per band of a measure, with their share."""
    by = features.filter(F.col(column).isNotNull()).groupBy(bands(column, BANDS[column], "other").alias("band")).agg(
        F.count(F.lit(1)).alias("n_products"))
    total = F.sum("n_products").over(W.partitionBy(F.lit(0)))  # a handful of bands
    return by.withColumn("measure", F.lit(column)).withColumn("pct", F.round(F.col("n_products") / total * 100, 2))


def measure_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """p10, p50 and p90 of several columns over the whole frame, one row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    return rk.exact_quantiles(df.select(F.inline(cells)), "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["measure"], 4)


# ---- rankings ----

def customer_ranking(sales: DataFrame, features: DataFrame) -> DataFrame:
    """Ranks by spend and volume and their sum re-ranked."""
    life = sales.filter(F.col("amount") > 0).groupBy("cust_id").agg(
        F.round(F.sum("amount"), 2).alias("lifetime_spend"), F.round(F.sum("qty"), 2).alias("lifetime_volume"),
        F.countDistinct("order_id").alias("lifetime_orders"), F.count(F.lit(1)).alias("lifetime_lines"))
    out = features.select("cust_id", "market", "size_tier").join(life, "cust_id", "left").fillna(
        0, ["lifetime_spend", "lifetime_volume", "lifetime_orders", "lifetime_lines"])
    out = rk.min_ranks(stage(out, "customer_totals"), {"lifetime_spend": "rank_by_spend", "lifetime_volume": "rank_by_volume"})
    out = out.withColumn("combined_rank_score", F.col("rank_by_spend") + F.col("rank_by_volume"))
    return rk.min_ranks(stage(out, "customer_ranks"), {"combined_rank_score": "combined_rank"}, descending=False)


def product_ranking(merged: DataFrame) -> DataFrame:
    paid = merged.filter(F.col("amount") > 0)
    sums = with_distinct_counts(
        paid, ["item_id"], {"sales_count": "order_id", "distinct_buyers": "cust_id"}, F.count(F.lit(1)).alias("line_count"), F.round(F.sum("amount"), 2).alias("total_revenue"),
        F.round(F.sum("qty"), 2).alias("total_volume"), F.max("order_date").alias("last_sold"),
        F.min("order_date").alias("first_sold")).withColumn(
        "avg_unit_price", half_up(F.try_divide(F.col("total_revenue"), F.col("total_volume")), 4))
    by_market = paid.filter(F.col("market").isNotNull()).groupBy("item_id", "market").agg(
        F.countDistinct("cust_id").alias("primary_market_buyers"))
    primary = rk.first_per_key(by_market, ["item_id"], [F.desc("primary_market_buyers"), "market"])
    out = sums.join(primary.withColumnRenamed("market", "primary_market"), "item_id", "left")
    return rk.min_ranks(stage(out, "product_totals"), {
        "sales_count": "rank_by_sales_count", "total_revenue": "rank_by_revenue",
        "total_volume": "rank_by_volume", "distinct_buyers": "rank_by_buyers"})


def tier_rollup(ranking: DataFrame) -> DataFrame:
    sums = ranking.groupBy("size_tier").agg(
        F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("lifetime_spend"), 2).alias("total_spend"),
        F.round(F.sum("lifetime_volume"), 2).alias("total_volume"),
        half_up(F.round(F.sum("lifetime_spend"), 2) / F.count(F.lit(1))).alias("avg_spend"))
    return sums.join(rk.quantiles(ranking, {"median_spend": ("lifetime_spend", 0.5),
                                            "median_volume": ("lifetime_volume", 0.5)}, ["size_tier"], 2), "size_tier")


def family_rollup(ranking: DataFrame, items: DataFrame) -> DataFrame:
    return ranking.join(items.select("item_id", "family"), "item_id").groupBy("family").agg(
        F.count(F.lit(1)).alias("n_products"), F.sum("sales_count").alias("total_sales_count"),
        F.round(F.sum("total_revenue"), 2).alias("total_revenue"), F.round(F.sum("total_volume"), 2).alias("total_volume"),
        F.sum("distinct_buyers").alias("total_buyers"), F.round(F.avg("avg_unit_price"), 2).alias("avg_unit_price"))
