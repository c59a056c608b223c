"""Star joins and the composite joins the other operators are built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag

CUSTOMER_COLUMNS = ("cust_id", "market", "specialty", "specialty_dsc", "state", "cust_type", "cust_class")
ITEM_COLUMNS = ("item_id", "item_dsc", "family", "category", "brand", "supplier",
                "is_private_brand", "is_discontinued")


def star_join(sales: DataFrame, customers: DataFrame, items: DataFrame,
              tiers: DataFrame | None = None) -> DataFrame:
    """Order lines with customer, product and (optional) specialty-tier attributes; all outer."""
    out = (sales
           .join(customers.select(*[c for c in CUSTOMER_COLUMNS if c in customers.columns]), "cust_id", "left")
           .join(items.select(*[c for c in ITEM_COLUMNS if c in items.columns]), "item_id", "left"))
    if tiers is not None:
        out = out.join(tiers.select("specialty", "specialty_tier"), "specialty", "left")
    return (out.withColumn("order_year", F.year("order_date"))
            .withColumn("order_month", F.month("order_date"))
            .withColumn("order_day", F.dayofmonth("order_date")))


def lines_for(sales: DataFrame, customers: DataFrame, items: DataFrame, columns) -> DataFrame:
    """Order lines joined with just the dimensions that own the wanted columns."""
    out = sales
    for dim, key, owned in ((customers, "cust_id", CUSTOMER_COLUMNS), (items, "item_id", ITEM_COLUMNS)):
        wanted = [c for c in owned if c in columns and c != key]
        if wanted:
            out = out.join(dim.select(key, *wanted), key, "left")
    return out.withColumn("order_year", F.year("order_date")).withColumn("order_month", F.month("order_date"))


def with_items(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Order lines with product attributes only, for operators that need nothing of the customer."""
    return sales.join(items.select(*[c for c in ITEM_COLUMNS if c in items.columns]), "item_id", "left")


def eligible_lines(merged: DataFrame, excluded_families=(), excluded_suppliers=()) -> DataFrame:
    """Paid lines with keys, outside the excluded families and suppliers."""
    out = merged.filter((F.col("amount") > 0) & F.col("cust_id").isNotNull() & F.col("item_id").isNotNull())
    if excluded_families:
        out = out.filter(~F.coalesce("family", F.lit("Unknown")).isin(*excluded_families))
    if excluded_suppliers:
        out = out.filter(~F.upper(F.coalesce("supplier", F.lit(""))).isin(
            *[s.upper() for s in excluded_suppliers]))
    return out


def describe_pairs(pairs: DataFrame, items: DataFrame, left: str, right: str,
                   columns: tuple[str, ...] = ("item_dsc", "family")) -> DataFrame:
    """Item attributes on both ends of a pair, and whether the ends share a family."""
    out = pairs
    for side in (left, right):
        out = out.join(items.select(F.col("item_id").alias(side),
                                    *[F.col(c).alias(f"{side}_{c}") for c in columns]), side, "left")
    return out.withColumn("same_family", flag(F.col(f"{left}_family") == F.col(f"{right}_family")))


def full_outer_years(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two yearly aggregates with one key column."""
    return first.join(second, key, "full")
