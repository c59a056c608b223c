"""Filters, deduplication and audits of raw order lines and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, half_up
from ..functions.distinct import with_distinct_counts
from ..functions.ranking import first_per_key
from ..params import CleaningParams


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return first_per_key(df, keys, order)


def dedup_latest(df: DataFrame, keys: Sequence[str], date_col: str, tie_break: Sequence) -> DataFrame:
    return first_per_key(df, keys, [F.desc_nulls_last(date_col), *tie_break])


def dedup_max_merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the column-wise maximum; may blend the copies of a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])


def _kept(order_col: str, amount_col: str, p: CleaningParams) -> Column:
    order = F.col(order_col).cast("string")
    not_blocked = order.isNotNull() & ~order.isin(*p.blocked_orders)
    return not_blocked & (F.col(amount_col).isNull() | (F.col(amount_col) <= p.line_cap))


def exclude_lines(df: DataFrame, order_col: str, amount_col: str, p: CleaningParams) -> DataFrame:
    """Drop blocked orders and lines above the cap; a NULL amount passes, a NULL order does not."""
    return df.filter(_kept(order_col, amount_col, p))


def exclusion_audit(df: DataFrame, order_col: str, amount_col: str, p: CleaningParams) -> DataFrame:
    """The excluded lines with the reason."""
    order = F.col(order_col).cast("string")
    reason = (F.when(order.isin(*p.blocked_orders), "blocked_order")
              .when(F.col(amount_col) > p.line_cap, "above_cap"))
    return df.withColumn("exclusion_reason", reason).filter(F.col("exclusion_reason").isNotNull())


def split_returns(df: DataFrame, is_return: Column) -> tuple[DataFrame, DataFrame]:
    return df.filter(~is_return), df.filter(is_return)


def dedup_accounting(df: DataFrame, group: str, keys: Sequence[str], order_col: str, amount_col: str,
                     p: CleaningParams) -> DataFrame:
    """Raw, blocked, capped, duplicate and clean line counts per source."""
    order = F.col(order_col).cast("string")
    blocked = flag(order.isin(*p.blocked_orders))
    capped = flag(F.col(amount_col) > p.line_cap) * (1 - blocked)
    per_key = df.withColumn("_kept", flag(_kept(order_col, amount_col, p))).groupBy(group, *keys).agg(
        F.count(F.lit(1)).alias("_raw"), F.sum(blocked).alias("_blocked"),
        F.sum(capped).alias("_capped"), F.sum("_kept").alias("_kept"))
    return per_key.groupBy(group).agg(
        F.sum("_raw").alias("raw_rows"), F.sum("_blocked").alias("blocked_rows"),
        F.sum("_capped").alias("capped_rows"),
        F.sum(F.greatest(F.col("_kept") - 1, F.lit(0))).alias("duplicate_rows"),
        F.sum(F.least(F.col("_kept"), F.lit(1))).alias("clean_rows"))


def null_zip_audit(customers: DataFrame, raw_zip: str, parsed: Column) -> DataFrame:
    return customers.filter(parsed.isNull()).withColumn("zip_original", F.col(raw_zip))


def returns_summary(returns: DataFrame) -> DataFrame:
    return with_distinct_counts(
        returns, ["fy"], {"customers": "cust_id", "products": "item_id"}, F.count(F.lit(1)).alias("return_lines"),
        F.round(F.abs(F.sum("amount")), 2).alias("returned_value"))


def dropped_column_audit(raw: DataFrame, kept: Sequence[str]) -> DataFrame:
    """One row per raw column that the clean table does not keep, with its NULL count."""
    gone = [c for c in raw.columns if c not in kept]
    nulls = raw.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in gone])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(c)).alias("null_count"))
                     for c in gone])
    return nulls.select(F.inline(rows))


def shape_purchases(lines: DataFrame, products: DataFrame, mode: str = "line_total") -> DataFrame:
    """Purchase-history rows: whole quantities of at least 1, unit price to 2 places, known items only."""
    qty = F.greatest(F.round("qty").cast("int"), F.lit(1))
    price = F.col("amount") / qty if mode == "line_total" else F.col("amount")
    return (lines.filter((F.col("amount") > 0) & F.col("order_date").isNotNull())
            .join(products.select("item_id"), "item_id", "left_semi")
            .select("order_id", "line_no", "cust_id", "item_id", qty.alias("quantity"),
                    half_up(price).alias("unit_price"), F.col("order_date").alias("sold_at")))
