"""State folded from append-only logs: carts, checkout, assignments, rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..functions.prefix import running
from ..params import REJECTION_REASONS

CLOSING = ("sold", "not_sold", "delete")


def cart_state(log: DataFrame) -> DataFrame:
    """Cart lines from a log of (cust_id, item_id, ts, event_id, action, quantity, price, source).

    Actions: add, set_quantity, sold, not_sold, delete. An add opens a line or bumps the open
    one; a closing action ends it, and the next add opens a new line, so resolved lines never
    change. Actions without an open line do nothing.
    """
    keys, order = ["cust_id", "item_id"], ["ts", "event_id"]
    close = F.col("action").isin(*CLOSING).cast("int")
    added = F.when(F.col("action") == "add", F.col("quantity")).otherwise(0)
    e = running(log.withColumn("_day", F.to_date("ts")), keys, order, "_day",
                {"line_no": (F.sum, close), "added_before": (F.sum, added)})
    at = F.struct("ts", "event_id")
    lines = e.groupBy(*keys, "line_no").agg(
        F.min(F.when(F.col("action") == "add", F.struct("ts", "event_id", "price", "source", "seller_id"))).alias("first_add"),
        F.max(F.when(F.col("action") == "set_quantity",
                     F.struct("ts", "event_id", "quantity", F.col("added_before").alias("at")))).alias("last_set"),
        F.max(F.col("added_before") + added).alias("added_to_end"),
        F.min("added_before").alias("added_to_start"),
        F.max(F.when(close == 1, F.struct(at.alias("at"), "action"))).alias("closed"))
    lines = lines.filter(F.col("first_add").isNotNull())
    set_at, add_at = F.struct("last_set.ts", "last_set.event_id"), F.struct("first_add.ts", "first_add.event_id")
    counts = F.col("last_set").isNotNull() & (set_at > add_at)
    quantity = F.when(counts, F.col("last_set.quantity") + F.col("added_to_end") - F.col("last_set.at")).otherwise(
        F.col("added_to_end") - F.col("added_to_start"))
    out = lines.select(
        F.col("first_add.event_id").alias("cart_item_id"), *keys, quantity.cast("int").alias("quantity"),
        F.col("first_add.price").alias("unit_price"), F.col("first_add.source").alias("source"),
        F.col("first_add.seller_id").alias("seller_id"), F.col("first_add.ts").alias("added_at"),
        F.coalesce("closed.action", F.lit("in_cart")).alias("status"), F.col("closed.at.ts").alias("resolved_at"))
    return out.filter("status <> 'delete' AND quantity > 0")


def checkout(cart: DataFrame) -> DataFrame:
    """Sold lines as purchase rows."""
    return cart.filter("status = 'sold'").select(
        F.col("cart_item_id").alias("purchase_id"), "cust_id", "item_id", "quantity", "unit_price",
        F.col("seller_id").alias("sold_by_seller_id"), F.col("resolved_at").alias("sold_at"), "cart_item_id", "source")


def assignment_history(changes: DataFrame) -> DataFrame:
    """Change log (cust_id, new_seller_id, ts, event_id) with the previous seller and the reason.

    A change to the seller already assigned is skipped.
    """
    owner = F.struct("ts", "event_id", F.coalesce("new_seller_id", F.lit(-1)).alias("who"))
    e = running(changes.withColumn("_day", F.to_date("ts")), ["cust_id"], ["ts", "event_id"], "_day",
                {"_before": (F.max, owner)})
    previous = F.nullif(F.col("_before.who"), F.lit(-1))
    e = e.withColumn("previous_seller_id", previous)
    new, old = F.col("new_seller_id"), F.col("previous_seller_id")
    reason = (F.when(old.isNull(), "admin_assign").when(new.isNull(), "admin_unassign").otherwise("admin_reassign"))
    return e.filter(~old.eqNullSafe(new)).select(
        F.col("event_id").alias("history_id"), "cust_id", "previous_seller_id", "new_seller_id",
        reason.alias("change_reason"), F.col("ts").alias("changed_at"))


def deactivate_sellers(current: DataFrame, sellers: DataFrame) -> DataFrame:
    """History rows that release every customer of the deactivated sellers."""
    return current.join(sellers.select(F.col("user_id").alias("seller_id")), "seller_id", "left_semi").select(
        "cust_id", F.col("seller_id").alias("previous_seller_id"), F.lit(None).cast("bigint").alias("new_seller_id"),
        F.lit("seller_deactivated").alias("change_reason"))


def current_assignment(history: DataFrame) -> DataFrame:
    latest = F.max(F.struct("changed_at", "history_id", F.col("new_seller_id").alias("s"))).alias("l")
    return history.groupBy("cust_id").agg(latest).select(
        "cust_id", F.col("l.s").alias("seller_id"), F.col("l.changed_at").alias("assigned_at")).filter("seller_id IS NOT NULL")


def rejection_resolution(log: DataFrame) -> DataFrame:
    """Outcome rows from shown and rejected events (cust_id, item_id, ts, event_id, kind, source, reason).

    A rejection resolves the latest pending shown event of the pair, else it makes a row of
    its own. Pending events form a stack, so a rejection meets the last shown event that
    reached its depth.
    """
    keys, order = ["cust_id", "item_id"], ["ts", "event_id"]
    log = log.filter((F.col("kind") == "shown") | F.col("reason").isin(*REJECTION_REASONS)).withColumn("_day", F.to_date("ts"))
    step = F.when(F.col("kind") == "shown", 1).otherwise(-1)
    e = running(log, keys, order, "_day", {"_sum": (F.sum, step)}).withColumn("_after", F.col("_sum") + step)
    e = running(e, keys, order, "_day", {"_low": (F.min, F.col("_after"))})
    floor = F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
    before = F.col("_sum") - floor  # pending events just before this one
    e = e.withColumn("_depth", F.when(F.col("kind") == "shown", before + 1).otherwise(before))
    shown = F.when(F.col("kind") == "shown", F.struct("ts", "event_id", "source"))
    m = running(e, [*keys, "_depth"], order, "_day", {"_match": (F.max, shown)})
    rejected = m.filter("kind = 'rejected'").withColumn("_hit", F.col("_depth") > 0)
    resolved = rejected.select(
        F.when(F.col("_hit"), F.col("_match.event_id")).otherwise(F.col("event_id")).alias("event_id"), *keys,
        F.when(F.col("_hit"), F.col("_match.source")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_hit"), F.col("_match.ts")).otherwise(F.col("ts")).alias("shown_at"),
        F.lit("rejected").alias("outcome"), F.col("ts").alias("resolved_at"), F.col("reason").alias("reason_code"),
        flag(F.col("_hit")).alias("was_pending"))
    pending = log.filter("kind = 'shown'").join(resolved.select("event_id"), "event_id", "left_anti").select(
        "event_id", *keys, "source", F.col("ts").alias("shown_at"), F.lit("pending").alias("outcome"),
        F.lit(None).cast(dict(log.dtypes)["ts"]).alias("resolved_at"), F.lit(None).cast("string").alias("reason_code"),
        F.lit(1).alias("was_pending"))
    return resolved.unionByName(pending)


def distinct_cart_items(cart: DataFrame) -> DataFrame:
    """Items of each active cart in add order."""
    first = cart.filter("status = 'in_cart'").groupBy("cust_id", "item_id").agg(
        F.min(F.struct("added_at", "cart_item_id")).alias("f")).withColumn("_day", F.to_date("f.added_at"))
    placed = running(first, ["cust_id"], ["f", "item_id"], "_day", {"_before": (F.sum, F.lit(1))})
    return placed.select("cust_id", "item_id", (F.col("_before") + 1).alias("position"))
