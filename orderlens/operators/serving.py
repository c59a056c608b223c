"""Lookup reads in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import flag


def resolve_names(df: DataFrame, users: DataFrame, names: dict[str, str]) -> DataFrame:
    """User names for several user-id columns of one frame."""
    for id_col, name_col in names.items():
        df = df.join(users.select(F.col("user_id").alias(id_col), F.col("full_name").alias(name_col)),
                     id_col, "left")
    return df


# ---- recommendations ----

def top_n_with_stock(recs: DataFrame, inventory: DataFrame, n: int, cust_id: int | None = None) -> DataFrame:
    """First n recommendations with the units in stock; one customer, or all of them."""
    rows = recs.filter(F.col("rank") <= n)
    if cust_id is not None:
        rows = rows.filter(F.col("cust_id") == cust_id)
    return rows.join(inventory.select("item_id", "units"), "item_id", "left").withColumn(
        "in_stock", flag(F.col("units") > 0))


def cold_start_lookup(features: DataFrame, specialty: DataFrame, specialties: DataFrame, n: int) -> DataFrame:
    """For each specialty: its own products first, then the most bought of the rest.

    If a specialty has fewer than n products of its own, the rest comes from the overall
    top 2n, because fewer than n of those can be its own.
    """
    df = features.filter(F.coalesce("is_discontinued", F.lit(0)) == 0).join(
        specialty.select("item_id", "top_specialty_1"), "item_id", "left").select(
        "item_id", "recent_buyer_count_6mo", "n_buyers", "top_specialty_1")
    best = [F.desc_nulls_last("recent_buyer_count_6mo"), F.desc_nulls_last("n_buyers"), "item_id"]
    own = rk.top_k(df.join(specialties.withColumnRenamed("specialty", "top_specialty_1"), "top_specialty_1", "left_semi"),
                   ["top_specialty_1"], best, n, "r").withColumn("specialty", F.col("top_specialty_1")).withColumn("tier", F.lit(0))
    overall = df.orderBy(*best).limit(2 * n).agg(F.collect_list(F.struct(
        "item_id", "recent_buyer_count_6mo", "n_buyers", "top_specialty_1")).alias("rows")).scalar()
    other = specialties.withColumn("_rows", overall).select("specialty", F.inline("_rows")).filter(
        ~F.col("top_specialty_1").eqNullSafe(F.col("specialty"))).withColumn("tier", F.lit(1))
    cols = ["specialty", "item_id", "recent_buyer_count_6mo", "n_buyers", "tier"]
    out = rk.top_k(own.select(*cols).unionByName(other.select(*cols)), ["specialty"], ["tier", *best], n)
    return out.withColumn("pitch", F.when(F.col("tier") == 0, F.concat(F.lit("Popular in your specialty ("), F.col("specialty"), F.lit(").")))
                          .otherwise("Popular across all customers.")).drop("tier")


# ---- cart helper ----

def cart_complements(cart: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Best trigger per partner item outside the cart, strongest n per customer.

    pairs holds both directions; a pair kept in one direction only still counts for both.
    """
    both = pairs.select("product_a", "product_b", "lift", "support_ab", "confidence").unionByName(pairs.select(
        F.col("product_b").alias("product_a"), F.col("product_a").alias("product_b"), "lift", "support_ab", "confidence"))
    hits = cart.select("cust_id", F.col("item_id").alias("trigger_item")).join(
        both.withColumnRenamed("product_a", "trigger_item").withColumnRenamed("product_b", "item_id"), "trigger_item")
    hits = hits.join(cart.select("cust_id", "item_id"), ["cust_id", "item_id"], "left_anti")
    best = rk.first_per_key(hits, ["cust_id", "item_id"], [F.desc("lift"), F.desc("confidence"), "trigger_item"])
    return rk.top_k(best, ["cust_id"], [F.desc("lift"), "item_id"], n, "position")


def cart_swaps(cart: DataFrame, equivalents: DataFrame, kind: str, n: int, improving_only: bool) -> DataFrame:
    """Equivalents of cart items with the saving in percent, cheapest first."""
    e = equivalents.filter(F.col("match_type") == kind)
    if improving_only:
        e = e.filter("is_price_improvement = 1")
    hits = cart.select("cust_id", F.col("item_id").alias("cart_item")).join(
        e.select(F.col("original_item").alias("cart_item"), F.col("equivalent_item").alias("item_id"), "price_delta_pct"), "cart_item")
    out = rk.top_k(hits, ["cust_id"], ["price_delta_pct", "cart_item", "item_id"], n, "position")
    return out.withColumn("savings_pct", F.round(-F.col("price_delta_pct") * 100, 4))


def cart_helper(cart: DataFrame, pairs: DataFrame, equivalents: DataFrame, items: DataFrame, inventory: DataFrame,
                n_complements: int = 5, n_swaps: int = 3) -> DataFrame:
    """All suggestions for all carts as one tagged table."""
    none = F.lit(None).cast("double")
    comp = cart_complements(cart, pairs, n_complements).select(
        "cust_id", F.lit("complement").alias("kind"), F.col("trigger_item").alias("cart_item"), "item_id", "position",
        "lift", none.alias("savings_pct"), F.concat(F.lit("Often bought with an item in this cart, "), F.round("lift", 1).cast("string"),
                                                    F.lit(" times more than chance.")).alias("pitch"))

    def swaps(kind, tag, improving, pitch):
        s = cart_swaps(cart, equivalents, kind, n_swaps, improving)
        return s.select("cust_id", F.lit(tag).alias("kind"), "cart_item", "item_id", "position", none.alias("lift"), "savings_pct",
                        F.lit(pitch).alias("pitch"))
    out = comp.unionByName(swaps("private_brand_upgrade", "brand_upgrade", True, "House brand alternative at a lower price.")).unionByName(
        swaps("competitor_conversion", "conversion", False, "Comparable product to replace a competitor item."))
    return out.join(items.select("item_id", "item_dsc", "family"), "item_id", "left").join(
        inventory.select("item_id", "units"), "item_id", "left")


# ---- catalogue, customers, purchases, carts ----

def text_search(df: DataFrame, term: str | None, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """A number is an id; anything else is a case-insensitive substring of any of the columns."""
    if not term:
        return df
    if term.strip().isdigit():
        return df.filter(F.col(id_col) == int(term))
    literal = term.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{literal}%"), F.lit(False))
    return df.filter(cond)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page with the number of all matches."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_matches", total)


def product_browse(items: DataFrame, inventory: DataFrame, term: str | None = None, equals: dict | None = None,
                   in_stock_only: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    df = items.join(inventory.select("item_id", "units"), "item_id", "left")
    df = text_search(df, term, "item_id", ("item_dsc", "family", "category", "supplier"))
    for column, value in (equals or {}).items():
        df = df.filter(F.col(column) == value)
    if in_stock_only:
        df = df.filter(F.col("units") > 0)
    return page(df, ["item_dsc", "item_id"], offset, limit)


def facet_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter("value IS NOT NULL").distinct().orderBy("facet", "value")


def customer_filter(customers: DataFrame, accounts: DataFrame, equals: dict | None = None, term: str | None = None,
                    has_account: bool | None = None) -> DataFrame:
    df = text_search(customers, term, "cust_id", ("cust_name",))
    for column, value in (equals or {}).items():
        df = df.filter(F.col(column) == value)
    known = accounts.select("cust_id").distinct()
    if has_account is not None:
        return df.join(known, "cust_id", "left_semi" if has_account else "left_anti").withColumn(
            "has_account", F.lit(int(has_account)))
    return df.join(known.withColumn("_a", F.lit(1)), "cust_id", "left").withColumn(
        "has_account", F.coalesce("_a", F.lit(0))).drop("_a")


def purchase_page(purchases: DataFrame, offset: int, limit: int) -> DataFrame:
    """The same page of every customer's history, newest first."""
    ranked = rk.top_k(purchases, ["cust_id"], [F.desc("sold_at"), F.desc("purchase_id")], offset + limit, "position")
    return ranked.filter(F.col("position") > offset)


def order_grouping(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy("cust_id", F.to_date("sold_at").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"),
        F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2).alias("total"))


def cart_view(cart: DataFrame, items: DataFrame, inventory: DataFrame) -> DataFrame:
    lines = cart.filter("status = 'in_cart'").join(items.select("item_id", "item_dsc", "family"), "item_id", "left").join(
        inventory.select("item_id", "units"), "item_id", "left")
    return lines.withColumn("line_total", F.round(F.col("quantity") * F.col("unit_price"), 2))


def cart_totals(cart: DataFrame) -> DataFrame:
    """Totals per cart; the amount is NULL when no line has a price."""
    return cart.filter("status = 'in_cart'").groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("n_units"),
        F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2).alias("cart_total"))


def seller_book(current: DataFrame, customers: DataFrame, limit: int) -> DataFrame:
    """Newest assigned customers of every seller, and how many there are."""
    total = current.groupBy("seller_id").agg(F.count(F.lit(1)).alias("total_customers"))
    top = rk.top_k(current, ["seller_id"], [F.desc("assigned_at"), "cust_id"], limit, "position")
    return top.join(total, "seller_id").join(customers.select("cust_id", "cust_name"), "cust_id", "left")


def assignment_page(history: DataFrame, users: DataFrame, offset: int, limit: int) -> DataFrame:
    newest = history.orderBy(F.desc("changed_at"), F.desc("history_id")).offset(offset).limit(limit)
    return resolve_names(newest, users, {"previous_seller_id": "previous_name", "new_seller_id": "new_name"})


def recs_by_variant(recs: DataFrame, keys: DataFrame) -> DataFrame:
    """A customer's recommendations collapsed by variant group, led by the best rank."""
    by = recs.select("cust_id", "item_id", "rank").join(keys.select("item_id", "group_key"), "item_id").groupBy(
        "cust_id", "group_key").agg(F.min("rank").alias("lead_rank"), F.min_by("item_id", "rank").alias("lead_item"),
                                    F.count(F.lit(1)).alias("n_variants"))
    return by.withColumn("position", F.row_number().over(Window.partitionBy("cust_id").orderBy("lead_rank", "group_key")))
