"""Lookups over recommendations, carts, catalogue and customers."""

from pyspark.sql import functions as F

from ..operators import serving as sv
from ..operators import state as st
from ..plans import driver_tables as d
from ..plans.model import Model
from . import products as cp
from . import signals, state  # noqa: F401  (their subqueries)
from .registry import cte, query

M = Model.from_folder

cte("v_stock", "SELECT item_id, CAST(size_no * 3 % 40 AS BIGINT) AS units FROM v_items")
cte("v_open", "SELECT DISTINCT cust_id, item_id FROM v_cart WHERE status = 'in_cart'")
cte("v_both", """
SELECT product_a, product_b, lift, support_ab, confidence FROM v_pp UNION ALL SELECT product_b, product_a, lift, support_ab, confidence FROM v_pp""")


def comp_sql(cart, n):
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY lift DESC, item_id) AS position FROM (
  SELECT c.cust_id, product_b AS item_id, c.item_id AS trigger_item, lift, support_ab, confidence, row_number() OVER (PARTITION BY c.cust_id, product_b
    ORDER BY lift DESC, confidence DESC, c.item_id) AS k FROM {cart} c JOIN v_both ON product_a = c.item_id
  WHERE NOT EXISTS (SELECT 1 FROM {cart} x WHERE x.cust_id = c.cust_id AND x.item_id = product_b)) WHERE k = 1) WHERE position <= {n}"""


def swap_sql(cart, kind, n, improving):
    return f"""
SELECT *, round(-price_delta_pct * 100, 4) AS savings_pct FROM (SELECT c.cust_id, c.item_id AS cart_item, equivalent_item AS item_id, price_delta_pct,
  row_number() OVER (PARTITION BY c.cust_id ORDER BY price_delta_pct, c.item_id, equivalent_item) AS position FROM {cart} c JOIN v_equiv ON original_item = c.item_id
  WHERE match_type = '{kind}' {'AND is_price_improvement = 1' if improving else ''}) WHERE position <= {n}"""


def stock(spark, sf):
    return d.items(spark, sf).select("item_id", (F.col("size_no") * 3 % 40).cast("bigint").alias("units"))


def open_cart(spark, sf):
    return state.cart(spark, sf).filter("status = 'in_cart'").select("cust_id", "item_id").distinct()


@query("j1_top_n_with_stock", """
SELECT r.cust_id, r.item_id, rank, primary_signal, units, CASE WHEN units > 0 THEN 1 ELSE 0 END AS in_stock FROM v_recs r LEFT JOIN v_stock s ON s.item_id = r.item_id WHERE rank <= 5""")
def _(spark, sf):
    return sv.top_n_with_stock(M(spark, sf).recommendations(), stock(spark, sf), 5).select(
        "cust_id", "item_id", "rank", "primary_signal", "units", "in_stock")


@query("j2_cold_start_lookup", """
SELECT specialty, item_id, recent_buyer_count_6mo, n_buyers, rank, CASE WHEN t = 0 THEN 'Popular in your specialty (' || specialty || ').' ELSE 'Popular across all customers.' END AS pitch FROM (
  SELECT *, row_number() OVER (PARTITION BY specialty ORDER BY t, recent_buyer_count_6mo DESC NULLS LAST, n_buyers DESC NULLS LAST, item_id) AS rank FROM (
    SELECT c.specialty, f.item_id, recent_buyer_count_6mo, n_buyers, CASE WHEN top_specialty_1 = c.specialty THEN 0 ELSE 1 END AS t
    FROM (SELECT DISTINCT specialty FROM v_customers) c, v_pf f LEFT JOIN v_pspec s ON s.item_id = f.item_id WHERE is_discontinued = 0)) WHERE rank <= 10""")
def _(spark, sf):
    m = M(spark, sf)
    return sv.cold_start_lookup(m.product_features, m.product_specialty, m.customers.select("specialty").distinct(), 10)


@query("j3_cart_complements", f"SELECT cust_id, item_id, trigger_item, lift, position FROM ({comp_sql('v_open', 5)})")
def _(spark, sf):
    return sv.cart_complements(open_cart(spark, sf), M(spark, sf).product_pairs, 5).select(
        "cust_id", "item_id", "trigger_item", "lift", "position")


@query("j4_cart_brand_upgrades", swap_sql("v_open", "private_brand_upgrade", 3, True))
def _(spark, sf):
    return sv.cart_swaps(open_cart(spark, sf), M(spark, sf).equivalents, "private_brand_upgrade", 3, True)


@query("j4_cart_conversions", swap_sql("v_open", "competitor_conversion", 3, False))
def _(spark, sf):
    return sv.cart_swaps(open_cart(spark, sf), M(spark, sf).equivalents, "competitor_conversion", 3, False)


@query("j5_cart_helper", f"""
SELECT h.*, item_dsc, family, units FROM (
  SELECT cust_id, 'complement' AS kind, trigger_item AS cart_item, item_id, position, lift, CAST(NULL AS DOUBLE) AS savings_pct FROM ({comp_sql('v_open', 5)})
  UNION ALL SELECT cust_id, 'brand_upgrade', cart_item, item_id, position, NULL, savings_pct FROM ({swap_sql('v_open', 'private_brand_upgrade', 3, True)})
  UNION ALL SELECT cust_id, 'conversion', cart_item, item_id, position, NULL, savings_pct FROM ({swap_sql('v_open', 'competitor_conversion', 3, False)})) h
LEFT JOIN v_items i ON i.item_id = h.item_id LEFT JOIN v_stock s ON s.item_id = h.item_id""")
def _(spark, sf):
    m = M(spark, sf)
    return sv.cart_helper(open_cart(spark, sf), m.product_pairs, m.equivalents, m.items, stock(spark, sf)).drop("pitch")


@query("j7_product_browse", """
SELECT item_id, item_dsc, family, units, total_matches FROM (SELECT *, count(*) OVER () AS total_matches FROM v_items JOIN v_stock USING (item_id)
  WHERE (item_dsc ILIKE '%RING%' OR family ILIKE '%RING%' OR category ILIKE '%RING%' OR supplier ILIKE '%RING%') AND is_private_brand = 0 AND units > 0)
ORDER BY item_dsc, item_id OFFSET 10 LIMIT 20""")
def _(spark, sf):
    return sv.product_browse(d.items(spark, sf), stock(spark, sf), "RING", {"is_private_brand": 0}, True, 10, 20).select(
        "item_id", "item_dsc", "family", "units", "total_matches")


@query("j7_product_by_id", "SELECT item_id, item_dsc, family FROM v_items WHERE item_id = 42")
def _(spark, sf):
    return sv.product_browse(d.items(spark, sf), stock(spark, sf), "42").select("item_id", "item_dsc", "family")


@query("j8_facet_values", """
SELECT DISTINCT 'family' AS facet, family AS value FROM v_items UNION SELECT DISTINCT 'category', category FROM v_items UNION SELECT DISTINCT 'supplier', supplier FROM v_items""")
def _(spark, sf):
    return sv.facet_values(d.items(spark, sf), ("family", "category", "supplier"))


@query("j9_customer_search", """
SELECT cust_id, cust_name, market, CASE WHEN cust_id IN (SELECT cust_id FROM v_current) THEN 1 ELSE 0 END AS has_account FROM v_customers WHERE cust_name ILIKE '%R#00000001%'""")
def _(spark, sf):
    accounts = st.current_assignment(st.assignment_history(state.changes(spark, sf)))
    return sv.customer_filter(d.customers(spark, sf), accounts, term="r#00000001").select("cust_id", "cust_name", "market", "has_account")


@query("j9_customer_filter", """
SELECT cust_id, segment, specialty, 0 AS has_account FROM (SELECT g.cust_id, g.segment, specialty FROM v_segments g JOIN v_customers c ON c.cust_id = g.cust_id)
WHERE segment = 'BUILDING_new' AND cust_id NOT IN (SELECT cust_id FROM v_current)""")
def _(spark, sf):
    m = M(spark, sf)
    accounts = st.current_assignment(st.assignment_history(state.changes(spark, sf)))
    c = m.customers.join(m.segments, "cust_id")
    return sv.customer_filter(c, accounts, {"segment": "BUILDING_new"}, has_account=False).select("cust_id", "segment", "specialty", "has_account")


cte("v_hist_lines", """
SELECT order_id * 1000000 + line_no AS purchase_id, cust_id, item_id, CAST(qty AS INTEGER) AS quantity, CAST(round(CAST(amount / qty AS DECIMAL(28, 8)), 2) AS DOUBLE) AS unit_price, order_date AS sold_at FROM v_sales""")


def purchase_lines(spark, sf):
    from ..functions.columns import half_up
    s = M(spark, sf).sales
    return s.select((F.col("order_id") * 1000000 + F.col("line_no")).alias("purchase_id"), "cust_id", "item_id", F.col("qty").cast("int").alias("quantity"),
                    half_up(F.col("amount") / F.col("qty")).alias("unit_price"), F.col("order_date").alias("sold_at"))


@query("j10_purchase_page", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY sold_at DESC, purchase_id DESC) AS position FROM v_hist_lines) WHERE position > 5 AND position <= 15""")
def _(spark, sf):
    return sv.purchase_page(purchase_lines(spark, sf), 5, 10)


@query("j10_order_grouping", """
SELECT cust_id, sold_at AS order_day, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS units, round(sum(quantity * unit_price), 2) AS total FROM v_hist_lines GROUP BY 1, 2""")
def _(spark, sf):
    return sv.order_grouping(purchase_lines(spark, sf))


@query("j11_cart_view", """
SELECT cart_item_id, c.cust_id, c.item_id, quantity, unit_price, item_dsc, units, round(quantity * unit_price, 2) AS line_total
FROM v_cart c LEFT JOIN v_items i ON i.item_id = c.item_id LEFT JOIN v_stock s ON s.item_id = c.item_id WHERE status = 'in_cart'""")
def _(spark, sf):
    return sv.cart_view(state.cart(spark, sf), d.items(spark, sf), stock(spark, sf)).select(
        "cart_item_id", "cust_id", "item_id", "quantity", "unit_price", "item_dsc", "units", "line_total")


@query("j11_cart_totals", """
SELECT cust_id, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS n_units, round(sum(quantity * unit_price), 2) AS cart_total FROM v_cart WHERE status = 'in_cart' GROUP BY 1""")
def _(spark, sf):
    return sv.cart_totals(state.cart(spark, sf))


cte("v_users", "SELECT s_suppkey AS user_id, s_name AS full_name FROM supplier")


def users(spark, sf):
    return d.raw(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("full_name"))


@query("j12_seller_book", """
SELECT b.cust_id, seller_id, assigned_at, position, total_customers, cust_name FROM (SELECT *, count(*) OVER (PARTITION BY seller_id) AS total_customers,
  row_number() OVER (PARTITION BY seller_id ORDER BY assigned_at DESC, cust_id) AS position FROM v_current) b LEFT JOIN v_customers c ON c.cust_id = b.cust_id WHERE position <= 10""")
def _(spark, sf):
    current = st.current_assignment(st.assignment_history(state.changes(spark, sf)))
    return sv.seller_book(current, d.customers(spark, sf), 10)


@query("j12_assignment_page", """
SELECT h.*, a.full_name AS previous_name, b.full_name AS new_name FROM (SELECT * FROM v_assign ORDER BY changed_at DESC, history_id DESC OFFSET 20 LIMIT 50) h
LEFT JOIN v_users a ON a.user_id = previous_seller_id LEFT JOIN v_users b ON b.user_id = new_seller_id""")
def _(spark, sf):
    return sv.assignment_page(st.assignment_history(state.changes(spark, sf)), users(spark, sf), 20, 50)


@query("j13_recs_by_variant", """
SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY lead_rank) AS position FROM (
  SELECT cust_id, group_key, min(rank) AS lead_rank, min_by(r.item_id, rank) AS lead_item, count(*) AS n_variants FROM v_recs r JOIN v_variant v ON v.item_id = r.item_id GROUP BY 1, 2)""")
def _(spark, sf):
    from ..functions import text
    keys = cp._variant_items(spark, sf).select("item_id", text.variant_group_key(
        "item_id", "item_dsc", "family", "category", "is_private_brand").alias("group_key"))
    return sv.recs_by_variant(M(spark, sf).recommendations(), keys)
