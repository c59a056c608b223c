"""Dashboard reports over purchases, carts and outcomes."""

from pyspark.sql import functions as F

from ..operators import customers as cu
from ..operators import dashboards as db
from ..operators import state as st
from ..plans import driver_tables as d
from ..plans.model import Model
from . import serving as sv
from . import state as cs
from .registry import cte, half_up, query

M = Model.from_folder
NOW = "2024-01-31"
cte("v_sold", """
SELECT event_id AS purchase_id, cust_id, item_id, quantity, price AS unit_price, seller_id AS sold_by_seller_id, ts AS sold_at, source FROM v_events WHERE event_type = 'purchase'""")


def sold(spark, sf):
    return d.event_log(spark, sf).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "cust_id", "item_id", "quantity", F.col("price").alias("unit_price"),
        F.col("seller_id").alias("sold_by_seller_id"), F.col("ts").alias("sold_at"), "source")


def accounts(spark, sf):
    return st.current_assignment(st.assignment_history(cs.changes(spark, sf)))


def outcomes(spark, sf):
    return st.rejection_resolution(cs.rejection_log(spark, sf))


_REV = "round(sum(quantity * unit_price), 2)"
_SINCE = "sold_at >= CAST('2024-01-31' AS DATE) - {}"


@query("k1_overview_kpis", f"""
SELECT (SELECT count(*) FROM v_customers) AS n_customers, (SELECT count(DISTINCT cust_id) FROM v_current) AS n_accounts, (SELECT count(*) FROM v_items) AS n_products,
  (SELECT round(avg(is_private_brand) * 100, 2) FROM v_items) AS private_brand_pct, count(DISTINCT cust_id) AS active_carts, count(*) AS cart_lines, {_REV} AS cart_value
FROM v_cart WHERE status = 'in_cart'""")
def _(spark, sf):
    return db.overview_kpis(d.customers(spark, sf), accounts(spark, sf), d.items(spark, sf), cs.cart(spark, sf))


@query("k2_sales_period", f"""
SELECT count(*) AS transactions, {_REV} AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity, count(DISTINCT cust_id) AS customers, count(DISTINCT sold_by_seller_id) AS sellers
FROM v_sold WHERE {_SINCE.format(7)}""")
def _(spark, sf):
    return db.sales_period(sold(spark, sf), NOW, 7)


_AGG = f"count(*) AS order_count, {_REV} AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity"


@query("k3_sales_trend_daily", f"""
SELECT CAST(date_trunc('day', sold_at) AS DATE) AS bucket_start, {_AGG}, strftime(date_trunc('day', sold_at), '%Y-%m-%d') AS bucket FROM v_sold WHERE {_SINCE.format(30)} GROUP BY 1, 5""")
def _(spark, sf):
    return db.sales_trend(sold(spark, sf), "daily", NOW, 30)


@query("k3_sales_trend_weekly", f"""
SELECT CAST(date_trunc('week', sold_at) AS DATE) AS bucket_start, {_AGG}, strftime(date_trunc('week', sold_at), '%G-W%V') AS bucket FROM v_hist_lines GROUP BY 1, 5""")
def _(spark, sf):
    return db.sales_trend(sv.purchase_lines(spark, sf), "weekly", NOW)


@query("k3_sales_trend_monthly", f"""
SELECT CAST(date_trunc('month', sold_at) AS DATE) AS bucket_start, {_AGG}, strftime(date_trunc('month', sold_at), '%Y-%m') AS bucket FROM v_hist_lines GROUP BY 1, 5""")
def _(spark, sf):
    return db.sales_trend(sv.purchase_lines(spark, sf), "monthly", NOW)


_CONV = f"""count(*) AS cart_adds, CAST(sum(CASE WHEN status = 'sold' THEN 1 ELSE 0 END) AS BIGINT) AS checkouts,
  CAST(sum(CASE WHEN status IN ('not_sold', 'in_cart') THEN 1 ELSE 0 END) AS BIGINT) AS abandons, round(sum(CASE WHEN status = 'sold' THEN quantity * unit_price ELSE 0 END), 2) AS revenue,
  CAST(sum(CASE WHEN status = 'sold' THEN quantity ELSE 0 END) AS BIGINT) AS quantity_sold,
  {half_up("sum(CASE WHEN status = 'sold' THEN 1 ELSE 0 END) / count(*) * 100")} AS conversion_rate_pct"""


@query("k4_conversion_by_signal", f"SELECT coalesce(source, 'manual') AS source, {_CONV} FROM v_cart GROUP BY 1")
def _(spark, sf):
    return db.conversion_by_signal(cs.cart(spark, sf))


@query("k4_conversion_by_signal_and_seller", f"SELECT seller_id, coalesce(source, 'manual') AS source, {_CONV} FROM v_cart GROUP BY 1, 2")
def _(spark, sf):
    return db.conversion_by_signal(cs.cart(spark, sf), ["seller_id"])


@query("k5_segment_distribution", """
SELECT segment, count(*) AS n_customers, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct,
  CASE split_part(segment, '_', 1) WHEN 'BUILDING' THEN 'Building trade' WHEN 'FURNITURE' THEN 'Furniture makers' ELSE split_part(segment, '_', 1) END || ', ' ||
  CASE split_part(segment, '_', 2) WHEN 'new' THEN 'New Customer' WHEN 'small' THEN 'Small' WHEN 'mid' THEN 'Mid-Market' WHEN 'large' THEN 'Large' ELSE 'Enterprise' END AS display_name
FROM v_segments GROUP BY segment""")
def _(spark, sf):
    return db.segment_distribution(M(spark, sf).segments, cu.segment_names(
        "segment", {"BUILDING": "Building trade", "FURNITURE": "Furniture makers"}))


@query("k6_top_sellers", f"""
SELECT t.user_id, t.full_name, total_sales, total_revenue, total_quantity, coalesce(n, 0) AS customers_managed, {half_up('total_revenue / total_sales')} AS avg_order_value FROM (
  SELECT u.user_id, u.full_name, count(*) AS total_sales, {_REV} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM v_sold s JOIN v_users u ON u.user_id = sold_by_seller_id
  WHERE {_SINCE.format(30)} GROUP BY 1, 2 ORDER BY total_revenue DESC, 1 LIMIT 5) t LEFT JOIN (SELECT seller_id, count(*) AS n FROM v_current GROUP BY 1) c ON c.seller_id = t.user_id""")
def _(spark, sf):
    return db.top_sellers(sold(spark, sf), sv.users(spark, sf), accounts(spark, sf), NOW, 30, 5)


_FEED = """SELECT p.purchase_id, p.cust_id, p.item_id, sold_by_seller_id, quantity, unit_price, sold_at, source, cust_name, item_dsc, family, full_name AS seller_name,
  round(quantity * unit_price, 2) AS line_total, CASE WHEN starts_with(source, 'recommendation_') THEN 1 ELSE 0 END AS from_recommendation"""


@query("k7_recent_sales", f"""
{_FEED} FROM (SELECT * FROM v_sold ORDER BY sold_at DESC, purchase_id DESC LIMIT 200) p LEFT JOIN v_customers c ON c.cust_id = p.cust_id LEFT JOIN v_items i ON i.item_id = p.item_id
LEFT JOIN v_users u ON u.user_id = sold_by_seller_id""")
def _(spark, sf):
    return db.recent_sales(sold(spark, sf), d.customers(spark, sf), d.items(spark, sf), sv.users(spark, sf), 200)


@query("c13_purchase_hydration", """
SELECT h.purchase_id, h.cust_id, h.item_id, cust_name, item_dsc, c.status, full_name AS seller_name FROM v_purchases h LEFT JOIN v_customers k ON k.cust_id = h.cust_id
LEFT JOIN v_items i ON i.item_id = h.item_id LEFT JOIN v_users u ON u.user_id = h.sold_by_seller_id LEFT JOIN v_cart c ON c.cart_item_id = h.cart_item_id""")
def _(spark, sf):
    cart = cs.cart(spark, sf)
    return (st.checkout(cart).join(d.customers(spark, sf).select("cust_id", "cust_name"), "cust_id", "left")
            .join(d.items(spark, sf).select("item_id", "item_dsc"), "item_id", "left")
            .join(sv.users(spark, sf).select(F.col("user_id").alias("sold_by_seller_id"), F.col("full_name").alias("seller_name")), "sold_by_seller_id", "left")
            .join(cart.select("cart_item_id", "status"), "cart_item_id", "left")
            .select("purchase_id", "cust_id", "item_id", "cust_name", "item_dsc", "status", "seller_name"))


def _summary_sql(key, src):
    return f"""
SELECT *, {half_up('total_revenue / total_orders')} AS avg_order_value FROM (SELECT {key}, count(*) AS total_orders, {_REV} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_items,
  count(DISTINCT item_id) AS distinct_products, CAST(min(sold_at) AS DATE) AS first_order_date, CAST(max(sold_at) AS DATE) AS last_order_date FROM {src} GROUP BY 1)"""


@query("k8_customer_summary", _summary_sql("cust_id", "v_hist_lines"))
def _(spark, sf):
    return db.drilldown_summary(sv.purchase_lines(spark, sf), "cust_id")


@query("k8_seller_summary", _summary_sql("sold_by_seller_id", "v_sold"))
def _(spark, sf):
    return db.drilldown_summary(sold(spark, sf), "sold_by_seller_id")


@query("k8_seller_trend", f"""
SELECT sold_by_seller_id, CAST(date_trunc('week', sold_at) AS DATE) AS bucket_start, {_AGG}, strftime(date_trunc('week', sold_at), '%G-W%V') AS bucket FROM v_sold GROUP BY 1, 2, 6""")
def _(spark, sf):
    return db.sales_trend(sold(spark, sf), "weekly", NOW, None, ["sold_by_seller_id"])


def _top_sql(key, by, src, k):
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY revenue DESC, {by}) AS rank, round(revenue / sum(revenue) OVER (PARTITION BY {key}) * 100, 2) AS pct_of_revenue FROM (
  SELECT {key}, {by}, {_REV} AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS order_count FROM {src} GROUP BY 1, 2)) WHERE rank <= {k}"""


@query("k8_customer_top_products", _top_sql("cust_id", "item_id", "v_hist_lines", 10))
def _(spark, sf):
    return db.drilldown_top(sv.purchase_lines(spark, sf), d.items(spark, sf), "cust_id", "item_id", 10)


@query("k8_seller_top_families", _top_sql("sold_by_seller_id", "family", "(SELECT s.*, family FROM v_sold s LEFT JOIN v_items i ON i.item_id = s.item_id)", 5))
def _(spark, sf):
    return db.drilldown_top(sold(spark, sf), d.items(spark, sf), "sold_by_seller_id", "family", 5)


@query("k9_top_customers", f"""
SELECT t.*, cust_name FROM (SELECT cust_id, count(*) AS total_orders, {_REV} AS total_revenue FROM v_sold WHERE {_SINCE.format(20)} AND sold_at <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1
  ORDER BY total_revenue DESC, cust_id LIMIT 15) t LEFT JOIN v_customers c ON c.cust_id = t.cust_id""")
def _(spark, sf):
    return db.top_customers(sold(spark, sf), d.customers(spark, sf), NOW, 20, 15)


_P = lambda a, b: f"coalesce({half_up(f'{a} / nullif({b}, 0) * 100')}, 0)"


@query("k10_engine_effectiveness", f"""
WITH a AS (SELECT source, count(*) AS cart_adds, sum(CASE WHEN status = 'sold' THEN 1 ELSE 0 END) AS sold, sum(CASE WHEN status = 'not_sold' THEN 1 ELSE 0 END) AS not_sold_cart,
  round(sum(CASE WHEN status = 'sold' THEN quantity * unit_price ELSE 0 END), 2) AS revenue FROM v_cart WHERE starts_with(source, 'recommendation_') GROUP BY 1),
r AS (SELECT source, count(*) AS rejected FROM v_outcomes WHERE outcome = 'rejected' AND starts_with(source, 'recommendation_') GROUP BY 1),
b AS (SELECT coalesce(a.source, r.source) AS source, coalesce(cart_adds, 0) AS cart_adds, coalesce(sold, 0) AS sold, coalesce(not_sold_cart, 0) AS not_sold_cart, coalesce(rejected, 0) AS rejected,
  coalesce(revenue, 0) AS revenue FROM a FULL JOIN r ON a.source = r.source),
t AS (SELECT coalesce(source, 'TOTAL') AS source, CAST(sum(cart_adds) AS BIGINT) AS cart_adds, CAST(sum(sold) AS BIGINT) AS sold, CAST(sum(not_sold_cart) AS BIGINT) AS not_sold_cart,
  CAST(sum(rejected) AS BIGINT) AS rejected, round(sum(revenue), 2) AS revenue FROM b GROUP BY ROLLUP (b.source))
SELECT *, cart_adds + rejected AS engaged, {_P('sold', 'cart_adds')} AS conversion_rate_pct, {_P('cart_adds', '(cart_adds + rejected)')} AS acceptance_rate_pct,
  {_P('rejected', '(cart_adds + rejected)')} AS rejection_rate_pct FROM t""")
def _(spark, sf):
    return db.engine_effectiveness(cs.cart(spark, sf), outcomes(spark, sf))


@query("k10_rejection_reasons", "SELECT reason_code, count(*) AS n FROM v_outcomes WHERE outcome = 'rejected' AND reason_code IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return db.rejection_reasons(outcomes(spark, sf))


@query("k11_lifecycle_funnel", """
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct, CASE status WHEN 'cold_start' THEN 'Cold Start' WHEN 'stable_warm' THEN 'Stable' WHEN 'declining_warm' THEN 'Declining'
  WHEN 'churned_warm' THEN 'Churned' ELSE 'Other' END AS label, CASE status WHEN 'cold_start' THEN 0 WHEN 'stable_warm' THEN 1 WHEN 'declining_warm' THEN 2 WHEN 'churned_warm' THEN 3 ELSE 4 END AS position,
  CASE WHEN status IN ('declining_warm', 'churned_warm') THEN 1 ELSE 0 END AS is_at_risk
FROM (SELECT CASE WHEN s.status IS NULL THEN 'other' ELSE s.status END AS status FROM v_customers c LEFT JOIN v_status s ON s.cust_id = c.cust_id) GROUP BY status""")
def _(spark, sf):
    m = M(spark, sf)
    return db.lifecycle_funnel(m.customers.select("cust_id").join(
        m.patterns.select("cust_id", cu.lifecycle_status().alias("status")), "cust_id", "left"))


@query("k12_reorder_heatmap", """
SELECT cust_id, day, n, CASE WHEN n = 0 THEN 0 WHEN b <= 1 THEN 4 WHEN n / b <= 0.25 THEN 1 WHEN n / b <= 0.5 THEN 2 WHEN n / b <= 0.75 THEN 3 ELSE 4 END AS intensity FROM (
  SELECT g.cust_id, g.day, coalesce(n, 0) AS n, max(coalesce(n, 0)) OVER (PARTITION BY g.cust_id) AS b FROM (
    SELECT cust_id, CAST(unnest(generate_series(DATE '2023-11-03', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT cust_id FROM v_sold)) g
  LEFT JOIN (SELECT cust_id, CAST(sold_at AS DATE) AS day, count(*) AS n FROM v_sold GROUP BY 1, 2) s ON s.cust_id = g.cust_id AND s.day = g.day)""")
def _(spark, sf):
    return db.reorder_heatmap(sold(spark, sf), NOW)


@query("k13_category_mix", f"""
SELECT * FROM (SELECT cust_id, CASE WHEN r > 3 THEN 'Other categories' ELSE family END AS family, CASE WHEN r > 3 THEN 1 ELSE 0 END AS is_other, round(sum(revenue), 2) AS revenue,
  round(round(sum(revenue), 2) / any_value(t) * 100, 2) AS pct FROM (
  SELECT *, sum(revenue) OVER (PARTITION BY cust_id) AS t, row_number() OVER (PARTITION BY cust_id ORDER BY revenue DESC, family) AS r FROM (
    SELECT cust_id, family, {_REV} AS revenue FROM v_hist_lines h JOIN v_items i ON i.item_id = h.item_id GROUP BY 1, 2) WHERE revenue > 0) GROUP BY 1, 2, 3) WHERE is_other = 0 OR pct > 0.5""")
def _(spark, sf):
    return db.category_mix(sv.purchase_lines(spark, sf), d.items(spark, sf), 3)


@query("k14_low_stock_in_top_family", f"""
WITH f AS (SELECT cust_id, family FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY r DESC, family) AS k FROM (
  SELECT cust_id, family, {_REV} AS r FROM v_hist_lines h JOIN v_items i ON i.item_id = h.item_id GROUP BY 1, 2)) WHERE k = 1),
l AS (SELECT * FROM (SELECT i.item_id, family, units, row_number() OVER (PARTITION BY family ORDER BY units, i.item_id) AS position FROM v_items i JOIN v_stock s ON s.item_id = i.item_id
  WHERE units > 0 AND units < 30) WHERE position <= 5)
SELECT f.cust_id, f.family, item_id, units, position FROM f JOIN l ON l.family = f.family""")
def _(spark, sf):
    return db.low_stock_in_top_family(sv.purchase_lines(spark, sf), d.items(spark, sf), sv.stock(spark, sf))


@query("k15_product_leaderboard", f"""
SELECT item_id, CAST(sum(quantity) AS BIGINT) AS units, {_REV} AS revenue, count(*) AS transactions, max(sold_at) AS last_sold,
  CAST(sum(CASE WHEN starts_with(source, 'recommendation_') THEN 1 ELSE 0 END) AS BIGINT) AS rec_driven FROM v_sold GROUP BY 1""")
def _(spark, sf):
    return db.product_leaderboard(sold(spark, sf))
