"""Grouped summaries and table profiles."""

from ..operators import joins
from ..operators import profiling as pf
from ..plans import driver_tables as d
from ..plans.model import Model
from .registry import cte, half_up, query

M = Model.from_folder


def _lines(spark, sf, *columns):
    m = M(spark, sf)
    return joins.lines_for(m.sales, m.customers, m.items, columns)


cte("v_sold_lines", "SELECT * FROM v_merged WHERE is_return = 0")
_CNT = {"cust_id": "unique_customers", "item_id": "unique_products", "order_id": "unique_orders"}


def _sum_sql(keys, counts=("cust_id", "order_id"), extra="", src="v_sold_lines"):
    named = ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'Unknown') AS {k}" for k in keys)
    cnt = ", ".join(f"count(DISTINCT {c}) AS {_CNT[c]}" for c in counts)
    return (f"SELECT *{extra} FROM (SELECT {named}, {cnt}, count(*) AS total_order_lines, round(sum(amount), 2) AS total_revenue "
            f"FROM {src} GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))})")


_PR = ", round(total_revenue * 100.0 / sum(total_revenue) OVER (), 2) AS pct_revenue"
_PF = ", round(total_revenue * 100.0 / sum(total_revenue) OVER (PARTITION BY fy), 2) AS pct_of_fy_revenue"


@query("l1_data_overview", """
WITH w AS (SELECT CAST(count(*) AS DOUBLE) AS total_rows, CAST(sum(is_return) AS DOUBLE) AS return_rows, CAST(count(DISTINCT cust_id) AS DOUBLE) AS unique_customers,
  CAST(count(DISTINCT item_id) AS DOUBLE) AS unique_products, CAST(count(DISTINCT order_id) AS DOUBLE) AS unique_orders, CAST(count(DISTINCT specialty) AS DOUBLE) AS unique_specialties,
  CAST(count(DISTINCT state) AS DOUBLE) AS unique_states, CAST(count(DISTINCT family) AS DOUBLE) AS unique_families, round(sum(CASE WHEN is_return = 0 THEN amount END), 2) AS revenue_without_returns,
  CAST(strftime(min(order_date), '%Y%m%d') AS DOUBLE) AS first_date, CAST(strftime(max(order_date), '%Y%m%d') AS DOUBLE) AS last_date FROM v_merged)
SELECT name AS metric, value FROM (UNPIVOT w ON COLUMNS(*) INTO NAME name VALUE value)""")
def _(spark, sf):
    return pf.data_overview(_lines(spark, sf, "specialty", "state", "family"))


@query("l2_customers_by_type", _sum_sql(["cust_type"], extra=", round(unique_customers * 100.0 / sum(unique_customers) OVER (), 2) AS pct_customers" + _PR))
def _(spark, sf):
    return pf.customers_by_type(_lines(spark, sf, "cust_type"))


def _simple(name, keys, counts=("cust_id", "order_id")):
    @query(name, _sum_sql(keys, counts))
    def _(spark, sf):
        return pf.summary(pf.sold(_lines(spark, sf, *keys)), keys, counts)


_simple("l2_customers_by_specialty", ["specialty", "specialty_dsc"])
_simple("l2_customers_by_market", ["market"])
_simple("l2_customers_by_class", ["cust_class"])


def _products(name, keys):
    @query(name, _sum_sql(keys, ("item_id", "cust_id"), _PR))
    def _(spark, sf):
        return pf.products_by(_lines(spark, sf, *keys), keys)


_products("l3_products_by_family", ["family"])
_products("l3_products_by_category", ["family", "category"])
_products("l3_products_by_supplier", ["supplier"])
_products("l3_brand_split", ["is_private_brand"])


@query("l4_sales_by_month", f"""
SELECT fy, order_year, order_month, count(DISTINCT cust_id) AS unique_customers, count(DISTINCT order_id) AS unique_orders, count(*) AS total_order_lines,
  round(sum(amount), 2) AS total_revenue, {half_up('round(sum(amount), 2) / count(*)')} AS avg_line_revenue FROM v_sold_lines GROUP BY 1, 2, 3""")
def _(spark, sf):
    return pf.sales_by_month(_lines(spark, sf))


def _by_fy(name, keys, counts=("cust_id", "order_id"), share=True):
    @query(name, _sum_sql(["fy", *keys], counts, _PF if share else ""))
    def _(spark, sf):
        merged = _lines(spark, sf, *keys)
        return pf.sales_by_fy_and(merged, keys, counts) if share else pf.summary(pf.sold(merged), ["fy", *keys], counts)


_by_fy("l5_sales_by_fy_and_customer_type", ["cust_type"])
_by_fy("l5_sales_by_fy_and_specialty", ["specialty"])
_by_fy("l5_sales_by_fy_and_product", ["family", "category"])
_by_fy("l6_geo_by_state", ["state"])
_by_fy("l6_geo_by_zone", ["state", "specialty"])
_by_fy("l7_brand_overall", ["is_private_brand"], ("cust_id", "item_id", "order_id"))
_by_fy("l7_brand_by_customer_type", ["cust_type", "is_private_brand"], share=False)
_by_fy("l7_brand_by_specialty", ["specialty", "is_private_brand"], share=False)


@query("l8_yoy_overall", f"""
SELECT fy, count(DISTINCT cust_id) AS unique_customers, count(DISTINCT item_id) AS unique_products, count(DISTINCT order_id) AS unique_orders, count(*) AS total_order_lines,
  round(sum(amount), 2) AS total_revenue, {half_up('round(sum(amount), 2) / count(*)')} AS avg_line_revenue, CAST(sum(is_return) AS BIGINT) AS return_lines,
  round(sum(is_return) * 100.0 / count(*), 2) AS return_pct FROM v_merged GROUP BY 1""")
def _(spark, sf):
    return pf.yoy_overall(_lines(spark, sf))


@query("l8_yoy_by_month", "SELECT fy, order_year, order_month, count(DISTINCT cust_id) AS unique_customers, round(sum(amount), 2) AS total_revenue FROM v_sold_lines GROUP BY 1, 2, 3")
def _(spark, sf):
    return pf.sales_by_month(_lines(spark, sf)).select("fy", "order_year", "order_month", "unique_customers", "total_revenue")


@query("l8_yoy_by_family", """
SELECT family, round(sum(CASE WHEN fy = 'FY1' THEN amount END), 2) AS revenue_fy1, round(sum(CASE WHEN fy = 'FY2' THEN amount END), 2) AS revenue_fy2 FROM v_sold_lines GROUP BY 1""")
def _(spark, sf):
    return pf.yoy_by_family(_lines(spark, sf, "family"), ("FY1", "FY2"))


@query("l9_yoy_customers", """
WITH a AS (SELECT DISTINCT cust_id FROM v_sold_lines WHERE fy = 'FY1'), b AS (SELECT DISTINCT cust_id FROM v_sold_lines WHERE fy = 'FY2')
SELECT * FROM (SELECT 'new' AS customer_status, count(*) AS customer_count FROM b WHERE cust_id NOT IN (SELECT cust_id FROM a)
UNION ALL SELECT 'retained', count(*) FROM b WHERE cust_id IN (SELECT cust_id FROM a) UNION ALL SELECT 'lost', count(*) FROM a WHERE cust_id NOT IN (SELECT cust_id FROM b)) WHERE customer_count > 0""")
def _(spark, sf):
    return pf.yoy_customers(_lines(spark, sf), "FY1", "FY2")


@query("l10_returns_summary", """
SELECT fy, cust_type, family, count(*) AS return_lines, round(sum(abs(qty)), 0) AS total_return_qty, round(sum(abs(amount)), 2) AS total_return_value FROM v_merged WHERE is_return = 1 GROUP BY 1, 2, 3""")
def _(spark, sf):
    return pf.returns_summary(_lines(spark, sf, "cust_type", "family"))


@query("l11_revenue_outliers", """
SELECT fy, order_id, line_no, item_dsc, cust_type, specialty, qty, amount, order_date FROM v_sold_lines
WHERE amount > (SELECT quantile_cont(amount, 0.99) FROM v_sold_lines) ORDER BY amount DESC, order_id, line_no LIMIT 500""")
def _(spark, sf):
    m = M(spark, sf)
    return pf.revenue_outliers(m.sales, m.customers, m.items, 0.99)


@query("c11_threshold_join", """
SELECT order_id, line_no, amount FROM v_sold_lines WHERE amount > (SELECT quantile_cont(amount, 0.995) FROM v_sold_lines)""")
def _(spark, sf):
    from ..functions import ranking as rk
    lines = pf.sold(M(spark, sf).sales)
    t = rk.exact_quantiles(lines.select("amount"), "amount", {"t": 0.995}).scalar()
    return lines.filter(lines["amount"] > t).select("order_id", "line_no", "amount")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")


@query("l12_numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
    f"round(avg({c}), 4) AS mean_value, {half_up(f'median({c})', 4)} AS median_value FROM lineitem" for c in _NUM))
def _(spark, sf):
    return pf.numeric_profile(d.raw(spark, sf, "lineitem"), _NUM)


_TOP = ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")


@query("l12_top_values", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, value, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1)) WHERE rank <= 5"
    for c in _TOP))
def _(spark, sf):
    return pf.top_values(d.raw(spark, sf, "lineitem"), _TOP)
