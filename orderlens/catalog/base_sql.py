"""Reference SQL of the role tables."""

from ..plans import driver_tables as d
from .registry import cte


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


cte("v_lines", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1""")
cte("v_sales", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS item_id, l_suppkey AS supplier_id,
  l_quantity AS qty, l_extendedprice AS amount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return,
  o_custkey AS cust_id, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN CAST(o_orderdate AS DATE) < DATE '{d.FY_SPLIT}' THEN 'FY1' ELSE 'FY2' END AS fy
FROM v_lines JOIN orders ON o_orderkey = l_orderkey""")
cte("v_customers", """
SELECT c_custkey AS cust_id, c_name AS cust_name, c_mktsegment AS market, n_name AS specialty,
  n_name || ' ' || r_name AS specialty_dsc, r_name AS state,
  CASE WHEN c_acctbal < 3000 THEN 'S' WHEN c_acctbal < 6000 THEN 'B' ELSE 'X' END AS cust_type,
  substr(c_mktsegment, 1, 4) AS cust_class, c_acctbal AS acct_balance
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("v_items", f"""
SELECT p_partkey AS item_id, p_name AS item_dsc, p_type AS family, split_part(p_name, ' ', 2) AS category,
  p_brand AS brand, p_brand AS supplier,
  CASE WHEN p_brand IN ({words(d.PRIVATE_BRANDS)}) THEN 1 ELSE 0 END AS is_private_brand,
  CASE WHEN p_size >= 49 THEN 1 ELSE 0 END AS is_discontinued, p_retailprice AS list_price, p_size AS size_no
FROM part""")
cte("v_coarse", """
SELECT item_id, CAST(regexp_extract(brand, '(\\d+)', 1) AS BIGINT) * 10 +
  CASE family WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3
       WHEN 'SMALL' THEN 4 ELSE 5 END AS coarse_id FROM v_items""")
cte("v_merged", """
SELECT s.*, year(order_date) AS order_year, month(order_date) AS order_month, day(order_date) AS order_day,
  market, specialty, specialty_dsc, state, cust_type, cust_class,
  item_dsc, family, category, brand, supplier, is_private_brand, is_discontinued
FROM v_sales s LEFT JOIN v_customers c ON s.cust_id = c.cust_id LEFT JOIN v_items i ON s.item_id = i.item_id""")
cte("v_max", "SELECT max(order_date) AS d FROM v_sales WHERE amount > 0")
cte("v_elig", f"""
SELECT * FROM v_merged WHERE amount > 0 AND cust_id IS NOT NULL AND item_id IS NOT NULL
  AND coalesce(family, 'Unknown') NOT IN ({words(d.EXCLUDED_FAMILIES)})
  AND upper(coalesce(supplier, '')) NOT IN ({words(x.upper() for x in d.COMPETITORS)})""")
cte("v_events", f"""
SELECT event_id, ts, user_id AS cust_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type,
  user_id % 7 AS seller_id, value AS price, CAST(floor(value) AS INTEGER) % 5 + 1 AS quantity,
  ([{words(d.SOURCES)}])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 + 1] AS source,
  (['not_relevant', 'already_have', 'out_of_stock', 'price_too_high', 'wrong_size_or_spec', 'different_brand',
    'bad_timing', 'wrong_recommendation', 'other'])[event_id % 9 + 1] AS reason
FROM events""")
