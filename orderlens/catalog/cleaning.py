"""Sources, cleaning and joins."""

import uuid

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import cleaning as cl
from ..operators import joins
from ..plans import driver_tables as d
from ..plans.model import Model
from ..session import stage_root
from ..sources import tables as src
from .registry import half_up, query
from .base_sql import words

R = d.raw
BLOCKED = words(d.CLEANING.blocked_orders)
CAP = d.CLEANING.line_cap


@query("a1_scan_sharded_parquet", """
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS amount
FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return src.scan_sharded(spark, [f"{sf}/lineitem.parquet"]).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("a2_shape_customers", """
SELECT cust_id, substr(trim(cust_name), 1, 200) AS customer_name, substr(specialty, 1, 50) AS specialty_code,
  substr(market, 1, 50) AS market_code FROM v_customers""")
def _(spark, sf):
    return src.shape_customers(d.customers(spark, sf))


@query("a2_shape_products", """
SELECT item_id, trim(item_dsc) AS description, family, category,
  round(least(greatest(list_price, 0), 1000.0), 2) AS unit_price, is_private_brand FROM v_items""")
def _(spark, sf):
    return src.shape_products(d.items(spark, sf), price_cap=1000.0)


@query("a3_tag_fiscal_year", f"""
SELECT fiscal_year, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM (
  SELECT 'FY1' AS fiscal_year, * FROM orders WHERE o_orderdate < TIMESTAMP '{d.FY_SPLIT}'
  UNION ALL SELECT 'FY2', * FROM orders WHERE o_orderdate >= TIMESTAMP '{d.FY_SPLIT}') GROUP BY 1""")
def _(spark, sf):
    o = R(spark, sf, "orders")
    split = F.to_date("o_orderdate") < F.lit(d.FY_SPLIT).cast("date")
    both = src.tag_fiscal_year({"FY1": o.filter(split), "FY2": o.filter(~split)})
    return both.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n_orders"),
                                           F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a4_write_sorted_parquet", "SELECT cust_id, market, specialty, state FROM v_customers")
def _(spark, sf):
    path = f"{stage_root(spark)}/sorted-{uuid.uuid4().hex}"
    src.write_sorted(d.customers(spark, sf).select("cust_id", "market", "specialty", "state"), path, ["cust_id"])
    return spark.read.parquet(path)


@query("a5_column_prune", "SELECT p_partkey, p_brand, p_size FROM part")
def _(spark, sf):
    kept = src.keep_columns(R(spark, sf, "part"), ["p_partkey", "p_brand", "p_size", "not_there"])
    return src.drop_columns(kept, ["p_comment"])


@query("a6_resolve_column", """
SELECT p_partkey AS item_id, p_type AS family, CAST(NULL AS VARCHAR) AS sub_category FROM part""")
def _(spark, sf):
    return src.adopt_columns(R(spark, sf, "part"), {
        "item_id": (["item_id", "p_partkey"], "bigint"), "family": (["family_cd", "p_type"], "string"),
        "sub_category": (["sub_cd", "sub_dsc"], "string")})


@query("a7_csv_export", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    path = f"{stage_root(spark)}/csv-{uuid.uuid4().hex}"
    src.csv_export(R(spark, sf, "supplier"), path)
    return spark.read.schema("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").option(
        "header", True).csv(path)


@query("b1_parse_zip", """
WITH z AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'nan' WHEN c_custkey % 11 = 0 THEN ' 1234.0 '
    WHEN c_custkey % 7 = 0 THEN '12345-' || CAST(c_custkey % 9000 + 1000 AS VARCHAR)
    ELSE CAST(c_acctbal AS VARCHAR) END AS raw_zip FROM customer),
t AS (SELECT *, regexp_replace(trim(raw_zip), '\\.0$', '') AS s FROM z),
g AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS dg FROM t)
SELECT c_custkey, raw_zip, CASE WHEN lower(s) IN ('nan', 'none', 'nat', 'null', '') THEN NULL
  WHEN length(dg) = 4 THEN '0' || dg WHEN length(dg) IN (5, 9) THEN dg END AS zip FROM g""")
def _(spark, sf):
    k = F.col("c_custkey")
    raw = (F.when(k % 13 == 0, "nan").when(k % 11 == 0, " 1234.0 ")
           .when(k % 7 == 0, F.concat(F.lit("12345-"), (k % 9000 + 1000).cast("string")))
           .otherwise(F.col("c_acctbal").cast("string")))
    return R(spark, sf, "customer").select(k, raw.alias("raw_zip")).withColumn("zip", fc.parse_zip("raw_zip"))


@query("b2_clean_state", """
SELECT c_custkey, CASE WHEN regexp_matches(upper(trim(r)), '^[A-Z]{2}$') THEN upper(trim(r)) END AS state
FROM (SELECT c_custkey, ' ' || lower(substr(c_mktsegment, 1, CAST(1 + c_custkey % 3 AS INTEGER))) || ' ' AS r FROM customer)""")
def _(spark, sf):
    part = F.lower(F.substring(F.col("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")))
    raw = F.concat(F.lit(" "), part, F.lit(" "))
    return R(spark, sf, "customer").select("c_custkey", fc.clean_state(raw).alias("state"))


_FLAGS = ("Y", "1 ", "true", "n", "0", "x", " f", "Yes")


@query("b3_flag_to_yn", f"""
SELECT p_partkey, CASE WHEN upper(trim(f)) IN ('Y', '1', 'TRUE', 'T', 'YES') THEN 'Y'
  WHEN upper(trim(f)) IN ('N', '0', 'FALSE', 'F', 'NO') THEN 'N' END AS flag_yn
FROM (SELECT p_partkey, ([{words(_FLAGS)}])[p_size % 9 + 1] AS f FROM part)""")
def _(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in _FLAGS]), F.col("p_size") % 9)
    return R(spark, sf, "part").select("p_partkey", fc.flag_to_yn(raw).alias("flag_yn"))


@query("b4_flag_to_int", f"""
SELECT p_partkey, CASE WHEN upper(trim(f)) IN ('Y', '1', 'TRUE', 'T', 'YES') THEN 1 ELSE 0 END AS flag_int
FROM (SELECT p_partkey, ([{words(_FLAGS)}])[p_size % 9 + 1] AS f FROM part)""")
def _(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in _FLAGS]), F.col("p_size") % 9)
    return R(spark, sf, "part").select("p_partkey", fc.flag_to_int(raw).alias("flag_int"))


@query("b5_valid_code", f"""
SELECT c_custkey, CASE WHEN c_mktsegment IN ({words(d.MARKETS)}) THEN c_mktsegment END AS market FROM customer""")
def _(spark, sf):
    return R(spark, sf, "customer").select("c_custkey", fc.valid_code("c_mktsegment", d.MARKETS).alias("market"))


@query("b6_dedup_first", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) rn FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    return cl.dedup_first(R(spark, sf, "lineitem"), ["l_orderkey"], [
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("b7_exclude_blocked_and_capped", f"""
SELECT l_returnflag, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS amount FROM lineitem
WHERE CAST(l_orderkey AS VARCHAR) NOT IN ({BLOCKED}) AND (l_extendedprice IS NULL OR l_extendedprice <= {CAP})
GROUP BY 1""")
def _(spark, sf):
    kept = cl.exclude_lines(R(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", d.CLEANING)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("b8_exclusion_audit", f"""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN CAST(l_orderkey AS VARCHAR) IN ({BLOCKED})
  THEN 'blocked_order' WHEN l_extendedprice > {CAP} THEN 'above_cap' END AS exclusion_reason FROM lineitem)
WHERE exclusion_reason IS NOT NULL""")
def _(spark, sf):
    return cl.exclusion_audit(R(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", d.CLEANING).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "exclusion_reason")


@query("b9_dedup_latest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM v_lines""")
def _(spark, sf):
    return d.latest_lines(R(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


@query("b10_dedup_max_merge", """
SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity,
  max(l_extendedprice) AS l_extendedprice, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    return cl.dedup_max_merge(R(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"),
        ["l_orderkey", "l_linenumber"])


@query("b11_dedup_any", """
SELECT l_orderkey, l_linenumber, yr, l_partkey, l_extendedprice FROM (SELECT *, year(l_shipdate) AS yr, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber, year(l_shipdate) ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) rn
  FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    li = R(spark, sf, "lineitem").withColumn("yr", F.year("l_shipdate"))
    return cl.dedup_first(li, ["l_orderkey", "l_linenumber", "yr"], [
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "yr", "l_partkey", "l_extendedprice")


@query("b12_split_returns", """
SELECT fy, CASE WHEN is_return = 1 THEN 'returns' ELSE 'transactions' END AS kind, count(*) AS n_lines,
  round(sum(amount), 2) AS amount FROM v_sales GROUP BY ALL""")
def _(spark, sf):
    sold, returned = cl.split_returns(Model.from_folder(spark, sf).sales, F.col("is_return") == 1)
    both = sold.withColumn("kind", F.lit("transactions")).unionByName(returned.withColumn("kind", F.lit("returns")))
    return both.groupBy("fy", "kind").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("amount"), 2).alias("amount"))


@query("b13_date_parts", """
SELECT o_orderkey, year(o_orderdate) AS order_year, month(o_orderdate) AS order_month, day(o_orderdate) AS order_day
FROM orders""")
def _(spark, sf):
    date_id = F.date_format("o_orderdate", "yyyyMMdd").cast("bigint")
    return R(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in fc.date_parts(date_id).items()])


@query("b14_try_date", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(try_strptime(lpad(CAST(i AS VARCHAR), 8, '0'), '%Y%m%d') AS DATE) AS d
FROM (SELECT *, year(l_shipdate) * 10000 + (l_orderkey % 14) * 100 + l_partkey % 33 AS i FROM lineitem)""")
def _(spark, sf):
    i = F.year("l_shipdate") * 10000 + (F.col("l_orderkey") % 14) * 100 + F.col("l_partkey") % 33
    return R(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fc.try_date(i).alias("d"))


@query("b15_dedup_accounting", f"""
WITH k AS (SELECT year(l_shipdate) AS shard, l_orderkey, l_linenumber, count(*) AS raw,
  sum(CASE WHEN CAST(l_orderkey AS VARCHAR) IN ({BLOCKED}) THEN 1 ELSE 0 END) AS blocked,
  sum(CASE WHEN CAST(l_orderkey AS VARCHAR) NOT IN ({BLOCKED}) AND l_extendedprice > {CAP} THEN 1 ELSE 0 END) AS capped
  FROM lineitem GROUP BY ALL)
SELECT shard, CAST(sum(raw) AS BIGINT) AS raw_rows, CAST(sum(blocked) AS BIGINT) AS blocked_rows,
  CAST(sum(capped) AS BIGINT) AS capped_rows, CAST(sum(greatest(raw - blocked - capped - 1, 0)) AS BIGINT) AS duplicate_rows,
  CAST(sum(least(raw - blocked - capped, 1)) AS BIGINT) AS clean_rows FROM k GROUP BY 1""")
def _(spark, sf):
    li = R(spark, sf, "lineitem").withColumn("shard", F.year("l_shipdate"))
    return cl.dedup_accounting(li, "shard", ["l_orderkey", "l_linenumber"], "l_orderkey", "l_extendedprice", d.CLEANING)


@query("b16_null_zip_audit", """
SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS zip_original FROM customer
WHERE length(regexp_replace(regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', ''), '[^0-9]', '', 'g')) NOT IN (4, 5, 9)""")
def _(spark, sf):
    c = R(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("zip"))
    return cl.null_zip_audit(c, "zip", fc.parse_zip("zip")).select("c_custkey", "zip_original")


@query("b16_returns_summary", """
SELECT fy, count(*) AS return_lines, count(DISTINCT cust_id) AS customers, count(DISTINCT item_id) AS products,
  round(abs(sum(amount)), 2) AS returned_value FROM v_sales WHERE is_return = 1 GROUP BY 1""")
def _(spark, sf):
    return cl.returns_summary(Model.from_folder(spark, sf).sales.filter("is_return = 1"))


@query("b16_dropped_column_audit", """
SELECT 'l_tax' AS column_name, count(*) - count(l_tax) AS null_count FROM lineitem
UNION ALL SELECT 'l_linestatus', count(*) - count(l_linestatus) FROM lineitem""")
def _(spark, sf):
    li = R(spark, sf, "lineitem")
    return cl.dropped_column_audit(li, [c for c in li.columns if c not in ("l_tax", "l_linestatus")])


@query("b17_purchase_line_shaping", f"""
SELECT order_id, line_no, cust_id, item_id, greatest(CAST(round(qty) AS INTEGER), 1) AS quantity,
  {half_up('amount / greatest(CAST(round(qty) AS INTEGER), 1)')} AS unit_price, order_date AS sold_at
FROM v_sales WHERE amount > 0 AND order_date IS NOT NULL
  AND item_id IN (SELECT item_id FROM v_items WHERE is_discontinued = 0)""")
def _(spark, sf):
    m = Model.from_folder(spark, sf)
    return cl.shape_purchases(m.sales, m.items.filter("is_discontinued = 0"))


# ---- joins ----

@query("c1_star_join", f"""
SELECT fy, market, state, family, is_private_brand, specialty_tier, count(*) AS n_lines, round(sum(amount), 2) AS revenue
FROM v_merged m LEFT JOIN (SELECT specialty AS sp, CASE WHEN n >= {d.CLEANING.tier1_customers} THEN 1 WHEN n >= {d.CLEANING.tier2_customers} THEN 2 ELSE 3 END AS specialty_tier
  FROM (SELECT specialty, count(DISTINCT s.cust_id) AS n FROM v_sales s JOIN v_customers c ON s.cust_id = c.cust_id GROUP BY 1)) ON sp = m.specialty
GROUP BY ALL""")
def _(spark, sf):
    m = Model.from_folder(spark, sf)
    merged = joins.star_join(m.sales, m.customers, m.items, m.specialty_tiers)
    return merged.groupBy("fy", "market", "state", "family", "is_private_brand", "specialty_tier").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("amount"), 2).alias("revenue"))


@query("c2_inner_fact_dim", """
SELECT s.cust_id, specialty, count(*) AS n_lines FROM v_sales s JOIN v_customers c ON s.cust_id = c.cust_id
WHERE cust_type = 'S' GROUP BY ALL""")
def _(spark, sf):
    m = Model.from_folder(spark, sf)
    dim = m.customers.filter("cust_type = 'S'").select("cust_id", "specialty")
    return m.sales.join(dim, "cust_id").groupBy("cust_id", "specialty").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c3_full_outer_years", """
SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(r1, 0) AS revenue_fy1, coalesce(r2, 0) AS revenue_fy2
FROM (SELECT item_id, round(sum(amount), 2) AS r1 FROM v_sales WHERE fy = 'FY1' GROUP BY 1) a
FULL JOIN (SELECT item_id, round(sum(amount), 2) AS r2 FROM v_sales WHERE fy = 'FY2' GROUP BY 1) b ON a.item_id = b.item_id""")
def _(spark, sf):
    s = Model.from_folder(spark, sf).sales

    def year(fy, out):
        return s.filter(F.col("fy") == fy).groupBy("item_id").agg(F.round(F.sum("amount"), 2).alias(out))
    both = joins.full_outer_years(year("FY1", "revenue_fy1"), year("FY2", "revenue_fy2"), "item_id")
    return both.fillna(0.0, ["revenue_fy1", "revenue_fy2"])


@query("c4_semi_join", """
SELECT cust_id, market FROM v_customers c WHERE EXISTS (SELECT 1 FROM v_merged m WHERE m.cust_id = c.cust_id AND m.family = 'PROMO')""")
def _(spark, sf):
    m = Model.from_folder(spark, sf)
    return m.customers.select("cust_id", "market").join(
        m.merged.filter("family = 'PROMO'").select("cust_id"), "cust_id", "left_semi")


@query("c5_anti_join", """
SELECT cust_id, market FROM v_customers WHERE cust_id NOT IN (SELECT cust_id FROM v_sales WHERE fy = 'FY2' AND cust_id IS NOT NULL)""")
def _(spark, sf):
    m = Model.from_folder(spark, sf)
    buyers = m.sales.filter("fy = 'FY2' AND cust_id IS NOT NULL").select("cust_id")
    return m.customers.select("cust_id", "market").join(buyers, "cust_id", "left_anti")


@query("c12_triple_alias", """
SELECT c.c_custkey, a.s_name AS previous_name, b.s_name AS new_name, e.s_name AS changed_by_name FROM customer c
LEFT JOIN supplier a ON a.s_suppkey = c.c_nationkey LEFT JOIN supplier b ON b.s_suppkey = c.c_custkey % 120
LEFT JOIN supplier e ON e.s_suppkey = c.c_custkey % 7""")
def _(spark, sf):
    from ..operators.serving import resolve_names
    changes = R(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("previous_id"),
        (F.col("c_custkey") % 120).alias("new_id"), (F.col("c_custkey") % 7).alias("changed_by_id"))
    users = R(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("full_name"))
    return resolve_names(changes, users, {"previous_id": "previous_name", "new_id": "new_name",
                                          "changed_by_id": "changed_by_name"}).drop(
        "previous_id", "new_id", "changed_by_id")
