"""Role tables (sales, customers, items, users, carts, events) read from a star-schema folder.

The operators only know role columns; this module says where a given folder has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..functions.ranking import first_per_key
from ..params import (CleaningParams, EngineParams, EvalParams, FamilyRuleParams, ModelParams, PairParams,
                      PatternParams, ProductParams, SizeParams, SupplierParams)

PRIVATE_BRANDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
COMPETITORS = ("Brand#21", "Brand#22", "Brand#23", "Brand#24", "Brand#25")
MARKETS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
EXCLUDED_FAMILIES = ("PROMO", "")
FY_SPLIT = "1998-05-01"

CLEANING = CleaningParams(blocked_orders=("7", "77", "777"), line_cap=100_000.0,
                          tier1_customers=70, tier2_customers=55, state_min_customers=300)
SIZE = SizeParams(spend=(120_000.0, 150_000.0, 190_000.0), volume=(60.0, 75.0, 95.0),
                  min_active_months=1)
SUPPLIER = SupplierParams(competitor_share=0.3, private_share=0.3)
PATTERNS = PatternParams(frequent_days=150, regular_days=300, alive_rate=0.10)
# item grain in the top-10 flow: repeats are rare, so one repeat buyer counts
PATTERNS_ITEM = PatternParams(frequent_days=150, regular_days=300, alive_rate=0.10,
                              segment_buyers=1, segment_repeat=1)
FAMILY_RULES = FamilyRuleParams(min_segment=10, window_days=2000)
PAIRS = PairParams(min_buyers=20, min_together=2, min_support=0.00001)
PRODUCTS = ProductParams(min_buyers=20)
ENGINE = EngineParams(min_buyers=20, market_share=0.30, size_share=0.25)
EVAL = EvalParams()
PARAMS = ModelParams(markets=MARKETS, competitors=COMPETITORS, excluded_families=EXCLUDED_FAMILIES, cleaning=CLEANING, size=SIZE,
                     supplier=SUPPLIER, patterns=PATTERNS, patterns_item=PATTERNS_ITEM, pairs=PAIRS, products=PRODUCTS, engine=ENGINE)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_lines(lineitem: DataFrame) -> DataFrame:
    """One row per (order, line): the latest ship date, then a full tie-break."""
    return first_per_key(lineitem, ["l_orderkey", "l_linenumber"], [
        F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"),
        F.to_date("o_orderdate").alias("order_date"))
    lines = latest_lines(raw(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
        flag(F.col("l_returnflag") == "R").alias("is_return"))
    return lines.join(orders, "order_id").withColumn(
        "fy", F.when(F.col("order_date") < F.lit(FY_SPLIT).cast("date"), "FY1").otherwise("FY2"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = raw(spark, sf_dir, "nation").join(
        raw(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bal = F.col("c_acctbal")
    return raw(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_name").alias("cust_name"),
        F.col("c_mktsegment").alias("market"), F.col("n_name").alias("specialty"),
        F.concat_ws(" ", "n_name", "r_name").alias("specialty_dsc"),
        F.col("r_name").alias("state"),
        F.when(bal < 3000, "S").when(bal < 6000, "B").otherwise("X").alias("cust_type"),
        F.substring("c_mktsegment", 1, 4).alias("cust_class"), bal.alias("acct_balance"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_dsc"),
        F.col("p_type").alias("family"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_brand").alias("supplier"),
        F.col("p_brand").isin(*PRIVATE_BRANDS).cast("int").alias("is_private_brand"),
        (F.col("p_size") >= 49).cast("int").alias("is_discontinued"),
        F.col("p_retailprice").alias("list_price"), F.col("p_size").alias("size_no"))


def coarse_items(items: DataFrame) -> DataFrame:
    """item_id -> brand x family grain, where repeat purchases are common."""
    brand_no = F.regexp_extract("brand", r"(\d+)", 1).cast("bigint")
    fam_no = F.when(F.col("family") == "ECONOMY", 0).when(F.col("family") == "LARGE", 1).when(
        F.col("family") == "MEDIUM", 2).when(F.col("family") == "PROMO", 3).when(
        F.col("family") == "SMALL", 4).otherwise(5)
    return items.select("item_id", (brand_no * 10 + fam_no).alias("coarse_id"))


# ---- carts, feedback and users, read from the event log ----
# view = shown, click = cart add, purchase = sold, error = rejected; in cart logs signup stands for set_quantity
# or delete (catalog/state.py), for which the table has no type of its own.
SOURCES = ("manual", "recommendation_peer_gap", "recommendation_lapsed",
           "recommendation_replenishment", "recommendation_cart_complement",
           "recommendation_pb_upgrade", "recommendation_competitor_conversion",
           "recommendation_item_similarity", "recommendation_popularity")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(raw(spark, sf_dir, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    item = F.get_json_object("props", "$.k").cast("bigint")
    sources = F.array(*[F.lit(s) for s in SOURCES])
    reasons = F.array(*[F.lit(s) for s in (
        "not_relevant", "already_have", "out_of_stock", "price_too_high", "wrong_size_or_spec",
        "different_brand", "bad_timing", "wrong_recommendation", "other")])
    return events.select(
        "event_id", "ts", F.col("user_id").alias("cust_id"), item.alias("item_id"), "event_type",
        (F.col("user_id") % 7).alias("seller_id"), F.col("value").alias("price"),
        (F.floor("value").cast("int") % 5 + 1).alias("quantity"),
        F.get(sources, (item % 9).cast("int")).alias("source"),
        F.get(reasons, (F.col("event_id") % 9).cast("int")).alias("reason"))
