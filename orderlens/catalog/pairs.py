"""Item pairs: lift, similarity, equivalents."""

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import pairs as pa
from ..plans import driver_tables as d
from ..plans.model import Model
from . import behaviour  # noqa: F401  (its subqueries)
from .registry import cte, half_up, query

M = Model.from_folder
P = d.PAIRS

cte("v_baskets", f"""
SELECT DISTINCT cust_id * 1000000 + year(order_date) * 100 + weekofyear(order_date) AS basket, item_id FROM v_elig
WHERE item_id IN (SELECT item_id FROM v_elig GROUP BY 1 HAVING count(DISTINCT cust_id) >= {P.min_buyers})""")
cte("v_co", f"""
SELECT item_a, item_b, n_orders_together, n_orders_a, n_orders_b, round(n_orders_together / t, 9) AS support_ab,
  round(n_orders_together / n_orders_a, 6) AS confidence_a_to_b, round(n_orders_together / n_orders_b, 6) AS confidence_b_to_a, lift FROM (
  SELECT c.*, x.n AS n_orders_a, y.n AS n_orders_b, t, round(n_orders_together * t / (x.n * y.n), 6) AS lift FROM (
    SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_orders_together FROM v_baskets a JOIN v_baskets b ON a.basket = b.basket AND a.item_id < b.item_id
    GROUP BY 1, 2 HAVING count(*) >= {P.min_together}) c
  JOIN (SELECT item_id, count(*) AS n FROM v_baskets GROUP BY 1) x ON x.item_id = item_a JOIN (SELECT item_id, count(*) AS n FROM v_baskets GROUP BY 1) y ON y.item_id = item_b,
  (SELECT count(DISTINCT basket) AS t FROM v_baskets))
WHERE n_orders_together / t >= {P.min_support} AND lift > {P.min_lift}""")
cte("v_pp", f"""
SELECT p.*, i.item_dsc AS product_a_item_dsc, i.family AS product_a_family, j.item_dsc AS product_b_item_dsc, j.family AS product_b_family,
  CASE WHEN i.family = j.family THEN 1 ELSE 0 END AS same_family FROM (
  SELECT *, row_number() OVER (PARTITION BY product_a ORDER BY lift DESC, confidence DESC, product_b) AS rank FROM (
    SELECT item_a AS product_a, item_b AS product_b, n_orders_together, n_orders_a AS n_orders_product_a, n_orders_b AS n_orders_product_b, support_ab,
      confidence_a_to_b AS confidence, lift FROM v_co
    UNION ALL SELECT item_b, item_a, n_orders_together, n_orders_b, n_orders_a, support_ab, confidence_b_to_a, lift FROM v_co)) p
LEFT JOIN v_items i ON i.item_id = product_a LEFT JOIN v_items j ON j.item_id = product_b WHERE rank <= {P.top_pairs}""")
cte("v_weights", f"""
WITH r AS (SELECT cust_id, item_id, ln(1 + line_count) AS w FROM v_ci WHERE item_id IN (SELECT item_id FROM v_ci GROUP BY 1 HAVING count(*) >= {P.min_buyers})),
c AS (SELECT cust_id, item_id, w - avg(w) OVER (PARTITION BY cust_id) AS c, count(*) OVER (PARTITION BY cust_id) AS n FROM r)
SELECT cust_id, item_id, c / norm AS x FROM (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS norm FROM c WHERE n >= 2) WHERE norm > 1e-9""")
cte("v_sim0", f"""
SELECT * FROM (SELECT a.item_id AS item_a, b.item_id AS item_b, round(sum(a.x * b.x), 6) AS similarity FROM v_weights a JOIN v_weights b
  ON a.cust_id = b.cust_id AND a.item_id < b.item_id GROUP BY 1, 2) WHERE similarity >= {P.min_similarity}""")
cte("v_sim", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY similarity DESC, item_b) AS rank FROM (
  SELECT item_a, item_b, similarity FROM v_sim0 UNION ALL SELECT item_b, item_a, similarity FROM v_sim0)) WHERE rank <= {P.sim_top}""")
cte("v_catalogue", """
SELECT i.*, category AS matching_category, regexp_extract(upper(item_dsc), '^([^\\s+/]*)', 1) AS product_type, '' AS form_code,
  e.* EXCLUDE (item_id) FROM v_items i JOIN v_econ e ON i.item_id = e.item_id WHERE is_excluded_family = 0 AND is_discontinued = 0""")


def _pairs(kind, left, right, extra, score, order):
    return f"""
SELECT original_item, equivalent_item, rank, '{kind}' AS match_type, original_price, equivalent_price, price_delta_pct, original_dsc, equivalent_dsc,
  original_supplier, equivalent_supplier, original_buyers, equivalent_buyers, family, score FROM (
  SELECT *, row_number() OVER (PARTITION BY original_item ORDER BY score DESC, {order}) AS rank FROM (
    SELECT *, round({score}, 6) AS score FROM (
      SELECT a.item_id AS original_item, b.item_id AS equivalent_item, a.median_unit_price AS original_price, b.median_unit_price AS equivalent_price,
        a.item_dsc AS original_dsc, b.item_dsc AS equivalent_dsc, a.supplier AS original_supplier, b.supplier AS equivalent_supplier,
        a.n_buyers AS original_buyers, b.n_buyers AS equivalent_buyers, a.family, b.is_private_brand AS equivalent_private,
        round(coalesce((b.median_unit_price - a.median_unit_price) / nullif(a.median_unit_price, 0), 0), 6) AS price_delta_pct
      FROM v_catalogue a JOIN v_catalogue b ON a.matching_category = b.matching_category AND a.family = b.family AND a.product_type = b.product_type AND a.form_code = b.form_code
      WHERE {left} AND {right} AND a.n_buyers >= {P.min_buyers} AND b.n_buyers >= {P.min_buyers})) WHERE {extra}) WHERE rank <= {P.max_equivalents}"""


cte("v_upgrades", _pairs("private_brand_upgrade", "a.is_private_brand = 0 AND a.is_competitor = 0", "b.is_private_brand = 1 AND b.is_competitor = 0",
                         f"price_delta_pct <= 0 AND price_delta_pct >= -{P.price_band}", "-2.0 * price_delta_pct + ln(1 + equivalent_buyers) / 10", "equivalent_item"))
cte("v_conversions", _pairs("competitor_conversion", "a.is_competitor = 1", "b.is_competitor = 0", "true",
                            "2.0 * equivalent_private - greatest(least(price_delta_pct, 1), -1) + ln(1 + equivalent_buyers) / 10", "equivalent_price, equivalent_item"))
cte("v_equiv", """
SELECT * EXCLUDE (score), CASE WHEN match_type = 'competitor_conversion' THEN 1 ELSE 0 END AS is_conversion,
  CASE WHEN price_delta_pct < 0 THEN 1 ELSE 0 END AS is_price_improvement, CASE WHEN abs(price_delta_pct) > 1.0 THEN 1 ELSE 0 END AS price_anomaly
FROM (SELECT * FROM v_upgrades UNION ALL SELECT * FROM v_conversions)""")


@query("h1_weekly_baskets", "SELECT * FROM v_baskets")
def _(spark, sf):
    return pa.weekly_baskets(M(spark, sf).eligible, P.min_buyers)


@query("c6_basket_self_join", """
SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_together FROM v_baskets a JOIN v_baskets b ON a.basket = b.basket AND a.item_id < b.item_id
GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    return pa.pair_counts(M(spark, sf).baskets, P)


@query("h2_cooccurrence", "SELECT * FROM v_co")
def _(spark, sf):
    return pa.cooccurrence(M(spark, sf).baskets, P)


@query("h3_directional_topk", """
SELECT product_a, product_b, rank, n_orders_together, support_ab, confidence, lift FROM v_pp""")
def _(spark, sf):
    return pa.directional_topk(M(spark, sf).cooccurrence, P.top_pairs).select(
        "product_a", "product_b", "rank", "n_orders_together", "support_ab", "confidence", "lift")


@query("c10_pair_enrichment", """
SELECT product_a, product_b, product_a_item_dsc, product_a_family, product_b_item_dsc, product_b_family, same_family FROM v_pp""")
def _(spark, sf):
    m = M(spark, sf)
    top = pa.directional_topk(m.cooccurrence, P.top_pairs).select("product_a", "product_b")
    return joins.describe_pairs(top, m.items, "product_a", "product_b")


@query("h4_lift_summary", f"""
SELECT count(*) AS n_pairs, count(DISTINCT product_a) AS n_products, round(avg(same_family) * 100, 2) AS same_family_pct, min(lift) AS min_lift, max(lift) AS max_lift,
  {half_up('median(lift)', 4)} AS median_lift, {half_up('quantile_cont(lift, 0.9)', 4)} AS p90_lift, {half_up('median(confidence)', 4)} AS median_confidence,
  {half_up('quantile_cont(confidence, 0.9)', 4)} AS p90_confidence FROM v_pp""")
def _(spark, sf):
    return pa.lift_summary(M(spark, sf).product_pairs)


@query("h4_lift_tiers", """
SELECT CASE WHEN lift < 2 THEN 'medium' WHEN lift < 3 THEN 'strong' WHEN lift < 5 THEN 'very_strong' WHEN lift < 10 THEN 'exceptional' ELSE 'extreme' END AS lift_tier,
  count(*) AS n_pairs, CAST(sum(same_family) AS BIGINT) AS n_same_family, round(min(lift), 4) AS min_lift, round(max(lift), 4) AS max_lift FROM v_pp GROUP BY 1""")
def _(spark, sf):
    return pa.lift_tiers(M(spark, sf).product_pairs)


@query("h4_strongest_pairs", """
SELECT product_a, product_b, lift, confidence FROM v_pp ORDER BY lift DESC, product_a, product_b LIMIT 500""")
def _(spark, sf):
    return pa.strongest_pairs(M(spark, sf).product_pairs, "lift").select("product_a", "product_b", "lift", "confidence")


@query("h5_item_similarity", "SELECT * FROM v_sim0")
def _(spark, sf):
    return pa.item_similarity(M(spark, sf).weights, P)


@query("h6_similar_topn", "SELECT * FROM v_sim")
def _(spark, sf):
    return M(spark, sf).similarity


@query("h7_brand_upgrades", "SELECT original_item, equivalent_item, rank, price_delta_pct, score FROM v_upgrades")
def _(spark, sf):
    return pa.brand_upgrades(M(spark, sf).match_catalogue, P).select("original_item", "equivalent_item", "rank", "price_delta_pct", "score")


@query("c8_composite_key_join", """
SELECT a.item_id AS original_item, count(*) AS n_equivalents, min(b.median_unit_price) AS cheapest_price FROM v_catalogue a JOIN v_catalogue b
  ON a.matching_category = b.matching_category AND a.family = b.family AND a.product_type = b.product_type AND a.form_code = b.form_code
WHERE a.is_private_brand = 0 AND a.is_competitor = 0 AND b.is_private_brand = 1 AND b.is_competitor = 0 GROUP BY 1""")
def _(spark, sf):
    return pa.key_matches(M(spark, sf).match_catalogue)


@query("h8_competitor_conversions", "SELECT original_item, equivalent_item, rank, price_delta_pct, score FROM v_conversions")
def _(spark, sf):
    return pa.competitor_conversions(M(spark, sf).match_catalogue, P).select("original_item", "equivalent_item", "rank", "price_delta_pct", "score")


@query("h9_equivalents_union", "SELECT * FROM v_equiv")
def _(spark, sf):
    return M(spark, sf).equivalents.select(*pa.EQUIVALENT_COLUMNS, "is_conversion", "is_price_improvement", "price_anomaly")


@query("h9_equivalent_counts", "SELECT match_type, count(*) AS n, CAST(sum(price_anomaly) AS BIGINT) AS anomalies FROM v_equiv GROUP BY 1")
def _(spark, sf):
    return M(spark, sf).equivalents.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"), F.sum("price_anomaly").alias("anomalies"))
