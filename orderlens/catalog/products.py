"""Product features and rankings."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins
from ..operators import products as pr
from ..params import SIZE_TIERS
from ..plans import driver_tables as d
from ..plans.model import Model
from . import customers  # noqa: F401  (its subqueries)
from .base_sql import words
from .registry import cte, half_up, query

M = Model.from_folder
P = d.PRODUCTS
MK = (*d.MARKETS, "OTHER")

cte("v_ci", f"""
SELECT cust_id, item_id, count(*) AS line_count, round(sum(amount), 2) AS total_spend,
  {half_up('round(sum(amount), 2) / count(*)', 6)} AS avg_unit_price, round(stddev_pop(amount), 4) AS std_unit_price,
  min(order_date) AS first_date, max(order_date) AS last_date FROM v_elig GROUP BY 1, 2""")
cte("v_cib", f"""
SELECT * FROM v_ci WHERE item_id IN (SELECT item_id FROM v_ci GROUP BY 1 HAVING count(*) >= {P.min_buyers})""")
cte("v_pairs", """
SELECT p.*, segment, market_clean, g.size_tier, median_monthly_spend, affordability_ceiling, active_months_last_12, specialty,
  CAST(round(CAST(line_count * 12 / greatest(coalesce(active_months_last_12, 6), 3) AS DECIMAL(28, 8)), 6) AS DOUBLE) AS annual_rate
FROM v_cib p LEFT JOIN v_segments g ON p.cust_id = g.cust_id LEFT JOIN v_features f ON p.cust_id = f.cust_id""")
cte("v_measures", f"""
SELECT item_id, count(*) AS n_buyers, CAST(sum(line_count) AS BIGINT) AS total_transactions, round(sum(total_spend), 2) AS total_spend,
  round(coalesce(stddev_samp(avg_unit_price) / avg(avg_unit_price), 0), 4) AS unit_price_cv,
  round(avg(CASE WHEN line_count > 1 THEN 1 ELSE 0 END), 6) AS repeat_purchase_rate,
  round(avg(annual_rate), 4) AS avg_purchases_per_buyer_per_year,
  CAST(sum(CASE WHEN last_date >= (SELECT d FROM v_max) - {P.recent_days} THEN 1 ELSE 0 END) AS BIGINT) AS recent_buyer_count_6mo,
  {half_up('((SELECT d FROM v_max) - max(last_date)) / 30', 1)} AS months_since_last_buyer,
  {half_up('median(total_spend)', 4)} AS median_line_value, {half_up('median(avg_unit_price)', 4)} AS median_unit_price,
  {half_up('median(annual_rate)', 4)} AS median_purchases_per_buyer_per_year FROM v_pairs GROUP BY 1""")


def _mix(col, values):
    return ", ".join(f"round(sum(CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END) / count({col}), 6) AS pct_buyers_{v}" for v in values)


cte("v_mix_market", f"SELECT item_id, {_mix('market_clean', MK)} FROM v_pairs GROUP BY 1")
cte("v_mix_size", f"SELECT item_id, {_mix('size_tier', SIZE_TIERS)} FROM v_pairs GROUP BY 1")
_G = "greatest(" + ", ".join(f"pct_buyers_{m}" for m in MK) + ")"
cte("v_market_hhi", f"""
SELECT item_id, round({' + '.join(f'pct_buyers_{m} * pct_buyers_{m}' for m in MK)}, 6) AS market_hhi,
  CASE {' '.join(f"WHEN pct_buyers_{m} = {_G} THEN '{m}'" for m in sorted(MK))} END AS primary_market, {_G} AS primary_market_pct
FROM v_mix_market""")


def _shares(col):
    return (f"SELECT item_id, {col} AS v, round(count(*) / sum(count(*)) OVER (PARTITION BY item_id), 6) AS pct "
            f"FROM v_pairs WHERE {col} IS NOT NULL GROUP BY item_id, {col}")


def _top(col, k, prefix, share, fill):
    cols = []
    for i in range(1, k + 1):
        n, p = f"max(CASE WHEN rk = {i} THEN v END)", f"max(CASE WHEN rk = {i} THEN pct END)"
        if fill:
            n, p = f"coalesce({n}, '')", f"coalesce({p}, 0)"
        cols += [f"{n} AS {prefix}_{i}", f"{p} AS {prefix}_{i}_pct"]
    return (f"SELECT item_id, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pct DESC, v) AS rk "
            f"FROM ({_shares(col)}) WHERE pct >= {share}) WHERE rk <= {k} GROUP BY 1")


cte("v_top_segments", _top("segment", P.top_segments, "top_segment", 0, False))
cte("v_seg_hhi", f"SELECT item_id, round(sum(pct * pct), 6) AS segment_hhi FROM ({_shares('segment')}) GROUP BY 1")
_Q = "quantile_cont({}, {})"
cte("v_afford", f"""
SELECT item_id, {half_up('quantile_cont(affordability_ceiling, 0.1)', 4)} AS buyer_affordability_p10,
  {half_up('quantile_cont(affordability_ceiling, 0.5)', 4)} AS buyer_affordability_p50,
  {half_up('quantile_cont(affordability_ceiling, 0.9)', 4)} AS buyer_affordability_p90,
  {half_up('quantile_cont(median_monthly_spend, 0.5)', 4)} AS buyer_monthly_spend_p50 FROM v_pairs GROUP BY 1""")
cte("v_adoption", """
SELECT item_id, round(n_buyers / (SELECT count(*) FROM v_segments), 6) AS adoption_rate,
  round((rank() OVER (PARTITION BY family ORDER BY median_unit_price) + (count(*) OVER (PARTITION BY family, median_unit_price) - 1) / 2)
    / count(*) OVER (PARTITION BY family), 6) AS price_percentile_in_family
FROM v_measures JOIN v_items USING (item_id)""")
cte("v_pf", """
SELECT m.*, x.* EXCLUDE (item_id), h.* EXCLUDE (item_id), z.* EXCLUDE (item_id), t.* EXCLUDE (item_id), segment_hhi, a.* EXCLUDE (item_id),
  o.* EXCLUDE (item_id), item_dsc, family, category, is_private_brand, is_discontinued,
  round(market_hhi * sqrt(adoption_rate), 6) AS specialty_score
FROM v_measures m JOIN v_mix_market x USING (item_id) JOIN v_market_hhi h USING (item_id) JOIN v_mix_size z USING (item_id)
LEFT JOIN v_top_segments t USING (item_id) LEFT JOIN v_seg_hhi s USING (item_id) JOIN v_afford a USING (item_id)
JOIN v_adoption o USING (item_id) LEFT JOIN v_items i USING (item_id)""")
cte("v_pspec", f"""
SELECT t.*, specialty_hhi FROM ({_top('specialty', P.specialty_top, 'top_specialty', P.specialty_share, True)}) t
LEFT JOIN (SELECT item_id, round(sum(pct * pct), 6) AS specialty_hhi FROM ({_shares('specialty')}) GROUP BY 1) h USING (item_id)""")


@query("f1_cust_item_agg", "SELECT * FROM v_ci")
def _(spark, sf):
    return pr.cust_item_agg(M(spark, sf).eligible)


@query("f2_min_buyers", "SELECT cust_id, item_id, line_count FROM v_cib")
def _(spark, sf):
    return pr.min_buyers(pr.cust_item_agg(M(spark, sf).eligible), P.min_buyers).select("cust_id", "item_id", "line_count")


@query("f3_product_measures", """
SELECT item_id, n_buyers, total_transactions, total_spend, median_line_value, median_unit_price, unit_price_cv, repeat_purchase_rate FROM v_measures""")
def _(spark, sf):
    m = M(spark, sf)
    return pr.product_measures(m.cust_items, m.latest, P).select(
        "item_id", "n_buyers", "total_transactions", "total_spend", "median_line_value", "median_unit_price",
        "unit_price_cv", "repeat_purchase_rate")


@query("f4_tenure_adjusted_frequency", """
SELECT item_id, avg_purchases_per_buyer_per_year, median_purchases_per_buyer_per_year FROM v_measures""")
def _(spark, sf):
    m = M(spark, sf)
    return pr.product_measures(m.cust_items, m.latest, P).select(
        "item_id", "avg_purchases_per_buyer_per_year", "median_purchases_per_buyer_per_year")


@query("f5_recency", "SELECT item_id, recent_buyer_count_6mo, months_since_last_buyer FROM v_measures")
def _(spark, sf):
    m = M(spark, sf)
    return pr.product_measures(m.cust_items, m.latest, P).select("item_id", "recent_buyer_count_6mo", "months_since_last_buyer")


@query("f6_buyer_mix_pivot", "SELECT * FROM v_mix_market JOIN v_mix_size USING (item_id)")
def _(spark, sf):
    p = M(spark, sf).cust_items
    return pr.buyer_mix(p, "market_clean", MK).join(pr.buyer_mix(p, "size_tier", SIZE_TIERS), "item_id")


@query("f7_market_hhi", "SELECT * FROM v_market_hhi")
def _(spark, sf):
    return pr.market_concentration(pr.buyer_mix(M(spark, sf).cust_items, "market_clean", MK), MK)


@query("f8_top3_segments", "SELECT * FROM v_top_segments")
def _(spark, sf):
    return pr.top_wide(M(spark, sf).cust_items, "segment", P.top_segments, "top_segment")


@query("f9_segment_hhi", "SELECT * FROM v_seg_hhi")
def _(spark, sf):
    return pr.share_hhi(M(spark, sf).cust_items, "segment", "segment_hhi")


@query("f10_affordability_percentiles", "SELECT * FROM v_afford")
def _(spark, sf):
    return pr.affordability_percentiles(M(spark, sf).cust_items)


@query("f11_adoption_price_specialty_score", "SELECT item_id, adoption_rate, price_percentile_in_family, specialty_score FROM v_pf")
def _(spark, sf):
    return M(spark, sf).product_features.select("item_id", "adoption_rate", "price_percentile_in_family", "specialty_score")


@query("f12_product_specialty", "SELECT * FROM v_pspec")
def _(spark, sf):
    return M(spark, sf).product_specialty


@query("f13_volume_tercile", """
SELECT item_id, n_buyers, CASE WHEN r * 3 > n * 2 THEN 'high' WHEN r * 3 > n THEN 'mid' ELSE 'low' END AS volume_tier FROM (
  SELECT item_id, n_buyers, row_number() OVER (ORDER BY n_buyers, item_id) AS r, count(*) OVER () AS n FROM v_measures)""")
def _(spark, sf):
    return pr.volume_tercile(M(spark, sf).product_features)


_DOCS = "SELECT doc_id, replace(text, 'ß', 'SS') AS t FROM documents UNION ALL SELECT -1 - p_partkey, upper(p_name) || ', TABS 500MG' FROM part"


@query("f14_parse_product_type", f"""
SELECT doc_id, regexp_extract(upper(trim(split_part(coalesce(t, ''), ',', 1))), '^([^\\s+/]*)', 1) AS product_type FROM ({_DOCS})""")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", text.product_type("t").alias("product_type"))


def _texts(spark, sf):
    docs = d.raw(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    parts = d.raw(spark, sf, "part").select((-1 - F.col("p_partkey")).alias("doc_id"),
                                            F.concat(F.upper("p_name"), F.lit(", TABS 500MG")).alias("t"))
    return docs.unionByName(parts)


_NORMAL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.FORM_NORMAL.items())


@query("f15_parse_form_code", f"""
SELECT doc_id, coalesce(CASE c {_NORMAL} ELSE c END, '') AS form_code FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(upper(coalesce(t, '')), '[,/\\s]+', ' ', 'g'), ' '),
    lambda w: regexp_replace(w, '^[.()\\[\\]0-9]+|[.()\\[\\]0-9]+$', '', 'g')), lambda w: w IN ({words(text.FORM_CODES)}))[1] AS c FROM ({_DOCS}))""")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", text.form_code("t").alias("form_code"))


@query("f16_matching_category", """
SELECT p_partkey AS item_id, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 3 = 1 THEN p_type END,
  CASE WHEN p_size % 2 = 0 THEN p_brand END, 'UNKNOWN_CATEGORY') AS matching_category FROM part""")
def _(spark, sf):
    size = F.col("p_size")
    return d.raw(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), text.matching_category(
        F.when(size % 3 == 0, F.col("p_name")), F.when(size % 3 == 1, F.col("p_type")),
        F.when(size % 2 == 0, F.col("p_brand"))).alias("matching_category"))


cte("v_econ", f"""
SELECT item_id, count(DISTINCT cust_id) AS n_buyers,
  max(CASE WHEN upper(coalesce(supplier, '')) IN ({words(c.upper() for c in d.COMPETITORS)}) THEN 1 ELSE 0 END) AS is_competitor,
  max(CASE WHEN coalesce(family, 'Unknown') IN ({words(d.EXCLUDED_FAMILIES)}) THEN 1 ELSE 0 END) AS is_excluded_family,
  {half_up('median(amount)', 4)} AS median_unit_price FROM v_merged WHERE amount > 0 AND item_id IS NOT NULL GROUP BY 1""")


@query("f17_product_economics", "SELECT * FROM v_econ")
def _(spark, sf):
    return pr.product_economics(M(spark, sf).item_lines, d.COMPETITORS, d.EXCLUDED_FAMILIES)


def _re(pattern):
    return pattern.replace("'", "''")


def _stem(expr):
    for p in text.VARIANT_PATTERNS + text.VARIANT_REST:
        expr = f"regexp_replace({expr}, '{_re(p)}', ' ', 'gi')"
    expr = f"trim(regexp_replace({expr}, '[\\s,]+', ' ', 'g'))"
    return f"lower(regexp_replace({expr}, '^[\\s,\\-|/]+|[\\s,\\-|/]+$', '', 'g'))"


cte("v_variant_text", """
SELECT item_id, family, category, is_private_brand, item_dsc || ' ' || CASE size_no % 5 WHEN 0 THEN '4x4 inch sterile' WHEN 1 THEN '200 mg, box of 50'
  WHEN 2 THEN '100/case size 7' WHEN 3 THEN 'XL 12 gloves' ELSE CAST(size_no AS VARCHAR) END AS item_dsc FROM v_items""")
cte("v_variant", f"""
SELECT item_id, CASE WHEN length(stem) < 4 THEN 'solo:' || CAST(item_id AS VARCHAR) ELSE lower(coalesce(family, '')) || '|' || lower(coalesce(category, ''))
  || '|' || CASE WHEN is_private_brand = 1 THEN '1' ELSE '0' END || '|' || stem END AS group_key, stem
FROM (SELECT *, {_stem('item_dsc')} AS stem FROM v_variant_text)""")


def _variant_items(spark, sf):
    n = F.col("size_no") % 5
    tail = (F.when(n == 0, "4x4 inch sterile").when(n == 1, "200 mg, box of 50").when(n == 2, "100/case size 7")
            .when(n == 3, "XL 12 gloves").otherwise(F.col("size_no").cast("string")))
    return d.items(spark, sf).withColumn("item_dsc", F.concat_ws(" ", "item_dsc", tail))


@query("f18_variant_stem", "SELECT item_id, stem FROM v_variant")
def _(spark, sf):
    return _variant_items(spark, sf).select("item_id", text.variant_stem("item_dsc").alias("stem"))


_LBL = ", ".join(f"trim(regexp_extract(item_dsc, '{_re(p)}', 0, 'i'))" for p in text.VARIANT_PATTERNS)


@query("f18_variant_label", f"""
SELECT item_id, CASE WHEN len(u) = 0 THEN item_dsc ELSE array_to_string(u, ' • ') END AS label FROM (
  SELECT *, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i) AS u FROM (
    SELECT item_id, item_dsc, list_filter([{_LBL}], lambda x: x <> '') AS f FROM v_variant_text))""")
def _(spark, sf):
    return _variant_items(spark, sf).select("item_id", text.variant_label("item_dsc").alias("label"))


@query("f18_variant_groups", """
SELECT group_key, count(*) AS n_variants, first(item_id ORDER BY units > 0 DESC, units DESC, item_id) AS representative,
  first(units ORDER BY units > 0 DESC, units DESC, item_id) AS units
FROM (SELECT v.group_key, v.item_id, CAST(size_no * 3 % 40 AS BIGINT) AS units FROM v_variant v JOIN v_items i ON v.item_id = i.item_id) GROUP BY 1""")
def _(spark, sf):
    stock = d.items(spark, sf).select("item_id", (F.col("size_no") * 3 % 40).cast("bigint").alias("units"))
    return pr.variant_groups(_variant_items(spark, sf), stock)


@query("f18_drop_carted_variants", """
WITH c AS (SELECT DISTINCT cust_id, group_key FROM v_events e JOIN v_variant v ON e.item_id = v.item_id WHERE event_type = 'click')
SELECT DISTINCT s.cust_id, s.item_id, group_key FROM v_events s JOIN v_variant v ON s.item_id = v.item_id
WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM c WHERE c.cust_id = s.cust_id AND c.group_key = v.group_key)""")
def _(spark, sf):
    e = d.event_log(spark, sf)
    views = e.filter("event_type = 'view'").select("cust_id", "item_id").distinct()
    cart = e.filter("event_type = 'click'").select("cust_id", "item_id")
    return pr.drop_carted_variants(views, cart, _variant_items(spark, sf))


def _band_sql(col):
    steps = pr.BANDS[col]
    case = " ".join(f"WHEN {col} < {b} THEN '{n}'" for b, n in steps)
    return (f"SELECT '{col}' AS measure, band, n_products, round(n_products / sum(n_products) OVER () * 100, 2) AS pct FROM ("
            f"SELECT CASE {case} END AS band, count(*) AS n_products FROM v_pf WHERE {col} IS NOT NULL GROUP BY 1)")


@query("f19_product_bands", " UNION ALL ".join(_band_sql(c) for c in pr.BANDS))
def _(spark, sf):
    pf = M(spark, sf).product_features
    out = None
    for c in pr.BANDS:
        b = pr.product_bands(pf, c)
        out = b if out is None else out.unionByName(b)
    return out


_MQ = ("n_buyers", "repeat_purchase_rate", "median_line_value", "specialty_score")


@query("f19_measure_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, {half_up(f'quantile_cont({c}, 0.1)', 4)} AS p10, {half_up(f'quantile_cont({c}, 0.5)', 4)} AS p50, "
    f"{half_up(f'quantile_cont({c}, 0.9)', 4)} AS p90 FROM v_pf" for c in _MQ))
def _(spark, sf):
    return pr.measure_quantiles(M(spark, sf).product_features, _MQ)


@query("f_product_features", """
SELECT item_id, n_buyers, median_unit_price, months_since_last_buyer, market_hhi, primary_market, top_segment_1, segment_hhi,
  buyer_affordability_p10, adoption_rate, specialty_score, family, is_private_brand FROM v_pf""")
def _(spark, sf):
    return M(spark, sf).product_features.select(
        "item_id", "n_buyers", "median_unit_price", "months_since_last_buyer", "market_hhi", "primary_market", "top_segment_1",
        "segment_hhi", "buyer_affordability_p10", "adoption_rate", "specialty_score", "family", "is_private_brand")


# ---- rankings ----

cte("v_crank", """
SELECT *, rank() OVER (ORDER BY combined_rank_score) AS combined_rank FROM (
  SELECT *, rank_by_spend + rank_by_volume AS combined_rank_score FROM (
    SELECT f.cust_id, market, size_tier, coalesce(s, 0) AS lifetime_spend, coalesce(v, 0) AS lifetime_volume, coalesce(o, 0) AS lifetime_orders,
      coalesce(l.n, 0) AS lifetime_lines, rank() OVER (ORDER BY coalesce(s, 0) DESC) AS rank_by_spend, rank() OVER (ORDER BY coalesce(v, 0) DESC) AS rank_by_volume
    FROM v_features f LEFT JOIN (SELECT cust_id, round(sum(amount), 2) AS s, round(sum(qty), 2) AS v, count(DISTINCT order_id) AS o, count(*) AS n
      FROM v_sales WHERE amount > 0 GROUP BY 1) l ON f.cust_id = l.cust_id))""")
cte("v_prank", f"""
SELECT *, rank() OVER (ORDER BY sales_count DESC) AS rank_by_sales_count, rank() OVER (ORDER BY total_revenue DESC) AS rank_by_revenue,
  rank() OVER (ORDER BY total_volume DESC) AS rank_by_volume, rank() OVER (ORDER BY distinct_buyers DESC) AS rank_by_buyers FROM (
  SELECT item_id, count(DISTINCT order_id) AS sales_count, count(*) AS line_count, count(DISTINCT cust_id) AS distinct_buyers,
    round(sum(amount), 2) AS total_revenue, round(sum(qty), 2) AS total_volume, max(order_date) AS last_sold, min(order_date) AS first_sold,
    {half_up('round(sum(amount), 2) / nullif(round(sum(qty), 2), 0)', 4)} AS avg_unit_price FROM v_merged WHERE amount > 0 GROUP BY 1)
LEFT JOIN (SELECT item_id, market AS primary_market, n AS primary_market_buyers FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, market) AS rn
  FROM (SELECT item_id, market, count(DISTINCT cust_id) AS n FROM v_merged WHERE amount > 0 AND market IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1) USING (item_id)""")


def _market_lines(m):
    return joins.lines_for(m.sales, m.customers, m.items, ["market"])


@query("h10_customer_ranking", "SELECT * FROM v_crank")
def _(spark, sf):
    m = M(spark, sf)
    return pr.customer_ranking(m.sales, m.features)


@query("h11_product_ranking", "SELECT * FROM v_prank")
def _(spark, sf):
    return pr.product_ranking(_market_lines(M(spark, sf)))


@query("h12_rank_rollup_by_tier", f"""
SELECT size_tier, count(*) AS n_customers, round(sum(lifetime_spend), 2) AS total_spend, round(sum(lifetime_volume), 2) AS total_volume,
  {half_up('round(sum(lifetime_spend), 2) / count(*)')} AS avg_spend, {half_up('median(lifetime_spend)')} AS median_spend,
  {half_up('median(lifetime_volume)')} AS median_volume FROM v_crank GROUP BY 1""")
def _(spark, sf):
    m = M(spark, sf)
    return pr.tier_rollup(pr.customer_ranking(m.sales, m.features))


@query("h12_rank_rollup_by_family", """
SELECT family, count(*) AS n_products, CAST(sum(sales_count) AS BIGINT) AS total_sales_count, round(sum(total_revenue), 2) AS total_revenue,
  round(sum(total_volume), 2) AS total_volume, CAST(sum(distinct_buyers) AS BIGINT) AS total_buyers, round(avg(avg_unit_price), 2) AS avg_unit_price
FROM v_prank JOIN v_items USING (item_id) GROUP BY 1""")
def _(spark, sf):
    m = M(spark, sf)
    return pr.family_rollup(pr.product_ranking(_market_lines(m)), m.items)
