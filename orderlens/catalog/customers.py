"""Customer features, segments and archetypes."""

from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions import text
from ..operators import customers as cu
from ..params import SEGMENT_WEIGHTS, SIZE_TIERS
from ..plans import driver_tables as d
from ..plans.model import Model
from .base_sql import words
from .registry import cte, half_up, query

M = Model.from_folder
C, S, SP = d.CLEANING, d.SIZE, d.SUPPLIER

cte("v_spec_stats", f"""
SELECT *, round(total_revenue / sum(total_revenue) OVER () * 100, 4) AS pct_of_total_revenue,
  {half_up('total_revenue / unique_orders')} AS avg_revenue_per_order,
  CASE WHEN unique_customers >= {C.tier1_customers} THEN 1 WHEN unique_customers >= {C.tier2_customers} THEN 2 ELSE 3 END
  AS specialty_tier FROM (
  SELECT specialty, specialty_dsc, count(DISTINCT s.cust_id) AS unique_customers, count(DISTINCT order_id) AS unique_orders,
    round(sum(amount), 2) AS total_revenue FROM v_sales s JOIN v_customers c ON s.cust_id = c.cust_id GROUP BY 1, 2)""")
cte("v_rfm", f"""
SELECT cust_id, max(order_date) AS last_order_date, count(DISTINCT order_id) AS frequency,
  round(sum(amount), 2) AS monetary, count(DISTINCT coalesce(family, 'Unknown')) AS n_categories_bought,
  {half_up("round(sum(amount), 2) / count(DISTINCT order_id)")} AS avg_revenue_per_order,
  CAST((SELECT max(order_date) FROM v_sales) - max(order_date) AS INTEGER) AS recency_days
FROM v_merged WHERE amount > 0 GROUP BY 1""")
cte("v_hhi", """
SELECT cust_id, round(sum(s * s) / pow(greatest(sum(s), 1), 2), 4) AS category_hhi FROM (
  SELECT cust_id, family, sum(amount) AS s FROM v_merged WHERE amount > 0 GROUP BY 1, 2) GROUP BY 1""")
cte("v_gaps", """
SELECT cust_id, round(coalesce(avg(g), 0), 2) AS avg_order_gap_days, round(coalesce(stddev_pop(g), 0), 2) AS cycle_regularity
FROM (SELECT cust_id, order_date - lag(order_date) OVER (PARTITION BY cust_id ORDER BY order_date) AS g
  FROM (SELECT DISTINCT cust_id, order_date FROM v_sales)) GROUP BY 1""")
cte("v_churn", """
SELECT cust_id, CASE WHEN a = 1 AND b = 0 THEN 1 WHEN a = 1 AND b = 1 THEN 0 ELSE -1 END AS churn_label FROM (
  SELECT cust_id, max(CASE WHEN fy = 'FY1' THEN 1 ELSE 0 END) AS a, max(CASE WHEN fy = 'FY2' THEN 1 ELSE 0 END) AS b
  FROM v_sales GROUP BY 1)""")
cte("v_scores", """
SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score FROM (
  SELECT *, CASE WHEN recency_days <= e[1] THEN 5 WHEN recency_days <= e[2] THEN 4 WHEN recency_days <= e[3] THEN 3
    WHEN recency_days <= e[4] THEN 2 ELSE 1 END AS r_score,
    CAST(greatest(1, ceil((row_number() OVER (ORDER BY frequency, cust_id) - 1) * 5 / (n - 1))) AS INTEGER) AS f_score,
    CAST(greatest(1, ceil((row_number() OVER (ORDER BY monetary, cust_id) - 1) * 5 / (n - 1))) AS INTEGER) AS m_score
  FROM v_rfm, (SELECT quantile_cont(CAST(recency_days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e, count(*) AS n FROM v_rfm))""")
cte("v_supplier", f"""
SELECT *, CASE WHEN pct_competitor >= {SP.competitor_share} THEN 'competitor_only'
  WHEN pct_private_brand >= {SP.private_share} THEN 'house_primary' ELSE 'mixed' END AS supplier_profile FROM (
  SELECT cust_id, round(sum(CASE WHEN supplier IN ({words(d.COMPETITORS)}) THEN amount ELSE 0 END) / greatest(sum(amount), 1), 6) AS pct_competitor,
    round(sum(CASE WHEN is_private_brand = 1 THEN amount ELSE 0 END) / greatest(sum(amount), 1), 6) AS pct_private_brand
  FROM v_merged WHERE amount > 0 GROUP BY 1)""")
cte("v_monthly", """
SELECT cust_id, year(order_date) AS order_year, month(order_date) AS order_month, round(sum(amount), 2) AS month_spend,
  sum(greatest(0, coalesce(nullif(qty, 0), qty, 0))) AS month_volume FROM v_sales WHERE amount > 0 GROUP BY 1, 2, 3""")
cte("v_active12", """
SELECT cust_id, count(*) AS active_months_last_12 FROM v_monthly
WHERE order_year * 100 + order_month > (SELECT max(order_year * 100 + order_month) - 100 FROM v_monthly) GROUP BY 1""")


def _tier(value, steps):
    return (f"CASE WHEN active_months_last_12 < {S.min_active_months} THEN 'new' WHEN {value} < {steps[0]} THEN 'small' "
            f"WHEN {value} < {steps[1]} THEN 'mid' WHEN {value} < {steps[2]} THEN 'large' ELSE 'enterprise' END")


_RANK = "list_position(['new', 'small', 'mid', 'large', 'enterprise'], {})"
cte("v_size0", f"""
SELECT *, {_tier('median_monthly_spend', S.spend)} AS spend_tier, {_tier('median_monthly_volume', S.volume)} AS volume_tier FROM (
  SELECT m.*, coalesce(active_months_last_12, 0) AS active_months_last_12 FROM (
    SELECT cust_id, {half_up('median(month_spend)')} AS median_monthly_spend, {half_up('median(month_volume)')} AS median_monthly_volume,
      count(month_spend) AS active_months_total FROM v_monthly GROUP BY 1) m
  LEFT JOIN v_active12 a ON m.cust_id = a.cust_id)""")
cte("v_size", f"""
SELECT *, {half_up("median_monthly_spend * CASE size_tier WHEN 'new' THEN 3.0 WHEN 'small' THEN 1.5 WHEN 'mid' THEN 1.8 WHEN 'large' THEN 2.0 ELSE 2.5 END")} AS affordability_ceiling FROM (
  SELECT *, CASE WHEN spend_tier = 'new' THEN 'new' ELSE (['new', 'small', 'mid', 'large', 'enterprise'])[
    greatest(least({_RANK.format('spend_tier')}, {_RANK.format('volume_tier')}), {_RANK.format('spend_tier')} - 1)] END AS size_tier
  FROM v_size0)""")
cte("v_features", """
SELECT s.*, coalesce(h.category_hhi, 1.0) AS category_hhi, coalesce(avg_order_gap_days, 0) AS avg_order_gap_days,
  coalesce(cycle_regularity, 0) AS cycle_regularity, churn_label, pct_competitor, pct_private_brand, supplier_profile,
  median_monthly_spend, median_monthly_volume, active_months_total, coalesce(active_months_last_12, 0) AS active_months_last_12,
  spend_tier, volume_tier, coalesce(size_tier, 'new') AS size_tier, affordability_ceiling, market, specialty, state, cust_type, cust_class
FROM v_scores s LEFT JOIN v_hhi h ON s.cust_id = h.cust_id LEFT JOIN v_gaps g ON s.cust_id = g.cust_id
LEFT JOIN v_churn c ON s.cust_id = c.cust_id LEFT JOIN v_supplier p ON s.cust_id = p.cust_id
LEFT JOIN v_size z ON s.cust_id = z.cust_id LEFT JOIN v_customers k ON s.cust_id = k.cust_id""")
cte("v_segments", f"""
SELECT cust_id, m || '_' || size_tier AS segment, m AS market_clean, size_tier FROM (
  SELECT cust_id, size_tier, CASE WHEN market IN ({words(d.MARKETS)}) THEN market ELSE 'OTHER' END AS m FROM v_features)""")


def _base(spark, sf):
    m = M(spark, sf)
    return cu.rfm_base(m.sales, cu.family_spend(m.item_lines))


@query("d1_specialty_stats", """
SELECT specialty, unique_customers, unique_orders, total_revenue, pct_of_total_revenue, avg_revenue_per_order FROM v_spec_stats""")
def _(spark, sf):
    m = M(spark, sf)
    return cu.specialty_stats(m.sales, m.customers).drop("specialty_dsc")


@query("d2_specialty_tier", "SELECT specialty, unique_customers, specialty_tier FROM v_spec_stats")
def _(spark, sf):
    return M(spark, sf).specialty_tiers.select("specialty", "unique_customers", "specialty_tier")


@query("d3_tier3_fallback", """
WITH t3 AS (SELECT specialty, unnest(string_split(upper(specialty_dsc), ' ')) AS word, generate_subscripts(string_split(specialty_dsc, ' '), 1) AS pos
    FROM v_spec_stats WHERE specialty_tier = 3),
t1 AS (SELECT specialty AS target, unique_customers AS uc, unnest(string_split(upper(specialty_dsc), ' ')) AS word,
    generate_subscripts(string_split(specialty_dsc, ' '), 1) AS pos FROM v_spec_stats WHERE specialty_tier = 1),
h AS (SELECT t3.specialty, target, CASE WHEN t3.pos = 1 AND t1.pos = 1 THEN 1 ELSE 2 END AS pr,
    CASE WHEN t3.pos = 1 AND t1.pos = 1 THEN uc ELSE -uc END AS sz FROM t3 JOIN t1 USING (word)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY specialty ORDER BY pr, sz, target) rn FROM h) WHERE rn = 1)
SELECT s.specialty, b.target AS tier3_fallback FROM v_spec_stats s LEFT JOIN b ON s.specialty = b.specialty WHERE specialty_tier = 3""")
def _(spark, sf):
    return cu.tier3_fallback(M(spark, sf).specialty_tiers)


@query("d4_rfm_base", """
SELECT cust_id, last_order_date, frequency, monetary, n_categories_bought, avg_revenue_per_order, recency_days FROM v_rfm""")
def _(spark, sf):
    return _base(spark, sf)


@query("d5_category_hhi", "SELECT cust_id, category_hhi FROM v_hhi")
def _(spark, sf):
    return cu.category_hhi(cu.family_spend(M(spark, sf).item_lines))


@query("d6_order_gap_stats", "SELECT cust_id, avg_order_gap_days, cycle_regularity FROM v_gaps")
def _(spark, sf):
    return cu.order_gaps(M(spark, sf).sales)


@query("d7_churn_label", "SELECT cust_id, churn_label FROM v_churn")
def _(spark, sf):
    return cu.churn_labels(M(spark, sf).sales)


@query("d8_r_score", "SELECT cust_id, recency_days, r_score FROM v_scores")
def _(spark, sf):
    return cu.r_score(_base(spark, sf)).select("cust_id", "recency_days", "r_score")


@query("d9_f_and_m_score", "SELECT cust_id, f_score, m_score FROM v_scores")
def _(spark, sf):
    base = _base(spark, sf)
    return rk.quantile_score(base, "frequency", "cust_id", "f_score").join(
        rk.quantile_score(base, "monetary", "cust_id", "m_score"), "cust_id").select("cust_id", "f_score", "m_score")


@query("d10_rfm_score", "SELECT cust_id, rfm_score FROM v_scores")
def _(spark, sf):
    return cu.value_scores(_base(spark, sf)).select("cust_id", "rfm_score")


@query("d11_supplier_profile", "SELECT cust_id, pct_competitor, pct_private_brand, supplier_profile FROM v_supplier")
def _(spark, sf):
    return cu.supplier_profile(cu.family_spend(M(spark, sf).item_lines, d.COMPETITORS), SP)


@query("d12_monthly_spend_volume", "SELECT * FROM v_monthly")
def _(spark, sf):
    return cu.monthly_spend_volume(M(spark, sf).sales)


@query("d13_median_monthly", "SELECT cust_id, median_monthly_spend, median_monthly_volume, active_months_total FROM v_size0")
def _(spark, sf):
    return cu.median_monthly(cu.monthly_spend_volume(M(spark, sf).sales))


@query("d14_active_months_last_12", "SELECT cust_id, active_months_last_12 FROM v_active12")
def _(spark, sf):
    return cu.active_months_last_12(cu.monthly_spend_volume(M(spark, sf).sales))


@query("d15_spend_and_volume_tier", "SELECT cust_id, spend_tier, volume_tier FROM v_size")
def _(spark, sf):
    return cu.size_stats(M(spark, sf).sales, S).select("cust_id", "spend_tier", "volume_tier")


@query("d16_size_tier", f"""
SELECT cust_id, size_tier AS max_one, (['new', 'small', 'mid', 'large', 'enterprise'])[
  least({_RANK.format('spend_tier')}, {_RANK.format('volume_tier')})] AS pure_2d, spend_tier AS spend_only FROM v_size""")
def _(spark, sf):
    return cu.size_stats(M(spark, sf).sales, S).select(
        "cust_id", *[cu.size_tier("spend_tier", "volume_tier", r).alias(r) for r in ("max_one", "pure_2d", "spend_only")])


@query("d17_affordability_ceiling", "SELECT cust_id, size_tier, affordability_ceiling FROM v_size")
def _(spark, sf):
    return cu.size_stats(M(spark, sf).sales, S).select("cust_id", "size_tier", "affordability_ceiling")


@query("d18_label_encode", """
SELECT cust_id, specialty, coalesce((SELECT count(DISTINCT specialty) FROM v_customers b WHERE b.specialty < a.specialty), -1) AS specialty_encoded
FROM v_customers a""")
def _(spark, sf):
    return cu.label_encode(M(spark, sf).customers.select("cust_id", "specialty"), "specialty", "specialty_encoded")


@query("d19_rare_group", f"""
WITH g AS (SELECT cust_id, CASE WHEN n >= {C.state_min_customers} THEN state ELSE 'Other' END AS state_grouped
  FROM (SELECT cust_id, state, count(*) OVER (PARTITION BY state) AS n FROM v_customers))
SELECT cust_id, state_grouped, dense_rank() OVER (ORDER BY state_grouped) - 1 AS state_encoded FROM g""")
def _(spark, sf):
    grouped = cu.rare_group(M(spark, sf).customers.select("cust_id", "state"), "state", C.state_min_customers, "state_grouped")
    return cu.label_encode(grouped.drop("state"), "state_grouped", "state_encoded")


@query("d20_one_hot_top_k", """
WITH t AS (SELECT specialty AS code FROM v_spec_stats ORDER BY total_revenue DESC, specialty LIMIT 5)
SELECT cust_id, code, CASE WHEN specialty = code THEN 1 ELSE 0 END AS is_set FROM v_customers, t""")
def _(spark, sf):
    m = M(spark, sf)
    codes = cu.top_codes(m.merged, "specialty", "amount", 5)
    hot = cu.one_hot(m.customers.select("cust_id", "specialty"), "specialty", codes, "spec_").drop("specialty")
    long = hot.unpivot("cust_id", [f"spec_{c}" for c in codes], "code", "is_set")
    return long.withColumn("code", F.substring("code", 6, 100))


@query("d21_specialty_trend", """
SELECT coalesce(a.specialty, b.specialty) AS specialty, coalesce(r1, 0) AS revenue_first, coalesce(r2, 0) AS revenue_second,
  round((coalesce(r2, 0) - coalesce(r1, 0)) / nullif(coalesce(r1, 0), 0) * 100, 2) AS trend_pct FROM
(SELECT specialty, round(sum(amount), 2) AS r1 FROM v_merged WHERE fy = 'FY1' GROUP BY 1) a FULL JOIN
(SELECT specialty, round(sum(amount), 2) AS r2 FROM v_merged WHERE fy = 'FY2' GROUP BY 1) b ON a.specialty = b.specialty""")
def _(spark, sf):
    m = M(spark, sf)
    return cu.specialty_trend(m.sales, m.customers)


@query("d22_tier_crosstab", """
SELECT CASE WHEN grouping(spend_tier) = 1 THEN 'TOTAL' ELSE spend_tier END AS spend_tier,
  CASE WHEN grouping(volume_tier) = 1 THEN 'TOTAL' ELSE volume_tier END AS volume_tier, count(*) AS n
FROM v_size GROUP BY CUBE (spend_tier, volume_tier)""")
def _(spark, sf):
    return cu.crosstab(M(spark, sf).features, "spend_tier", "volume_tier")


@query("d23_column_profile", """
SELECT 'bigint' AS data_type, 'l_partkey' AS column_name, count(*) AS n_rows, count(*) - count(l_partkey) AS null_count, count(DISTINCT l_partkey) AS n_distinct, CAST(0 AS DOUBLE) AS null_pct FROM lineitem
UNION ALL SELECT 'double', 'l_quantity', count(*), count(*) - count(l_quantity), count(DISTINCT l_quantity), 0.0 FROM lineitem
UNION ALL SELECT 'string', 'l_returnflag', count(*), count(*) - count(l_returnflag), count(DISTINCT l_returnflag), 0.0 FROM lineitem
UNION ALL SELECT 'int', 'l_linenumber', count(*), count(*) - count(l_linenumber), count(DISTINCT l_linenumber), 0.0 FROM lineitem""")
def _(spark, sf):
    return cu.column_profile(d.raw(spark, sf, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag", "l_linenumber"])


@query("d24_fy_sales_stats", """
SELECT fy, count(*) AS n_lines, count(DISTINCT cust_id) AS customers, count(DISTINCT item_id) AS products,
  round(sum(amount), 2) AS revenue, min(order_date) AS first_date, max(order_date) AS last_date FROM v_sales GROUP BY 1""")
def _(spark, sf):
    return cu.fy_sales_stats(M(spark, sf).sales)


_CHURN_MEANING = {-1: "only in the second year", 0: "bought in both years", 1: "bought in the first year only"}


@query("d25_label_distribution", """
SELECT CAST(churn_label AS VARCHAR) AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct,
  CASE churn_label WHEN -1 THEN 'only in the second year' WHEN 0 THEN 'bought in both years' ELSE 'bought in the first year only' END AS meaning
FROM v_churn GROUP BY churn_label""")
def _(spark, sf):
    return cu.label_distribution(cu.churn_labels(M(spark, sf).sales), "churn_label", _CHURN_MEANING)


@query("d_customer_features", """
SELECT cust_id, recency_days, frequency, monetary, rfm_score, churn_label, category_hhi, avg_order_gap_days, cycle_regularity,
  supplier_profile, median_monthly_spend, median_monthly_volume, active_months_last_12, spend_tier, volume_tier, size_tier,
  affordability_ceiling, market, specialty, state FROM v_features""")
def _(spark, sf):
    return M(spark, sf).features.select(
        "cust_id", "recency_days", "frequency", "monetary", "rfm_score", "churn_label", "category_hhi",
        "avg_order_gap_days", "cycle_regularity", "supplier_profile", "median_monthly_spend", "median_monthly_volume",
        "active_months_last_12", "spend_tier", "volume_tier", "size_tier", "affordability_ceiling", "market", "specialty", "state")


# ---- segments and archetypes ----

@query("e1_assign_segment", "SELECT * FROM v_segments")
def _(spark, sf):
    return M(spark, sf).segments


_W = " ".join(f"WHEN '{t}' THEN {SEGMENT_WEIGHTS[t][0]}" for t in SIZE_TIERS)
_L = " ".join(f"WHEN '{t}' THEN {SEGMENT_WEIGHTS[t][1]}" for t in SIZE_TIERS)


@query("e2_segment_profile", f"""
SELECT *, CASE WHEN peer_gap_weight >= lapsed_weight THEN 'peer_gap' ELSE 'lapsed' END AS primary_signal FROM (
SELECT segment, market_clean, g.size_tier, count(*) AS n_customers,
  round(avg(CASE WHEN churn_label IN (0, 1) THEN churn_label END) * 100, 1) AS churn_rate_pct,
  {', '.join(f'{half_up(f"median({c})", 4)} AS {n}' for n, c in cu.SEGMENT_MEASURES.items())},
  CAST(CASE g.size_tier {_W} END AS DOUBLE) AS peer_gap_weight, CAST(CASE g.size_tier {_L} END AS DOUBLE) AS lapsed_weight,
  CASE market_clean WHEN 'BUILDING' THEN 'Building trade' ELSE 'Other' END AS market_label,
  {_RANK.format('g.size_tier')} - 1 AS display_order
FROM v_features f JOIN v_segments g ON f.cust_id = g.cust_id GROUP BY segment, market_clean, g.size_tier)""")
def _(spark, sf):
    m = M(spark, sf)
    return cu.segment_profile(m.features, m.segments, {"BUILDING": "Building trade"})


# archetype words and codes of the driver tables' specialties
WORDS = (("asia_trade", ("ASIA",)), ("teens", ("NATION_1",)), ("old_world", ("EUROPE", "AFRICA")))
CODES = (("first", ("NATION_3", "NATION_4")), ("twenties", ("NATION_2",)), ("east", ("ASIA", "MIDDLE")))
cte("v_arch", """
SELECT cust_id, specialty, specialty_dsc, CASE WHEN specialty_dsc IS NULL OR specialty_dsc = '' THEN 'unknown'
  WHEN contains(upper(trim(specialty_dsc)), 'ASIA') THEN 'asia_trade' WHEN contains(upper(trim(specialty_dsc)), 'NATION_1') THEN 'teens'
  WHEN contains(upper(trim(specialty_dsc)), 'EUROPE') OR contains(upper(trim(specialty_dsc)), 'AFRICA') THEN 'old_world'
  ELSE 'specialty_clinic' END AS archetype,
  CASE WHEN market = 'AUTOMOBILE' THEN 'hospital_acute'
  WHEN specialty IN ('NATION_3', 'NATION_4') OR contains(specialty_dsc, 'NATION_3') OR contains(specialty_dsc, 'NATION_4') THEN 'first'
  WHEN specialty = 'NATION_2' OR contains(specialty_dsc, 'NATION_2') THEN 'twenties'
  WHEN contains(specialty_dsc, 'ASIA') OR contains(specialty_dsc, 'MIDDLE') THEN 'east' ELSE 'specialty_clinic' END AS archetype_code
FROM v_customers""")


@query("e4_archetype_by_description", "SELECT cust_id, archetype FROM v_arch")
def _(spark, sf):
    return M(spark, sf).customers.select("cust_id", text.archetype_by_description("specialty_dsc", WORDS).alias("archetype"))


@query("e5_archetype_by_code", "SELECT cust_id, archetype_code FROM v_arch")
def _(spark, sf):
    return M(spark, sf).customers.select("cust_id", text.archetype_by_code(
        "specialty", "specialty_dsc", "market", CODES, "AUTOMOBILE").alias("archetype_code"))


def _with_archetype(m):
    a = m.customers.select("cust_id", "specialty_dsc", text.archetype_by_description("specialty_dsc", WORDS).alias("archetype"))
    return m.features.join(a, "cust_id")


@query("e6_archetype_profile", f"""
SELECT archetype, count(*) AS n_customers, round(sum(monetary), 2) AS total_spend, round(avg(monetary), 2) AS mean_spend,
  round(avg(CASE WHEN churn_label = 1 THEN 1 ELSE 0 END) * 100, 2) AS churn_rate, {half_up("median(monetary)")} AS median_spend,
  {half_up("median(median_monthly_volume)")} AS median_volume, {half_up("median(frequency)")} AS median_freq,
  {half_up("median(recency_days)")} AS median_recency, {half_up("median(n_categories_bought)")} AS median_n_cats
FROM v_features f JOIN v_arch a ON f.cust_id = a.cust_id GROUP BY 1""")
def _(spark, sf):
    return cu.archetype_profile(_with_archetype(M(spark, sf)))


@query("e6_top_specialties_per_archetype", """
SELECT archetype, specialty, n_customers, rank FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY n_customers DESC, specialty) AS rank
FROM (SELECT archetype, specialty_dsc AS specialty, count(*) AS n_customers FROM v_arch a JOIN v_features f ON a.cust_id = f.cust_id GROUP BY 1, 2)) WHERE rank <= 10""")
def _(spark, sf):
    return cu.top_specialties(_with_archetype(M(spark, sf)))


# The rule tables as they are shipped, over descriptions and codes that hold their words: a customer's words follow from its id.
_ALL_WORDS = [w for _, ws in text.ARCHETYPE_WORDS for w in ws]
_ALL_CODES = [c for _, cs in text.ARCHETYPE_CODES for c in cs]


def _described(spark, sf):
    pick = lambda words, step: F.get(F.array(*[F.lit(w) for w in words]), (F.col("cust_id") * step % (len(words) + 2)).cast("int"))
    return M(spark, sf).customers.select(
        "cust_id", F.concat(F.lit("dept of "), pick(_ALL_WORDS, 7), F.lit(" "), F.col("specialty")).alias("description"),
        pick(_ALL_CODES, 5).alias("code"), F.when(F.col("cust_id") % 11 == 0, "AC").otherwise(F.lit("PO")).alias("market"))


def _rules(column, rules, test):
    return " ".join("WHEN " + " OR ".join(test.format(c=column, w=w.replace("'", "''")) for w in ws) + f" THEN '{name}'" for name, ws in rules)


cte("v_described", f"""
SELECT cust_id, 'dept of ' || ([{", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in _ALL_WORDS)}])[cust_id * 7 % {len(_ALL_WORDS) + 2} + 1] || ' ' || specialty AS description,
  ([{", ".join(f"'{c}'" for c in _ALL_CODES)}])[cust_id * 5 % {len(_ALL_CODES) + 2} + 1] AS code, CASE WHEN cust_id % 11 = 0 THEN 'AC' ELSE 'PO' END AS market FROM v_customers""")
cte("v_shipped", f"""
SELECT cust_id, CASE WHEN description IS NULL OR description = '' THEN 'unknown' {_rules('upper(trim(description))', text.ARCHETYPE_WORDS, "contains({c}, '{w}')")} ELSE 'specialty_clinic' END AS archetype,
  CASE WHEN coalesce(code, '') = '' AND coalesce(description, '') = '' THEN 'unknown' WHEN market = 'AC' THEN 'hospital_acute'
    {_rules('code', text.ARCHETYPE_CODES, "upper(trim(coalesce({c}, ''))) = '{w}' OR contains(upper(trim(coalesce(description, ''))), '{w}')")} ELSE 'specialty_clinic' END AS archetype_code
FROM v_described""")


@query("e4_archetype_shipped_words", "SELECT cust_id, archetype FROM v_shipped")
def _(spark, sf):
    return _described(spark, sf).select("cust_id", text.archetype_by_description("description").alias("archetype"))


@query("e5_archetype_shipped_codes", "SELECT cust_id, archetype_code FROM v_shipped")
def _(spark, sf):
    return _described(spark, sf).select("cust_id", text.archetype_by_code("code", "description", "market").alias("archetype_code"))


@query("e6_archetype_profile_shipped", f"""
SELECT archetype, count(*) AS n_customers, round(sum(monetary), 2) AS total_spend, round(avg(monetary), 2) AS mean_spend,
  round(avg(CASE WHEN churn_label = 1 THEN 1 ELSE 0 END) * 100, 2) AS churn_rate, {half_up("median(monetary)")} AS median_spend,
  {half_up("median(median_monthly_volume)")} AS median_volume, {half_up("median(frequency)")} AS median_freq,
  {half_up("median(recency_days)")} AS median_recency, {half_up("median(n_categories_bought)")} AS median_n_cats
FROM v_features f JOIN v_shipped a ON f.cust_id = a.cust_id GROUP BY 1""")
def _(spark, sf):
    named = _described(spark, sf).select("cust_id", text.archetype_by_description("description").alias("archetype"))
    return cu.archetype_profile(M(spark, sf).features.join(named, "cust_id"))
