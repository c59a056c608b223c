"""Buying behaviour and family rules."""

from pyspark.sql import functions as F

from ..operators import behaviour as bh
from ..operators import customers as cu
from ..plans import driver_tables as d
from ..plans.model import Model
from . import products  # noqa: F401  (its subqueries)
from .base_sql import words
from .registry import cte, half_up, query

M = Model.from_folder
P, PI, FR = d.PATTERNS, d.PATTERNS_ITEM, d.FAMILY_RULES
MAXD = "(SELECT d FROM v_max)"


def _ago(months):
    return f"CAST({MAXD} - INTERVAL {months} MONTH AS DATE)"


cte("v_pl", f"SELECT * FROM v_merged WHERE amount > 0 AND coalesce(family, 'Unknown') NOT IN ({words(d.EXCLUDED_FAMILIES)})")
cte("v_cadence", f"""
SELECT *, CASE WHEN g < 0 THEN 'single_order' WHEN g <= {P.frequent_days} THEN 'frequent' WHEN g <= {P.regular_days} THEN 'regular'
  ELSE 'occasional' END AS order_cadence_tier, g AS avg_days_between_orders FROM (
  SELECT *, CASE WHEN n_order_dates > 1 THEN round(active_span_days / (n_order_dates - 1), 6) ELSE -1.0 END AS g FROM (
    SELECT cust_id, count(DISTINCT order_date) AS n_order_dates, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
      max(order_date) - min(order_date) AS active_span_days FROM v_pl GROUP BY 1))""")
cte("v_trend", f"""
SELECT *, CASE WHEN spend_historical > 0 AND spend_last_6mo = 0 THEN 1 ELSE 0 END AS is_churned,
  CASE WHEN spend_historical >= {P.decline_base} AND spend_last_6mo > 0 AND spend_last_6mo / 6 < spend_historical / 18 * 0.5 THEN 1 ELSE 0 END AS is_declining FROM (
SELECT cust_id, count(DISTINCT item_id) AS total_unique_products, round(sum(amount), 2) AS total_spend_all_time,
  count(DISTINCT CASE WHEN order_date >= {_ago(6)} THEN item_id END) AS unique_products_last_6mo,
  round(sum(CASE WHEN order_date >= {_ago(6)} THEN amount ELSE 0 END), 2) AS spend_last_6mo,
  count(DISTINCT CASE WHEN order_date >= {_ago(3)} THEN item_id END) AS unique_products_last_3mo,
  round(sum(CASE WHEN order_date >= {_ago(3)} THEN amount ELSE 0 END), 2) AS spend_last_3mo,
  count(DISTINCT CASE WHEN order_date < {_ago(6)} THEN item_id END) AS unique_products_historical,
  round(sum(CASE WHEN order_date < {_ago(6)} THEN amount ELSE 0 END), 2) AS spend_historical FROM v_pl GROUP BY 1)""")
cte("v_lapsed", f"""
SELECT cust_id, item_id, max(order_date) AS last_order_date, min(order_date) AS first_order_date, count(*) AS n_lines,
  round(sum(qty), 2) AS total_qty, round(sum(amount), 2) AS total_spend, CAST({MAXD} - max(order_date) AS INTEGER) AS days_since_last
FROM v_pl GROUP BY 1, 2 HAVING max(order_date) < {_ago(P.lapsed_months)} AND bool_or(fy = 'FY1')""")
cte("v_portfolio", """
SELECT *, n_unique_products_total - n_lapsed_products AS n_active_products, round(n_lapsed_products / n_unique_products_total, 6) AS lapsed_rate FROM (
  SELECT t.cust_id, n AS n_unique_products_total, coalesce(l, 0) AS n_lapsed_products FROM (SELECT cust_id, count(DISTINCT item_id) AS n FROM v_pl GROUP BY 1) t
  LEFT JOIN (SELECT cust_id, count(*) AS l FROM v_lapsed GROUP BY 1) x ON t.cust_id = x.cust_id)""")


def _personal(lines):
    return f"""
SELECT *, CASE WHEN n_purchases >= 2 THEN round(span_days / (n_purchases - 1), 6) END AS personal_avg_days FROM (
  SELECT cust_id, item_id, count(DISTINCT order_date) AS n_purchases, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
    max(order_date) - min(order_date) AS span_days FROM ({lines}) GROUP BY 1, 2)"""


def _seg_cadence(src, p):
    return f"""
SELECT *, CASE WHEN n_buyers_segment >= {p.segment_buyers} AND n_buyers_with_2plus >= {p.segment_repeat} AND peer_activity_rate >= {p.alive_rate}
    THEN 1 ELSE 0 END AS is_alive, CASE WHEN n_buyers_with_2plus >= {p.segment_repeat} THEN 1 ELSE 0 END AS cadence_is_reliable FROM (
  SELECT *, round(n_buyers_active_recent / n_buyers_segment, 6) AS peer_activity_rate FROM (
    SELECT item_id, segment, size_tier, market_clean, count(*) AS n_buyers_segment,
      CAST(sum(CASE WHEN n_purchases >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_buyers_with_2plus,
      CAST(sum(CASE WHEN last_order_date >= {_ago(p.peer_months)} THEN 1 ELSE 0 END) AS BIGINT) AS n_buyers_active_recent,
      round(avg(personal_avg_days), 4) AS mean_days_between_segment, {half_up('median(personal_avg_days)', 4)} AS median_days_between_segment
    FROM {src} c JOIN v_segments s ON c.cust_id = s.cust_id GROUP BY 1, 2, 3, 4))"""


def _repl(src, seg, p):
    return f"""
SELECT * FROM (SELECT c.cust_id, c.item_id, s.segment, n_purchases, last_order_date, personal_avg_days, median_days_between_segment, peer_activity_rate,
  n_buyers_segment, CAST({MAXD} - last_order_date AS INTEGER) AS days_since_last,
  round(({MAXD} - last_order_date) / greatest(median_days_between_segment, 1), 6) AS overdue_ratio
  FROM {src} c JOIN v_segments s ON c.cust_id = s.cust_id JOIN {seg} a ON a.item_id = c.item_id AND a.segment = s.segment
  WHERE is_alive = 1 AND cadence_is_reliable = 1) WHERE overdue_ratio >= {p.overdue}"""


cte("v_coarse_cad", _personal("SELECT cust_id, coarse_id AS item_id, order_date FROM v_pl JOIN v_coarse USING (item_id)"))
cte("v_item_cad", _personal("SELECT cust_id, item_id, order_date FROM v_pl"))
cte("v_coarse_seg", _seg_cadence("v_coarse_cad", P))
cte("v_item_seg", _seg_cadence("v_item_cad", PI))
cte("v_repl", _repl("v_item_cad", "v_item_seg", PI))
cte("v_patterns", f"""
SELECT *, CASE WHEN order_cadence_tier = 'single_order' THEN 1 ELSE 0 END AS is_single_order_customer,
  CASE WHEN n_unique_products_total < {P.cold_products} OR order_cadence_tier IN ('single_order', 'no_data') THEN 1 ELSE 0 END AS is_cold_start
FROM v_cadence c FULL JOIN v_trend t USING (cust_id) FULL JOIN v_portfolio p USING (cust_id) LEFT JOIN v_segments s USING (cust_id)""")
cte("v_firsts", """
SELECT e.cust_id, family, segment, min(order_date) AS first_date FROM v_elig e JOIN v_segments s ON e.cust_id = s.cust_id GROUP BY 1, 2, 3""")
cte("v_fam_profile", f"""
SELECT segment, family, n_customers, order_count, seg_total_custs, {half_up('n_customers / seg_total_custs', 4)} AS adoption_rate FROM (
  SELECT segment, family, count(DISTINCT e.cust_id) AS n_customers, count(DISTINCT order_date) AS order_count FROM v_elig e JOIN v_segments s ON e.cust_id = s.cust_id GROUP BY 1, 2)
JOIN (SELECT segment, count(DISTINCT e.cust_id) AS seg_total_custs FROM v_elig e JOIN v_segments s ON e.cust_id = s.cust_id GROUP BY 1) USING (segment)""")


@query("g1_order_cadence", """
SELECT cust_id, n_order_dates, first_order_date, last_order_date, CAST(active_span_days AS INTEGER) AS active_span_days, avg_days_between_orders, order_cadence_tier FROM v_cadence""")
def _(spark, sf):
    return bh.order_cadence(M(spark, sf).pattern_lines, P)


_TREND = ("cust_id", "total_unique_products", "total_spend_all_time", "unique_products_last_6mo", "spend_last_6mo",
          "unique_products_last_3mo", "spend_last_3mo", "unique_products_historical", "spend_historical")


@query("g2_activity_trend", f"SELECT {', '.join(_TREND)} FROM v_trend")
def _(spark, sf):
    m = M(spark, sf)
    return bh.activity_trend(m.pattern_lines, m.latest, P).select(*_TREND)


@query("g3_churned_declining", "SELECT cust_id, is_churned, is_declining FROM v_trend")
def _(spark, sf):
    m = M(spark, sf)
    return bh.activity_trend(m.pattern_lines, m.latest, P).select("cust_id", "is_churned", "is_declining")


@query("g4_lapsed_products", "SELECT * FROM v_lapsed")
def _(spark, sf):
    return M(spark, sf).lapsed


@query("g5_portfolio", "SELECT * FROM v_portfolio")
def _(spark, sf):
    m = M(spark, sf)
    return bh.portfolio(m.pattern_lines, m.lapsed)


@query("g6_personal_cadence", """
SELECT cust_id, item_id, n_purchases, first_order_date, last_order_date, CAST(span_days AS INTEGER) AS span_days, personal_avg_days FROM v_coarse_cad""")
def _(spark, sf):
    return M(spark, sf).coarse_cadence


@query("g7_segment_cadence", "SELECT * FROM v_coarse_seg")
def _(spark, sf):
    m = M(spark, sf)
    return bh.segment_cadence(m.coarse_cadence, m.segments, m.latest, P)


@query("g8_replenishment_candidates", _repl("v_coarse_cad", "v_coarse_seg", P))
def _(spark, sf):
    m = M(spark, sf)
    cad = bh.segment_cadence(m.coarse_cadence, m.segments, m.latest, P)
    return bh.replenishment_candidates(m.coarse_cadence, cad, m.segments, m.latest, P)


@query("g8_replenishment_item_grain", "SELECT * FROM v_repl")
def _(spark, sf):
    return M(spark, sf).replenishment


@query("g9_customer_patterns", """
SELECT cust_id, n_order_dates, avg_days_between_orders, order_cadence_tier, spend_last_6mo, is_churned, is_declining, n_unique_products_total,
  n_lapsed_products, lapsed_rate, is_cold_start, is_single_order_customer, segment FROM v_patterns""")
def _(spark, sf):
    return M(spark, sf).patterns.select(
        "cust_id", "n_order_dates", "avg_days_between_orders", "order_cadence_tier", "spend_last_6mo", "is_churned", "is_declining",
        "n_unique_products_total", "n_lapsed_products", "lapsed_rate", "is_cold_start", "is_single_order_customer", "segment")


@query("c7_family_pairs_within_window", f"""
SELECT a.cust_id, a.segment, a.family AS category_a, b.family AS category_b FROM v_firsts a JOIN v_firsts b ON a.cust_id = b.cust_id
AND a.family < b.family AND abs(a.first_date - b.first_date) <= 180""")
def _(spark, sf):
    return bh.family_pairs_within(M(spark, sf).family_firsts, 180)


@query("g10_family_cooccurrence_rules", f"""
WITH sz AS (SELECT segment, count(DISTINCT cust_id) AS n FROM v_firsts GROUP BY 1 HAVING count(DISTINCT cust_id) >= {FR.min_segment}),
ct AS (SELECT segment, family, count(*) AS n FROM v_firsts GROUP BY 1, 2),
co AS (SELECT a.segment, a.family AS category_a, b.family AS category_b, count(*) AS co FROM v_firsts a JOIN v_firsts b ON a.cust_id = b.cust_id
  AND a.family < b.family AND abs(a.first_date - b.first_date) <= {FR.window_days} GROUP BY 1, 2, 3),
r AS (SELECT co.*, sz.n AS n, x.n AS na, y.n AS nb FROM co JOIN sz USING (segment) JOIN ct x ON x.segment = co.segment AND x.family = category_a
  JOIN ct y ON y.segment = co.segment AND y.family = category_b),
f AS (SELECT *, round((co / n) / ((na / n) * (nb / n)), 4) AS lift FROM r
  WHERE co / n >= {FR.min_support} AND greatest(co / na, co / nb) >= {FR.min_confidence})
SELECT segment, category_a, category_b, co AS co_occurrence, n AS n_segment_custs, round(co / na, 4) AS confidence_a_b, round(co / nb, 4) AS confidence_b_a,
  lift, round(co / n, 4) AS support, 'Offer ' || CASE WHEN na <= nb THEN category_b ELSE category_a END || ' with '
  || CASE WHEN na <= nb THEN category_a ELSE category_b END || ': ' || CAST(CAST(round(greatest(co / na, co / nb) * 100, 0) AS INTEGER) AS VARCHAR)
  || '% of its buyers take both inside {FR.window_days} days.' AS seller_action, rule_rank
FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY lift DESC, category_a, category_b) AS rule_rank FROM f WHERE lift > 1) WHERE rule_rank <= {FR.top_rules}""")
def _(spark, sf):
    return bh.family_cooccurrence_rules(M(spark, sf).family_firsts, FR)


@query("g11_family_transitions", f"""
WITH sz AS (SELECT segment, count(DISTINCT cust_id) AS n FROM v_firsts GROUP BY 1 HAVING count(DISTINCT cust_id) >= {FR.min_segment}),
st AS (SELECT *, lead(family) OVER (PARTITION BY cust_id ORDER BY first_date, family) AS nxt FROM v_firsts),
c AS (SELECT segment, family AS from_category, nxt AS to_category, count(*) AS transition_count, sum(count(*)) OVER (PARTITION BY segment, family) AS f
  FROM st WHERE nxt IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT segment, from_category, to_category, transition_count, n AS n_segment_custs, round(transition_count / f, 4) AS transition_prob,
  round(transition_count / n, 4) AS support FROM c JOIN sz USING (segment) WHERE transition_count / n >= {FR.min_support} AND transition_count / f >= {FR.min_confidence})
SELECT *, 'After a first order of ' || from_category || ' show ' || to_category || ': ' || CAST(CAST(round(transition_prob * 100, 0) AS INTEGER) AS VARCHAR) || '% go there next.' AS seller_action
FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY transition_prob DESC, from_category, to_category) AS seq_rank FROM k) WHERE seq_rank <= {FR.top_sequences}""")
def _(spark, sf):
    return bh.family_transitions(M(spark, sf).family_firsts, FR)


@query("g12_segment_family_profile", "SELECT * FROM v_fam_profile")
def _(spark, sf):
    return M(spark, sf).family_profile


# ---- customer picks that need the lifecycle status ----

cte("v_status", """
SELECT c.cust_id, segment, market_clean, size_tier, CASE WHEN is_cold_start = 1 THEN 'cold_start' WHEN is_churned = 1 THEN 'churned_warm'
  WHEN is_declining = 1 THEN 'declining_warm' ELSE 'stable_warm' END AS status, n_order_dates AS n_orders_total,
  n_unique_products_total AS n_unique_products, total_spend_all_time AS total_spend, archetype, supplier_profile
FROM v_patterns c JOIN v_arch a ON a.cust_id = c.cust_id JOIN v_supplier p ON p.cust_id = c.cust_id""")


def _status(spark, sf):
    from ..functions import text
    from .customers import WORDS
    m = M(spark, sf)
    arch = m.customers.select("cust_id", text.archetype_by_description("specialty_dsc", WORDS).alias("archetype"))
    return (m.patterns.withColumn("status", cu.lifecycle_status()).join(arch, "cust_id")
            .join(m.features.select("cust_id", "supplier_profile"), "cust_id")
            .select("cust_id", "segment", "market_clean", "size_tier", "status", F.col("n_order_dates").alias("n_orders_total"),
                    F.col("n_unique_products_total").alias("n_unique_products"), F.col("total_spend_all_time").alias("total_spend"),
                    "archetype", "supplier_profile"))


@query("e7_lifecycle_status", "SELECT cust_id, status FROM v_status")
def _(spark, sf):
    return M(spark, sf).patterns.select("cust_id", cu.lifecycle_status().alias("status"))


QUOTAS = (("stable_warm", ("BUILDING", "FURNITURE"), 8), ("declining_warm", ("BUILDING", "OTHER"), 6),
          ("churned_warm", ("AUTOMOBILE",), 5), ("cold_start", ("HOUSEHOLD", "OTHER"), 4))
_QSQL = " ".join("WHEN status = '{}' AND ({}) THEN {}".format(s, " OR ".join(f"starts_with(segment, '{p}')" for p in ps), i)
                 for i, (s, ps, _) in enumerate(QUOTAS))


@query("e3_quota_picks", f"""
SELECT cust_id, segment, status, n_orders_total, quota_no, pick FROM (SELECT *, row_number() OVER (PARTITION BY quota_no ORDER BY n_orders_total DESC, cust_id) AS pick
  FROM (SELECT *, CASE {_QSQL} END AS quota_no FROM v_status) WHERE quota_no IS NOT NULL) WHERE pick <= ([8, 6, 5, 4])[quota_no + 1]""")
def _(spark, sf):
    return cu.quota_picks(_status(spark, sf), QUOTAS).select("cust_id", "segment", "status", "n_orders_total", "quota_no", "pick")


_REP = "SELECT *, '{r}' AS pick_reason, {i} AS p FROM (SELECT *, row_number() OVER (PARTITION BY {c}, status ORDER BY sc DESC, cust_id) AS rn FROM s) WHERE rn = 1"


@query("e8_representatives_per_cell", f"""
WITH s AS (SELECT *, round(n_unique_products + least(total_spend / 1000, 200.0), 6) AS sc FROM v_status),
u AS ({_REP.format(r='segment_x_status', i=0, c='segment')} UNION ALL {_REP.format(r='archetype_x_status', i=1, c='archetype')}
  UNION ALL {_REP.format(r='supplier_x_status', i=2, c='supplier_profile')})
SELECT cust_id, segment, status, archetype, supplier_profile, pick_reason FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY p) AS k FROM u) WHERE k = 1""")
def _(spark, sf):
    return cu.representatives(_status(spark, sf)).select("cust_id", "segment", "status", "archetype", "supplier_profile", "pick_reason")
