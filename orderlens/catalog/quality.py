"""Expectations, back-tests and review of the final list."""

from pyspark.sql import functions as F

from ..operators import combine as cb
from ..operators import customers as cu
from ..operators import evaluation as ev
from ..params import SIGNALS, SIZE_TIERS
from ..plans import driver_tables as d
from ..plans.model import Model
from . import dashboards, profiling  # noqa: F401  (their subqueries)
from .base_sql import words
from .registry import CTES, cte, half_up, past, query
from .serving import comp_sql, swap_sql

M = Model.from_folder
P = d.EVAL

_RULE_SQL = {
    "size_tier_allowed": f"size_tier IN ({words(SIZE_TIERS)})",
    "supplier_profile_allowed": "supplier_profile IN ('competitor_only', 'house_primary', 'mixed')",
    "churn_label_allowed": "churn_label IN (-1, 0, 1)",
    "monetary_not_negative": "monetary >= 0",
    "ceiling_not_negative": "affordability_ceiling >= 0",
    "active_months_in_range": "active_months_last_12 BETWEEN 0 AND 12",
    "r_score_in_range": "r_score BETWEEN 1 AND 5",
    "f_score_in_range": "f_score BETWEEN 1 AND 5",
    "m_score_in_range": "m_score BETWEEN 1 AND 5",
    "hhi_in_range": "category_hhi BETWEEN 0 AND 1",
    "new_tier_means_inactive": f"size_tier <> 'new' OR active_months_last_12 < {d.SIZE.min_active_months}",
    "other_tiers_mean_active": f"size_tier = 'new' OR active_months_last_12 >= {d.SIZE.min_active_months}",
    "ceiling_formula": "abs(affordability_ceiling - median_monthly_spend * CASE size_tier WHEN 'new' THEN 3.0 WHEN 'small' THEN 1.5 "
                       "WHEN 'mid' THEN 1.8 WHEN 'large' THEN 2.0 ELSE 2.5 END) < 0.02",
    "more_than_five_orders": "frequency > 5",
}


@query("m1_value_expectations", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(sum(CASE WHEN {s} THEN 0 ELSE 1 END) AS BIGINT) AS violations, CASE WHEN sum(CASE WHEN {s} THEN 0 ELSE 1 END) = 0 THEN 1 ELSE 0 END AS passed FROM v_features"
    for n, s in _RULE_SQL.items()))
def _(spark, sf):
    return ev.expect_rules(M(spark, sf).features, {n: F.expr(s) for n, s in _RULE_SQL.items()})


_BOUNDS = {"new": (0.1, 70.0), "small": (0.1, 70.0), "mid": (0.1, 70.0), "large": (0.1, 70.0), "enterprise": (0.1, 10.0)}


@query("m1_share_expectations", " UNION ALL ".join(
    f"SELECT 'size_tier {v}' AS rule, s AS share_pct, CASE WHEN s BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS passed FROM (SELECT round(sum(CASE WHEN size_tier = '{v}' THEN 1 ELSE 0 END) / count(*) * 100, 4) AS s FROM v_features)"
    for v, (lo, hi) in _BOUNDS.items()))
def _(spark, sf):
    return ev.expect_shares(M(spark, sf).features, "size_tier", _BOUNDS)


_ROWS = {"sales": ("v_sales", 1_000, 10**12), "customer_features": ("v_features", 100, 10**9)}


@query("m1_row_counts", " UNION ALL ".join(
    f"SELECT '{t} rows' AS rule, count(*) AS n_rows, CAST({lo} AS BIGINT) AS low, CAST({hi} AS BIGINT) AS high, CASE WHEN count(*) BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS passed FROM {v}"
    for t, (v, lo, hi) in _ROWS.items()))
def _(spark, sf):
    m = M(spark, sf)
    m.features  # written, and noted, by whoever asks first
    return ev.expect_row_counts(spark, m.observed, {t: (lo, hi) for t, (_, lo, hi) in _ROWS.items()})


@query("m1_churn_band", """
SELECT 'churn rate' AS rule, p AS churn_pct, 5.0::DOUBLE AS low, 50.0::DOUBLE AS high, CASE WHEN p BETWEEN 5 AND 50 THEN 1 ELSE 0 END AS passed
FROM (SELECT round(count(*) FILTER (churn_label = 1) / count(*) FILTER (churn_label IN (0, 1)) * 100, 4) AS p FROM v_features)""")
def _(spark, sf):
    m = M(spark, sf)
    m.features
    return ev.expect_churn_band(spark, m.observed["customer_features"], 5, 50)


@query("m1_noted_shares", " UNION ALL ".join(
    f"SELECT 'size_tier {v}' AS rule, s AS share_pct, CASE WHEN s BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS passed FROM (SELECT round(sum(CASE WHEN size_tier = '{v}' THEN 1 ELSE 0 END) / count(*) * 100, 4) AS s FROM v_features)"
    for v, (lo, hi) in _BOUNDS.items()))
def _(spark, sf):
    m = M(spark, sf)
    m.features
    return ev.expect_noted_shares(spark, m.observed["customer_features"], "size_tier", _BOUNDS)


@query("m1_keys_and_orphans", """
SELECT 'features_unique' AS rule, (SELECT count(*) FROM (SELECT cust_id FROM v_features GROUP BY 1 HAVING count(*) > 1)) AS violations, 1 AS passed
UNION ALL SELECT 'lines_unique', n, CASE WHEN n = 0 THEN 1 ELSE 0 END FROM (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'sales_without_customer', n, CASE WHEN n = 0 THEN 1 ELSE 0 END FROM (SELECT count(*) AS n FROM v_sales WHERE cust_id NOT IN (SELECT cust_id FROM v_customers))
UNION ALL SELECT 'customers_without_sales', n, CASE WHEN n = 0 THEN 1 ELSE 0 END FROM (SELECT count(*) AS n FROM v_customers WHERE cust_id NOT IN (SELECT cust_id FROM v_sales))
UNION ALL SELECT 'features_columns', 0, 1""")
def _(spark, sf):
    m = M(spark, sf)
    return ev.union([
        ev.expect_unique(m.features, ["cust_id"], "features_unique"),
        ev.expect_unique(d.raw(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lines_unique"),
        ev.expect_no_orphans(m.sales, m.customers, "cust_id", "sales_without_customer"),
        ev.expect_no_orphans(m.customers, m.sales, "cust_id", "customers_without_sales"),
        ev.expect_columns(m.features, ["cust_id", "rfm_score", "size_tier", "churn_label"], "features_columns")])


@query("m1_list_invariants", f"""
SELECT 'rank_in_range' AS rule, CAST(sum(CASE WHEN rank BETWEEN 1 AND 10 THEN 0 ELSE 1 END) AS BIGINT) AS violations, 1 AS passed FROM v_recs
UNION ALL SELECT 'signal_allowed', CAST(sum(CASE WHEN primary_signal IN ({words(SIGNALS)}) THEN 0 ELSE 1 END) AS BIGINT), 1 FROM v_recs
UNION ALL SELECT 'score_in_range', CAST(sum(CASE WHEN normalized_score > 0 AND normalized_score <= 1 THEN 0 ELSE 1 END) AS BIGINT), 1 FROM v_recs""")
def _(spark, sf):
    return ev.expect_rules(M(spark, sf).recommendations(), {
        "rank_in_range": F.expr("rank BETWEEN 1 AND 10"), "signal_allowed": F.col("primary_signal").isin(*SIGNALS),
        "score_in_range": F.expr("normalized_score > 0 AND normalized_score <= 1")})


cte("v_cut", f"SELECT max(order_date) - {P.holdout_days} AS d FROM v_sales")
cte("v_hold", """
SELECT cust_id, item_id, count(*) AS n_lines, round(sum(amount), 2) AS spend, count(DISTINCT order_date) AS n_orders FROM v_sales
WHERE amount > 0 AND order_date > (SELECT d FROM v_cut) GROUP BY 1, 2""")
cte("v_base10", f"""
SELECT p.item_id, n_buyers, family, category FROM (SELECT item_id, count(DISTINCT cust_id) AS n_buyers FROM v_sales WHERE amount > 0 AND order_date <= (SELECT d FROM v_cut) GROUP BY 1
  ORDER BY n_buyers DESC, item_id LIMIT {P.popular_pool}) p JOIN v_items i ON i.item_id = p.item_id ORDER BY n_buyers DESC, p.item_id LIMIT {P.top_n}""")


def _hit(col):
    return f"""(SELECT r.cust_id, count(DISTINCT CASE WHEN rec THEN x END) AS e, count(DISTINCT CASE WHEN base THEN x END) AS b FROM (SELECT DISTINCT cust_id FROM v_recs) r LEFT JOIN (
    SELECT h.cust_id, i.{col} AS x, EXISTS (SELECT 1 FROM v_recs q JOIN v_items j ON j.item_id = q.item_id WHERE q.cust_id = h.cust_id AND j.{col} = i.{col}) AS rec,
      i.{col} IN (SELECT {col} FROM v_base10) AS base FROM v_hold h JOIN v_items i ON i.item_id = h.item_id) z ON z.cust_id = r.cust_id GROUP BY 1)"""


cte("v_hits", f"""
SELECT n.cust_id, n_holdout_items, n_rec_items, a.e AS eng_items_hits, b.e AS eng_families_hits, c.e AS eng_categories_hits, a.b AS bl_items_hits, b.b AS bl_families_hits, c.b AS bl_categories_hits,
  round(a.e / n_rec_items, 6) AS eng_precision, round(a.e / n_holdout_items, 6) AS eng_recall, round(a.b / (SELECT count(*) FROM v_base10), 6) AS bl_precision, round(a.b / n_holdout_items, 6) AS bl_recall
FROM (SELECT cust_id, count(*) AS n_holdout_items FROM v_hold GROUP BY 1) n JOIN (SELECT cust_id, count(*) AS n_rec_items FROM v_recs GROUP BY 1) r ON r.cust_id = n.cust_id
JOIN {_hit('item_id')} a ON a.cust_id = n.cust_id JOIN {_hit('family')} b ON b.cust_id = n.cust_id JOIN {_hit('category')} c ON c.cust_id = n.cust_id""")


@query("m2_holdout_purchases", "SELECT * FROM v_hold")
def _(spark, sf):
    return ev.holdout_purchases(M(spark, sf).sales, P)


@query("m3_popularity_baseline", "SELECT * FROM v_base10")
def _(spark, sf):
    m = M(spark, sf)
    return ev.popularity_baseline(m.sales, m.items, P)


def _hits(m):
    return ev.hits_per_customer(m.recommendations(), ev.holdout_purchases(m.sales, P), ev.popularity_baseline(m.sales, m.items, P), m.items)


@query("m4_hits_per_customer", "SELECT * FROM v_hits")
def _(spark, sf):
    return _hits(M(spark, sf))


_METRICS = [("strict_hit_rate", "avg(CASE WHEN {s}_items_hits > 0 THEN 1 ELSE 0 END)"), ("family_hit_rate", "avg(CASE WHEN {s}_families_hits > 0 THEN 1 ELSE 0 END)"),
            ("category_hit_rate", "avg(CASE WHEN {s}_categories_hits > 0 THEN 1 ELSE 0 END)"), ("precision", "avg({s}_precision)"), ("recall", "avg({s}_recall)")]


@query("m4_hit_rates", " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round({e.format(s='eng')} * 100, 4) AS engine_pct, round({e.format(s='bl')} * 100, 4) AS baseline_pct, round(({e.format(s='eng')} - {e.format(s='bl')}) * 100, 4) AS lift_pp FROM v_hits"
    for n, e in _METRICS))
def _(spark, sf):
    return ev.hit_rates(_hits(M(spark, sf)))


# the list as the lines before the holdout alone give it: every subquery of the list again, over those lines
past("v_recs", "p_", {"v_sales": "SELECT * FROM v_sales WHERE order_date <= (SELECT d FROM v_cut)"})
cte("p_hits", CTES["v_hits"].replace("v_recs", "p_recs"))


@query("m4_hit_rates_without_leak", " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round({e.format(s='eng')} * 100, 4) AS engine_pct, round({e.format(s='bl')} * 100, 4) AS baseline_pct, round(({e.format(s='eng')} - {e.format(s='bl')}) * 100, 4) AS lift_pp FROM p_hits"
    for n, e in _METRICS))
def _(spark, sf):
    """The list is rebuilt from the lines before the holdout only."""
    m = M(spark, sf)
    past = m.before_holdout(P)
    return ev.hit_rates(ev.hits_per_customer(
        past.recommendations(), ev.holdout_purchases(m.sales, P), ev.popularity_baseline(m.sales, m.items, P), m.items))


def _by_sql(dim, src):
    return f"""SELECT '{dim}' AS dimension, {dim} AS value, count(*) AS n_customers, round(avg(CASE WHEN eng_items_hits > 0 THEN 1 ELSE 0 END) * 100, 4) AS strict_hit_pct,
  round(avg(CASE WHEN eng_families_hits > 0 THEN 1 ELSE 0 END) * 100, 4) AS family_hit_pct, round(avg(CASE WHEN eng_categories_hits > 0 THEN 1 ELSE 0 END) * 100, 4) AS category_hit_pct
FROM v_hits h JOIN {src} g ON g.cust_id = h.cust_id GROUP BY {dim}"""


@query("m5_hit_rate_by_status_and_size", _by_sql("status", "v_status") + " UNION ALL " + _by_sql("size_tier", "v_segments"))
def _(spark, sf):
    m = M(spark, sf)
    per = _hits(m)
    status = m.patterns.select("cust_id", cu.lifecycle_status().alias("status"))
    return ev.hit_rate_by(per, status, "status").unionByName(ev.hit_rate_by(per, m.segments, "size_tier"))


@query("m5_hit_rate_by_signal", """
SELECT primary_signal, count(*) AS n_recs, count(h.item_id) AS n_hits, round(count(h.item_id) / count(*) * 100, 4) AS hit_pct FROM v_recs r LEFT JOIN v_hold h ON h.cust_id = r.cust_id AND h.item_id = r.item_id
WHERE r.cust_id IN (SELECT cust_id FROM v_hold) GROUP BY 1""")
def _(spark, sf):
    m = M(spark, sf)
    return ev.hit_rate_by_signal(m.recommendations(), ev.holdout_purchases(m.sales, P))


@query("m6_stratified_sample", f"""
WITH p AS (SELECT cust_id, size_tier, status, md5(CAST(cust_id AS VARCHAR) || '-42') AS h FROM v_status), c AS (SELECT size_tier, status, count(*) AS n FROM p GROUP BY 1, 2),
w AS (SELECT *, least(greatest(2, {P.carts} // (SELECT count(*) FROM c)), n) AS w FROM c),
t AS (SELECT *, greatest(0, least(w, {P.carts} - coalesce(sum(w) OVER (ORDER BY size_tier, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM w),
f AS (SELECT cust_id, size_tier, status FROM (SELECT p.*, take, row_number() OVER (PARTITION BY p.size_tier, p.status ORDER BY h, cust_id) AS r FROM p JOIN t ON t.size_tier = p.size_tier AND t.status = p.status) WHERE r <= take)
SELECT * FROM f UNION ALL (SELECT cust_id, size_tier, status FROM (SELECT *, row_number() OVER (ORDER BY h, cust_id) AS r FROM p WHERE cust_id NOT IN (SELECT cust_id FROM f))
WHERE r <= {P.carts} - (SELECT sum(take) FROM t))""")
def _(spark, sf):
    m = M(spark, sf)
    c = m.patterns.select("cust_id", "size_tier", cu.lifecycle_status().alias("status"))
    return ev.stratified_sample(c, ["size_tier", "status"], P.carts)


cte("v_lastcart", f"""
SELECT * FROM (SELECT cust_id, item_id, order_date, line_amount, row_number() OVER (PARTITION BY cust_id ORDER BY line_amount DESC, item_id) AS cart_line FROM (
  SELECT cust_id, item_id, order_date, round(sum(amount), 2) AS line_amount FROM v_sales s WHERE amount > 0 AND order_date = (SELECT max(order_date) FROM v_sales x WHERE x.cust_id = s.cust_id AND amount > 0)
  GROUP BY 1, 2, 3)) WHERE cart_line <= {P.cart_lines}""")


@query("m7_last_order_as_cart", "SELECT * FROM v_lastcart")
def _(spark, sf):
    return ev.last_order_as_cart(M(spark, sf).sales, P.cart_lines)


def _comp(cart):
    return comp_sql(cart, 5).replace("FROM v_lastcart c JOIN v_both", f"FROM v_lastcart c JOIN (SELECT * FROM v_both WHERE lift >= {P.cart_lift} AND support_ab >= {d.PAIRS.min_support})")


cte("v_backtest", f"""
SELECT k.cust_id, cart_size, coalesce(n_complements, 0) AS n_complements, category_alignment, house_brand_rate, avg_lift, coalesce(u.n, 0) AS n_upgrades, coalesce(v.n, 0) AS n_conversions
FROM (SELECT cust_id, count(*) AS cart_size FROM v_lastcart GROUP BY 1) k LEFT JOIN (
  SELECT c.cust_id, count(*) AS n_complements, round(avg(CASE WHEN EXISTS (SELECT 1 FROM v_lastcart l JOIN v_items j ON j.item_id = l.item_id WHERE l.cust_id = c.cust_id AND j.category = i.category)
    THEN 1 ELSE 0 END), 6) AS category_alignment, round(avg(is_private_brand), 6) AS house_brand_rate, {half_up('avg(lift)', 4)} AS avg_lift
  FROM ({_comp('v_lastcart')}) c LEFT JOIN v_items i ON i.item_id = c.item_id GROUP BY 1) x ON x.cust_id = k.cust_id
LEFT JOIN (SELECT cust_id, count(*) AS n FROM ({swap_sql('v_lastcart', 'private_brand_upgrade', 3, True)}) GROUP BY 1) u ON u.cust_id = k.cust_id
LEFT JOIN (SELECT cust_id, count(*) AS n FROM ({swap_sql('v_lastcart', 'competitor_conversion', 3, False)}) GROUP BY 1) v ON v.cust_id = k.cust_id""")


def _backtest(m):
    from dataclasses import replace
    return ev.cart_backtest(ev.last_order_as_cart(m.sales, P.cart_lines), m.product_pairs, m.equivalents, m.items,
                            replace(P, cart_support=d.PAIRS.min_support))


@query("m8_cart_backtest", "SELECT * FROM v_backtest")
def _(spark, sf):
    return _backtest(M(spark, sf))


_ROLL = """count(*) AS n_carts, round(avg(CASE WHEN n_complements > 0 THEN 1 ELSE 0 END) * 100, 4) AS complements_trigger_pct, round(avg(CASE WHEN n_upgrades > 0 THEN 1 ELSE 0 END) * 100, 4) AS upgrades_trigger_pct,
  round(avg(CASE WHEN n_conversions > 0 THEN 1 ELSE 0 END) * 100, 4) AS conversions_trigger_pct, round(avg(category_alignment) * 100, 4) AS category_alignment_pct, round(avg(house_brand_rate) * 100, 4) AS house_brand_pct,
  round(avg(avg_lift), 4) AS avg_lift"""


@query("m8_cart_backtest_summary", f"SELECT {_ROLL} FROM v_backtest")
def _(spark, sf):
    return ev.backtest_rollup(_backtest(M(spark, sf)))


@query("m12_cart_backtest_by_size", f"SELECT size_tier, {_ROLL} FROM v_backtest b JOIN v_segments s ON s.cust_id = b.cust_id GROUP BY 1")
def _(spark, sf):
    m = M(spark, sf)
    return ev.backtest_rollup(_backtest(m), m.segments, "size_tier")


@query("m12_cart_backtest_by_status", f"SELECT status, {_ROLL} FROM v_backtest b JOIN v_status s ON s.cust_id = b.cust_id GROUP BY 1")
def _(spark, sf):
    m = M(spark, sf)
    return ev.backtest_rollup(_backtest(m), m.patterns.select("cust_id", cu.lifecycle_status().alias("status")), "status")


@query("m12_business_shares", " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(sum(is_house_brand) AS BIGINT) AS n_house_brand, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM v_recs GROUP BY {c}"
    for c in ("rec_purpose", "primary_signal", "is_house_brand")))
def _(spark, sf):
    recs = M(spark, sf).recommendations()
    return ev.union([cb.share_by(recs, c) for c in ("rec_purpose", "primary_signal", "is_house_brand")])


@query("m9_recent_orders", """
WITH l AS (SELECT cust_id, item_id, qty, amount, order_date, CAST(strftime(order_date, '%Y%W') AS INTEGER) AS order_week FROM v_sales WHERE amount > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY d DESC, order_week DESC) AS recency_rank FROM (
  SELECT cust_id, order_week, max(order_date) AS d, count(*) AS line_count, round(sum(amount), 2) AS order_total FROM l GROUP BY 1, 2))
SELECT l.*, line_count, order_total, recency_rank FROM l JOIN w ON w.cust_id = l.cust_id AND w.order_week = l.order_week WHERE recency_rank <= 3""")
def _(spark, sf):
    return ev.recent_orders(M(spark, sf).sales, 3)


def _branch(kind, src, a, b, m, lo):
    return f"""
SELECT cust_id, item_id, trigger_item, strength, position, '{kind}' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY strength DESC, item_id) AS position FROM (
  SELECT c.cust_id, {b} AS item_id, c.item_id AS trigger_item, {m} AS strength, row_number() OVER (PARTITION BY c.cust_id, {b} ORDER BY {m} DESC, c.item_id) AS k
  FROM v_lastcart c JOIN {src} ON {a} = c.item_id WHERE {m} >= {lo} AND NOT EXISTS (SELECT 1 FROM v_lastcart x WHERE x.cust_id = c.cust_id AND x.item_id = {b})
    AND NOT EXISTS (SELECT 1 FROM v_history h WHERE h.cust_id = c.cust_id AND h.item_id = {b})) WHERE k = 1) WHERE position <= 5"""


@query("m10_cart_recs_from_history", _branch("cart_complement", "v_pp", "product_a", "product_b", "lift", 2.0) + " UNION ALL "
       + _branch("item_similarity", "v_sim", "item_a", "item_b", "similarity", 0.1))
def _(spark, sf):
    m = M(spark, sf)
    return ev.cart_recs_from_history(ev.last_order_as_cart(m.sales, P.cart_lines), m.history, m.product_pairs, m.similarity, 2.0, 0.1, 5)


def _overlap(c):
    return (f"(SELECT cust_id, {half_up('avg(CASE WHEN o THEN 1 ELSE 0 END) * 100', 1)} AS p FROM (SELECT DISTINCT r.cust_id, r.{c}, EXISTS (SELECT 1 FROM v_history h JOIN v_items i ON i.item_id = h.item_id "
            f"WHERE h.cust_id = r.cust_id AND i.{c} = r.{c}) AS o FROM v_recs r) GROUP BY 1)")


@query("m11_rec_quality", f"""
SELECT q.*, f.p AS family_overlap_pct, c.p AS category_overlap_pct, coalesce(n_history, 0) AS n_history,
  CASE WHEN coalesce(n_history, 0) >= 10 AND n_mismatch > 0 AND coalesce(is_cold_start, 1) = 0 THEN 1 ELSE 0 END AS specialty_breach FROM (
  SELECT cust_id, count(DISTINCT family) AS n_families, count(DISTINCT primary_signal) AS n_signals, count(DISTINCT rec_purpose) AS n_purposes, CAST(sum(is_house_brand) AS BIGINT) AS n_house_brand,
    count(*) FILTER (primary_signal = 'replenishment') AS n_replenishment, count(*) FILTER (specialty_match = 'match') AS n_match, count(*) FILTER (specialty_match = 'mismatch') AS n_mismatch
  FROM v_recs GROUP BY 1) q JOIN {_overlap('family')} f ON f.cust_id = q.cust_id JOIN {_overlap('category')} c ON c.cust_id = q.cust_id
LEFT JOIN (SELECT cust_id, count(*) AS n_history FROM v_history GROUP BY 1) h ON h.cust_id = q.cust_id LEFT JOIN v_patterns p ON p.cust_id = q.cust_id""")
def _(spark, sf):
    m = M(spark, sf)
    return ev.rec_quality(m.recommendations(), m.history, m.items, m.patterns)
