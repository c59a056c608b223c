"""Recommendation signals and their combination."""

from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..operators import combine as cb
from ..operators import signals as sg
from ..params import BACKFILL_SIGNALS, SIGNAL_PURPOSE, SIGNAL_QUOTA, SIGNALS, SIZE_TIERS
from ..plans import driver_tables as d
from ..plans.model import Model
from . import pairs  # noqa: F401  (its subqueries)
from .base_sql import words
from .registry import cte, half_up, query

M = Model.from_folder
E = d.ENGINE
MK = (*d.MARKETS, "OTHER")

cte("v_profile", """
SELECT g.cust_id, g.segment, g.market_clean, g.size_tier, coalesce(specialty, 'UNKNOWN') AS specialty, coalesce(affordability_ceiling, 0) AS affordability_ceiling,
  coalesce(is_cold_start, 1) AS is_cold_start, coalesce(is_churned, 0) AS is_churned, coalesce(is_declining, 0) AS is_declining,
  coalesce(order_cadence_tier, 'no_data') AS order_cadence_tier, coalesce(n_unique_products_total, 0) AS n_unique_products_total
FROM v_segments g LEFT JOIN v_features f ON g.cust_id = f.cust_id LEFT JOIN v_patterns p ON g.cust_id = p.cust_id""")
cte("v_history", "SELECT cust_id, item_id, round(sum(amount), 2) AS total_spend, count(*) AS n_lines FROM v_merged WHERE amount > 0 GROUP BY 1, 2")
cte("v_ep", f"""
SELECT *, round(ln(1 + n_buyers) * ln(1 + recent_buyer_count_6mo), 6) AS popularity_score FROM v_pf WHERE is_discontinued = 0 AND n_buyers >= {E.min_buyers}
  AND (months_since_last_buyer <= {E.recency_months} OR months_since_last_buyer IS NULL OR months_since_last_buyer < 0) AND item_dsc IS NOT NULL""")


def _scored(signal, candidates, base, private, life, boost, tier, k, peer="0.0", anti=True, order="", where="true", extra=""):
    """candidates: rows (cust_id, item_id, ...); joins profile and product, filters, scores, keeps k."""
    bought = "AND NOT EXISTS (SELECT 1 FROM v_history h WHERE h.cust_id = c.cust_id AND h.item_id = c.item_id)" if anti else ""
    return f"""
SELECT cust_id, item_id, '{signal}' AS primary_signal, confidence_tier, numeric_score, peer_adoption_rate, specialty_match FROM (
  SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY numeric_score DESC, item_id {order}) AS k FROM (
    SELECT *, {half_up(f'{base} + {private} + {life} + {boost}', 6)} AS numeric_score, {tier} AS confidence_tier, CAST({peer} AS DOUBLE) AS peer_adoption_rate FROM (
      SELECT *, CASE specialty_match WHEN 'match' THEN {E.match_boost} WHEN 'mismatch' THEN {E.mismatch_penalty} ELSE 1.0 END AS mult FROM (
        SELECT c.*, p.specialty, p.is_declining, p.is_churned, e.n_buyers, e.is_private_brand,
          CASE WHEN p.specialty IN (s.top_specialty_1, s.top_specialty_2, s.top_specialty_3, s.top_specialty_4, s.top_specialty_5) THEN 'match'
            WHEN coalesce(specialty_hhi, 0) >= {E.universal_hhi} AND p.specialty <> 'UNKNOWN' THEN 'mismatch' ELSE 'neutral' END AS specialty_match
        FROM ({candidates}) c JOIN v_profile p ON p.cust_id = c.cust_id JOIN v_ep e ON e.item_id = c.item_id LEFT JOIN v_pspec s ON s.item_id = c.item_id
        WHERE {where} AND buyer_affordability_p10 <= greatest(affordability_ceiling, {E.ceiling_floor}) * {E.grace} {bought})))) WHERE k <= {k}"""


PB3, PB5 = "is_private_brand * 0.3", "is_private_brand * 0.5"
DEC = "is_declining * {}"
DECCH = "(is_declining * 0.5 + is_churned * 0.7)"


def _tier(high):
    return f"CASE WHEN {high} THEN 'high' WHEN specialty_match = 'mismatch' THEN 'low' ELSE 'medium' END"


SQL = {}
SQL["peer_gap"] = _scored("peer_gap", f"""
  SELECT q.cust_id, t.item_id, adoption_rate FROM v_profile q JOIN v_fam_profile f ON f.segment = q.segment AND adoption_rate >= {E.peer_adoption}
  JOIN (SELECT * FROM (SELECT item_id, family, row_number() OVER (PARTITION BY family ORDER BY popularity_score DESC, item_id) AS fr FROM v_ep) WHERE fr <= {E.family_pool}) t
    ON t.family = f.family WHERE q.is_cold_start = 0""", "adoption_rate * ln(1 + n_buyers) * mult", PB5, DEC.format(0.3), 0.0,
    _tier("specialty_match = 'match' AND adoption_rate >= 0.5"), E.per_signal, "adoption_rate")
_UNM = " UNION ALL ".join(f"SELECT item_id, popularity_score, '{m}' AS market_clean, pct_buyers_{m} AS ms FROM v_ep" for m in MK)
_UNS = " UNION ALL ".join(f"SELECT item_id, '{s}' AS size_tier, pct_buyers_{s} AS ss FROM v_ep" for s in SIZE_TIERS)
cte("v_pool", f"""
SELECT market_clean, size_tier, item_id, popularity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY market_clean, size_tier ORDER BY popularity_score DESC, item_id) AS r FROM (
    SELECT *, min(lvl) OVER (PARTITION BY market_clean, size_tier) AS best FROM (
      SELECT c.market_clean, c.size_tier, m.item_id, m.popularity_score,
        CASE WHEN ms >= {E.market_share} AND ss >= {E.size_share} THEN 1 WHEN ms >= {E.market_share} THEN 2 ELSE 3 END AS lvl
      FROM (SELECT DISTINCT market_clean, size_tier FROM v_profile WHERE is_cold_start = 1) c JOIN ({_UNM}) m ON m.market_clean = c.market_clean
      JOIN ({_UNS}) z ON z.size_tier = c.size_tier AND z.item_id = m.item_id)) WHERE lvl <= best) WHERE r <= {E.pool}""")
SQL["popularity"] = _scored("popularity", """
  SELECT q.cust_id, t.item_id, t.popularity_score FROM v_profile q JOIN v_pool t ON t.market_clean = q.market_clean AND t.size_tier = q.size_tier
  WHERE q.is_cold_start = 1""", "popularity_score", PB3, "CASE WHEN specialty_match = 'match' THEN 0.5 ELSE 0 END", 0.0, "'medium'", E.per_signal)


def _hist(k):
    return f"""(SELECT * FROM (SELECT h.cust_id, h.item_id, row_number() OVER (PARTITION BY h.cust_id ORDER BY total_spend DESC, h.item_id) AS sr
    FROM v_history h JOIN v_profile w ON w.cust_id = h.cust_id WHERE w.is_cold_start = 0) WHERE sr <= {k})"""


SQL["cart_complement"] = _scored("cart_complement", f"""
  SELECT cust_id, product_b AS item_id, max(lift) AS lift FROM {_hist(E.cart_history)} JOIN v_pp ON product_a = item_id AND lift >= {E.cart_lift} GROUP BY 1, 2""",
    "ln(1 + lift) * 2.0 * mult", PB3, DEC.format(0.2), 0.5, _tier("lift >= 5.0"), E.cart_top)
SQL["item_similarity"] = _scored("item_similarity", f"""
  SELECT cust_id, item_b AS item_id, max(similarity) AS similarity FROM {_hist(E.sim_history)} JOIN v_sim ON item_a = item_id AND similarity >= {E.sim_min} GROUP BY 1, 2""",
    "similarity * 5.0 * mult", PB3, DEC.format(0.2), 0.3, _tier("similarity >= 0.30"), E.sim_top)
SQL["lapsed_recovery"] = _scored("lapsed_recovery", f"SELECT cust_id, item_id, total_qty FROM v_lapsed WHERE total_qty >= {E.lapsed_qty}",
    "ln(1 + total_qty) * 2.0 * mult", PB3, DECCH, 0.7, _tier("is_declining = 1 OR is_churned = 1"), E.lapsed_top, anti=False)
SQL["replenishment"] = _scored("replenishment", "SELECT cust_id, item_id, overdue_ratio, peer_activity_rate FROM v_repl",
    f"ln(1 + least(overdue_ratio, {E.overdue_cap})) * (1.0 + peer_activity_rate) * 3.0 * mult", PB3, DECCH, 0.6,
    _tier("overdue_ratio BETWEEN 1.5 AND 3.0 AND peer_activity_rate >= 0.5"), E.repl_top, "peer_activity_rate", anti=False)
_SWAP = """SELECT h.cust_id, equivalent_item AS item_id, original_item, price_delta_pct, original_price, equivalent_price
  FROM v_history h JOIN v_equiv q ON q.original_item = h.item_id WHERE match_type = '{}' AND price_anomaly = 0"""
SQL["competitor_conversion"] = _scored("competitor_conversion", _SWAP.format("competitor_conversion"), "3.0 * mult", PB3, DEC.format(0.2), 0.8,
    "'high'", E.swap_top, order=", original_item")
SQL["private_brand_upgrade"] = _scored("private_brand_upgrade", _SWAP.format("private_brand_upgrade"),
    "(greatest(-price_delta_pct, 0) * 5.0 + 1.0) * (1.0 + ln(1 + least(greatest(original_price - equivalent_price, 0), 50))) * mult", "0.5", DEC.format(0.2), 0.5,
    _tier("greatest(-price_delta_pct, 0) >= 0.20"), E.swap_top, order=", original_item")
for _s in SIGNALS:
    cte(f"v_sig_{_s}", SQL[_s])
cte("v_cand", " UNION ALL ".join(f"SELECT * FROM v_sig_{s}" for s in SIGNALS))
_ORD = "CASE primary_signal " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SIGNALS)) + " END"
_QUO = "CASE primary_signal " + " ".join(f"WHEN '{s}' THEN {q}" for s, q in SIGNAL_QUOTA.items()) + " END"
_PUR = "CASE primary_signal " + " ".join(f"WHEN '{s}' THEN '{q}'" for s, q in SIGNAL_PURPOSE.items()) + " END"
cte("v_kept", f"""
SELECT c.* FROM v_cand c JOIN v_profile p USING (cust_id) WHERE NOT (n_unique_products_total >= {E.mismatch_history} AND specialty_match = 'mismatch')""")
cte("v_uniq", f"""
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY cust_id, item_id ORDER BY numeric_score DESC, {_ORD}) AS k FROM v_kept) WHERE k = 1""")
cte("v_norm", """
SELECT *, round((rank() OVER (PARTITION BY primary_signal ORDER BY numeric_score) + (count(*) OVER (PARTITION BY primary_signal, numeric_score) - 1) / 2)
  / count(*) OVER (PARTITION BY primary_signal), 9) AS normalized_score FROM v_uniq""")
cte("v_quota", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY normalized_score DESC, item_id) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY cust_id, primary_signal ORDER BY numeric_score DESC, item_id) AS w FROM v_norm) WHERE w <= {_QUO}) WHERE r <= {E.top_n}""")
cte("v_fill", f"""
SELECT b.* FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY normalized_score DESC, item_id) AS br FROM v_norm n
  WHERE primary_signal IN ({words(BACKFILL_SIGNALS)}) AND NOT EXISTS (SELECT 1 FROM v_quota q WHERE q.cust_id = n.cust_id AND q.item_id = n.item_id)) b
JOIN (SELECT cust_id, {E.top_n} - count(*) AS slots FROM v_quota GROUP BY 1) s ON s.cust_id = b.cust_id WHERE br <= slots""")
_C = "cust_id, item_id, primary_signal, confidence_tier, numeric_score, peer_adoption_rate, specialty_match, normalized_score"
cte("v_final", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY normalized_score DESC, item_id) AS rank FROM (
  SELECT {_C} FROM v_quota UNION ALL SELECT {_C} FROM v_fill)) WHERE rank <= {E.top_n}""")
_PCT = "CAST(CAST(round(peer_adoption_rate * 100, 0) AS INTEGER) AS VARCHAR)"
cte("v_recs", f"""
SELECT r.cust_id, r.item_id, item_dsc, family, category, rank, primary_signal, {_PUR} AS rec_purpose, is_private_brand AS is_house_brand,
  CASE primary_signal WHEN 'peer_gap' THEN family || ' is missing from the orders, while ' || {_PCT} || '% of ' || segment || ' accounts order it.'
    WHEN 'popularity' THEN 'Best seller for ' || segment || ' accounts: ' || format('{{:,}}', n_buyers) || ' of them order it, which suits a new account.'
    WHEN 'cart_complement' THEN 'Often in one basket with items of this account, from ' || family || '.'
    WHEN 'item_similarity' THEN 'Bought by the same accounts as items in the order history, from ' || family || '.'
    WHEN 'lapsed_recovery' THEN 'Ordered earlier, not in the last half year, from ' || family || '.'
    WHEN 'replenishment' THEN 'Next order is overdue by the account''s rhythm; ' || {_PCT} || '% of comparable accounts still reorder it.'
    WHEN 'competitor_conversion' THEN 'House Brand counterpart of a competitor item in the history, from ' || family || '.'
    ELSE 'House Brand counterpart of a branded item in the history, at the same price or less.' END
  || CASE specialty_match WHEN 'match' THEN ' Fits ' || specialty || '.' WHEN 'mismatch' THEN ' Mostly ordered by other specialties.' ELSE '' END AS pitch_reason,
  confidence_tier, numeric_score, normalized_score, peer_adoption_rate, specialty_match, median_unit_price, median_purchases_per_buyer_per_year, is_private_brand,
  segment, size_tier, market_clean, specialty, CASE WHEN primary_signal = 'popularity' THEN 0 ELSE is_declining END AS is_declining,
  CASE WHEN primary_signal = 'popularity' THEN 0 ELSE is_churned END AS is_churned,
  CASE WHEN primary_signal = 'popularity' THEN 'no_data' ELSE order_cadence_tier END AS order_cadence_tier
FROM v_final r JOIN v_profile p ON p.cust_id = r.cust_id JOIN v_pf f ON f.item_id = r.item_id""")


@query("i1_customer_profile", "SELECT * FROM v_profile")
def _(spark, sf):
    m = M(spark, sf)
    return sg.customer_profile(m.segments, m.features, m.patterns)


@query("i2_purchase_history", "SELECT * FROM v_history")
def _(spark, sf):
    return sg.purchase_history(M(spark, sf).sales)


@query("i3_eligible_products", "SELECT item_id, n_buyers, months_since_last_buyer FROM v_ep")
def _(spark, sf):
    return sg.eligible_products(M(spark, sf).product_features, E).select("item_id", "n_buyers", "months_since_last_buyer")


@query("i4_specialty_match", f"""
SELECT h.cust_id, h.item_id, CASE WHEN p.specialty IN (top_specialty_1, top_specialty_2, top_specialty_3, top_specialty_4, top_specialty_5) THEN 'match'
  WHEN coalesce(specialty_hhi, 0) >= {E.universal_hhi} AND p.specialty <> 'UNKNOWN' THEN 'mismatch' ELSE 'neutral' END AS specialty_match
FROM v_history h JOIN v_profile p ON p.cust_id = h.cust_id LEFT JOIN v_pspec s ON s.item_id = h.item_id""")
def _(spark, sf):
    m = M(spark, sf)
    c = m.history.select("cust_id", "item_id").join(m.profile.select("cust_id", "specialty"), "cust_id")
    return sg.specialty_match(c, m.product_specialty, E).select("cust_id", "item_id", "specialty_match")


@query("i5_affordability_filter", f"""
SELECT h.cust_id, h.item_id FROM v_history h JOIN v_profile p ON p.cust_id = h.cust_id JOIN v_ep e ON e.item_id = h.item_id
WHERE buyer_affordability_p10 <= greatest(affordability_ceiling, {E.ceiling_floor}) * {E.grace}""")
def _(spark, sf):
    m = M(spark, sf)
    c = m.history.join(m.profile.select("cust_id", "affordability_ceiling"), "cust_id").join(
        m.engine_products.select("item_id", "buyer_affordability_p10"), "item_id")
    return c.filter(sg.affordable(E)).select("cust_id", "item_id")


@query("c9_fan_out_join", f"""
SELECT q.cust_id, count(*) AS n_candidates FROM v_profile q JOIN v_fam_profile f ON f.segment = q.segment AND adoption_rate >= {E.peer_adoption}
JOIN (SELECT * FROM (SELECT item_id, family, row_number() OVER (PARTITION BY family ORDER BY popularity_score DESC, item_id) AS fr FROM v_ep) WHERE fr <= {E.family_pool}) t
  ON t.family = f.family GROUP BY 1""")
def _(spark, sf):
    m = M(spark, sf)
    fam = m.family_profile.filter(F.col("adoption_rate") >= E.peer_adoption).select("segment", "family")
    per = fam.join(sg.family_pool(m.engine_products, E.family_pool).select("family", "item_id"), "family")
    # all customers of a segment have its offers, so they are counted once
    per = per.groupBy("segment").agg(F.count(F.lit(1)).alias("n_candidates"))
    return salted_join(m.profile.select("cust_id", "segment"), per, ["segment"], ["cust_id"]).select("cust_id", "n_candidates")


def _signal_query(number, name):
    @query(f"i{number}_{name}", f"SELECT * FROM v_sig_{name}")
    def _(spark, sf):
        return M(spark, sf).signal(name)


for _i, _s in enumerate(("peer_gap", "popularity", "cart_complement", "item_similarity", "lapsed_recovery", "replenishment",
                         "competitor_conversion", "private_brand_upgrade"), 6):
    _signal_query(_i, _s)


@query("i14_confidence_tiers", "SELECT primary_signal, confidence_tier, count(*) AS n FROM v_cand GROUP BY 1, 2")
def _(spark, sf):
    return cb.union_signals(M(spark, sf).signals).groupBy("primary_signal", "confidence_tier").agg(F.count(F.lit(1)).alias("n"))


@query("i15_mismatch_filter", "SELECT cust_id, item_id, primary_signal FROM v_kept")
def _(spark, sf):
    m = M(spark, sf)
    return cb.mismatch_filter(cb.union_signals(m.signals), m.profile, E).select("cust_id", "item_id", "primary_signal")


def _unique(m):
    return cb.cross_signal_dedup(cb.mismatch_filter(cb.union_signals(m.signals), m.profile, E))


@query("i16_cross_signal_dedup", "SELECT cust_id, item_id, primary_signal, numeric_score FROM v_uniq")
def _(spark, sf):
    return _unique(M(spark, sf)).select("cust_id", "item_id", "primary_signal", "numeric_score")


@query("i17_normalise_scores", "SELECT cust_id, item_id, primary_signal, normalized_score FROM v_norm")
def _(spark, sf):
    from ..session import stage
    return cb.normalise_scores(stage(_unique(M(spark, sf)), "candidates")).select("cust_id", "item_id", "primary_signal", "normalized_score")


@query("i18_quota_select", "SELECT cust_id, item_id, primary_signal, normalized_score FROM v_quota")
def _(spark, sf):
    from ..session import stage
    marked = cb.quota_select(cb.normalise_scores(stage(_unique(M(spark, sf)), "candidates")), E)
    return marked.filter("selected = 1").select("cust_id", "item_id", "primary_signal", "normalized_score")


@query("i19_backfill", "SELECT cust_id, item_id, primary_signal, rank FROM v_final")
def _(spark, sf):
    m = M(spark, sf)
    return cb.combine(m.signals, m.profile, E).select("cust_id", "item_id", "primary_signal", "rank")


@query("i20_recommendations", "SELECT * FROM v_recs")
def _(spark, sf):
    return M(spark, sf).recommendations()


_DIM = " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, CAST(sum(is_house_brand) AS BIGINT) AS n_house_brand, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM v_recs GROUP BY {c}"
    for c in ("primary_signal", "rec_purpose", "confidence_tier", "specialty_match"))


@query("i21_rec_stats", _DIM)
def _(spark, sf):
    return cb.rec_stats(M(spark, sf).recommendations())


@query("i21_diversity_quantiles", "WITH p AS (SELECT cust_id, count(DISTINCT family) AS families, count(DISTINCT primary_signal) AS signals, count(DISTINCT rec_purpose) AS purposes FROM v_recs GROUP BY 1) "
       + " UNION ALL ".join(f"SELECT '{c}' AS measure, {half_up(f'quantile_cont({c}, 0.1)', 4)} AS p10, {half_up(f'quantile_cont({c}, 0.5)', 4)} AS p50, {half_up(f'quantile_cont({c}, 0.9)', 4)} AS p90 FROM p"
                            for c in ("families", "signals", "purposes")))
def _(spark, sf):
    return cb.diversity(M(spark, sf).recommendations())


@query("i21_house_brand_bands", """
SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' ELSE '7-10' END AS house_brand_recs, count(*) AS n_customers
FROM (SELECT cust_id, sum(is_house_brand) AS n FROM v_recs GROUP BY 1) GROUP BY 1""")
def _(spark, sf):
    return cb.brand_bands(M(spark, sf).recommendations())
