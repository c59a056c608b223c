"""The eight recommendation signals.

Every signal is candidates -> customer profile -> eligible products -> affordability ->
(not in history) -> specialty -> score -> best k per customer. Candidates carry ids and
score parts only; descriptions join after the final top-n. The number of candidates per
customer is bounded by the caps on history, partners and pool of each signal.

Offers that are the same for many customers (``peer_gap``, ``popularity``) are scored once per cell of customers and
walked from the best down: see ``walk``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import clip, half_up
from ..functions.skew import salted_join
from ..params import EngineParams
from ..session import stage

OUTPUT = ("cust_id", "item_id", "primary_signal", "confidence_tier", "numeric_score",
          "peer_adoption_rate", "specialty_match")


def customer_profile(segments: DataFrame, features: DataFrame, patterns: DataFrame) -> DataFrame:
    out = (segments.join(features.select("cust_id", "specialty", "affordability_ceiling"), "cust_id", "left")
           .join(patterns.select("cust_id", "is_cold_start", "is_churned", "is_declining", "order_cadence_tier",
                                 "n_unique_products_total"), "cust_id", "left"))
    return out.fillna({"is_cold_start": 1, "is_churned": 0, "is_declining": 0, "order_cadence_tier": "no_data",
                       "affordability_ceiling": 0.0, "specialty": "UNKNOWN", "n_unique_products_total": 0})


def purchase_history(merged: DataFrame) -> DataFrame:
    return merged.filter((F.col("amount") > 0) & F.col("cust_id").isNotNull() & F.col("item_id").isNotNull()).groupBy(
        "cust_id", "item_id").agg(F.round(F.sum("amount"), 2).alias("total_spend"), F.count(F.lit(1)).alias("n_lines"))


def eligible_products(features: DataFrame, p: EngineParams) -> DataFrame:
    months = F.col("months_since_last_buyer")
    return features.filter((F.col("is_discontinued") == 0) & (F.col("n_buyers") >= p.min_buyers)
                           & ((months <= p.recency_months) | months.isNull() | (months < 0))
                           & F.col("item_dsc").isNotNull())


def popularity() -> Column:
    return F.round(F.log1p("n_buyers") * F.log1p("recent_buyer_count_6mo"), 6)


def affordable(p: EngineParams) -> Column:
    return F.col("buyer_affordability_p10") <= F.greatest("affordability_ceiling", F.lit(p.ceiling_floor)) * p.grace


def drop_bought(candidates: DataFrame, history: DataFrame) -> DataFrame:
    return candidates.join(history.select("cust_id", "item_id"), ["cust_id", "item_id"], "left_anti")


def with_own_items(customers: DataFrame, history: DataFrame, pool: DataFrame) -> DataFrame:
    """Customers with the pool items they already buy as an array.

    The pool has a fixed number of items of every family, so the array is bounded by the catalogue and by
    what a customer has bought. It lets a join of customers with offers drop bought items in place.
    """
    own = history.select("cust_id", "item_id").join(pool.select("item_id"), "item_id", "left_semi").groupBy("cust_id").agg(
        F.collect_list("item_id").alias("own"))
    return customers.join(own, "cust_id", "left")


def not_own() -> Column:
    return ~F.coalesce(F.array_contains("own", F.col("item_id")), F.lit(False))


def specialty_match(candidates: DataFrame, specialty: DataFrame, p: EngineParams) -> DataFrame:
    tops = [f"top_specialty_{i}" for i in range(1, 6)]
    out = candidates.join(specialty.select("item_id", *tops, "specialty_hhi"), "item_id", "left")
    hit = F.lit(False)
    for t in tops:
        hit = hit | F.coalesce(F.col(t) == F.col("specialty"), F.lit(False))
    concentrated = (F.coalesce("specialty_hhi", F.lit(0.0)) >= p.universal_hhi) & (F.col("specialty") != "UNKNOWN")
    match = F.when(hit, "match").when(concentrated, "mismatch").otherwise("neutral")
    return out.withColumn("specialty_match", match).withColumn(
        "mult", F.when(F.col("specialty_match") == "match", p.match_boost)
        .when(F.col("specialty_match") == "mismatch", p.mismatch_penalty).otherwise(1.0)).drop(*tops, "specialty_hhi")


_PROFILE = ("cust_id", "segment", "market_clean", "size_tier", "specialty", "affordability_ceiling", "is_declining", "is_churned")
_PRODUCT = ("item_id", "n_buyers", "buyer_affordability_p10", "is_private_brand")


def _scored(candidates: DataFrame, signal: str, base: Column, private: Column | float, life: Column | float, boost: float,
            tier: Column, peer: Column | float = 0.0) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    out = candidates.withColumn("numeric_score", half_up(base + as_col(private) + as_col(life) + F.lit(boost), 6))
    return out.withColumns({"primary_signal": F.lit(signal), "confidence_tier": tier, "peer_adoption_rate": as_col(peer)})


def _best(scored: DataFrame, k: int, tie: Sequence[str] = ()) -> DataFrame:
    keep = scored.select(*OUTPUT, *[t for t in tie if t not in OUTPUT])
    return rk.top_k(keep, ["cust_id"], [F.desc("numeric_score"), "item_id", *tie], k).select(*OUTPUT)


def _finish(candidates: DataFrame, signal: str, base: Column, private: Column | float, life: Column | float,
            boost: float, tier: Column, k: int, peer: Column | float = 0.0, tie: Sequence[str] = ()) -> DataFrame:
    """Score, keep the best k per customer, and give the rows the common columns."""
    return _best(_scored(candidates, signal, base, private, life, boost, tier, peer), k, tie)


_OFFER = ("item_id", "primary_signal", "confidence_tier", "numeric_score", "peer_adoption_rate", "specialty_match")


def _reach(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The offers of a cell that are among the first ``wanted`` affordable ones for some limit, best first, each with
    the limits for which it is: from its price up to the price at which as many better offers are affordable."""
    pdf = pdf.sort_values(["numeric_score", "item_id"], ascending=[False, True], kind="stable")
    wanted = k << int(pdf["_class"].iloc[0])
    cheapest: list[float] = []  # negated prices of the ``wanted`` cheapest offers so far
    keep, until = [], []
    for price in pdf["_price"].tolist():
        bound = -cheapest[0] if len(cheapest) == wanted else math.inf
        keep.append(price < bound)
        until.append(bound)
        if len(cheapest) < wanted:
            heapq.heappush(cheapest, -price)
        elif price < bound:
            heapq.heapreplace(cheapest, -price)
    return pdf.assign(_until=until)[keep]


def walk(customers: DataFrame, offers: DataFrame, cell: Sequence[str], k: int, p: EngineParams) -> DataFrame:
    """The best k affordable offers of their cell for customers, without those they buy.

    ``customers`` holds cust_id, the cell, affordability_ceiling and ``own`` and is a stored table; ``offers`` holds the cell and scored offers, whose score
    is the same for all customers of the cell. Offers are sorted once a cell. What a customer can see of that order
    depends on their limit alone: an offer counts from its price on, until k better ones are affordable. So each
    offer carries an interval of limits, offers with an empty one go, and a customer meets only the k offers whose interval
    holds their limit (k twice or more for those who buy some of them, by powers of two), not all of the cell.
    """
    limit = F.greatest("affordability_ceiling", F.lit(p.ceiling_floor)) * p.grace
    needed = (k + F.greatest(F.size("own"), F.lit(0))) / k
    asked = customers.select("cust_id", *cell, "own", limit.alias("_limit"), F.ceil(F.log2(needed)).cast("int").alias("_class"))
    cells = asked.select(*cell, "_class").distinct()
    priced = offers.withColumn("_price", F.col("buyer_affordability_p10").cast("double")).filter(F.col("_price").isNotNull())
    rows = cells.join(priced.select(*cell, "_price", *_OFFER), list(cell))
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in rows.columns) + ", _until double"
    reach = rows.groupBy(*cell, "_class").applyInPandas(lambda pdf: _reach(pdf, k), schema)
    seen = salted_join(asked, reach, [*cell, "_class"], ["cust_id"]).filter(
        (F.col("_price") <= F.col("_limit")) & (F.col("_limit") < F.col("_until")))
    return _best(seen.filter(not_own()), k)


def _private(weight: float) -> Column:
    return F.coalesce("is_private_brand", F.lit(0)) * weight


def _dec(weight: float) -> Column:
    return F.col("is_declining") * weight


def _dec_churn() -> Column:
    return F.col("is_declining") * 0.5 + F.col("is_churned") * 0.7


def _tier(high: Column) -> Column:
    return F.when(high, "high").when(F.col("specialty_match") == "mismatch", "low").otherwise("medium")


def family_pool(products: DataFrame, k: int) -> DataFrame:
    """Most popular k products of every family."""
    return rk.top_k(products.withColumn("popularity_score", popularity()), ["family"],
                    [F.desc("popularity_score"), "item_id"], k, "family_rank")


def peer_gap(profile: DataFrame, family_profile: DataFrame, products: DataFrame, specialty: DataFrame,
             history: DataFrame, p: EngineParams) -> DataFrame:
    families = family_profile.filter(F.col("adoption_rate") >= p.peer_adoption).select("segment", "family", "adoption_rate")
    pool = family_pool(products, p.family_pool).select(*_PRODUCT, "family")
    # segment x family x product is catalogue-sized
    offers = families.join(pool, "family").drop("family")
    warm = stage(with_own_items(profile.filter("is_cold_start = 0").select(*_PROFILE), history, pool), "warm")
    cell = ("segment", "specialty", "is_declining")
    c = specialty_match(warm.select(*cell).distinct().join(offers, "segment"), specialty, p)
    c = _scored(c, "peer_gap", F.col("adoption_rate") * F.log1p("n_buyers") * F.col("mult"), _private(0.5), _dec(0.3), 0.0,
                _tier((F.col("specialty_match") == "match") & (F.col("adoption_rate") >= 0.5)), F.col("adoption_rate"))
    return walk(warm, c, cell, p.per_signal, p)


def cold_start_pool(cells: DataFrame, products: DataFrame, markets: Sequence[str], sizes: Sequence[str],
                    p: EngineParams) -> DataFrame:
    """Top products per (market, size) cell from the strictest non-empty pool.

    Pool 1 needs the market and the size share, pool 2 the market share, pool 3 nothing.
    A cell sees the products of its strictest pool only.
    """
    def long(prefix: Sequence[str], name: str, share: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(f"pct_buyers_{v}").alias(share)) for v in prefix])
        return products.withColumn("popularity_score", popularity()).select("item_id", "popularity_score", F.inline(pairs))
    cells = cells.filter(F.col("market_clean").isin(*markets) & F.col("size_tier").isin(*sizes))
    by_market = long(markets, "market_clean", "market_share").filter(F.col("market_share") >= p.market_share)
    by_size = long(sizes, "size_tier", "size_share").filter(F.col("size_share") >= p.size_share)
    # each pool shrinks to its best rows before it meets the cells
    two = by_market.join(by_size.select("item_id", "size_tier"), "item_id")
    best = [F.desc("popularity_score"), "item_id"]
    level1 = rk.top_k(two, ["market_clean", "size_tier"], best, p.pool).select("market_clean", "size_tier", "item_id", "popularity_score")
    level2 = rk.top_k(by_market, ["market_clean"], best, p.pool).select("market_clean", "item_id", "popularity_score")
    level3 = products.withColumn("popularity_score", popularity()).orderBy(*best).limit(p.pool).agg(
        F.collect_list(F.struct("item_id", "popularity_score")).alias("rows")).scalar()  # at most p.pool entries
    keys = ["market_clean", "size_tier"]
    got1 = cells.join(level1, keys)
    rest = cells.join(level1.select(*keys), keys, "left_anti")
    got2 = rest.join(level2, "market_clean")
    last = rest.join(level2.select("market_clean"), "market_clean", "left_anti")
    got3 = last.withColumn("_rows", level3).select(*keys, F.inline("_rows"))
    cols = [*keys, "item_id", "popularity_score"]
    return got1.select(*cols).unionByName(got2.select(*cols)).unionByName(got3.select(*cols))


def popularity_recs(profile: DataFrame, products: DataFrame, specialty: DataFrame, history: DataFrame,
                    markets: Sequence[str], sizes: Sequence[str], p: EngineParams) -> DataFrame:
    cold = profile.filter("is_cold_start = 1").select(*_PROFILE)
    pool = cold_start_pool(cold.select("market_clean", "size_tier").distinct(), products, markets, sizes, p)
    offers = pool.join(products.select(*_PRODUCT), "item_id")
    cold = stage(with_own_items(cold, history, pool.select("item_id").distinct()), "cold")
    cell = ("market_clean", "size_tier", "specialty")
    c = specialty_match(cold.select(*cell).distinct().join(offers, ["market_clean", "size_tier"]), specialty, p)
    match = F.when(F.col("specialty_match") == "match", 0.5).otherwise(0.0)
    c = _scored(c, "popularity", F.col("popularity_score"), _private(0.3), match, 0.0, F.lit("medium"))
    return walk(cold, c, cell, p.per_signal, p)


def top_history(history: DataFrame, k: int) -> DataFrame:
    return rk.top_k(history, ["cust_id"], [F.desc("total_spend"), "item_id"], k, "spend_rank").select("cust_id", "item_id")


def _partners(history: DataFrame, pairs: DataFrame, source: str, target: str, measure: str) -> DataFrame:
    """Best pair value per (customer, partner item)."""
    return history.join(pairs.select(F.col(source).alias("item_id"), F.col(target).alias("_to"), measure), "item_id").groupBy(
        "cust_id", F.col("_to").alias("item_id")).agg(F.max(measure).alias(measure))


def _candidates(c: DataFrame, profile: DataFrame, products: DataFrame, p: EngineParams) -> DataFrame:
    return c.join(profile.select(*_PROFILE), "cust_id").join(products.select(*_PRODUCT), "item_id").filter(affordable(p))


def cart_complement(profile: DataFrame, pairs: DataFrame, products: DataFrame, specialty: DataFrame,
                    history: DataFrame, p: EngineParams) -> DataFrame:
    warm = profile.filter("is_cold_start = 0")
    mine = top_history(history.join(warm.select("cust_id"), "cust_id", "left_semi"), p.cart_history)
    c = _partners(mine, pairs.filter(F.col("lift") >= p.cart_lift), "product_a", "product_b", "lift")
    c = specialty_match(drop_bought(_candidates(c, warm, products, p), history), specialty, p)
    return _finish(c, "cart_complement", F.log1p("lift") * 2.0 * F.col("mult"), _private(0.3), _dec(0.2), 0.5,
                   _tier(F.col("lift") >= 5.0), p.cart_top)


def item_similarity(profile: DataFrame, similar: DataFrame, products: DataFrame, specialty: DataFrame,
                    history: DataFrame, p: EngineParams) -> DataFrame:
    warm = profile.filter("is_cold_start = 0")
    mine = top_history(history.join(warm.select("cust_id"), "cust_id", "left_semi"), p.sim_history)
    c = _partners(mine, similar.filter(F.col("similarity") >= p.sim_min), "item_a", "item_b", "similarity")
    c = specialty_match(drop_bought(_candidates(c, warm, products, p), history), specialty, p)
    return _finish(c, "item_similarity", F.col("similarity") * 5.0 * F.col("mult"), _private(0.3), _dec(0.2), 0.3,
                   _tier(F.col("similarity") >= 0.30), p.sim_top)


def lapsed_recovery(profile: DataFrame, lapsed: DataFrame, products: DataFrame, specialty: DataFrame, p: EngineParams) -> DataFrame:
    c = lapsed.filter(F.col("total_qty") >= p.lapsed_qty).select("cust_id", "item_id", "total_qty")
    c = specialty_match(_candidates(c, profile, products, p), specialty, p)
    return _finish(c, "lapsed_recovery", F.log1p("total_qty") * 2.0 * F.col("mult"), _private(0.3), _dec_churn(), 0.7,
                   _tier((F.col("is_declining") == 1) | (F.col("is_churned") == 1)), p.lapsed_top)


def replenishment(profile: DataFrame, candidates: DataFrame, products: DataFrame, specialty: DataFrame, p: EngineParams) -> DataFrame:
    c = candidates.select("cust_id", "item_id", "overdue_ratio", "peer_activity_rate")
    c = specialty_match(_candidates(c, profile, products, p), specialty, p)
    peer = clip("peer_activity_rate", 0.0, 1.0)
    base = F.log1p(F.least("overdue_ratio", F.lit(p.overdue_cap))) * (1.0 + peer) * 3.0 * F.col("mult")
    high = F.col("overdue_ratio").between(1.5, 3.0) & (F.col("peer_activity_rate") >= 0.5)
    return _finish(c, "replenishment", base, _private(0.3), _dec_churn(), 0.6, _tier(high), p.repl_top, peer)


def _swaps(history: DataFrame, equivalents: DataFrame, kind: str) -> DataFrame:
    e = equivalents.filter((F.col("match_type") == kind) & (F.col("price_anomaly") == 0)).select(
        "original_item", "equivalent_item", "price_delta_pct", "original_price", "equivalent_price")
    return history.select("cust_id", F.col("item_id").alias("original_item")).join(e, "original_item").withColumnRenamed(
        "equivalent_item", "item_id")


def competitor_conversion(profile: DataFrame, equivalents: DataFrame, products: DataFrame, specialty: DataFrame,
                          history: DataFrame, p: EngineParams) -> DataFrame:
    c = _candidates(_swaps(history, equivalents, "competitor_conversion"), profile, products, p)
    c = specialty_match(drop_bought(c, history), specialty, p)
    return _finish(c, "competitor_conversion", 3.0 * F.col("mult"), _private(0.3), _dec(0.2), 0.8, F.lit("high"),
                   p.swap_top, tie=["original_item"])


def brand_upgrade(profile: DataFrame, equivalents: DataFrame, products: DataFrame, specialty: DataFrame,
                  history: DataFrame, p: EngineParams) -> DataFrame:
    c = _candidates(_swaps(history, equivalents, "private_brand_upgrade"), profile, products, p)
    c = specialty_match(drop_bought(c, history), specialty, p)
    saving = F.greatest(-F.col("price_delta_pct"), F.lit(0.0))
    dollars = clip(F.col("original_price") - F.col("equivalent_price"), 0.0, 50.0)
    base = (saving * 5.0 + 1.0) * (1.0 + F.log1p(dollars)) * F.col("mult")
    return _finish(c, "private_brand_upgrade", base, 0.5, _dec(0.2), 0.5, _tier(saving >= 0.20), p.swap_top,
                   tie=["original_item"])
