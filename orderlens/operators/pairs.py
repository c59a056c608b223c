"""Item pairs: co-purchase lift, adjusted-cosine similarity, equivalents across brands.

Self-joins inside a basket or a customer are the heavy part. Three rules keep them flat:
only items that can still qualify enter; a group is cut into blocks of items, so its pairs
are made by many tasks; and the widest groups list only pairs that an exact bound allows, as
their part of other pairs is looked up for the candidates found elsewhere.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import clip, flag, half_up
from ..params import PairParams
from ..session import stage

BLOCK = 512  # items of one group that meet in one task


def weekly_baskets(eligible: DataFrame, min_buyers: int) -> DataFrame:
    """Distinct (basket, item); a basket is a customer and a calendar-year/ISO-week pair."""
    week = F.year("order_date") * 100 + F.weekofyear("order_date")
    rows = eligible.select("cust_id", "item_id", (F.col("cust_id") * 1000000 + week).alias("basket")).distinct()
    enough = rows.select("cust_id", "item_id").distinct().groupBy("item_id").agg(
        F.count(F.lit(1)).alias("b")).filter(F.col("b") >= min_buyers)
    return rows.join(enough.select("item_id"), "item_id", "left_semi").select("basket", "item_id")


def _meet(dealt: DataFrame, group: str, payload: Sequence[str]) -> DataFrame:
    """Pairs (item_a < item_b) of rows dealt to the cells of their own block (``_own``) and another (``_other``)."""
    r = dealt.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")})
    a = r.select(group, "_lo", "_hi", F.col("item_id").alias("item_a"), F.col("_own").alias("_own_a"),
                 *[F.col(c).alias(f"{c}_a") for c in payload])
    b = r.select(group, "_lo", "_hi", F.col("item_id").alias("item_b"), F.col("_own").alias("_own_b"),
                 *[F.col(c).alias(f"{c}_b") for c in payload])
    once = (F.col("_lo") == F.col("_hi")) | (F.col("_own_a") != F.col("_own_b"))
    return a.join(b, [group, "_lo", "_hi"]).filter((F.col("item_a") < F.col("item_b")) & once).drop(
        "_lo", "_hi", "_own_a", "_own_b")


def half_pairs(rows: DataFrame, group: str, sizes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Pairs (item_a < item_b) that share a group; wide groups are cut into block pairs."""
    k = F.ceil(F.col("_n") / BLOCK).cast("int")
    r = rows.join(sizes, group).withColumn("_k", k).withColumn(
        "_own", F.pmod(F.xxhash64("item_id"), F.col("_k")).cast("int"))
    return _meet(r.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))), group, payload)


def bounded_half_pairs(rows: DataFrame, group: str, length: str, floor: float, payload: Sequence[str] = ()) -> DataFrame:
    """Pairs of a group whose lengths (above 0, at most 1) may multiply to ``floor``; others are hardly ever listed.

    Blocks hold items of like length, in steps of the eighth root of 2. A block meets only blocks whose
    longest items can make up for its own, so short items are never paired with short ones. Pairs that are
    listed may miss ``floor`` by two steps; those that reach it are all there.
    """
    most = math.floor(-8 * math.log2(floor) + 1e-6)  # steps that two items may be short of 1 together
    step = F.greatest(F.floor(-8 * F.log2(F.col(length)) - 1e-9), F.lit(0)).cast("int")
    r = rows.withColumn("_step", step).filter(F.col("_step") <= most)
    cells = (r.groupBy(group, "_step").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy(group).agg(F.collect_list(F.struct("_step", F.ceil(F.col("_n") / BLOCK).cast("int").alias("k"))).alias("_cells")))

    def block(at, number):
        return at.cast("long") * F.lit(1 << 32) + number

    blocks = F.flatten(F.transform(
        F.filter("_cells", lambda c: c["_step"] + F.col("_step") <= most),
        lambda c: F.transform(F.sequence(F.lit(0), c["k"] - 1), lambda i: block(c["_step"], i))))
    mine = F.filter("_cells", lambda c: c["_step"] == F.col("_step"))[0]["k"]
    r = r.join(cells, group).withColumn("_own", block(F.col("_step"), F.pmod(F.xxhash64("item_id"), mine)))
    return _meet(r.withColumn("_other", F.explode(blocks)).drop("_cells"), group, payload)


def pair_counts(baskets: DataFrame, p: PairParams) -> DataFrame:
    """Exact counts of item pairs seen together in at least ``min_together`` baskets.

    baskets: stored rows. The widest baskets (at most min_together - 1 of them) are left out of
    the self-join: a pair that qualifies is also together min_together - n_wide times elsewhere,
    so their pairs are only looked up for those candidates.
    """
    t = p.min_together
    frequent = baskets.groupBy("item_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= t)
    rows = baskets.join(frequent.select("item_id"), "item_id", "left_semi")
    sizes = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("_n"))
    wide = [r[0] for r in sizes.filter(F.col("_n") > p.wide_basket).orderBy(
        F.desc("_n"), "basket").limit(t - 1).select("basket").collect()]  # fewer ids than min_together
    if not wide:
        return half_pairs(rows, "basket", sizes).groupBy("item_a", "item_b").agg(
            F.count(F.lit(1)).alias("n_together")).filter(F.col("n_together") >= t)
    normal, hot = rows.filter(~F.col("basket").isin(wide)), rows.filter(F.col("basket").isin(wide))
    seen = half_pairs(normal, "basket", sizes).groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).alias("n_normal")).filter(F.col("n_normal") >= t - len(wide))
    extra = (seen.select("item_a", "item_b")
             .join(hot.select("basket", F.col("item_id").alias("item_a")), "item_a")
             .join(hot.select("basket", F.col("item_id").alias("item_b")), ["basket", "item_b"])
             .groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_extra")))
    return seen.join(extra, ["item_a", "item_b"], "left").select(
        "item_a", "item_b", (F.col("n_normal") + F.coalesce("n_extra", F.lit(0))).alias("n_together")).filter(
        F.col("n_together") >= t)


def cooccurrence(baskets: DataFrame, p: PairParams) -> DataFrame:
    """Support, both confidences and lift of the pairs that pass all thresholds."""
    total = baskets.select("basket").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    per_item = baskets.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    out = (pair_counts(baskets, p)
           .join(per_item.select(F.col("item_id").alias("item_a"), F.col("n").alias("n_orders_a")), "item_a")
           .join(per_item.select(F.col("item_id").alias("item_b"), F.col("n").alias("n_orders_b")), "item_b")
           .withColumn("_t", total))
    co = F.col("n_together")
    support = co / F.col("_t")
    lift = co * F.col("_t") / (F.col("n_orders_a") * F.col("n_orders_b"))
    return out.withColumn("support_ab", F.round(support, 9)).withColumn("lift", F.round(lift, 6)).filter(
        (support >= p.min_support) & (F.col("lift") > p.min_lift)).select(
        "item_a", "item_b", F.col("n_together").alias("n_orders_together"), "n_orders_a", "n_orders_b", "support_ab",
        F.round(co / F.col("n_orders_a"), 6).alias("confidence_a_to_b"),
        F.round(co / F.col("n_orders_b"), 6).alias("confidence_b_to_a"), "lift")


def directional_topk(pairs: DataFrame, k: int) -> DataFrame:
    """Both directions of every pair, best k partners per product."""
    def side(a, b, conf):
        return pairs.select(F.col(f"item_{a}").alias("product_a"), F.col(f"item_{b}").alias("product_b"),
                            "n_orders_together", F.col(f"n_orders_{a}").alias("n_orders_product_a"),
                            F.col(f"n_orders_{b}").alias("n_orders_product_b"), "support_ab",
                            F.col(conf).alias("confidence"), "lift")
    both = side("a", "b", "confidence_a_to_b").unionByName(side("b", "a", "confidence_b_to_a"))
    return rk.top_k(both, ["product_a"], [F.desc("lift"), F.desc("confidence"), "product_b"], k)


LIFT_TIERS = ((2.0, "medium"), (3.0, "strong"), (5.0, "very_strong"), (10.0, "exceptional"))


def lift_tiers(pairs: DataFrame) -> DataFrame:
    tier = None
    for bound, name in LIFT_TIERS:
        tier = F.when(F.col("lift") < bound, name) if tier is None else tier.when(F.col("lift") < bound, name)
    return pairs.groupBy(tier.otherwise("extreme").alias("lift_tier")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("same_family").alias("n_same_family"),
        F.round(F.min("lift"), 4).alias("min_lift"), F.round(F.max("lift"), 4).alias("max_lift"))


def lift_summary(pairs: DataFrame) -> DataFrame:
    totals = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("product_a").alias("n_products"),
        F.round(F.avg("same_family") * 100, 2).alias("same_family_pct"),
        F.min("lift").alias("min_lift"), F.max("lift").alias("max_lift"))
    for column, names in (("lift", ("median_lift", "p90_lift")), ("confidence", ("median_confidence", "p90_confidence"))):
        q = rk.exact_quantiles(pairs, column, {"m": 0.5, "p": 0.9}, digits=4)
        totals = totals.withColumns({names[0]: q.select("m").scalar(), names[1]: q.select("p").scalar()})
    return totals


def strongest_pairs(pairs: DataFrame, measure: str, k: int = 500) -> DataFrame:
    return pairs.orderBy(F.desc(measure), "product_a", "product_b").limit(k)


# ---- similarity ----

def centred_weights(cust_items: DataFrame, min_buyers: int) -> DataFrame:
    """Unit-length item vectors of log counts, centred on each customer's mean: (cust, item, x)."""
    enough = cust_items.groupBy("item_id").agg(F.count(F.lit(1)).alias("b")).filter(F.col("b") >= min_buyers)
    rows = cust_items.join(enough.select("item_id"), "item_id", "left_semi").select(
        "cust_id", "item_id", F.log1p(F.col("line_count").cast("double")).alias("w"))
    mean = rows.groupBy("cust_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("w").alias("m")).filter(F.col("_n") >= 2)
    c = rows.join(mean, "cust_id").select("cust_id", "item_id", (F.col("w") - F.col("m")).alias("c"))
    norm = c.groupBy("item_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return c.join(norm, "item_id").filter(F.col("norm") > 1e-9).select(
        "cust_id", "item_id", (F.col("c") / F.col("norm")).alias("x"))


def item_similarity(weights: DataFrame, p: PairParams) -> DataFrame:
    """Cosine of every item pair at or above the minimum; weights: stored unit vectors.

    Customers with very many items stay out of the self-join of all items. What they add to a pair is
    at most the product of the lengths of both items' parts in those customers, so only pairs that can still
    reach the minimum with that are kept and looked up, and only blocks of items whose lengths can multiply to it
    meet inside those customers. The result does not depend on ``wide_basket``.
    """
    floor = p.min_similarity - 6e-7  # results are compared after rounding to 6 digits
    w = weights.filter(F.abs("x") > 1e-12)  # an entry at its customer's mean adds nothing
    sizes = w.groupBy("cust_id").agg(F.count(F.lit(1)).alias("_n"))
    wide = sizes.filter(F.col("_n") > p.wide_basket).select("cust_id")
    hot = w.join(wide, "cust_id", "left_semi")
    part = hot.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("h"))
    side = lambda end: part.select(F.col("item_id").alias(f"item_{end}"), F.col("h").alias(f"h_{end}"))
    bound = F.coalesce("h_a", F.lit(0.0)) * F.coalesce("h_b", F.lit(0.0))
    dots = half_pairs(w.join(wide, "cust_id", "left_anti"), "cust_id", sizes, ["x"]).groupBy("item_a", "item_b").agg(
        F.sum(F.col("x_a") * F.col("x_b")).alias("dot"))
    # with a negative dot a pair may fall short, but must not come back as one that only wide customers share
    seen = stage(dots.join(side("a"), "item_a", "left").join(side("b"), "item_b", "left")
                 .withColumn("bound", bound).filter(F.greatest("dot", F.lit(0.0)) + F.col("bound") >= floor)
                 .select("item_a", "item_b", "dot", "bound"), "similar_candidates")
    extra = (seen.filter((F.col("bound") > 0) & (F.col("dot") + F.col("bound") >= floor)).select("item_a", "item_b")
             .join(hot.select("cust_id", F.col("item_id").alias("item_a"), F.col("x").alias("xa")), "item_a")
             .join(hot.select("cust_id", F.col("item_id").alias("item_b"), F.col("x").alias("xb")), ["cust_id", "item_b"])
             .groupBy("item_a", "item_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("more")))
    both = seen.join(extra, ["item_a", "item_b"], "left").select(
        "item_a", "item_b", (F.col("dot") + F.coalesce("more", F.lit(0.0))).alias("dot"))
    strong = hot.join(part.filter(F.col("h") >= floor), "item_id")
    only_hot = bounded_half_pairs(strong, "cust_id", "h", floor, ["x", "h"]).filter(
        F.col("h_a") * F.col("h_b") >= floor).groupBy("item_a", "item_b").agg(
        F.sum(F.col("x_a") * F.col("x_b")).alias("dot")).join(
        seen.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")
    found = both.unionByName(only_hot)
    return found.select("item_a", "item_b", F.round("dot", 6).alias("similarity")).filter(
        F.col("similarity") >= p.min_similarity)


def similar_topn(pairs: DataFrame, k: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "similarity"))
    return rk.top_k(both, ["item_a"], [F.desc("similarity"), "item_b"], k)


# ---- equivalents ----

MATCH_KEYS = ["matching_category", "family", "product_type", "form_code"]


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*MATCH_KEYS, F.col("item_id").alias(f"{side}_item"), F.col("median_unit_price").alias(f"{side}_price"),
                     F.col("n_buyers").alias(f"{side}_buyers"), F.col("item_dsc").alias(f"{side}_dsc"),
                     F.col("supplier").alias(f"{side}_supplier"), F.col("is_private_brand").alias(f"{side}_private"))


def match_catalogue(parsed: DataFrame, economics: DataFrame) -> DataFrame:
    return parsed.join(economics, "item_id").filter("is_excluded_family = 0 AND is_discontinued = 0")


def key_matches(catalogue: DataFrame) -> DataFrame:
    """For each national item: how many private-brand items have its keys, and the cheapest price among them.

    An aggregate over the many-to-many join of both sides; one side is summed up per key before it, so a
    large category costs its items and not their pairs.
    """
    own = catalogue.filter("is_competitor = 0")
    private = own.filter("is_private_brand = 1").groupBy(*MATCH_KEYS).agg(
        F.count(F.lit(1)).alias("n_equivalents"), F.min("median_unit_price").alias("cheapest_price"))
    return own.filter("is_private_brand = 0").join(private, MATCH_KEYS).select(
        F.col("item_id").alias("original_item"), "n_equivalents", "cheapest_price")


def _delta(price: str = "equivalent_price") -> Column:
    return F.round(F.coalesce(F.try_divide(F.col(price) - F.col("original_price"),
                                           F.nullif("original_price", F.lit(0.0))), F.lit(0.0)), 6)


_LOW = 1e-6  # prices are compared by their logarithm from here on
_SLACK = 2e-6  # more than rounding to 6 digits can shift a price change
_FINE = 16  # price cells a band is wide
_SURE = 50_000  # below it one buyer more is always a better rounded score


def _kth_rival(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The rows of a price step, each with the price ``_rival`` of the k-th nearest item that is no dearer and goes before it.

    An item goes before another with fewer buyers, or as many and a larger id, whatever the original, as long as it is in the
    band; so who is bought instead of an original has fewer than k such items in its band. ``best`` holds
    the items that can still be among the k nearest for a dearer one, in that order.
    """
    pdf = pdf.sort_values(["equivalent_price", "equivalent_buyers", "equivalent_item"], ascending=[True, False, True], kind="stable")
    best: list[list] = []  # [buyers, negated id, price, dearer ones before it]
    rival = []
    for price, buyers, item in zip(pdf["equivalent_price"].tolist(), pdf["equivalent_buyers"].tolist(), pdf["equivalent_item"].tolist()):
        if not price > _LOW:
            rival.append(None)
            continue
        after = bisect.bisect_right(best, [buyers, -item, math.inf])
        near = heapq.nlargest(k, (x[2] for x in best[after:]))
        rival.append(near[-1] if len(near) == k and buyers < _SURE else None)
        at = bisect.bisect_left(best, [buyers, -item, -math.inf])
        for x in best[:at]:
            x[3] += 1
        best[:at] = [x for x in best[:at] if x[3] < k]
        bisect.insort(best, [buyers, -item, price, 0])
    pdf = pdf.assign(_rival=pd.Series(rival, index=pdf.index, dtype="float64"))
    return pdf[pdf["_own"] & ~(pdf["_rival"] >= pdf["equivalent_price"])]


def brand_upgrades(catalogue: DataFrame, p: PairParams) -> DataFrame:
    """National item -> private-brand item of the same keys, same price or up to ``price_band`` cheaper.

    Of the alternatives in the band of an original only those can win that fewer than ``max_equivalents`` others in it
    beat both in price and in buyers. So each alternative has a range of original prices for which it counts,
    from its own price and that at which its k-th rival leaves the band, up to where it leaves the band itself. An original meets the
    alternatives whose range touches its price cell, a few, not all of its band.
    """
    national = _side(catalogue.filter((F.col("is_private_brand") == 0) & (F.col("is_competitor") == 0)
                                      & (F.col("n_buyers") >= p.min_buyers)), "original")
    private = _side(catalogue.filter((F.col("is_private_brand") == 1) & (F.col("is_competitor") == 0)
                                     & (F.col("n_buyers") >= p.min_buyers)), "equivalent")
    width = -math.log(1.0 - p.price_band - 0.001)
    step = lambda c, parts=1: F.floor(F.log(F.greatest(c, F.lit(_LOW))) * (parts / width))
    # rivals lie in the same price step or the one below
    near = private.withColumn("_at", step(F.col("equivalent_price"))).withColumn(
        "price_step", F.explode(F.array(F.col("_at"), F.col("_at") + 1))).withColumn("_own", F.col("_at") == F.col("price_step")).drop("_at")
    types = dict(near.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in near.columns) + ", _rival double"
    most = p.max_equivalents
    e = near.groupBy(*MATCH_KEYS, "price_step").applyInPandas(lambda pdf: _kth_rival(pdf, most), schema).drop("_own", "price_step")
    left = 1.0 - p.price_band
    first = F.greatest(F.col("equivalent_price"), F.col("_rival") / (left + _SLACK)) * (1 - _SLACK)
    last = F.greatest(F.col("equivalent_price"), F.lit(_LOW)) / (left - _SLACK) * (1 + _SLACK)
    e = e.withColumn("price_cell", F.explode(F.sequence(step(first, _FINE), F.greatest(step(first, _FINE), step(last, _FINE)))))
    o = national.withColumn("price_cell", step(F.col("original_price"), _FINE))
    out = o.join(e, [*MATCH_KEYS, "price_cell"]).withColumn("price_delta_pct", _delta()).filter(
        (F.col("price_delta_pct") <= 0) & (F.col("price_delta_pct") >= -p.price_band)
        & (F.col("_rival").isNull() | (_delta("_rival") < -p.price_band)))
    score = F.round(-2.0 * F.col("price_delta_pct") + F.log1p("equivalent_buyers") / 10, 6)
    out = out.withColumn("score", score).withColumn("match_type", F.lit("private_brand_upgrade"))
    return rk.top_k(out, ["original_item"], [F.desc("score"), "equivalent_item"], p.max_equivalents)


def _unbeaten(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The alternatives of a key without those that k others beat for every original: others that are no dearer, with as many
    buyers, and private brands if they are."""
    pdf = pdf.sort_values(["equivalent_price", "equivalent_item"], kind="stable")
    levels = sorted(set(pdf["equivalent_private"].fillna(-1).tolist()))
    most: dict = {level: [] for level in levels}  # the k largest numbers of buyers so far, of that level or above
    keep = []
    for price, buyers, level in zip(pdf["equivalent_price"].tolist(), pdf["equivalent_buyers"].tolist(), pdf["equivalent_private"].fillna(-1).tolist()):
        if price != price:  # no price
            keep.append(True)
            continue
        keep.append(len(most[level]) < k or buyers > most[level][0])
        for other in levels:
            if other <= level:
                (heapq.heappush if len(most[other]) < k else heapq.heappushpop)(most[other], buyers)
    return pdf[keep]


def competitor_conversions(catalogue: DataFrame, p: PairParams) -> DataFrame:
    """Competitor item -> any own item of the same keys; private brand first, then price, then buyers.

    Of alternatives alike in keys, brand flag and buyers only the ``max_equivalents`` cheapest can
    win for any original, and of those only the ones that fewer others beat in price, buyers and brand at once; the
    rest never meets the originals.
    """
    competitor = _side(catalogue.filter((F.col("is_competitor") == 1) & (F.col("n_buyers") >= p.min_buyers)), "original")
    own = _side(catalogue.filter((F.col("is_competitor") == 0) & (F.col("n_buyers") >= p.min_buyers)), "equivalent")
    own = rk.top_k(own, [*MATCH_KEYS, "equivalent_private", "equivalent_buyers"],
                   ["equivalent_price", "equivalent_item"], p.max_equivalents, "_r").drop("_r")
    most = p.max_equivalents
    own = own.groupBy(*MATCH_KEYS).applyInPandas(lambda pdf: _unbeaten(pdf, most), own.schema)
    out = competitor.join(own, MATCH_KEYS).withColumn("price_delta_pct", _delta())
    score = F.round(2.0 * F.col("equivalent_private") - clip("price_delta_pct", -1.0, 1.0)
                    + F.log1p("equivalent_buyers") / 10, 6)
    out = out.withColumn("score", score).withColumn("match_type", F.lit("competitor_conversion"))
    # equal scores go to the cheaper item first, then to the smaller id
    return rk.top_k(out, ["original_item"], [F.desc("score"), "equivalent_price", "equivalent_item"], p.max_equivalents)


EQUIVALENT_COLUMNS = ("original_item", "equivalent_item", "rank", "match_type", "original_price", "equivalent_price",
                      "price_delta_pct", "original_dsc", "equivalent_dsc", "original_supplier", "equivalent_supplier",
                      "original_buyers", "equivalent_buyers", "family")


def equivalents_union(upgrades: DataFrame, conversions: DataFrame) -> DataFrame:
    both = upgrades.select(*EQUIVALENT_COLUMNS).unionByName(conversions.select(*EQUIVALENT_COLUMNS))
    return both.withColumn("is_conversion", flag(F.col("match_type") == "competitor_conversion")).withColumn(
        "is_price_improvement", flag(F.col("price_delta_pct") < 0)).withColumn(
        "price_anomaly", flag(F.abs("price_delta_pct") > 1.0))


def price_saving(original: str = "original_price", equivalent: str = "equivalent_price"):
    return half_up(F.col(original) - F.col(equivalent), 4)
