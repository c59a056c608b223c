"""From signals to one explained, diversified list per customer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import flag, lookup
from ..params import BACKFILL_SIGNALS, SIGNAL_PURPOSE, SIGNAL_QUOTA, SIGNALS, EngineParams
from ..session import stage


def union_signals(signals: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), signals)


def mismatch_filter(candidates: DataFrame, profile: DataFrame, p: EngineParams) -> DataFrame:
    """Drop specialty mismatches for customers whose own history says enough."""
    known = candidates.join(profile.select("cust_id", "n_unique_products_total"), "cust_id")
    return known.filter(~((F.col("n_unique_products_total") >= p.mismatch_history)
                          & (F.col("specialty_match") == "mismatch"))).drop("n_unique_products_total")


def cross_signal_dedup(candidates: DataFrame) -> DataFrame:
    order = lookup("primary_signal", {s: i for i, s in enumerate(SIGNALS)})
    return rk.first_per_key(candidates.withColumn("_o", order), ["cust_id", "item_id"],
                            [F.desc("numeric_score"), "_o"]).drop("_o")


def normalise_scores(candidates: DataFrame) -> DataFrame:
    """Average-rank percentile within the signal, from distinct scores and their counts."""
    out = rk.average_rank_pct(candidates, "numeric_score", ["primary_signal"], "normalized_score")
    return out.withColumn("normalized_score", F.round("normalized_score", 9))


def quota_select(scored: DataFrame, p: EngineParams) -> DataFrame:
    """Marks the rows inside the quotas and ranks them; all windows share the customer partitioning."""
    quota = lookup("primary_signal", SIGNAL_QUOTA, 2)
    within = F.row_number().over(W.partitionBy("cust_id", "primary_signal").orderBy(F.desc("numeric_score"), "item_id"))
    out = scored.repartition("cust_id").withColumn("_in", flag(within <= quota))
    place = F.row_number().over(W.partitionBy("cust_id", "_in").orderBy(F.desc("normalized_score"), "item_id"))
    return out.withColumn("_place", place).withColumn(
        "selected", flag((F.col("_in") == 1) & (F.col("_place") <= p.top_n))).drop("_in", "_place")


def backfill(marked: DataFrame, p: EngineParams) -> DataFrame:
    """Under-filled customers take their best remaining rows of the backfill signals; then all re-rank."""
    per = W.partitionBy("cust_id")
    out = marked.withColumn("_n", F.sum("selected").over(per))
    pool = flag((F.col("selected") == 0) & F.col("primary_signal").isin(*BACKFILL_SIGNALS))
    out = out.withColumn("_pool", pool)
    place = F.row_number().over(W.partitionBy("cust_id", "_pool").orderBy(F.desc("normalized_score"), "item_id"))
    out = out.withColumn("_place", place).filter(
        (F.col("selected") == 1)
        | ((F.col("_pool") == 1) & (F.col("_n") > 0) & (F.col("_place") <= p.top_n - F.col("_n"))))
    rank = F.row_number().over(per.orderBy(F.desc("normalized_score"), "item_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= p.top_n).drop("_n", "_pool", "_place", "selected")


def combine(signals: Sequence[DataFrame], profile: DataFrame, p: EngineParams) -> DataFrame:
    unique = cross_signal_dedup(mismatch_filter(union_signals(signals), profile, p))
    # read twice by the percentile (score counts, then rows), so it is written once; what that shuffles goes before the lists are made
    return backfill(quota_select(stage(normalise_scores(stage(unique, "candidates")), "normalised"), p), p)


def decorate(recs: DataFrame, profile: DataFrame, features: DataFrame) -> DataFrame:
    """Customer and product columns for the few final rows; cold-start rows carry no lifecycle."""
    cust = profile.select("cust_id", "segment", "size_tier", "market_clean", "specialty", "is_declining", "is_churned",
                          "order_cadence_tier")
    item = features.select("item_id", "item_dsc", "family", "category", "median_unit_price",
                           "median_purchases_per_buyer_per_year", "is_private_brand", "n_buyers")
    out = recs.join(cust, "cust_id").join(item, "item_id")
    cold = F.col("primary_signal") == "popularity"
    return out.withColumns({
        "is_declining": F.when(cold, 0).otherwise(F.col("is_declining")),
        "is_churned": F.when(cold, 0).otherwise(F.col("is_churned")),
        "order_cadence_tier": F.when(cold, "no_data").otherwise(F.col("order_cadence_tier")),
        "rec_purpose": lookup("primary_signal", SIGNAL_PURPOSE, "other"),
        "is_house_brand": F.coalesce("is_private_brand", F.lit(0))})


def pitch_reason(house: str = "House Brand", competitor: str = "competitor") -> Column:
    """One sentence per recommendation; the brand names are parameters."""
    family = F.substring(F.coalesce("family", F.lit("")), 1, 30)
    pct = F.round(F.coalesce("peer_adoption_rate", F.lit(0.0)) * 100, 0).cast("int").cast("string")
    segment, buyers = F.coalesce("segment", F.lit("")), F.format_number(F.coalesce("n_buyers", F.lit(0)), 0)
    s = F.col("primary_signal")
    text = (
        F.when(s == "peer_gap", F.concat(family, F.lit(" is missing from the orders, while "), pct, F.lit("% of "), segment,
                                         F.lit(" accounts order it.")))
        .when(s == "popularity", F.concat(F.lit("Best seller for "), segment, F.lit(" accounts: "), buyers,
                                          F.lit(" of them order it, which suits a new account.")))
        .when(s == "cart_complement", F.concat(F.lit("Often in one basket with items of this account, from "), family, F.lit(".")))
        .when(s == "item_similarity", F.concat(F.lit("Bought by the same accounts as items in the order history, from "), family, F.lit(".")))
        .when(s == "lapsed_recovery", F.concat(F.lit("Ordered earlier, not in the last half year, from "), family, F.lit(".")))
        .when(s == "replenishment", F.concat(F.lit("Next order is overdue by the account's rhythm; "), pct,
                                             F.lit("% of comparable accounts still reorder it.")))
        .when(s == "competitor_conversion", F.concat(
            F.lit(f"{house} counterpart of a {competitor} item in the history, from "), family, F.lit(".")))
        .when(s == "private_brand_upgrade", F.lit(f"{house} counterpart of a branded item in the history, at the same price or less."))
        .otherwise(F.lit("Suggested item.")))
    m = F.col("specialty_match")
    return F.concat(text, F.when(m == "match", F.concat(F.lit(" Fits "), F.col("specialty"), F.lit(".")))
                    .when(m == "mismatch", F.lit(" Mostly ordered by other specialties.")).otherwise(F.lit("")))


OUTPUT = ("cust_id", "item_id", "item_dsc", "family", "category", "rank", "primary_signal", "rec_purpose", "is_house_brand",
          "pitch_reason", "confidence_tier", "numeric_score", "normalized_score", "peer_adoption_rate", "specialty_match",
          "median_unit_price", "median_purchases_per_buyer_per_year", "is_private_brand", "segment", "size_tier",
          "market_clean", "specialty", "is_declining", "is_churned", "order_cadence_tier")


def recommendations(signals: Sequence[DataFrame], profile: DataFrame, features: DataFrame, p: EngineParams) -> DataFrame:
    out = decorate(combine(signals, profile, p), profile, features)
    return out.withColumn("pitch_reason", pitch_reason()).select(*OUTPUT)


# ---- statistics over the final list ----

def share_by(recs: DataFrame, column: str) -> DataFrame:
    by = recs.groupBy(F.lit(column).alias("dimension"), F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_house_brand").alias("n_house_brand"))
    total = F.sum("n").over(W.partitionBy("dimension"))  # a handful of values
    return by.withColumn("pct", F.round(F.col("n") / total * 100, 2))


def rec_stats(recs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [
        share_by(recs, c) for c in ("primary_signal", "rec_purpose", "confidence_tier", "specialty_match")])


def diversity(recs: DataFrame) -> DataFrame:
    per = recs.groupBy("cust_id").agg(
        F.countDistinct("family").alias("families"), F.countDistinct("primary_signal").alias("signals"),
        F.countDistinct("rec_purpose").alias("purposes"))
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("families", "signals", "purposes")])
    return rk.exact_quantiles(per.select(F.inline(cells)), "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["measure"], 4)


def brand_bands(recs: DataFrame) -> DataFrame:
    n = F.col("n")
    band = F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 6, "4-6").otherwise("7-10")
    return recs.groupBy("cust_id").agg(F.sum("is_house_brand").alias("n")).groupBy(band.alias("house_brand_recs")).agg(
        F.count(F.lit(1)).alias("n_customers"))
