"""Customer features: value scores, concentration, cadence, size tiers, specialties, segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions import text
from ..functions.columns import bands, col, flag, half_up, lookup
from ..functions.distinct import with_distinct_counts
from ..params import (MARKET_NAMES, SEGMENT_WEIGHTS, SIZE_NAMES, SIZE_TIERS, CleaningParams,
                      SizeParams, SupplierParams)
from ..session import stage


def _paid() -> Column:
    return F.col("amount") > 0


# ---- specialties ----

def specialty_stats(sales: DataFrame, customers: DataFrame) -> DataFrame:
    by = with_distinct_counts(
        sales.join(customers.select("cust_id", "specialty", "specialty_dsc"), "cust_id"), ["specialty", "specialty_dsc"],
        {"unique_customers": "cust_id", "unique_orders": "order_id"},
        F.round(F.sum("amount"), 2).alias("total_revenue"))
    total = F.sum("total_revenue").over(W.partitionBy(F.lit(0)))  # one row per specialty: small
    return (by.withColumn("pct_of_total_revenue", F.round(F.col("total_revenue") / total * 100, 4))
            .withColumn("avg_revenue_per_order",
                        half_up(F.try_divide(F.col("total_revenue"), F.col("unique_orders")))))


def specialty_tier(n: str | Column, p: CleaningParams) -> Column:
    return F.when(col(n) >= p.tier1_customers, 1).when(col(n) >= p.tier2_customers, 2).otherwise(3)


def tier3_fallback(stats: DataFrame) -> DataFrame:
    """Map each tier-3 specialty to a tier-1 code by its words.

    Same first word (the smallest of several tier-1 specialties wins, as the later
    entry of a map would), else any shared word (the largest wins).
    """
    t3 = stats.filter("specialty_tier = 3").select("specialty", "specialty_dsc")
    t1 = stats.filter("specialty_tier = 1").select(
        F.col("specialty").alias("target"), F.split(F.trim(F.upper("specialty_dsc")), r"\s+").alias("t_words"),
        F.col("unique_customers").alias("t_customers"))
    words = t3.select("specialty", F.posexplode(F.split(F.trim(F.upper("specialty_dsc")), r"\s+")).alias("pos", "word"))
    words = words.filter("word <> ''")
    targets = t1.select("target", "t_customers", F.posexplode("t_words").alias("t_pos", "word"))
    hits = words.join(targets, "word").withColumn(
        "priority", F.when((F.col("pos") == 0) & (F.col("t_pos") == 0), 1).otherwise(2))
    size = F.when(F.col("priority") == 1, F.col("t_customers")).otherwise(-F.col("t_customers"))
    best = rk.first_per_key(hits.withColumn("_size", size), ["specialty"], ["priority", "_size", "target"])
    return t3.select("specialty").join(
        best.select("specialty", F.col("target").alias("tier3_fallback")), "specialty", "left")


# ---- recency, frequency, value ----

def family_spend(item_lines: DataFrame, competitors: Sequence[str] = ()) -> DataFrame:
    """Paid amounts per customer and family, in all, from competitors and of private brands.

    Families, concentration and supplier profile all start here, so one shuffle serves them.
    """
    rival = F.col("supplier").isin(*competitors) if competitors else F.lit(False)
    return item_lines.filter(_paid() & F.col("cust_id").isNotNull()).groupBy(
        "cust_id", F.coalesce("family", F.lit("Unknown")).alias("family")).agg(
        F.sum("amount").alias("s"), F.sum(F.when(rival, F.col("amount")).otherwise(0.0)).alias("c"),
        F.sum(F.when(F.col("is_private_brand") == 1, F.col("amount")).otherwise(0.0)).alias("p"))


def rfm_base(sales: DataFrame, spend: DataFrame) -> DataFrame:
    """spend: rows of ``family_spend``. Recency counts to the latest date of all lines, paid or not."""
    latest = sales.agg(F.max("order_date").alias("d")).scalar()
    out = sales.filter(_paid()).groupBy("cust_id").agg(
        F.max("order_date").alias("last_order_date"),
        F.countDistinct("order_id").alias("frequency"),
        F.round(F.sum("amount"), 2).alias("monetary"))
    families = spend.groupBy("cust_id").agg(F.count(F.lit(1)).alias("n_categories_bought"))
    return out.join(families, "cust_id").withColumns({
        "avg_revenue_per_order": half_up(F.col("monetary") / F.col("frequency")),
        "recency_days": F.greatest(F.datediff(latest, "last_order_date"), F.lit(0))})


def category_hhi(spend: DataFrame) -> DataFrame:
    # sum(s^2) / total^2 equals the sum of squared shares
    return spend.groupBy("cust_id").agg(F.round(
        F.sum(F.col("s") * F.col("s")) / F.pow(F.greatest(F.sum("s"), F.lit(1.0)), 2), 4).alias("category_hhi"))


def order_gaps(sales: DataFrame) -> DataFrame:
    """Mean and population deviation of the gaps between distinct order dates."""
    dates = sales.filter(F.col("order_date").isNotNull()).select("cust_id", "order_date").distinct()
    gap = F.datediff("order_date", F.lag("order_date").over(W.partitionBy("cust_id").orderBy("order_date")))
    return dates.withColumn("gap", gap).groupBy("cust_id").agg(
        F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 2).alias("avg_order_gap_days"),
        F.round(F.coalesce(F.stddev_pop("gap"), F.lit(0.0)), 2).alias("cycle_regularity"))


def churn_labels(sales: DataFrame, first: str = "FY1", second: str = "FY2") -> DataFrame:
    one, two = F.max(flag(F.col("fy") == first)), F.max(flag(F.col("fy") == second))
    return sales.groupBy("cust_id").agg(one.alias("_a"), two.alias("_b")).select(
        "cust_id", F.when((F.col("_a") == 1) & (F.col("_b") == 0), 1)
        .when((F.col("_a") == 1) & (F.col("_b") == 1), 0).otherwise(-1).alias("churn_label"))


def r_score(df: DataFrame, value: str = "recency_days", out: str = "r_score") -> DataFrame:
    """5 (most recent) .. 1 by exact quintile edges, right-closed."""
    edges = rk.exact_quantiles(df, value, {f"e{i}": i / 5 for i in range(1, 5)}).select(
        F.array("e1", "e2", "e3", "e4").alias("e")).scalar()
    slot = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(value).cast("double")))
    return df.withColumn("_edges", edges).withColumn(out, (F.lit(5) - slot).cast("int")).drop("_edges")


def value_scores(base: DataFrame) -> DataFrame:
    base = stage(base, "rfm_base")  # every score takes several passes over it
    out = r_score(base)
    for value, score in (("frequency", "f_score"), ("monetary", "m_score")):
        out = out.join(rk.quantile_score(base.select("cust_id", value), value, "cust_id", score).drop(value), "cust_id")
    return out.withColumn("rfm_score", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]))


def supplier_profile(spend: DataFrame, p: SupplierParams) -> DataFrame:
    whole = F.greatest(F.sum("s"), F.lit(1.0))
    out = spend.groupBy("cust_id").agg(F.round(F.sum("c") / whole, 6).alias("pct_competitor"),
                                       F.round(F.sum("p") / whole, 6).alias("pct_private_brand"))
    return out.withColumn("supplier_profile", F.when(F.col("pct_competitor") >= p.competitor_share, "competitor_only")
                          .when(F.col("pct_private_brand") >= p.private_share, "house_primary").otherwise("mixed"))


# ---- size ----

def monthly_spend_volume(sales: DataFrame, primary: str = "qty", fallback: str = "qty") -> DataFrame:
    units = F.greatest(F.lit(0.0), F.coalesce(F.nullif(F.col(primary), F.lit(0.0)), F.col(fallback), F.lit(0.0)))
    return sales.filter(_paid() & F.col("cust_id").isNotNull()).groupBy(
        "cust_id", F.year("order_date").alias("order_year"), F.month("order_date").alias("order_month")).agg(
        F.round(F.sum("amount"), 2).alias("month_spend"), F.sum(units).alias("month_volume"))


def median_monthly(monthly: DataFrame) -> DataFrame:
    # one value per calendar month and customer: a bounded buffer
    return monthly.groupBy("cust_id").agg(
        half_up(F.median("month_spend")).alias("median_monthly_spend"),
        half_up(F.median("month_volume")).alias("median_monthly_volume"),
        F.count("month_spend").alias("active_months_total"))


def active_months_last_12(monthly: DataFrame) -> DataFrame:
    ym = F.col("order_year") * 100 + F.col("order_month")
    newest = monthly.agg(F.max(ym).alias("m")).scalar()
    return monthly.filter(ym > newest - 100).groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("active_months_last_12"))  # one row per month already


def step_tier(value: str, steps: tuple, active: str, min_active: int) -> Column:
    names = SIZE_TIERS[1:4]
    return F.when(F.col(active) < min_active, SIZE_TIERS[0]).otherwise(
        bands(value, list(zip(steps, names, strict=True)), SIZE_TIERS[4]))


def size_tier(spend: str | Column, volume: str | Column, rule: str = "max_one") -> Column:
    rank = {t: i for i, t in enumerate(SIZE_TIERS)}
    s, v = lookup(spend, rank), lookup(volume, rank)
    if rule == "spend_only":
        return col(spend)
    best = F.least(s, v)
    if rule == "max_one":
        best = F.when(s == 0, 0).otherwise(F.greatest(best, s - 1))
    return F.get(F.array(*[F.lit(t) for t in SIZE_TIERS]), best)


def size_stats(sales: DataFrame, p: SizeParams) -> DataFrame:
    monthly = monthly_spend_volume(sales)
    out = median_monthly(monthly).join(active_months_last_12(monthly), "cust_id", "left").fillna(
        0, ["active_months_last_12"])
    out = (out.withColumn("spend_tier", step_tier("median_monthly_spend", p.spend, "active_months_last_12", p.min_active_months))
           .withColumn("volume_tier", step_tier("median_monthly_volume", p.volume, "active_months_last_12", p.min_active_months)))
    out = out.withColumn("size_tier", size_tier("spend_tier", "volume_tier", p.rule))
    return out.withColumn("affordability_ceiling", half_up(
        F.col("median_monthly_spend") * lookup("size_tier", p.ceiling)))


# ---- encodings ----

def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Position of the value among the distinct values sorted as text; NULL becomes -1.

    The values are dealt to ranges of the whole text, in order; places inside a range and the sizes of the ranges before it make
    the position, and only the sizes, one a range, are summed in one task. The ranges are written, as they come from a sample.
    """
    codes = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_t", F.col(column).cast("string"))
    codes = stage(codes.repartitionByRange("_t").withColumn("_p", F.spark_partition_id()), "codes")
    starts = codes.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_p").orderBy("_t"))
    index = codes.withColumn("_r", inside).join(starts, "_p").select(column, (F.col("_start") + F.col("_r") - 1).cast("int").alias("_i"))
    return df.join(index, column, "left").withColumn(out, F.coalesce("_i", F.lit(-1))).drop("_i")


def rare_group(df: DataFrame, column: str, min_count: int, out: str) -> DataFrame:
    common = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count).drop("_n")
    return df.join(common.withColumn("_ok", F.lit(1)), column, "left").withColumn(
        out, F.when(F.col("_ok") == 1, F.col(column)).otherwise("Other")).drop("_ok")


def top_codes(df: DataFrame, column: str, measure: str, k: int) -> list[str]:
    """The k codes with the largest measure (k names for columns, so they come to the driver)."""
    ranked = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.round(F.sum(measure), 2).alias("_m"))
    return [r[0] for r in ranked.orderBy(F.desc("_m"), column).limit(k).collect()]


def one_hot(df: DataFrame, column: str, codes: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{c}": flag(F.col(column) == c) for c in codes})


def specialty_trend(sales: DataFrame, customers: DataFrame, first: str = "FY1", second: str = "FY2") -> DataFrame:
    by = sales.join(customers.select("cust_id", "specialty").filter("specialty IS NOT NULL"), "cust_id").groupBy(
        "specialty").agg(
        F.round(F.sum(F.when(F.col("fy") == first, F.col("amount")).otherwise(0.0)), 2).alias("revenue_first"),
        F.round(F.sum(F.when(F.col("fy") == second, F.col("amount")).otherwise(0.0)), 2).alias("revenue_second"))
    return by.withColumn("trend_pct", F.round(F.try_divide(
        F.col("revenue_second") - F.col("revenue_first"), F.nullif("revenue_first", F.lit(0.0))) * 100, 2))


def crosstab(df: DataFrame, a: str, b: str, margin: str = "TOTAL") -> DataFrame:
    """Long crosstab with margins."""
    out = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return out.select(F.when(F.col("_ga") == 1, margin).otherwise(F.col(a)).alias(a),
                      F.when(F.col("_gb") == 1, margin).otherwise(F.col(b)).alias(b), "n")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count, NULL share and distinct count per column.

    One pass counts rows and NULLs of all columns; distinct values are grouped column by column, each read alone and in its type.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_n_{c}") for c in columns])
    distinct = {c: df.select(F.col(c).alias("v")).distinct().agg(F.count("v")).scalar() for c in columns}
    for c in columns:
        wide = wide.withColumn(f"_d_{c}", distinct[c])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"), F.col("_rows").alias("n_rows"),
                               (F.col("_rows") - F.col(f"_n_{c}")).alias("null_count"), F.col(f"_d_{c}").alias("n_distinct")) for c in columns])
    return wide.select(F.inline(cells)).filter("n_rows > 0").withColumn("null_pct", F.round(F.col("null_count") / F.col("n_rows") * 100, 4))


def fy_sales_stats(sales: DataFrame) -> DataFrame:
    return with_distinct_counts(
        sales, ["fy"], {"customers": "cust_id", "products": "item_id"}, F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("amount"), 2).alias("revenue"),
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


def label_distribution(df: DataFrame, column: str, meanings: Mapping) -> DataFrame:
    by = df.groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # one row per label
    return by.withColumn("pct", F.round(F.col("n") / total * 100, 2)).withColumn(
        "meaning", lookup("label", {str(k): v for k, v in meanings.items()}))


# ---- features and segments ----

def customer_features(sales: DataFrame, item_lines: DataFrame, customers: DataFrame, competitors: Sequence[str],
                      size: SizeParams, supplier: SupplierParams) -> DataFrame:
    """All features; only the parts that need product attributes read the lines joined with items."""
    spend = family_spend(item_lines, competitors)
    # the scores take half of all steps; in one plan with the rest the driver would plan them again at each
    scores = stage(value_scores(rfm_base(sales, spend)), "value_scores")
    return (scores
            .join(category_hhi(spend), "cust_id", "left")
            .join(order_gaps(sales), "cust_id", "left")
            .join(churn_labels(sales), "cust_id", "left")
            .join(supplier_profile(spend, supplier), "cust_id", "left")
            .join(size_stats(sales, size), "cust_id", "left")
            .join(customers.select("cust_id", "market", "specialty", "state", "cust_type", "cust_class"),
                  "cust_id", "left")
            .fillna({"category_hhi": 1.0, "avg_order_gap_days": 0.0, "cycle_regularity": 0.0,
                     "active_months_last_12": 0, "size_tier": "new"}))


def assign_segments(features: DataFrame, markets: Sequence[str]) -> DataFrame:
    clean = F.when(F.col("market").isin(*markets), F.col("market")).otherwise("OTHER")
    tier = F.coalesce("size_tier", F.lit("new"))
    return features.select("cust_id", F.concat_ws("_", clean, tier).alias("segment"),
                           clean.alias("market_clean"), tier.alias("size_tier"))


SEGMENT_MEASURES = {
    "median_monetary": "monetary", "median_monthly_spend": "median_monthly_spend",
    "median_monthly_volume": "median_monthly_volume", "median_recency": "recency_days",
    "median_frequency": "frequency", "median_avg_order": "avg_revenue_per_order",
    "median_afford_ceiling": "affordability_ceiling", "median_active_months": "active_months_last_12",
    "median_n_cats": "n_categories_bought", "median_hhi": "category_hhi", "median_cycle": "cycle_regularity",
}


def group_medians(df: DataFrame, key: str, measures: Mapping[str, str], digits: int = 4) -> DataFrame:
    return rk.quantiles(df, {n: (c, 0.5) for n, c in measures.items()}, [key], digits)


def segment_profile(features: DataFrame, segments: DataFrame, market_names: Mapping = MARKET_NAMES) -> DataFrame:
    df = features.drop("size_tier").join(segments, "cust_id")
    counts = df.groupBy("segment", "market_clean", "size_tier").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.round(F.avg(F.when(F.col("churn_label").isin(0, 1), F.col("churn_label"))) * 100, 1).alias("churn_rate_pct"))
    out = counts.join(group_medians(df, "segment", SEGMENT_MEASURES), "segment")
    peer = lookup("size_tier", {k: v[0] for k, v in SEGMENT_WEIGHTS.items()}, 2.5)
    lapsed = lookup("size_tier", {k: v[1] for k, v in SEGMENT_WEIGHTS.items()}, 2.5)
    return (out.withColumn("peer_gap_weight", peer).withColumn("lapsed_weight", lapsed)
            .withColumn("primary_signal", F.when(peer >= lapsed, "peer_gap").otherwise("lapsed"))
            .withColumn("market_label", lookup("market_clean", market_names, "Other"))
            .withColumn("display_order", lookup("size_tier", {t: i for i, t in enumerate(SIZE_TIERS)})))


def lifecycle_status(cold: str = "is_cold_start", churned: str = "is_churned",
                     declining: str = "is_declining") -> Column:
    return (F.when(F.col(cold) == 1, "cold_start").when(F.col(churned) == 1, "churned_warm")
            .when(F.col(declining) == 1, "declining_warm").otherwise("stable_warm"))


def quota_picks(customers: DataFrame, quotas: Sequence[tuple[str, Sequence[str], int]]) -> DataFrame:
    """n customers per (status, segment prefixes) entry, most orders first; an earlier entry keeps its picks."""
    hit = None
    for i, (status, prefixes, _) in enumerate(quotas):
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col("segment").startswith(p)
        cond = (F.col("status") == status) & cond
        hit = F.when(cond, i) if hit is None else hit.when(cond, i)
    tagged = customers.withColumn("quota_no", hit).filter(F.col("quota_no").isNotNull())
    ranked = rk.top_k(tagged, ["quota_no"], [F.desc("n_orders_total"), "cust_id"],
                      max(n for _, _, n in quotas), "pick")
    return ranked.filter(F.col("pick") <= lookup("quota_no", {i: q[2] for i, q in enumerate(quotas)}))


def representatives(customers: DataFrame) -> DataFrame:
    """Best-scoring customer per cell of three dimensions; an earlier dimension claims a customer."""
    score = F.coalesce("n_unique_products", F.lit(0)) + F.least(
        F.coalesce("total_spend", F.lit(0.0)) / 1000, F.lit(200.0))
    df = customers.withColumn("picked_score", F.round(score, 6))
    parts = []
    for i, (dim, reason) in enumerate((("segment", "segment_x_status"), ("archetype", "archetype_x_status"),
                                       ("supplier_profile", "supplier_x_status"))):
        best = rk.first_per_key(df, [dim, "status"], [F.desc("picked_score"), "cust_id"])
        parts.append(best.withColumn("pick_reason", F.lit(reason)).withColumn("_p", F.lit(i)))
    all_picks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rk.first_per_key(all_picks, ["cust_id"], ["_p", "segment", "archetype", "supplier_profile"]).drop("_p")


def archetype_profile(df: DataFrame) -> DataFrame:
    sums = df.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("monetary"), 2).alias("total_spend"),
        F.round(F.avg("monetary"), 2).alias("mean_spend"),
        F.round(F.avg(flag(F.col("churn_label") == 1)) * 100, 2).alias("churn_rate"))
    med = group_medians(df, "archetype", {
        "median_spend": "monetary", "median_volume": "median_monthly_volume", "median_freq": "frequency",
        "median_recency": "recency_days", "median_n_cats": "n_categories_bought"}, 2)
    return sums.join(med, "archetype")


def top_specialties(df: DataFrame, k: int = 10) -> DataFrame:
    by = df.groupBy("archetype", F.coalesce("specialty_dsc", F.lit("(blank)")).alias("specialty")).agg(
        F.count(F.lit(1)).alias("n_customers"))
    return rk.top_k(by, ["archetype"], [F.desc("n_customers"), "specialty"], k)


def segment_names(segment: str = "segment", markets: Mapping = MARKET_NAMES) -> Column:
    return text.display_name(segment, dict(markets), SIZE_NAMES)
