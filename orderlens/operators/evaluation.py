"""Data expectations, holdout back-test, cart back-test and review of the final list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.columns import flag, half_up
from ..params import SIZE_TIERS, EvalParams, ModelParams
from . import serving

# ---- expectations ----


def expect_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule from one aggregate; a NULL outcome is a violation."""
    bad = df.agg(*[F.sum(1 - flag(cond)).alias(name) for name, cond in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in rules])
    return bad.select(F.inline(cells)).withColumn("passed", flag(F.col("violations") == 0))


def expect_shares(df: DataFrame, column: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of each expected value and whether it lies in its range."""
    total = F.count(F.lit(1))
    wide = df.agg(*[F.round(F.sum(flag(F.col(column) == v)) / total * 100, 4).alias(v) for v in bounds])
    cells = F.array(*[F.struct(F.lit(f"{column} {v}").alias("rule"), F.col(v).alias("share_pct"),
                               flag(F.col(v).between(lo, hi)).alias("passed")) for v, (lo, hi) in bounds.items()])
    return wide.select(F.inline(cells))


def expect_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("rule"), "violations", flag(F.col("violations") == 0).alias("passed"))


def expect_no_orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    lost = child.select(key).filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("rule"), "violations", flag(F.col("violations") == 0).alias("passed"))


def expect_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    missing = len([c for c in required if c not in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("rule"), F.lit(missing).cast("bigint").alias("violations"),
        flag((F.col("n") > 0) & F.lit(missing == 0)).alias("passed"))


def table_metrics(df: DataFrame, params: ModelParams) -> dict[str, Column]:
    """What is noted of a table while it is written: rows, and rows per size tier and churn label where it has them."""
    counts = {"n_rows": F.count(F.lit(1))}
    if "size_tier" in df.columns:
        counts |= {f"size_tier {t}": F.count(F.when(F.col("size_tier") == t, 1)) for t in SIZE_TIERS}
    if "churn_label" in df.columns:
        counts |= {f"churn {v}": F.count(F.when(F.col("churn_label") == v, 1)) for v in (-1, 0, 1)}
    return counts


def expect_row_counts(spark: SparkSession, observed: Mapping[str, Mapping], ranges: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Noted row counts of stored tables against the ranges in which they should lie."""
    rows = [(f"{name} rows", int(observed[name]["n_rows"]), lo, hi, int(lo <= observed[name]["n_rows"] <= hi)) for name, (lo, hi) in ranges.items()]
    return spark.createDataFrame(rows, "rule string, n_rows long, low long, high long, passed int")


def expect_churn_band(spark: SparkSession, noted: Mapping, low: float, high: float) -> DataFrame:
    """Share of lost customers among those of the first year, in percent, against a band; without any it fails."""
    lost, kept = int(noted["churn 1"]), int(noted["churn 0"])
    pct = round(lost / (lost + kept) * 100, 4) if lost + kept else None
    return spark.createDataFrame([("churn rate", pct, float(low), float(high), int(pct is not None and low <= pct <= high))],
                                 "rule string, churn_pct double, low double, high double, passed int")


def expect_noted_shares(spark: SparkSession, noted: Mapping, column: str, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """As ``expect_shares``, from what was noted while the table was written."""
    n = int(noted["n_rows"])
    rows = [(f"{column} {v}", round(noted[f"{column} {v}"] / n * 100, 4) if n else None) for v in bounds]
    rows = [(rule, pct, int(pct is not None and lo <= pct <= hi)) for (rule, pct), (lo, hi) in zip(rows, bounds.values())]
    return spark.createDataFrame(rows, "rule string, share_pct double, passed int")


# ---- holdout ----

def holdout_start(sales: DataFrame, days: int) -> Column:
    return F.date_sub(sales.agg(F.max("order_date").alias("d")).scalar(), days)


def holdout_purchases(sales: DataFrame, p: EvalParams) -> DataFrame:
    return sales.filter((F.col("amount") > 0) & (F.col("order_date") > holdout_start(sales, p.holdout_days))).groupBy(
        "cust_id", "item_id").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("amount"), 2).alias("spend"),
                                  F.countDistinct("order_date").alias("n_orders"))


def before_holdout(sales: DataFrame, p: EvalParams) -> DataFrame:
    return sales.filter(F.col("order_date") <= holdout_start(sales, p.holdout_days))


def popularity_baseline(sales: DataFrame, items: DataFrame, p: EvalParams) -> DataFrame:
    """Top n by buyers before the holdout, among the most bought that the catalogue knows."""
    pool = before_holdout(sales, p).filter(F.col("amount") > 0).groupBy("item_id").agg(
        F.countDistinct("cust_id").alias("n_buyers")).orderBy(F.desc("n_buyers"), "item_id").limit(p.popular_pool)
    return pool.join(items.select("item_id", "family", "category"), "item_id").orderBy(
        F.desc("n_buyers"), "item_id").limit(p.top_n)


def hits_per_customer(recs: DataFrame, holdout: DataFrame, baseline: DataFrame, items: DataFrame) -> DataFrame:
    """Strict, family and category hits of the list and of the baseline per evaluated customer.

    A customer holds at most as many families and categories as its items, and the baseline
    is one row of three short arrays, so sets stay small.
    """
    meta = items.select("item_id", "family", "category")

    def sets(df, name):
        return df.select("cust_id", "item_id").distinct().join(meta, "item_id", "left").groupBy("cust_id").agg(
            F.collect_set("item_id").alias(f"{name}_items"), F.collect_set("family").alias(f"{name}_families"),
            F.collect_set("category").alias(f"{name}_categories"))
    # bought sets are cut to what can hit at all before they are collected
    bought = holdout.select("cust_id", "item_id")
    n_bought = bought.groupBy("cust_id").agg(F.countDistinct("item_id").alias("n_holdout_items"))
    mine = sets(recs, "rec").join(n_bought, "cust_id")
    base = baseline.agg(*[F.collect_set(c).alias(f"bl_{n}") for c, n in (
        ("item_id", "items"), ("family", "families"), ("category", "categories"))])
    per = bought.join(meta, "item_id", "left")
    out = mine
    for c, n in (("item_id", "items"), ("family", "families"), ("category", "categories")):
        base_c = base.select(f"bl_{n}").scalar()
        mine_c = mine.select("cust_id", f"rec_{n}")
        got = per.select("cust_id", F.col(c).alias("x")).filter("x IS NOT NULL").distinct().join(mine_c, "cust_id").withColumn(
            "_b", base_c).groupBy("cust_id").agg(
            F.sum(flag(F.array_contains(f"rec_{n}", F.col("x")))).alias(f"eng_{n}_hits"),
            F.sum(flag(F.array_contains("_b", F.col("x")))).alias(f"bl_{n}_hits"))
        out = out.join(got, "cust_id", "left").fillna(0, [f"eng_{n}_hits", f"bl_{n}_hits"])
    n_base = base.select(F.size("bl_items").alias("n")).scalar()
    out = out.withColumn("n_rec_items", F.size("rec_items")).withColumn("_nb", n_base)
    return out.select(
        "cust_id", "n_holdout_items", "n_rec_items",
        *[F.col(f"{s}_{n}_hits") for s in ("eng", "bl") for n in ("items", "families", "categories")],
        F.round(F.col("eng_items_hits") / F.col("n_rec_items"), 6).alias("eng_precision"),
        F.round(F.col("eng_items_hits") / F.col("n_holdout_items"), 6).alias("eng_recall"),
        F.round(F.col("bl_items_hits") / F.greatest("_nb", F.lit(1)), 6).alias("bl_precision"),
        F.round(F.col("bl_items_hits") / F.col("n_holdout_items"), 6).alias("bl_recall"))


_HITS = (("strict", "items"), ("family", "families"), ("category", "categories"))


def hit_rates(per_customer: DataFrame) -> DataFrame:
    """Engine against baseline, in percent, with the lift in points."""
    aggs = []
    for side in ("eng", "bl"):
        aggs += [F.avg(flag(F.col(f"{side}_{n}_hits") > 0)).alias(f"{side}_{m}_hit_rate") for m, n in _HITS]
        aggs += [F.avg(f"{side}_precision").alias(f"{side}_precision"), F.avg(f"{side}_recall").alias(f"{side}_recall")]
    wide = per_customer.agg(*aggs)
    names = [*(f"{m}_hit_rate" for m, _ in _HITS), "precision", "recall"]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(f"eng_{n}") * 100, 4).alias("engine_pct"),
                               F.round(F.col(f"bl_{n}") * 100, 4).alias("baseline_pct"),
                               F.round((F.col(f"eng_{n}") - F.col(f"bl_{n}")) * 100, 4).alias("lift_pp")) for n in names])
    return wide.select(F.inline(cells))


def hit_rate_by(per_customer: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    return per_customer.join(groups.select("cust_id", column), "cust_id").groupBy(
        F.lit(column).alias("dimension"), F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n_customers"),
        *[F.round(F.avg(flag(F.col(f"eng_{n}_hits") > 0)) * 100, 4).alias(f"{m}_hit_pct") for m, n in _HITS])


def hit_rate_by_signal(recs: DataFrame, holdout: DataFrame) -> DataFrame:
    """Share of each signal's recommendations that the customer then bought."""
    known = recs.join(holdout.select("cust_id").distinct(), "cust_id", "left_semi")
    hit = holdout.select("cust_id", "item_id", F.lit(1).alias("_h"))
    return known.join(hit, ["cust_id", "item_id"], "left").groupBy("primary_signal").agg(
        F.count(F.lit(1)).alias("n_recs"), F.sum(F.coalesce("_h", F.lit(0))).alias("n_hits"),
        F.round(F.avg(F.coalesce("_h", F.lit(0))) * 100, 4).alias("hit_pct"))


# ---- sampled carts ----

def stratified_sample(customers: DataFrame, strata: Sequence[str], budget: int, seed: int = 42) -> DataFrame:
    """About equal shares per stratum within the budget, the rest from everyone left; order by a seeded hash."""
    h = F.md5(F.concat_ws("-", F.col("cust_id").cast("string"), F.lit(str(seed))))
    df = customers.select("cust_id", *strata).withColumn("_h", h)
    cells = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))  # a handful of rows
    n_cells = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = F.greatest(F.lit(2), F.floor(F.lit(budget) / F.col("_cells")).cast("int"))
    want = cells.withColumn("_cells", n_cells).withColumn("_w", F.least(base, F.col("_n")))
    before = F.coalesce(F.sum("_w").over(W.partitionBy(F.lit(0)).orderBy(*strata).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = want.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_w"), F.lit(budget) - before))).select(*strata, "_take")
    ranked = rk.top_k(df, list(strata), ["_h", "cust_id"], budget, "_r").join(take, list(strata))
    first = ranked.filter(F.col("_r") <= F.col("_take")).select("cust_id", *strata)
    used = take.agg(F.sum("_take").alias("n")).scalar()
    rest = df.join(first.select("cust_id"), "cust_id", "left_anti").orderBy("_h", "cust_id").limit(budget)
    left = rest.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_h", "cust_id"))).withColumn("_used", used)
    extra = left.filter(F.col("_r") <= F.lit(budget) - F.col("_used")).select("cust_id", *strata)
    return first.unionByName(extra)


def last_order_as_cart(sales: DataFrame, max_lines: int) -> DataFrame:
    """Items of each customer's latest order date, largest amounts first."""
    paid = sales.filter(F.col("amount") > 0)
    last = paid.groupBy("cust_id").agg(F.max("order_date").alias("order_date"))
    lines = paid.join(last, ["cust_id", "order_date"]).groupBy("cust_id", "item_id", "order_date").agg(
        F.round(F.sum("amount"), 2).alias("line_amount"))
    return rk.top_k(lines, ["cust_id"], [F.desc("line_amount"), "item_id"], max_lines, "cart_line")


def cart_backtest(cart: DataFrame, pairs: DataFrame, equivalents: DataFrame, items: DataFrame, p: EvalParams) -> DataFrame:
    """Per cart: suggestions of each kind, category alignment, house-brand share and lift."""
    strong = pairs.filter((F.col("lift") >= p.cart_lift) & (F.col("support_ab") >= p.cart_support))
    comp = serving.cart_complements(cart, strong, 5).join(items.select("item_id", "category", "is_private_brand"), "item_id", "left")
    mine = cart.join(items.select("item_id", "category"), "item_id").select("cust_id", "category", F.lit(1).alias("_in")).distinct()
    comp = comp.join(mine, ["cust_id", "category"], "left").groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("n_complements"), F.round(F.avg(F.coalesce("_in", F.lit(0))), 6).alias("category_alignment"),
        F.round(F.avg("is_private_brand"), 6).alias("house_brand_rate"), half_up(F.avg("lift"), 4).alias("avg_lift"))

    def n(kind, name, improving):
        return serving.cart_swaps(cart, equivalents, kind, 3, improving).groupBy("cust_id").agg(F.count(F.lit(1)).alias(name))
    out = cart.groupBy("cust_id").agg(F.count(F.lit(1)).alias("cart_size")).join(comp, "cust_id", "left")
    out = out.join(n("private_brand_upgrade", "n_upgrades", True), "cust_id", "left").join(
        n("competitor_conversion", "n_conversions", False), "cust_id", "left")
    return out.fillna(0, ["n_complements", "n_upgrades", "n_conversions"])


def backtest_rollup(per_cart: DataFrame, groups: DataFrame | None = None, column: str | None = None) -> DataFrame:
    keys = []
    if groups is not None:
        per_cart, keys = per_cart.join(groups.select("cust_id", column), "cust_id"), [column]
    aggs = [F.count(F.lit(1)).alias("n_carts"),
            *[F.round(F.avg(flag(F.col(c) > 0)) * 100, 4).alias(f"{c[2:]}_trigger_pct")
              for c in ("n_complements", "n_upgrades", "n_conversions")],
            F.round(F.avg("category_alignment") * 100, 4).alias("category_alignment_pct"),
            F.round(F.avg("house_brand_rate") * 100, 4).alias("house_brand_pct"),
            F.round(F.avg("avg_lift"), 4).alias("avg_lift")]
    return per_cart.groupBy(*keys).agg(*aggs) if keys else per_cart.agg(*aggs)


def monday_week(date_col: str = "order_date") -> Column:
    """year * 100 + week of the year, weeks starting on Monday and week 0 before the first Monday."""
    day, weekday = F.dayofyear(date_col), (F.dayofweek(date_col) + 5) % 7
    return F.year(date_col) * 100 + F.floor((day - 1 + 7 - weekday) / 7).cast("int")


def recent_orders(sales: DataFrame, n: int) -> DataFrame:
    """Lines of each customer's n latest weekly orders."""
    lines = sales.filter(F.col("amount") > 0).withColumn("order_week", monday_week())
    weeks = lines.groupBy("cust_id", "order_week").agg(
        F.max("order_date").alias("_d"), F.count(F.lit(1)).alias("line_count"), F.round(F.sum("amount"), 2).alias("order_total"))
    top = rk.top_k(weeks, ["cust_id"], [F.desc("_d"), F.desc("order_week")], n, "recency_rank").drop("_d")
    return lines.select("cust_id", "item_id", "qty", "amount", "order_date", "order_week").join(top, ["cust_id", "order_week"])


def cart_recs_from_history(cart: DataFrame, history: DataFrame, pairs: DataFrame, similar: DataFrame,
                           min_lift: float, min_similarity: float, n: int) -> DataFrame:
    """Complements and similar items of a cart that are neither in it nor bought before."""
    def branch(source, target, measure, df, kind):
        hits = cart.select("cust_id", F.col("item_id").alias("trigger_item")).join(
            df.select(F.col(source).alias("trigger_item"), F.col(target).alias("item_id"), F.col(measure).alias("strength")), "trigger_item")
        hits = hits.join(cart.select("cust_id", "item_id"), ["cust_id", "item_id"], "left_anti").join(
            history.select("cust_id", "item_id"), ["cust_id", "item_id"], "left_anti")
        best = rk.first_per_key(hits, ["cust_id", "item_id"], [F.desc("strength"), "trigger_item"])
        return rk.top_k(best, ["cust_id"], [F.desc("strength"), "item_id"], n, "position").withColumn("kind", F.lit(kind))
    return branch("product_a", "product_b", "lift", pairs.filter(F.col("lift") >= min_lift), "cart_complement").unionByName(
        branch("item_a", "item_b", "similarity", similar.filter(F.col("similarity") >= min_similarity), "item_similarity"))


def rec_quality(recs: DataFrame, history: DataFrame, items: DataFrame, patterns: DataFrame, rich: int = 10) -> DataFrame:
    """Overlap of the list with the own families and categories, diversity, and the mismatch breach flag."""
    mine = history.join(items.select("item_id", "family", "category"), "item_id")
    out = recs.groupBy("cust_id").agg(
        F.countDistinct("family").alias("n_families"), F.countDistinct("primary_signal").alias("n_signals"),
        F.countDistinct("rec_purpose").alias("n_purposes"), F.sum("is_house_brand").alias("n_house_brand"),
        F.sum(flag(F.col("primary_signal") == "replenishment")).alias("n_replenishment"),
        F.sum(flag(F.col("specialty_match") == "match")).alias("n_match"),
        F.sum(flag(F.col("specialty_match") == "mismatch")).alias("n_mismatch"))
    for c in ("family", "category"):
        own = mine.select("cust_id", c).distinct().withColumn("_o", F.lit(1))
        overlap = recs.select("cust_id", c).distinct().join(own, ["cust_id", c], "left").groupBy("cust_id").agg(
            half_up(F.avg(F.coalesce("_o", F.lit(0))) * 100, 1).alias(f"{c}_overlap_pct"))
        out = out.join(overlap, "cust_id")
    n = history.groupBy("cust_id").agg(F.count(F.lit(1)).alias("n_history"))
    out = out.join(n, "cust_id", "left").fillna(0, ["n_history"]).join(patterns.select("cust_id", "is_cold_start"), "cust_id", "left")
    return out.withColumn("specialty_breach", flag((F.col("n_history") >= rich) & (F.col("n_mismatch") > 0)
                                                   & (F.coalesce("is_cold_start", F.lit(1)) == 0))).drop("is_cold_start")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
