"""The derived tables, wired once: every table is a lazy step over the role tables.

Tables that several later steps read are written once (``session.stage``), as the
batch they stand for would; everything else stays one declarative plan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour as bh
from ..operators import combine as cb
from ..operators import customers as cu
from ..operators import joins
from ..operators import pairs as pa
from ..operators import products as pr
from ..operators import signals as sg
from ..operators import evaluation as ev
from ..operators.evaluation import before_holdout
from ..params import SIGNALS, SIZE_TIERS, EvalParams, ModelParams
from ..session import stage, stage_observed, stage_parts
from . import driver_tables as d


LINES = 10_000_000  # up to which two tables are written at once
CUSTOMERS = 400_000  # whose candidates of a signal are listed at once, at most


class Model:
    _shared: dict[tuple[str, str], Model] = {}

    def __init__(self, sales: DataFrame, customers: DataFrame, items: DataFrame, reuse: bool = True,
                 params: ModelParams = ModelParams(), coarse_items: DataFrame | None = None):
        """``coarse_items`` maps items to the grain of the coarse cadence; without it items are taken as they are."""
        self._sales, self.customers, self.items, self.reuse, self.params = sales, customers, items, reuse, params
        self.observed: dict[str, dict] = {}
        self._coarse_items = items.select("item_id", F.col("item_id").alias("coarse_id")) if coarse_items is None else coarse_items

    @classmethod
    def from_folder(cls, spark: SparkSession, sf_dir: str) -> Model:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._shared:
            items = d.items(spark, sf_dir)
            cls._shared[key] = cls(d.sales(spark, sf_dir), d.customers(spark, sf_dir), items, params=d.PARAMS,
                                   coarse_items=d.coarse_items(items))
        return cls._shared[key]

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name) if self.reuse else df

    def _watched(self, df: DataFrame, name: str) -> DataFrame:
        """A stored table whose size and shares are noted in ``observed`` as it is written; tables that are not stored are asked."""
        metrics = ev.table_metrics(df, self.params)
        if self.reuse:
            table, self.observed[name] = stage_observed(df, name, metrics)
            return table
        self.observed[name] = df.agg(*[v.alias(k) for k, v in metrics.items()]).head().asDict()
        return df

    @cached_property
    def sales(self) -> DataFrame:
        return self._watched(self._sales, "sales")

    @cached_property
    def merged(self) -> DataFrame:
        return joins.star_join(self.sales, self.customers, self.items)

    @cached_property
    def eligible(self) -> DataFrame:
        return joins.eligible_lines(self.item_lines, self.params.excluded_families, self.params.competitors)

    @cached_property
    def item_lines(self) -> DataFrame:
        return joins.with_items(self.sales, self.items)

    @cached_property
    def specialty_tiers(self) -> DataFrame:
        stats = cu.specialty_stats(self.sales, self.customers)
        return stats.withColumn("specialty_tier", cu.specialty_tier("unique_customers", self.params.cleaning))

    @cached_property
    def features(self) -> DataFrame:
        return self._watched(cu.customer_features(self.sales, self.item_lines, self.customers, self.params.competitors, self.params.size, self.params.supplier),
                             "customer_features")

    @cached_property
    def segments(self) -> DataFrame:
        return cu.assign_segments(self.features, self.params.markets)

    @cached_property
    def latest(self) -> DataFrame:
        return bh.newest_date(self.sales)

    @cached_property
    def cust_items(self) -> DataFrame:
        pairs = pr.min_buyers(pr.cust_item_agg(self.eligible), self.params.products.min_buyers)
        return self._keep(pr.with_context(pairs, self.segments, self.features), "cust_items")

    @cached_property
    def product_features(self) -> DataFrame:
        return self._keep(pr.product_features(
            self.cust_items, self.latest, self.items, self.segments, (*self.params.markets, "OTHER"), SIZE_TIERS, self.params.products),
            "product_features")

    @cached_property
    def product_specialty(self) -> DataFrame:
        return self._keep(pr.product_specialty(self.cust_items, self.params.products), "product_specialty")

    @cached_property
    def pattern_lines(self) -> DataFrame:
        return joins.eligible_lines(self.item_lines, self.params.excluded_families)

    @cached_property
    def lapsed(self) -> DataFrame:
        return self._keep(bh.lapsed_products(self.pattern_lines, self.latest, self.params.patterns), "lapsed")

    @cached_property
    def patterns(self) -> DataFrame:
        lines = self.pattern_lines
        return self._keep(bh.customer_patterns(
            bh.order_cadence(lines, self.params.patterns), bh.activity_trend(lines, self.latest, self.params.patterns),
            bh.portfolio(lines, self.lapsed), self.segments, self.params.patterns), "customer_patterns")

    @cached_property
    def coarse_cadence(self) -> DataFrame:
        """Personal cadence at the coarse item grain, where repeats are common."""
        lines = self.pattern_lines.join(self._coarse_items, "item_id").withColumn("item_id", F.col("coarse_id"))
        return self._keep(bh.personal_cadence(lines), "coarse_cadence")

    @cached_property
    def item_cadence(self) -> DataFrame:
        return self._keep(bh.personal_cadence(self.pattern_lines), "item_cadence")

    @cached_property
    def replenishment(self) -> DataFrame:
        cadence = bh.segment_cadence(self.item_cadence, self.segments, self.latest, self.params.patterns_item)
        return self._keep(bh.replenishment_candidates(
            self.item_cadence, cadence, self.segments, self.latest, self.params.patterns_item), "replenishment")

    @cached_property
    def family_firsts(self) -> DataFrame:
        return self._keep(bh.first_family_dates(self.eligible, self.segments), "family_firsts")

    @cached_property
    def family_profile(self) -> DataFrame:
        return self._keep(bh.segment_family_profile(self.eligible, self.segments), "family_profile")

    @cached_property
    def baskets(self) -> DataFrame:
        return self._keep(pa.weekly_baskets(self.eligible, self.params.pairs.min_buyers), "baskets")

    @cached_property
    def cooccurrence(self) -> DataFrame:
        return self._keep(pa.cooccurrence(self.baskets, self.params.pairs), "cooccurrence")

    @cached_property
    def product_pairs(self) -> DataFrame:
        top = pa.directional_topk(self.cooccurrence, self.params.pairs.top_pairs)
        return self._keep(joins.describe_pairs(top, self.items, "product_a", "product_b"), "product_pairs")

    @cached_property
    def weights(self) -> DataFrame:
        return self._keep(pa.centred_weights(pr.cust_item_agg(self.eligible), self.params.pairs.min_buyers), "weights")

    @cached_property
    def similarity(self) -> DataFrame:
        return self._keep(pa.similar_topn(pa.item_similarity(self.weights, self.params.pairs), self.params.pairs.sim_top), "similarity")

    @cached_property
    def match_catalogue(self) -> DataFrame:
        economics = pr.product_economics(self.item_lines, self.params.competitors, self.params.excluded_families)
        return self._keep(pa.match_catalogue(pr.parsed_items(self.items), economics), "match_catalogue")

    @cached_property
    def equivalents(self) -> DataFrame:
        return self._keep(pa.equivalents_union(
            pa.brand_upgrades(self.match_catalogue, self.params.pairs),
            pa.competitor_conversions(self.match_catalogue, self.params.pairs)), "equivalents")

    @cached_property
    def profile(self) -> DataFrame:
        return self._keep(sg.customer_profile(self.segments, self.features, self.patterns), "profile")

    @cached_property
    def history(self) -> DataFrame:
        return self._keep(sg.purchase_history(self.sales), "history")

    @cached_property
    def engine_products(self) -> DataFrame:
        return self._keep(sg.eligible_products(self.product_features, self.params.engine), "engine_products")

    def signal(self, name: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
        """``part``: which slice of the customers, by a hash, and of how many; a customer's rows do not depend on others."""
        p, e = self.params.engine, (self.engine_products, self.product_specialty)
        mine = lambda df: df if part[1] == 1 else df.filter(F.pmod(F.xxhash64("cust_id"), F.lit(part[1])) == part[0])
        profile, history = mine(self.profile), mine(self.history)
        return {
            "peer_gap": lambda: sg.peer_gap(profile, self.family_profile, *e, history, p),
            "popularity": lambda: sg.popularity_recs(
                profile, *e, history, (*self.params.markets, "OTHER"), SIZE_TIERS, p),
            "cart_complement": lambda: sg.cart_complement(profile, self.product_pairs, *e, history, p),
            "item_similarity": lambda: sg.item_similarity(profile, self.similarity, *e, history, p),
            "lapsed_recovery": lambda: sg.lapsed_recovery(profile, mine(self.lapsed), *e, p),
            "replenishment": lambda: sg.replenishment(profile, mine(self.replenishment), *e, p),
            "competitor_conversion": lambda: sg.competitor_conversion(profile, self.equivalents, *e, history, p),
            "private_brand_upgrade": lambda: sg.brand_upgrade(profile, self.equivalents, *e, history, p),
        }[name]()

    # Stored tables by depth: those of one line need only tables of the lines before.
    WAVES = (
        ("sales",),
        ("features", "lapsed", "item_cadence", "match_catalogue", "history", "baskets", "weights"),
        ("cust_items", "patterns", "replenishment", "family_profile", "cooccurrence", "similarity", "equivalents"),
        ("product_features", "product_specialty", "product_pairs", "profile"),
        ("engine_products",),
    )

    def prepare(self) -> None:
        """Write the stored tables, independent ones as concurrent Spark jobs, so that short
        stages of one table do not leave the cluster idle. At most two at a time: each holds a plan and its
        threads in the driver, and what it shuffles on disk. Many lines fill the cluster with one."""
        for wave in self.WAVES:
            todo = [n for n in wave if n not in self.__dict__]
            few = int(self.observed.get("sales", {}).get("n_rows", 0)) <= LINES
            with ThreadPoolExecutor(max_workers=2 if few else 1) as pool:
                list(pool.map(lambda n: getattr(self, n), todo))

    def _stored_signal(self, name: str) -> DataFrame:
        if not self.reuse or name in ("peer_gap", "popularity"):  # whose offers are scored by cell, not by customer
            return self._keep(self.signal(name), f"signal_{name}")
        n = max(1, -(-int(self.observed["customer_features"]["n_rows"]) // CUSTOMERS))
        return stage_parts([self.signal(name, (i, n)) for i in range(n)], f"signal_{name}")

    @cached_property
    def signals(self) -> list[DataFrame]:
        """Each signal is written by itself, and slice by slice of the customers: one plan of all eight is more than a small
        driver should hold, and would keep what all of them shuffle on disk at once."""
        self.prepare()
        return [self._stored_signal(s) for s in SIGNALS]

    @cached_property
    def _recommendations(self) -> DataFrame:
        return self._keep(cb.recommendations(self.signals, self.profile, self.product_features, self.params.engine), "recommendations")

    def recommendations(self) -> DataFrame:
        """The flagship table: an explained top-10 per customer."""
        return self._recommendations

    def before_holdout(self, p: EvalParams) -> Model:
        """The same tables built from the lines before the holdout only."""
        if "_past" not in self.__dict__:
            self._past = Model(before_holdout(self.sales, p), self.customers, self.items, self.reuse, self.params, self._coarse_items)
        return self._past
