"""Thresholds of every operator. The defaults are fixed values of the business rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Labels and orderings used in the outputs.
SIZE_TIERS = ("new", "small", "mid", "large", "enterprise")
SIGNALS = (
    "peer_gap", "popularity", "cart_complement", "item_similarity",
    "lapsed_recovery", "replenishment", "competitor_conversion", "private_brand_upgrade",
)
SIGNAL_PURPOSE = {
    "peer_gap": "new_product",
    "cart_complement": "new_product",
    "popularity": "new_product",
    "lapsed_recovery": "win_back",
    "replenishment": "replenishment",
    "item_similarity": "cross_sell",
    "competitor_conversion": "house_brand_substitute",
    "private_brand_upgrade": "house_brand_substitute",
}
SIGNAL_QUOTA = {
    "competitor_conversion": 2,
    "private_brand_upgrade": 2,
    "lapsed_recovery": 2,
    "replenishment": 3,
    "cart_complement": 3,
    "item_similarity": 2,
    "peer_gap": 4,
    "popularity": 10,
}
BACKFILL_SIGNALS = (
    "peer_gap", "cart_complement", "popularity",
    "item_similarity", "lapsed_recovery", "replenishment",
)
EXCLUDED_FAMILIES = ("Fee", "Unknown", "NaN", "nan", "")
REJECTION_REASONS = (
    "not_relevant", "already_have", "out_of_stock", "price_too_high",
    "wrong_size_or_spec", "different_brand", "bad_timing", "wrong_recommendation", "other",
)
MARKET_NAMES = {
    "PO": "Physician Office", "LTC": "Long-Term Care", "SC": "Surgery Center",
    "HC": "Home Care", "LC": "Lab / Diagnostics", "AC": "Acute Care",
}
SIZE_NAMES = {
    "new": "New Customer", "small": "Small", "mid": "Mid-Market",
    "large": "Large", "enterprise": "Enterprise",
}
SEGMENT_WEIGHTS = {
    "new": (2.0, 1.0), "small": (2.0, 3.0), "mid": (2.5, 2.5),
    "large": (3.0, 2.0), "enterprise": (3.5, 1.5),
}


@dataclass(frozen=True)
class CleaningParams:
    blocked_orders: tuple = ("61408700", "61737401", "35996955")
    line_cap: float = 10_000_000.0
    tier1_customers: int = 1000
    tier2_customers: int = 10
    state_min_customers: int = 500


@dataclass(frozen=True)
class SizeParams:
    spend: tuple = (500.0, 2500.0, 15000.0)
    volume: tuple = (1600.0, 9050.0, 92500.0)
    min_active_months: int = 2
    ceiling: dict = field(default_factory=lambda: {
        "new": 3.0, "small": 1.5, "mid": 1.8, "large": 2.0, "enterprise": 2.5})
    rule: str = "max_one"  # or "pure_2d", "spend_only"


@dataclass(frozen=True)
class SupplierParams:
    competitor_share: float = 0.5
    private_share: float = 0.5


@dataclass(frozen=True)
class PatternParams:
    frequent_days: int = 14
    regular_days: int = 45
    lapsed_months: int = 6
    peer_months: int = 6
    alive_rate: float = 0.30
    overdue: float = 1.5
    segment_buyers: int = 10
    segment_repeat: int = 5
    decline_base: float = 100.0
    cold_products: int = 5


@dataclass(frozen=True)
class FamilyRuleParams:
    min_support: float = 0.03
    min_confidence: float = 0.20
    window_days: int = 90
    min_segment: int = 50
    top_rules: int = 30
    top_sequences: int = 20


@dataclass(frozen=True)
class PairParams:
    min_buyers: int = 50
    min_together: int = 20
    min_lift: float = 1.5
    min_support: float = 0.0001
    top_pairs: int = 20
    sim_top: int = 50
    min_similarity: float = 0.05
    price_band: float = 0.30
    max_equivalents: int = 3
    wide_basket: int = 2000  # baskets and customers above this take the bounded route


@dataclass(frozen=True)
class ProductParams:
    min_buyers: int = 50
    recent_days: int = 180
    top_segments: int = 3
    specialty_top: int = 5
    specialty_share: float = 0.05


@dataclass(frozen=True)
class EngineParams:
    top_n: int = 10
    per_signal: int = 20
    pool: int = 50
    family_pool: int = 100
    peer_adoption: float = 0.30
    min_buyers: int = 50
    grace: float = 1.2
    ceiling_floor: float = 100.0
    recency_months: float = 6.0
    match_boost: float = 1.2
    mismatch_penalty: float = 0.7
    universal_hhi: float = 0.30
    market_share: float = 0.30
    size_share: float = 0.25
    cart_lift: float = 2.0
    cart_top: int = 15
    cart_history: int = 50
    sim_min: float = 0.10
    sim_top: int = 15
    sim_history: int = 30
    lapsed_qty: float = 2.0
    lapsed_top: int = 10
    repl_top: int = 10
    overdue_cap: float = 5.0
    swap_top: int = 5
    mismatch_history: int = 10


@dataclass(frozen=True)
class EvalParams:
    holdout_days: int = 60
    top_n: int = 10
    popular_pool: int = 100
    carts: int = 100
    cart_lines: int = 4
    cart_lift: float = 1.5
    cart_support: float = 0.0001


@dataclass(frozen=True)
class ModelParams:
    """Everything the derived tables depend on besides the role tables."""
    markets: tuple = ("PO", "LTC", "SC", "LC", "HC", "AC")
    competitors: tuple = ()
    excluded_families: tuple = EXCLUDED_FAMILIES
    cleaning: CleaningParams = field(default_factory=CleaningParams)
    size: SizeParams = field(default_factory=SizeParams)
    supplier: SupplierParams = field(default_factory=SupplierParams)
    patterns: PatternParams = field(default_factory=PatternParams)
    patterns_item: PatternParams = field(default_factory=PatternParams)
    pairs: PairParams = field(default_factory=PairParams)
    products: ProductParams = field(default_factory=ProductParams)
    engine: EngineParams = field(default_factory=EngineParams)
