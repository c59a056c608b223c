from collections import Counter, defaultdict

import pytest

from orderlens.operators import combine as cb
from orderlens.params import BACKFILL_SIGNALS, SIGNAL_QUOTA, EngineParams

P = EngineParams()
COLS = ("cust_id long, item_id long, primary_signal string, confidence_tier string, numeric_score double, "
        "peer_adoption_rate double, specialty_match string")


def rows(cust, signal, n, start=0, match="neutral"):
    return [(cust, start + i, signal, "medium", 1.0 + (start + i) * 0.01 + cust * 0.001, 0.0, match) for i in range(n)]


@pytest.fixture(scope="module")
def combined(spark):
    data = (rows(1, "peer_gap", 3) + rows(2, "peer_gap", 12) + rows(2, "cart_complement", 6, 100) + rows(2, "lapsed_recovery", 5, 200)
            + rows(3, "private_brand_upgrade", 5, 300) + rows(3, "competitor_conversion", 5, 400)
            + rows(4, "peer_gap", 2, match="mismatch") + rows(4, "item_similarity", 1, 50))
    data += [(5, 7, "replenishment", "medium", 2.0, 0.0, "neutral"), (5, 7, "peer_gap", "medium", 2.0, 0.0, "neutral")]
    df = spark.createDataFrame(data, COLS)
    profile = spark.createDataFrame([(c, 50) for c in range(1, 6)], "cust_id long, n_unique_products_total int")
    out = defaultdict(list)
    for r in cb.combine([df], profile, P).orderBy("cust_id", "rank").collect():
        out[r.cust_id].append(r)
    return out


def test_ranks_have_no_gaps_and_items_are_unique(combined):
    for recs in combined.values():
        assert [r["rank"] for r in recs] == list(range(1, len(recs) + 1)) and len(recs) <= P.top_n
        assert len({r.item_id for r in recs}) == len(recs)


def test_short_list_stays_whole(combined):
    assert len(combined[1]) == 3


def test_quota_then_backfill(combined):
    n = Counter(r.primary_signal for r in combined[2])
    assert sum(n.values()) == 10
    # 4 + 3 + 2 within the quotas, and one more from a backfill signal
    assert n["peer_gap"] + n["cart_complement"] + n["lapsed_recovery"] == 10
    assert all(n[s] >= SIGNAL_QUOTA[s] for s in n)


def test_signals_without_backfill_stop_at_their_quota(combined):
    n = Counter(r.primary_signal for r in combined[3])
    assert n == {"private_brand_upgrade": 2, "competitor_conversion": 2}
    assert not set(n) & set(BACKFILL_SIGNALS)


def test_mismatch_dropped_for_rich_history(combined):
    assert [r.primary_signal for r in combined[4]] == ["item_similarity"]


def test_equal_scores_go_to_the_earlier_signal(combined):
    assert [r.primary_signal for r in combined[5]] == ["peer_gap"]
