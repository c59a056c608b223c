import random

import pytest

from orderlens.operators import signals as sg
from orderlens.params import EngineParams


@pytest.mark.parametrize("k", [1, 3, 20])
def test_walk_equals_the_full_fan_out(spark, tmp_path, k):
    r = random.Random(k)
    cells = ["x", "y", "z"]
    offers = {c: [(i, r.choice([None, *range(1, 40)]), float(r.randint(1, 25))) for i in range(120 if c == "x" else 7)] for c in cells}
    customers = [(n, r.choice(cells), float(r.randint(0, 50)), r.sample(range(120), r.choice([0, 0, 2, 60])) or None) for n in range(200)]
    p = EngineParams()
    o = spark.createDataFrame([(c, i, float(q) if q is not None else None, s, "sig", "high", 0.0, "neutral") for c, rows in offers.items() for i, q, s in rows],
                              "cell string, item_id long, buyer_affordability_p10 double, numeric_score double, primary_signal string, "
                              "confidence_tier string, peer_adoption_rate double, specialty_match string")
    spark.createDataFrame(customers, "cust_id long, cell string, affordability_ceiling double, own array<long>").write.parquet(str(tmp_path / "c"))
    rows = sg.walk(spark.read.parquet(str(tmp_path / "c")), o, ["cell"], k, p).collect()
    got = {}
    for x in rows:
        got.setdefault(x.cust_id, []).append((-x.numeric_score, x.item_id))
    for n, c, ceiling, own in customers:
        limit = max(ceiling, p.ceiling_floor) * p.grace
        want = sorted((-s, i) for i, q, s in offers[c] if q is not None and q <= limit and i not in (own or []))[:k]
        assert sorted(got.get(n, [])) == want
