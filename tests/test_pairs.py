"""Pair mining against brute force, on the plain and on the wide-group route."""

import math
import random
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import combinations

import pandas as pd
import pytest

from orderlens.operators import pairs as pa
from orderlens.params import PairParams


def baskets(seed=3):
    r = random.Random(seed)
    rows = set()
    for b in range(60):
        for i in r.sample(range(30), r.randint(1, 5)):
            rows.add((b, i))
    for b in (100, 101, 102):  # wide baskets hold a third of all rows
        for i in r.sample(range(30), 28):
            rows.add((b, i))
    return sorted(rows)


@pytest.mark.parametrize("wide,together", [(10**6, 3), (20, 3), (20, 2), (20, 5)])
def test_pair_counts(spark, wide, together, monkeypatch):
    monkeypatch.setattr(pa, "BLOCK", 7)  # wide groups are cut into blocks
    rows = baskets()
    per = defaultdict(set)
    for b, i in rows:
        per[b].add(i)
    want = Counter(p for s in per.values() for p in combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, "basket long, item_id long")
    p = PairParams(min_together=together, wide_basket=wide)
    got = {(r.item_a, r.item_b): r.n_together for r in pa.pair_counts(df, p).collect()}
    assert got == {k: n for k, n in want.items() if n >= together}


def test_lift_is_symmetric_and_topk_bounded(spark):
    df = spark.createDataFrame(baskets(), "basket long, item_id long")
    p = PairParams(min_together=2, min_lift=0.0, min_support=0.0, top_pairs=4)
    pairs = pa.cooccurrence(df, p)
    n = len({b for b, _ in baskets()})
    for r in pairs.collect():
        assert math.isclose(r.lift, round(r.n_orders_together * n / (r.n_orders_a * r.n_orders_b), 6), abs_tol=2e-6)
    top = pa.directional_topk(pairs, 4).collect()
    ranks = defaultdict(list)
    for r in top:
        ranks[r.product_a].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 4 for v in ranks.values())


@pytest.mark.parametrize("wide", [10**6, 15])
def test_similarity(spark, wide, monkeypatch):
    monkeypatch.setattr(pa, "BLOCK", 5)
    r = random.Random(5)
    rows = [(c, i, r.randint(1, 6)) for c in range(25) for i in r.sample(range(20), 4)]
    rows += [(c, i, r.randint(1, 6)) for c in (100, 101) for i in range(20)]
    rows += [(200, i, 2) for i in range(4)]  # identical counts: zero after centring
    means = defaultdict(list)
    for c, i, n in rows:
        means[c].append(math.log1p(n))
    vec = defaultdict(dict)
    for c, i, n in rows:
        vec[i][c] = math.log1p(n) - sum(means[c]) / len(means[c])
    unit = {}
    for i, v in vec.items():
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[i] = {c: x / norm for c, x in v.items()}
    want = {}
    for a, b in combinations(sorted(unit), 2):
        s = sum(x * unit[b].get(c, 0.0) for c, x in unit[a].items())
        if round(s, 6) >= 0.05:
            want[a, b] = round(s, 5)
    ci = spark.createDataFrame(rows, "cust_id long, item_id long, line_count long")
    w = pa.centred_weights(ci, 1)
    got = {(x.item_a, x.item_b): round(x.similarity, 5)
           for x in pa.item_similarity(w, replace(PairParams(), wide_basket=wide)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_similarity_does_not_depend_on_the_switch(spark):
    # a pair whose cosine is under the minimum by less than rounding, shared by wide and narrow customers
    r = random.Random(3)
    rows = [(0, i, r.randint(1, 9)) for i in range(60)] + [(c, i, r.randint(1, 9)) for c in range(1, 200) for i in r.sample(range(60), 2)]
    w = pa.centred_weights(spark.createDataFrame(rows, "cust_id long, item_id long, line_count long"), 1).cache()
    unit = defaultdict(dict)
    for x in w.collect():
        unit[x.item_id][x.cust_id] = x.x
    dots = sorted(sum(x * unit[b].get(c, 0.0) for c, x in unit[a].items()) for a, b in combinations(sorted(unit), 2))
    low = next(d for d in dots if d > 0.05 and round(d, 6) > d + 5e-8)  # rounds up to the minimum
    found = [{(x.item_a, x.item_b, x.similarity) for x in pa.item_similarity(
        w, replace(PairParams(), min_similarity=round(low, 6), wide_basket=n)).collect()} for n in (1, 50, 10**9)]
    assert found[0] == found[1] == found[2] and min(s for _, _, s in found[0]) == round(low, 6)


def test_bounded_pairs_list_those_that_can_reach_the_minimum(spark):
    r = random.Random(4)
    rows = [(c, i, 2 ** -r.uniform(0, 6)) for c in range(3) for i in range(400)] + [(3, 1, 1.0), (3, 2, 0.05), (3, 3, 0.0499)]
    floor = 0.05
    frame = spark.createDataFrame(rows, "cust_id long, item_id long, h double")
    listed = [(x.cust_id, x.item_a, x.item_b) for x in pa.bounded_half_pairs(frame, "cust_id", "h", floor, ["h"]).collect()]
    of = {(c, i): h for c, i, h in rows}
    pairs = [(c, a, b) for c in range(4) for a, b in combinations(sorted(i for d, i in of if d == c), 2)]
    can = {(c, a, b) for c, a, b in pairs if of[c, a] * of[c, b] >= floor}
    assert len(listed) == len(set(listed)) and can <= set(listed)
    assert all(of[c, a] * of[c, b] >= floor * 2 ** -0.26 for c, a, b in listed)
    assert len(listed) < 0.5 * len(pairs)


def test_key_matches_count_the_join(spark):
    df = catalogue(spark, [(1, 10.0, 60, 0, 0), (2, 9.0, 1, 0, 0), (3, 5.0, 60, 1, 0), (4, 4.0, 60, 1, 0), (5, 1.0, 60, 1, 1)])
    assert {tuple(x) for x in pa.key_matches(df).collect()} == {(1, 2, 4.0), (2, 2, 4.0)}


def catalogue(spark, rows):
    cols = ("item_id long, median_unit_price double, n_buyers long, is_private_brand int, is_competitor int, item_dsc string, "
            "supplier string, family string, matching_category string, product_type string, form_code string")
    return spark.createDataFrame([(i, p, n, pb, co, "d", "s", "F", "C", "T", "") for i, p, n, pb, co in rows], cols)


def test_upgrades_keep_the_price_band(spark):
    alt = [(10, 10.0), (11, 7.0), (12, 6.9), (13, 10.1), (14, 25.0), (15, 8.5)]
    df = catalogue(spark, [(1, 10.0, 60, 0, 0)] + [(i, p, 60, 1, 0) for i, p in alt])
    got = pa.brand_upgrades(df, PairParams(max_equivalents=9)).collect()
    assert {r.equivalent_item: r.price_delta_pct for r in got} == {10: 0.0, 11: -0.3, 15: -0.15}


def test_conversions_equal_brute_force(spark):
    r = random.Random(9)
    own = [(100 + i, round(r.uniform(1, 30), 2), r.choice([50, 60, 70]), r.randint(0, 1), 0) for i in range(60)]
    comp = [(i, round(r.uniform(1, 30), 2), 80, 0, 1) for i in range(12)]
    got = defaultdict(list)
    for x in pa.competitor_conversions(catalogue(spark, own + comp), PairParams()).orderBy("original_item", "rank").collect():
        got[x.original_item].append(x.equivalent_item)
    for i, p, *_ in comp:
        def score(o):
            delta = round((o[1] - p) / p, 6)
            return round(2.0 * o[3] - max(-1, min(1, delta)) + math.log1p(o[2]) / 10, 6)
        want = sorted(own, key=lambda o: (-score(o), o[1], o[0]))[:3]
        assert got[i] == [o[0] for o in want]


@pytest.mark.parametrize("k,cheap_are_popular", [(1, False), (3, False), (3, True)])
def test_upgrades_equal_brute_force_and_meet_few(spark, k, cheap_are_popular):
    r = random.Random(k)
    price = lambda: r.choice([round(r.uniform(5, 30), 2), 10.0, 7.0])
    own = [(1000 + i, price(), r.randint(50, 400)) for i in range(400)]
    if cheap_are_popular:
        own = [(i, q, int(4000 / q)) for i, q, _ in own]
    own += [(2000 + i, q, 60_000 + i % 3) for i, q in enumerate([9.0, 9.0, 9.0, 9.5, 9.5])] + own[:3]  # more buyers than a score tells apart, rows twice
    national = [(i, price(), 80) for i in range(60)]
    df = catalogue(spark, [(*x, 0, 0) for x in national] + [(*x, 1, 0) for x in own])
    got = defaultdict(list)
    for x in pa.brand_upgrades(df, PairParams(max_equivalents=k)).orderBy("original_item", "rank").collect():
        got[x.original_item].append((x.equivalent_item, x.price_delta_pct, x.score))
    for i, q, _ in national:
        found = [(e, round((x - q) / q, 6), b) for e, x, b in own]
        want = sorted((-round(-2.0 * d + math.log1p(b) / 10, 6), e, d) for e, d, b in found if -0.3 <= d <= 0)[:k]
        assert [(e, d) for _, e, d in want] == [x[:2] for x in got[i]]


def rivals(rows, private=None):
    return pd.DataFrame([(i, q, b, 1 if private is None else private[n], True) for n, (i, q, b) in enumerate(rows)],
                        columns=["equivalent_item", "equivalent_price", "equivalent_buyers", "equivalent_private", "_own"])


def test_alternatives_that_cannot_win_meet_no_original():
    r = random.Random(1)
    rows = [(i, r.uniform(10, 14), r.randint(50, 5000)) for i in range(2000)]
    ranges = [(q, x) for q, x in pa._kth_rival(rivals(rows), 3)[["equivalent_price", "_rival"]].itertuples(index=False)]
    for original in (14.0, 14.5, 15.0):  # all 2000 are in the band of the first
        assert sum(q >= 0.7 * original and not x >= 0.7 * original for q, x in ranges) < 60
    left = pa._unbeaten(rivals(rows, [r.randint(0, 1) for _ in rows]), 3)
    assert 3 <= len(left) < 100


@pytest.mark.parametrize("k", [1, 3])
def test_conversions_with_rows_twice_and_null_flags(spark, k):
    r = random.Random(k)
    own = [(100 + i, float(r.randint(1, 12)), r.randint(50, 300), r.choice([0, 1]), 0) for i in range(150)]
    own += own[:5] + [(900 + i, 0.5, 900, None, 0) for i in range(3)]
    comp = [(i, float(r.randint(1, 12)), 80, 0, 1) for i in range(10)]
    got = defaultdict(list)
    for x in pa.competitor_conversions(catalogue(spark, own + comp), PairParams(max_equivalents=k)).orderBy("original_item", "rank").collect():
        got[x.original_item].append(x.equivalent_item)
    for i, p, *_ in comp:
        def score(o):
            return round(2.0 * o[3] - max(-1, min(1, round((o[1] - p) / p, 6))) + math.log1p(o[2]) / 10, 6)
        want = sorted((o for o in own if o[3] is not None), key=lambda o: (-score(o), o[1], o[0]))[:k]
        assert got[i] == [o[0] for o in want]
