import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))


def brute(rows):
    """rows: distinct (id, label, integer vector)"""
    dot = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, label, w in rows:
        if i % 100:
            continue
        scored = [(-dot(w, v), j, m) for j, m, v in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted((t, j) for t, j, m in scored if m != label and -80 * s <= -100 * t <= -100 * s)[:5]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def answer(df):
    return sorted((x.anchor_id, x.positive_id, x["rank"], x.negative_id, x.positive_score, x.negative_score) for x in df.collect())


def whole(rows, scale=256):
    return [(i, (m + 1) % 10 if i % 7 == 0 else m, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, m in rows]


@pytest.mark.parametrize("limits", [{}, {"cells": 256, "block_rows": 40, "reference_count": 4, "sample": 50}])
def test_equals_brute_force(spark, limits):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8))
    rows = [(i, (centres[r.integers(12)] * r.uniform(0.2, 1) + r.normal(size=8) * r.choice([0.05, 0.5])).tolist(), int(r.integers(0, 4))) for i in range(600)]
    rows += [(600 + i, rows[100][1], 1 + i % 2) for i in range(250)]  # a group of copies, ties everywhere
    rows += [(900 + i, [0.0] * 8, 1) for i in range(20)]
    got = answer(hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, label(), **limits))
    assert got == brute(whole(rows)) and len(got) > 100


def test_bounds_hold_and_filter():
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 32)) * 300
    w = np.floor(np.repeat(centres, 100, axis=0) + r.normal(size=(2000, 32)) * 30).astype(np.int64)
    x = w / np.linalg.norm(w, axis=1, keepdims=True)
    points = x[::100]
    norms, angles, nearest = hn._described(w, points)
    order = np.lexsort((angles[np.arange(2000), nearest], nearest))

    class Row:
        pass
    row = Row()
    for name, a in {"ids": np.arange(2000), "rows": np.arange(2000), "labels": np.zeros(2000, np.int64), "weights": w[order], "norms": norms[order],
                    "angles": angles[order], "nearest": nearest[order].astype(np.int32)}.items():
        setattr(row, name, np.ascontiguousarray(a).tobytes())
    row.n, row.terms = 2000, 32
    b = hn.Block(row)
    scored = 0
    for at in range(0, 2000, 50):
        truth = b.scores(np.arange(2000), b, at)
        low, high = b.bounds(np.arange(2000), b, at)
        assert (low <= truth).all() and (truth <= high).all()
        least = float(np.sort(truth)[-20])
        some = b.reach(b, at, least)
        assert set(np.flatnonzero(truth >= least)) <= set(some)
        scored += (b.bounds(some, b, at)[1] >= least).sum()
    assert scored < 0.2 * 40 * 2000  # groups are told apart


def test_odd_rows(spark, odd_vectors, no_vectors):
    assert hn.mine(no_vectors.withColumn("label", F.lit(1)), F.col("vec_id") % 100 == 0, label()).count() == 0
    odd = odd_vectors.unionByName(spark.createDataFrame([(100, [0.5, 0.5, 0.0], None, "q"), (200, [0.9] * 40, 3, "q"), (201, [0.8] * 41, 3, "q"),
                                                         (202, [0.85] * 2000, 4, "q"), (0, [0.5, 0.5], 2, "r"), (203, [0.7, 0.6], 2, "r")], odd_vectors.schema))
    rows = [(x.vec_id, x.embedding, x.label) for x in odd.collect()]
    some = [x for x in rows if x[0] is not None and x[2] is not None and x[1] and all(v is not None and np.isfinite(v) for v in x[1])]
    distinct = sorted({(i, m, tuple(w)) for i, m, w in whole(some)})
    names = odd.withColumns({"row": F.lit(1), "kind": F.lit("k"), "weights": F.lit(0.5)})
    assert answer(hn.mine(names, F.col("vec_id") % 100 == 0, label(), cells=128)) == brute(distinct)


def test_huge_components(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([1e30, 3e15, 1.0]) * r.random() for _ in range(3)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    most = 2 ** 63 - 1
    w = [(i, (m + 1) % 10 if i % 7 == 0 else m, [min(most, int(np.floor(256 * x))) for x in v]) for i, v, m in rows]
    assert answer(hn.mine(df, F.col("vec_id") % 100 == 0, label())) == brute(w)
