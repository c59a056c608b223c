import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orderlens.llm import components as cc
from orderlens.llm import pivots, topk, url_filter


def test_top_k_equals_brute_force(spark, no_vectors):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, r.gauss(0, 0.2)]) for _ in range(12)]) for i in range(300)] + [(300 + i, [0.5] * 12) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block_rows=50).collect()}
    q = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    for i in range(0, 360, 20):
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:20]
        assert [got[i, n + 1] for n in range(20)] == [(j, -s) for s, j in best]
    assert topk.top_k(no_vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_on_odd_vectors(odd_vectors):
    rows = topk.top_k(odd_vectors, F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for x in sorted(rows, key=lambda x: (x.query_id, x["rank"])):
        by.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert by[0][:2] == [(1, 4096), (2, 3840)] and {v for v, _ in by[0]} == {1, 2, 5, 9, 10, 20}
    assert set(by) == {0, 20}


def brute(rows):
    ids = [i for i, v in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    return ids, a, b


def test_pivot_index_recall_and_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + rng.normal(size=32) * rng.choice([0.05, 0.2, 2.0])).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(400)]  # a large group of copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {x.vec_id: x for x in pivots.near_duplicates(df, block_rows=128).collect()}
    ids, a, b = brute(rows)
    want = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
    links = np.array([got[i].n_links for i in ids])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    root = cc.local_roots(len(ids), a, b)
    same = np.mean([got[i].component_id == ids[root[k]] for k, i in enumerate(ids)])
    assert same > 0.95 and all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def dense(n, dims=64, seed=8):
    """One group with a third of all vectors (pair cosines about 0.9 to 1), the rest far apart or in small groups."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dims)
    x = rng.normal(size=(n, dims))
    m = n // 3
    x[:m] = base + rng.normal(size=(m, dims)) * rng.uniform(0.05, 0.33, (m, 1))
    x[m:m + 2000] = x[n - 200 + np.arange(2000) % 200] + rng.normal(size=(2000, dims)) * 0.1
    return x.astype(np.float32)


def test_pivot_index_finds_all_pairs_of_a_dense_group(spark):
    x = dense(50_000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>")
    got = pivots.near_duplicates(df).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[i:i + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(u), 1000)])
    m = len(x) // 3
    assert want[:m].sum() > 10**8 and (got[:m] == want[:m]).mean() > 0.999 and (got <= want + 1).all()
    assert got[m:].sum() >= 0.95 * want[m:].sum()


def test_permutations_are_deep_enough_for_the_most_pivots():
    """Partners at the threshold itself, pivots drawn like the vectors: the pairs that regions do not answer."""
    rng = np.random.default_rng(4)
    for count in (16, 1024, 8192, 1 << 15):
        depth = pivots.permutation_depth(count, 8)
        assert depth == {16: 8, 1024: 8, 8192: 11, 1 << 15: 13}[count]
        if count < 1024:
            continue
        points = pivots._unit(rng.normal(size=(count, 64))).astype(np.float32)
        x = pivots._unit(rng.normal(size=(1000, 64)))
        side = rng.normal(size=x.shape)
        side = pivots._unit(side - (side * x).sum(axis=1, keepdims=True) * x)
        y = 0.9 * x + math.sqrt(1 - 0.81) * side
        near = [np.argsort(-(v.astype(np.float32) @ points.T), axis=1)[:, :depth] for v in (x, y)]
        assert ((near[0][:, :, None] == near[1][:, None, :]).any(axis=2).sum(axis=1) >= 2).mean() >= 0.95


def test_doubles_are_compared_as_doubles(spark):
    """A pair whose cosine is 0.9 only in single precision, and components beyond its range."""
    a, below, above = [1.0, 0.0], [0.9 - 1e-12, math.sqrt(1 - 0.81)], [0.9 + 1e-12, math.sqrt(1 - 0.81)]
    for other, links in ((below, 0), (above, 1)):
        rows = [(1, [x * 1e200 for x in a]), (2, [x * 1e-200 for x in other])]
        got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert [x.n_links for x in got] == [links, links]


def test_every_link_of_a_member_meets_in_one_region():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    x = pivots._unit(centres[np.arange(3000) % 5] + rng.normal(size=(3000, 6)) * 0.5).astype(np.float32)
    points = pivots.spread(x[:40], 0.9)
    assert 1 < len(points) < 40 and (np.triu(points @ points.T, 1) < 0.9).all() and ((x[:40] @ points.T).max(axis=1) >= 0.9 - 1e-6).all()
    home, guest = pivots.Regions(points, 0.9).of(x @ points.T)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    meet = sum(((home[a] == p) & (guest[b, p] | (home[b] == p))).astype(int) for p in range(len(points)) for a, b in [(i, j)])
    meet = meet + sum(((home[j] == p) & guest[i, p]).astype(int) for p in range(len(points)))
    some = (home[i] >= 0) | (home[j] >= 0)
    assert (meet[some] == 1).all() and (meet[~some] == 0).all() and 0 < some.mean()


def test_pivot_index_on_odd_vectors(odd_vectors, no_vectors):
    assert pivots.near_duplicates(no_vectors).count() == 0
    rows = pivots.near_duplicates(odd_vectors).collect()
    assert len(rows) == odd_vectors.count()
    by = {}
    for x in rows:
        by.setdefault(x.vec_id, []).append((x.n_links, x.component_id, x.kept))
    assert by[0] == [(3, 0, True)] and by[1] == [(3, 0, False)] * 2 and by[2] == [(3, 0, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 20)) and by[None] == [(0, None, False)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(9, 9), (None, 3)]
    got = {x.node: x.component for x in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 580)}}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_rules_and_odd_urls(spark):
    urls = [(1, "http://WWW.Example.COM/en/x?q=/fr/"), (2, "https://a.example.com/en/1"), (3, "http://example.com/de/"), (4, "http://x.net/es/9#a"),
            (5, "ftp://x.net/fr"), (6, None), (7, ""), (8, "no scheme.com/en/"), (9, "http://com"), (10, "http://com/"), (11, "a://b.org/en/://c.net/es/"),
            (None, "http://y.net/fr/"), (1, "http://WWW.Example.COM/en/x?q=/fr/"), (12, "http://" + "a." * 500 + "net/es/" + "p" * 50_000), (13, "http://notexample.com/en/")]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in urls], "page_id long, url string, host string, verdict string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

    def judged(u):
        rest = (u or "").split("://", 1)
        host = path = ""
        if len(rest) == 2:
            cut = min([rest[1].find(c) for c in "/?#" if c in rest[1]], default=len(rest[1]))
            host, tail = rest[1][:cut].lower(), rest[1][cut:]
            path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for size in (64, 1 << 20):  # one block for all, and the usual size
        rows = url_filter.judge(df, url_filter.listing(spark, rules), max_filter_bytes=size).collect()
        assert sorted(map(str, [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in rows])) == sorted(map(str, [(i, *judged(u)) for i, u in urls]))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {x.verdict for x in url_filter.judge(df, none, default="block").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), url_filter.listing(spark, rules)).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    listed = url_filter.listing(spark, [("block", f"h{i}.org", "/") for i in range(3000)])
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/x")).alias("url"))
    rows = url_filter.judge(pages, listed).collect()
    assert sum(x.verdict == "block" for x in rows) == 3000
    assert sum(x.bloom_hits > 0 for x in rows) < 3000 + 60
