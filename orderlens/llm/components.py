"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).head()
    return r.n, r.h


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node next to it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its least node) for every node with an edge; ``edges`` has long columns u and v.

    A round is two joins. The edges of a round are written to the shared folder, which cuts the lineage; the
    number of rounds grows with the logarithm of a component's size. Nothing is collected but a count and a
    checksum. Null ends and self-loops are left out.
    """
    now = stage(edges.filter("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = stage(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def local_roots(n: int, a, b):
    """Least index reachable from each of ``n`` nodes over the pairs (a, b), in numpy."""
    import numpy as np
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
