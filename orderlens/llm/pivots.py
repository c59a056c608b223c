"""Near-duplicate vectors by a pivot-permutation index, exact where vectors lie close together.

Reference points (pivots) are vectors of the table itself, the first by a hash of their ids; their number
grows with the square root of the table and has a fixed upper bound. Of pivots that would link with each other only the
first stays, so a dense region has one pivot or a few and not a share of all. A vector that links with its nearest
pivot is a member of that pivot's region. All members of a region meet each other and its guests: the vectors
that by the triangle inequality, and by their distance from the plane between their nearest pivot and this one, may
link with a member. So every pair with a member in it is found, and of two regions only that of the lower pivot lists
the other's members.

Pairs of two vectors that are in no region, where a pivot seldom lies within linking distance, go by permutations: a
vector is described by its ``depth`` nearest pivots in order of nearness. Inverted lists hold, for each pivot, the
vectors near it; of two vectors that share at least ``shared`` of their pivots one of the first depth - shared + 1 (in
the order of pivot frequency) is shared as well, so only those lists are written, and a pair counts only in the list of
its first common pivot. Only these pairs can be missed; as more pivots make it likelier that two vectors order theirs
differently, ``depth`` grows by one with each doubling of the pivots beyond 1,024.

A list or region is cut into blocks of bounded size and every two blocks that have to meet do so in one cell, where
pairs are verified by their cosine in double precision. A cell gives the number of links of each vector and a star
of its connected parts, so its output is linear in its vectors however many pairs link. Where nearly all vectors are
within twice the linking angle of each other, nearly all are guests everywhere, and the work is that of all pairs.

Equal vectors are first joined into one with its number of copies (they are told apart by 128 bits of hash).
Null or empty vectors, zero vectors and those with null or non-finite components, and rows with null ids, link
with nothing; vectors of different length do not link either. Vectors of doubles are compared as doubles. An empty table gives no rows. Recall against
all pairs is measured in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import finite_vector, stage
from .components import components, local_roots

_BLOCK = "role int, pivot int, chunk long, n long, ids binary, copies binary, vectors binary, width int, near binary"
#: What a vector is in a list: one of those near a pivot, a member of its region, or a guest there.
NEAR, MEMBER, GUEST = 0, 1, 2
#: Room for single precision where a bound decides whether two vectors meet.
_SLACK = 1e-3


def pivot_count(n: int, least: int = 16, most: int = 1 << 15) -> int:
    return max(least, min(most, math.isqrt(max(n, 1))))


def permutation_depth(pivots: int, depth: int) -> int:
    """Nearest pivots that describe a vector: ``depth``, and one more for each doubling of the pivots beyond 1,024."""
    return min(pivots, depth + max(0, math.ceil(math.log2(max(pivots, 1) / 1024))))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, float) for r in rows])
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(points: np.ndarray, cosine: float, step: int = 256) -> np.ndarray:
    """The unit vectors ``points`` without those that link with an earlier one that stays."""
    kept = points[:0]
    for start in range(0, len(points), step):
        part = points[start:start + step]
        if len(kept):
            part = part[(part @ kept.T).max(axis=1) < cosine]
        near, stays = part @ part.T >= cosine, np.zeros(len(part), bool)
        for i in range(len(part)):
            stays[i] = not (near[i, :i] & stays[:i]).any()
        kept = np.concatenate([kept, part[stays]])
    return kept


class Regions:
    """Where vectors are members and guests, from their inner products with the pivots."""

    def __init__(self, points: np.ndarray, cosine: float):
        self.points, self.cosine = points, cosine
        self.reach = 2 * cosine * cosine - 1 if cosine > 0 else -1.0  # cosine of twice the linking angle
        self.sine = np.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0

    def of(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region each row is a member of (-1: none), and whether it is a guest of each."""
        first = near.argmax(axis=1)
        best = near[np.arange(len(near)), first]
        home = np.where(best >= self.cosine, first, -1)
        i, p = np.nonzero(near >= self.reach - _SLACK)
        mine = home[i]
        later = (mine < 0) | (mine > p)
        i, p = i[later], p[later]
        # members of p are at least as near to p as to this vector's nearest pivot, so on p's side of the plane between the two
        apart = np.sqrt(np.maximum(2 - 2 * (self.points[first[i]] * self.points[p]).sum(axis=1), 0))
        some = best[i] - near[i, p] <= self.sine * apart + _SLACK
        guest = np.zeros(near.shape, bool)
        guest[i[some], p[some]] = True
        return home, guest


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    vectors = np.stack(list(pdf["vector"]))  # single or double precision, as the table has it
    return pd.DataFrame({"role": [int(pdf["role"].iloc[0])], "pivot": [int(pdf["pivot"].iloc[0])], "chunk": [int(pdf["chunk"].iloc[0])], "n": [len(pdf)],
                         "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
                         "vectors": [vectors.tobytes()], "width": [vectors.itemsize],
                         "near": [np.stack(list(pdf["near"])).astype(np.int32).tobytes()]})


class Block:
    def __init__(self, n, ids, copies, vectors, width, near):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.unit = _unit(np.frombuffer(vectors, f"f{width}").reshape(n, -1))
        self.near = np.frombuffer(near, np.int32).reshape(n, -1)


def linked_in_region(a: Block, b: Block, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linking pairs of two blocks."""
    close = a.unit @ b.unit.T >= cosine
    return np.nonzero(np.triu(close, 1) if same else close)


def linked(a: Block, b: Block, same: bool, pivot: int, prefix: int, shared: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linking pairs of two blocks of a pivot's list whose first common listed pivot it is."""
    names, code = np.unique(np.concatenate([a.near, b.near]), return_inverse=True)
    code = code.reshape(-1, a.near.shape[1])
    has = np.zeros((len(code), len(names)), np.float32)
    np.put_along_axis(has, code, 1, axis=1)
    enough = has[:len(a.ids)] @ has[len(a.ids):].T >= shared
    if same:
        enough = np.triu(enough, 1)
    i, j = np.nonzero(enough & (a.unit @ b.unit.T >= cosine))
    if len(i):
        # near is in the order of pivot frequency, so the first common one of the listed is the least
        x, y = a.near[i, :prefix], b.near[j, :prefix]
        first = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max).min(axis=1)
        mine = first == pivot
        i, j = i[mine], j[mine]
    return i, j


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, depth: int = 8, shared: int = 2, block_rows: int = 1024,
                    seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    some = F.exists("embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    good = rows.filter(F.col("vec_id").isNotNull() & finite_vector("embedding") & some)
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(seed), F.col("embedding")).alias("k2")]
    distinct = stage(good.groupBy(*keys).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"),
                                             F.first("embedding").alias("vector")), "distinct-vectors")
    sizes = [r[0] for r in distinct.groupBy(F.size("vector")).count().orderBy("count", ascending=False).collect()]
    found = None
    for size in sizes:  # one pass for each length of vectors; a table has one
        links = _links(distinct.filter(F.size("vector") == size), cosine, depth, shared, block_rows, seed)
        found = links if found is None else found.unionByName(links)
    ids = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & finite_vector("embedding") & some, keys[0]).alias("k1"),
                      F.when(F.col("vec_id").isNotNull() & finite_vector("embedding") & some, keys[1]).alias("k2"))
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"))
    found = stage(found, "vector-links")
    groups = components(found.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = (distinct.select("k1", "k2", "id", "copies").join(counted, "id", "left")
              .join(groups.withColumnRenamed("node", "id"), "id", "left")
              .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "id").alias("component_id")))
    return (ids.join(result, ["k1", "k2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")))


def _links(distinct: DataFrame, cosine: float, depth: int, shared: int, block_rows: int, seed: int) -> DataFrame:
    """id, links, root: for each cell and vector with links, their number and a vector of the same component."""
    n = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivot_count(n)).select("vector").collect()
    points = spread(_unit([r.vector for r in chosen]).astype(np.float32), cosine)
    regions = Regions(points, cosine)
    depth = permutation_depth(len(points), depth)
    shared = min(shared, depth)
    prefix = depth - shared + 1

    def describe(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                near = _unit(pdf["vector"]).astype(np.float32) @ points.T
                home, guest = regions.of(near)
                order = np.argsort(-near, axis=1, kind="stable")[:, :depth].astype(np.int32)
                yield pdf[["id", "copies", "vector"]].assign(home=home.astype(np.int32), guest=[np.flatnonzero(g).astype(np.int32) for g in guest],
                                                             near=[x if h < 0 else x[:0] for x, h in zip(order, home)])

    described = stage(distinct.select("id", "copies", "vector").mapInPandas(
        describe, f"id long, copies long, vector {distinct.schema['vector'].dataType.simpleString()}, home int, guest array<int>, near array<int>"),
        "pivot-permutations")
    # number pivots from the rarest list to the longest
    length = {r.pivot: r["count"] for r in described.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect()}
    order = np.full(len(points), len(points))
    for rank, p in enumerate(sorted(length, key=lambda p: (length[p], p))):
        order[p] = rank

    def renamed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pdf.assign(near=[np.sort(order[x]).astype(np.int32) for x in pdf["near"]])

    rows = described.select("id", "copies", "vector", "near")
    lists = (rows.filter(F.size("near") > 0).mapInPandas(renamed, rows.schema)
             .select(F.lit(NEAR).alias("role"), F.explode(F.slice("near", 1, prefix)).alias("pivot"), "id", "copies", "vector", "near"))
    none = F.array().cast("array<int>").alias("near")
    members = described.filter("home >= 0").select(F.lit(MEMBER).alias("role"), F.col("home").alias("pivot"), "id", "copies", "vector", none)
    guests = described.select(F.lit(GUEST).alias("role"), F.explode("guest").alias("pivot"), "id", "copies", "vector", none)
    listed = lists.unionByName(members).unionByName(guests)
    # blocks of every list: a row for each pivot and role, joined by the size that the written table shows
    sizes = stage(listed.groupBy("role", "pivot").agg(F.ceil(F.count("*") / block_rows).alias("chunks")), "list-blocks")
    wide = sizes.groupBy("pivot").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("chunks"))), F.lit(0)).alias(f"{name}s")
                                        for r, name in ((NEAR, "near"), (MEMBER, "member"), (GUEST, "guest"))])
    blocks = stage(listed.join(sizes, ["role", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("chunks")))
                   .select("role", "pivot", "chunk", "id", "copies", "vector", "near")
                   .groupBy("role", "pivot", "chunk").applyInPandas(_pack, _BLOCK), "pivot-blocks")
    placed = blocks.join(wide, "pivot")
    zero = F.lit(0).cast("long")
    inside = placed.filter(F.col("role") != GUEST)
    own = F.when(F.col("role") == NEAR, F.col("nears")).otherwise(F.col("members"))
    left = inside.withColumn("o_role", F.col("role")).withColumn("other", F.explode(F.sequence(F.col("chunk"), own - 1)))
    left = left.unionByName(placed.filter((F.col("role") == MEMBER) & (F.col("guests") > 0)).withColumn("o_role", F.lit(GUEST))
                            .withColumn("other", F.explode(F.sequence(zero, F.col("guests") - 1))))
    left = left.drop("nears", "members", "guests")
    right = inside.withColumn("left", F.explode(F.sequence(zero, F.col("chunk")))).unionByName(
        placed.filter((F.col("role") == GUEST) & (F.col("members") > 0)).withColumn("left", F.explode(F.sequence(zero, F.col("members") - 1))))
    right = right.select(F.col("role").alias("o_role"), "pivot", F.col("left").alias("chunk"), F.col("chunk").alias("other"),
                         *[F.col(c).alias(f"o_{c}") for c in ("n", "ids", "copies", "vectors", "width", "near")])
    cells = left.join(right, ["o_role", "pivot", "chunk", "other"])

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples(index=False):
                same = r.role == r.o_role and r.chunk == r.other
                a = Block(r.n, r.ids, r.copies, r.vectors, r.width, r.near)
                b = a if same else Block(r.o_n, r.o_ids, r.o_copies, r.o_vectors, r.o_width, r.o_near)
                i, j = linked(a, b, same, r.pivot, prefix, shared, cosine) if r.role == NEAR else linked_in_region(a, b, same, cosine)
                if not len(i):
                    continue
                if not same:
                    j = j + len(a.ids)
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                copies = a.copies if same else np.concatenate([a.copies, b.copies])
                links = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
                root = ids[local_roots(len(ids), i, j)]
                at = np.flatnonzero(links)
                yield pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "root": root[at]})

    return cells.mapInPandas(verify, "id long, links long, root long")
