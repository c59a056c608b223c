"""Hard negatives of anchors, found by angular triangle filtering.

A few reference directions are taken from a bounded sample of the rows. Every row is stored in a block with its norm
and its angles to all references, in the order of its nearest reference and its angle to that. The angle between two
rows lies between the difference and the sum of their angles to any reference, so the stored angles give an interval
of their cosine, and with the norms one of their score; it is widened by more than rounding can take away. An anchor
looks up the run of angles that can reach a wanted score in each reference's list, narrows that down by the intervals
of all references, and only rows whose interval meets a wanted window get an integer score.

The first pass finds each anchor's best rows of its own label (the score of a few near rows is the first bound), the
second the best rows of other labels inside the window below each of those. Anchor blocks meet row blocks once a
pass, each pair returns its own best, and windows merge them. The anchors are a stated set against all rows, so no
key is hot, whatever labels or copies there are.

Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part. Missing trailing
components count as zero. Rows repeated in full count once; different rows under one id each count, and a row is
neither positive nor negative of an anchor with its id. Ties go to the smaller id. Components are cut to 64 bits, and
so are scores. Blocks hold a bounded number of components, so a long vector shares its block with few others. An
empty table, or one without anchors, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import finite_vector, stage

_BLOCK = ("kind int, block long, n long, terms long, ids binary, rows binary, labels binary, weights binary, norms binary, "
          "angles binary, nearest binary")
_SLACK = 1e-6  # of the product of two norms: far above the rounding of angles (2e-8) and cosines
_MOST = 2 ** 63 - 1


def prepared(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label, weights = floor(scale * x) and a hash of the row, for rows that take part, each once."""
    weights = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    some = vectors.filter(finite_vector("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = some.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), weights.alias("weights")).distinct()
    return rows.withColumn("row", F.xxhash64("label", "weights"))


def references(rows: DataFrame, count: int, sample: int) -> np.ndarray:
    """Unit vectors far apart from each other, from the ``sample`` rows with the least hashes."""
    held = rows.select("weights").orderBy(F.xxhash64("vec_id", "row"), "vec_id").limit(sample).toPandas()["weights"]
    terms = max((len(w) for w in held), default=1)
    x = np.zeros((len(held), terms))
    for i, w in enumerate(held):
        x[i, :len(w)] = w
    norms = np.sqrt((x * x).sum(axis=1))
    x = x[norms > 0] / norms[norms > 0, None]
    if not len(x):
        return np.ones((1, 1))
    chosen, close = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(close.argmin()))
        close = np.maximum(close, x @ x[chosen[-1]])
    return x[chosen]


def _described(weights: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms, angles to the references, and the nearest reference of each row."""
    x = weights.astype(float)
    norms = np.sqrt((x * x).sum(axis=1))
    terms = min(x.shape[1], points.shape[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        cosines = x[:, :terms] @ points[:, :terms].T / norms[:, None]
    angles = np.arccos(np.clip(np.nan_to_num(cosines), -1, 1))
    return norms, angles, angles.argmin(axis=1)


def blocks(rows: DataFrame, points: np.ndarray, cells: int, most_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows in blocks of about ``cells`` components, by powers of two of their length, with norms and angles; and the
    number of blocks of each of these at most 31 kinds."""
    rows = rows.withColumn("kind", F.ceil(F.log2(F.size("weights"))).cast("int"))
    sizes = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {kind: -(-n // max(1, min(most_rows, cells >> kind))) for kind, n in sizes.items()}
    of = F.lit(1)
    for kind, n in sizes.items():
        of = F.when(F.col("kind") == kind, n).otherwise(of)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = np.zeros((len(pdf), int(pdf["weights"].map(len).max())), np.int64)
        for i, w in enumerate(pdf["weights"]):
            weights[i, :len(w)] = w
        norms, angles, nearest = _described(weights, points)
        order = np.lexsort((pdf["vec_id"].to_numpy(), angles[np.arange(len(pdf)), nearest], nearest))
        raw = lambda a, t: [np.ascontiguousarray(a[order], t).tobytes()]
        return pd.DataFrame({
            "kind": [int(pdf["kind"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "n": [len(pdf)], "terms": [weights.shape[1]],
            "ids": raw(pdf["vec_id"].to_numpy(), np.int64), "rows": raw(pdf["row"].to_numpy(), np.int64),
            "labels": raw(pdf["label"].to_numpy(), np.int64), "weights": raw(weights, np.int64), "norms": raw(norms, float),
            "angles": raw(angles, float), "nearest": raw(nearest, np.int32)})

    return (rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), of.cast("long")))
            .groupBy("kind", "block").applyInPandas(block, _BLOCK)), sizes


class Block:
    """A block of rows with their stored angles."""

    def __init__(self, r, prefix: str = ""):
        get = lambda f, t: np.frombuffer(getattr(r, prefix + f), t)
        n, terms = getattr(r, prefix + "n"), getattr(r, prefix + "terms")
        self.ids, self.rows, self.labels = get("ids", np.int64), get("rows", np.int64), get("labels", np.int64)
        self.weights, self.norms = get("weights", np.int64).reshape(n, terms), get("norms", float)
        self.angles, self.nearest = get("angles", float).reshape(n, -1), get("nearest", np.int32)
        self.top = float(np.abs(self.weights.astype(float)).max(initial=0))
        self.exact = self.weights.astype(float)  # equal to the integers whenever it is used for scores
        edges = np.flatnonzero(np.concatenate([[True], self.nearest[1:] != self.nearest[:-1]])) if n else np.zeros(0, int)
        self.lists = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n]):
            own = int(self.nearest[a])
            self.lists.append((own, a, self.angles[a:b, own], float(self.norms[a:b].min()), float(self.norms[a:b].max())))
        self.by_label = {label: np.flatnonzero(self.labels == label) for label in np.unique(self.labels).tolist()}

    def scores(self, which: np.ndarray, other: Block, at: int) -> np.ndarray:
        """Integer scores of some rows with a row of the other block, cut to 64 bits."""
        terms = min(self.weights.shape[1], other.weights.shape[1])
        if self.top * other.top * max(terms, 1) < 2 ** 52:
            return (self.exact[which, :terms] @ other.exact[at, :terms]).astype(np.int64)
        wide = self.weights[which, :terms].astype(object) @ other.weights[at, :terms].astype(object)
        return np.array([max(-_MOST - 1, min(_MOST, int(x))) for x in wide], np.int64)

    def reach(self, other: Block, at: int, least: float) -> np.ndarray:
        """Rows whose angle to their nearest reference lets their score with a row of the other block be ``least`` or more."""
        norm, out = float(other.norms[at]), []
        for own, start, angles, low, high in self.lists:
            wanted = least - 1 - _SLACK * norm * high
            far = np.pi
            if wanted > 0:
                most = norm * high
                if wanted > most:
                    continue
                far = np.arccos(wanted / most)
            elif norm * low > 0:
                far = np.arccos(max(-1.0, wanted / (norm * low)))
            mid = other.angles[at, own]
            a, b = np.searchsorted(angles, [mid - far - 1e-6, mid + far + 1e-6])
            if a < b:
                out.append(np.arange(start + a, start + b))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def bounds(self, which: np.ndarray, other: Block, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the stored angles leave open, widened beyond rounding."""
        mine, his = self.angles[which], other.angles[at]
        near = np.abs(mine - his).max(axis=1)
        far = np.minimum(mine + his, 2 * np.pi - mine - his).min(axis=1)
        product = self.norms[which] * other.norms[at]
        wide = 1 + _SLACK * product
        cut = lambda x: np.clip(x, -2.0 ** 63, 2.0 ** 63)  # noqa: E731  (as scores are)
        return cut(product * np.cos(far) - wide), cut(product * np.cos(near) + wide)


def _best(order: list[np.ndarray], k: int) -> np.ndarray:
    return np.lexsort(order)[:k]


def own_label(rows: Block, anchors: Block, k: int) -> Iterator[tuple]:
    """(anchor place, row places, scores): each anchor's k best rows of its label."""
    for at in range(len(anchors.ids)):
        same = rows.by_label.get(int(anchors.labels[at]))
        if same is None:
            continue
        same = same[rows.ids[same] != anchors.ids[at]]
        least = float("-inf")
        if len(same) > 4 * k:
            # rows whose angle to the anchor's nearest reference is like its own give a first bound
            gap = np.abs(rows.angles[same, anchors.nearest[at]] - anchors.angles[at, anchors.nearest[at]])
            first = rows.scores(same[np.argpartition(gap, 4 * k)[:4 * k]], anchors, at)
            least = float(np.sort(first)[-k])
            same = rows.reach(anchors, at, least)
            same = same[(rows.labels[same] == anchors.labels[at]) & (rows.ids[same] != anchors.ids[at])]
            same = same[rows.bounds(same, anchors, at)[1] >= least]
        scores = rows.scores(same, anchors, at)
        best = _best([rows.rows[same], rows.ids[same], -scores], k)
        if len(best):
            yield at, same[best], scores[best]


def other_labels(rows: Block, anchors: Block, at: int, windows: list[tuple[int, int]], k: int) -> Iterator[tuple]:
    """(window, row places, scores): an anchor's k best rows of other labels in each window of scores."""
    some = rows.reach(anchors, at, min(low for low, _ in windows))
    some = some[(rows.labels[some] != anchors.labels[at]) & (rows.ids[some] != anchors.ids[at])]
    if not len(some):
        return
    low, high = rows.bounds(some, anchors, at)
    meets = np.zeros(len(some), bool)
    for a, b in windows:
        meets |= (low <= b) & (high >= a)
    some = some[meets]
    scores = rows.scores(some, anchors, at)
    for i, (a, b) in enumerate(windows):
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        best = inside[_best([rows.rows[some[inside]], rows.ids[some[inside]], -scores[inside]], k)]
        if len(best):
            yield i, some[best], scores[best]


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), high * score // 100


_FIRST = "a_kind int, a_block long, a_at int, anchor_id long, positive_id long, positive_row long, positive_score long"
_SECOND = ("a_kind int, a_block long, a_at int, anchor_id long, positive_id long, place int, positive_score long, "
           "negative_id long, negative_row long, negative_score long")


def _frame(parts: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    if not parts:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
    return pd.DataFrame({c: np.concatenate([np.atleast_1d(p[c]) for p in parts]) for c in names})


def _each(sizes: dict[int, int], kind: str, block: str) -> Column:
    """One row for every block."""
    def run(k: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")),
                           lambda b: F.struct(F.lit(k).alias(kind), b.alias(block)))
    lists = [run(k, n) for k, n in sizes.items()]
    return F.inline(F.flatten(F.array(*lists)) if lists else F.array().cast(f"array<struct<{kind}:int,{block}:long>>"))


def _meet(stored: DataFrame, sizes: dict[int, int], asked: DataFrame, asked_sizes: dict[int, int], fn, schema: str) -> DataFrame:
    """``fn(row block, anchor block)`` for every pair of the two, a task's memory being that of one pair."""
    cell = ["kind", "block", "a_kind", "a_block"]
    left = stored.select("*", _each(asked_sizes, "a_kind", "a_block")).groupBy(*cell)
    right = asked.select("*", _each(sizes, "kind", "block")).groupBy(*cell)
    return left.cogroup(right).applyInPandas(fn, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100, reference_count: int = 16, sample: int = 2048, cells: int = 1 << 20,
         block_rows: int = 1 << 14) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its ``positives`` best rows of its label, and for each of those the ``negatives`` best rows of
    other labels with a score from ``low`` to ``high`` percent of the positive's. The references are fitted on at
    most ``sample`` rows; they only decide how much is filtered, never a result.
    """
    rows = stage(prepared(vectors, label, scale), "vectors")
    points = references(rows, reference_count, sample)
    stored, sizes = blocks(rows, points, cells, block_rows)
    stored = stage(stored, "angles")
    anchors, asked_sizes = blocks(rows.filter(is_anchor), points, cells, block_rows)
    asked = stage(anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]), "anchors")

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            r = next(right.itertuples(index=False))
            held, ask = Block(next(left.itertuples(index=False))), Block(r, "a_")
            for at, which, scores in own_label(held, ask, positives):
                n = len(which)
                parts.append({"a_kind": np.full(n, r.a_kind), "a_block": np.full(n, r.a_block), "a_at": np.full(n, at),
                              "anchor_id": np.full(n, ask.ids[at]), "positive_id": held.ids[which], "positive_row": held.rows[which],
                              "positive_score": scores})
        return _frame(parts, _FIRST)

    key = ["a_kind", "a_block", "a_at"]
    best = Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    found = (_meet(stored, sizes, asked, asked_sizes, first, _FIRST).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives))
    # at most ``positives`` windows an anchor stand beside the anchors of a block
    wanted = found.groupBy("a_kind", "a_block").agg(F.sort_array(F.collect_list(F.struct("a_at", "place", "positive_id", "positive_score"))).alias("a_wanted"))
    asking = stage(asked.join(wanted, ["a_kind", "a_block"]), "windows")

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            r = next(right.itertuples(index=False))
            held, ask = Block(next(left.itertuples(index=False))), Block(r, "a_")
            by_anchor: dict[int, list] = {}
            for w in r.a_wanted:
                a, b = window_of(int(w["positive_score"]), low, high)
                if a <= b:
                    by_anchor.setdefault(w["a_at"], []).append((w, (a, b)))
            for at, wants in by_anchor.items():
                for i, which, scores in other_labels(held, ask, at, [x for _, x in wants], negatives):
                    n, w = len(which), wants[i][0]
                    parts.append({"a_kind": np.full(n, r.a_kind), "a_block": np.full(n, r.a_block), "a_at": np.full(n, at),
                                  "anchor_id": np.full(n, ask.ids[at]), "positive_id": np.full(n, w["positive_id"]),
                                  "place": np.full(n, w["place"]), "positive_score": np.full(n, w["positive_score"]),
                                  "negative_id": held.ids[which], "negative_row": held.rows[which], "negative_score": scores})
        return _frame(parts, _SECOND)

    ranked = Window.partitionBy(*key, "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    return (_meet(stored, sizes, asking, asked_sizes, second, _SECOND).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
