"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are rows of weighted terms. Candidates and queries are dealt into blocks of bounded size; every
query block meets every candidate block once. For each term the query weights scatter over the term's
postings into a dense array of scores, one row a query; each block pair then selects its own k best, and
those are merged by a window per query. The work is the product of the two sets, as exhaustive search is,
and is spread evenly over the block pairs, so no key is hot.

Scores are exact integers. Ties go to the smaller vec_id. A query is never its own candidate. Null ids and
vectors that are null, empty or hold null or non-finite components take no part; missing trailing terms
count as zero; rows repeated in full count once, and different
vectors under one id each count. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import finite_vector

_BLOCK = "block long, n long, terms long, ids binary, weights binary"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every component, for vectors that take part."""
    return (vectors.filter(finite_vector("embedding") & F.col("vec_id").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("weights")))


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    terms = int(pdf["weights"].map(len).max())
    rows = np.zeros((len(pdf), terms), np.int64)
    for i, w in enumerate(pdf["weights"]):
        rows[i, :len(w)] = w
    whole = np.unique(np.column_stack([pdf["vec_id"].to_numpy(np.int64), rows]), axis=0)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "n": [len(whole)], "terms": [terms],
                         "ids": [np.ascontiguousarray(whole[:, 0]).tobytes()],
                         "weights": [np.ascontiguousarray(whole[:, 1:]).tobytes()]})


def blocks(rows: DataFrame, n_rows: int, size: int) -> DataFrame:
    """Rows of about ``size`` vectors each, sorted by vec_id, without repeated rows."""
    n = max(1, math.ceil(n_rows / size))
    return (rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
            .groupBy("block").applyInPandas(_block, _BLOCK))


def postings(weights: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the rows that hold it and their weights; None for the rows of a frequent term, kept densely."""
    out = []
    for t in range(weights.shape[1]):
        column = weights[:, t]
        ids = np.flatnonzero(column)
        out.append((None, column.copy()) if 4 * len(ids) >= len(column) else (ids, column[ids]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Dense scores, a row for each query, term by term."""
    scores = np.zeros((len(queries), n), queries.dtype)
    held = np.empty(n, queries.dtype)
    for t, (ids, weights) in enumerate(lists[:queries.shape[1]]):
        if not len(weights):
            continue
        for row in np.flatnonzero(queries[:, t]):
            if ids is None:
                scores[row] += np.multiply(weights, queries[row, t], out=held)
            else:
                scores[row, ids] += weights * queries[row, t]
    return scores


def _narrow(a: np.ndarray, b: np.ndarray) -> type:
    """32-bit words when no score can leave them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * min(a.shape[1], b.shape[1])
    return np.int32 if most < 2**31 else np.int64


def _select(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Each row's k best; ids ascend, so an earlier place wins a tie."""
    rows, places = [], []
    for i, (scored, q) in enumerate(zip(scores, query_ids)):
        at = slice(*np.searchsorted(ids, [q, q + 1]))
        others = np.delete(scored, at) if at.start < at.stop else scored
        best = np.arange(len(others))
        if len(others) > k:
            least = np.partition(others, len(others) - k)[len(others) - k]
            above = np.flatnonzero(others > least)
            best = np.concatenate([above, np.flatnonzero(others == least)[:k - len(above)]])
        places.append(best + np.where(best >= at.start, at.stop - at.start, 0))
        rows.append(np.full(len(best), i))
    row, place = np.concatenate(rows), np.concatenate(places)
    return pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[place], "score": scores[row, place].astype(np.int64)})


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, block_rows: int = 4096, query_rows: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for every query row."""
    rows = quantised(vectors, scale)
    asked = rows.filter(is_query)
    n, n_queries = rows.count(), asked.count()
    candidates = blocks(rows, n, block_rows)
    queries = blocks(asked, n_queries, 8 * query_rows).select(
        F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("terms").alias("q_terms"),
        F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"))
    cells = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, math.ceil(n / block_rows)) - 1).cast("long"))))
    pairs = candidates.join(cells, "block")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, lists, w = None, None, None
        for pdf in it:
            for r in pdf.itertuples(index=False):
                if r.block != last:
                    w = np.frombuffer(r.weights, np.int64).reshape(r.n, r.terms)
                    ids, last, lists = np.frombuffer(r.ids, np.int64), r.block, None
                q = np.frombuffer(r.q_weights, np.int64).reshape(r.q_n, r.q_terms)
                kind = _narrow(w, q)
                if lists is None or lists[0] is not kind:
                    lists = kind, postings(w.astype(kind))
                q_ids = np.frombuffer(r.q_ids, np.int64)
                for i in range(0, r.q_n, query_rows):
                    scores = accumulate(q[i:i + query_rows].astype(kind), lists[1], r.n)
                    yield _select(scores, q_ids[i:i + query_rows], ids, k)

    local = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
