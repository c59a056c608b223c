"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

A document is a vector of statistics of its whole text. Random Fourier features of the standardised vector
approximate a Gaussian kernel; ridge weights on them come from normal equations that every partition sums
on its own and a grouped sum adds up, so fitting is one pass over the labelled rows and what reaches the
driver has a fixed size. A fifth of the labelled rows is kept out of the fit; their binned scores give the
isotonic map to probabilities.

Scoring is a function of the text alone, in one pass without a shuffle. Null text counts as empty; empty
texts have a score as well. Labelled rows without a label or document are left out; without any usable
label every score is 0.5. Repeated rows count as often as they occur. Null ids are scored and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .calibration import calibrated, isotonic
from .common import small_batches, stage
from .text_arrays import slices, utf8, word_hashes

#: Bytes by kind, for their shares in a text.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ",.;:", "!?", "|", "#$%&*^~", "()[]{}<>",
          "'\"`", "-_/\\=+@"]
_KIND = np.full(256, len(_KINDS), np.int64)
_KIND[128:] = len(_KINDS) + 1
for _i, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _i
_N_KINDS = len(_KINDS) + 2
STATISTICS = 2 * _N_KINDS + 7


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for rows without any."""
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row * _N_KINDS + _KIND[data], minlength=rows * _N_KINDS).reshape(rows, _N_KINDS)
    shares = kinds / np.maximum(size, 1)[:, None]
    hashes, of, at = word_hashes(data, offsets)
    bounds = np.searchsorted(of, np.arange(rows + 1))
    n_words = np.diff(bounds).astype(float)
    per_word = np.maximum(n_words, 1)
    pairs = np.lexsort((hashes, of))
    h, o = hashes[pairs], of[pairs]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o, weights=fresh, minlength=rows)[:rows]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    upper_first = (data[at] >= 65) & (data[at] <= 90) if len(at) else np.zeros(0, bool)
    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, -1]
    extra = np.column_stack([
        np.log1p(size), np.log1p(n_words), letters / per_word, distinct / per_word, _sums(same, bounds) / per_word,
        _sums(upper_first, bounds) / per_word, kinds[:, 4] / per_word])
    return np.hstack([shares, np.sqrt(shares), extra])


def _statistics_of(texts: pd.Series) -> np.ndarray:
    data, offsets = utf8(pa.array(texts, pa.large_string(), from_pandas=True))
    parts = [np.zeros((0, STATISTICS))]
    for s in slices(np.diff(offsets)):
        o = offsets[s.start:s.stop + 1]
        parts.append(statistics(data[o[0]:o[-1]], o - o[0]))
    return np.vstack(parts)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def text_statistics(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_statistics_of(texts).astype(np.float32)))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        fourier = np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.shift)
        return np.hstack([fourier, 0.1 * z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        return calibrated(self.raw(x), self.knots, -0.5, 1.5)

    def score(self, text: Column) -> Column:
        """Probability of label 1 as a column."""
        model = self

        @F.pandas_udf(T.DoubleType())
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(model.scores(_statistics_of(texts)))

        return run(text)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.zeros((0, STATISTICS)), *column]) if len(column) else np.zeros((0, STATISTICS))


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b) for b in pdf["sums"]], axis=0)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "sums": [total.tobytes()]})


def partition_sums(rows: DataFrame, of, blocks: int = 8) -> np.ndarray:
    """Sum over all rows of the flat array that ``of`` makes of a batch; partitions add up their own first."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in it:
            if len(pdf):
                part = of(pdf)
                total = part if total is None else total + part
        if total is not None:
            for i, part in enumerate(np.array_split(total, blocks)):
                yield pd.DataFrame({"block": [i], "sums": [part.tobytes()]})

    found = rows.mapInPandas(run, "block int, sums binary").groupBy("block").applyInPandas(_sum_blocks, "block int, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(found)]) if found else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", n_features: int = 256, width: float = 6.0,
        ridge: float = 1.0, seed: int = 11, bins: int = 1000) -> Model:
    """Fits all rows of ``labels`` (doc_id and the label); ``width`` is that of the kernel."""
    docs = small_batches(docs)
    rng = np.random.default_rng(seed)
    known = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)))
    # statistics, not texts, meet the labels
    rows = (docs.select(F.col("doc_id").alias("id"), text_statistics("text").alias("x")).join(known, "id")
            .select("x", "y", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5)) == 0).alias("kept")))
    rows = stage(rows, "quality-statistics")

    def moments(pdf: pd.DataFrame) -> np.ndarray:
        x = _matrix(pdf["x"])
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = partition_sums(rows, moments, 1)
    blank = Model(np.zeros(STATISTICS), np.ones(STATISTICS), rng.normal(size=(STATISTICS, n_features)) / width,
                  rng.uniform(0, 2 * np.pi, n_features), None)
    if not len(sums):
        return blank
    n, mean = sums[0], sums[1:1 + STATISTICS] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + STATISTICS:] / n - mean**2, 1e-8))
    model = Model(mean, scale, blank.waves, blank.shift, None)
    size = n_features + STATISTICS + 1

    def equations(pdf: pd.DataFrame) -> np.ndarray:
        z = model.features(_matrix(pdf["x"]))
        return np.concatenate([(z.T @ z).ravel(), z.T @ pdf["y"].to_numpy(float)])

    sums = partition_sums(rows.filter("not kept"), equations)
    if not len(sums):
        return blank
    gram, target = sums[:size * size].reshape(size, size), sums[size * size:]
    model = Model(mean, scale, blank.waves, blank.shift, np.linalg.solve(gram + ridge * np.eye(size), target))

    def histogram(pdf: pd.DataFrame) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(pdf["x"])) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=pdf["y"], minlength=bins)]).astype(float)

    sums = partition_sums(rows.filter("kept"), histogram, 1)
    if not len(sums):
        return blank
    count, positive = sums[:bins], sums[bins:]
    there = np.flatnonzero(count)
    knots = isotonic(((there + 0.5) / bins) * 2 - 0.5, count[there], positive[there])
    return Model(mean, scale, blank.waves, blank.shift, model.weights, knots)
