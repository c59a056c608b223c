"""Toxicity scores: a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel compares a word with a landmark by their common subsequences of ``order`` letters, each weighted
by decay to the power of the span it takes in both, so letters in between (``idxiot``, ``i-d-i-o-t``) lower a
match and do not end it. It is divided by the landmark's kernel with itself, so a landmark inside a longer
word counts in full. A text's value for a landmark is that of its best word. Words that share no
gapped letter triple with any landmark, and words whose values are all at most 0.2, count as 0.

Landmarks are the words and word beginnings whose counts in labelled toxic and other texts differ most, and some of the most common other words. Kernel values with the landmarks times the inverse square
root of the landmarks' own kernel matrix are the Nystroem features; a squared-hinge support vector machine on
them is fitted to at most ``most_rows`` labelled rows, taken in the order of a hash of their ids, and a logistic
map learned on a fifth of these gives probabilities. All other work covers all rows; scoring is a function of
the whole text, in one pass without a shuffle.

Words are runs of letters after marks inside a word are taken out; single letters with spaces between them
count as one word. Null text counts as empty; a text without any matching word has the score of all-zero
features. Rows without a label are left out of the fit; without both labels every score is 0. Repeated rows
count as often as they occur; null ids are scored and not held out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import small_batches, stage
from .text_arrays import slices

_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")
_LONGEST = 24  # letters of a word that are compared at once; longer words are cut into overlapping parts
_GAPS = [(1, 2), (1, 3), (2, 3), (1, 4), (3, 4), (2, 4)]  # places of the second and third letter


def _codes(words: list[str]) -> np.ndarray:
    """Letters of each word as numbers from 1, filled up with 0."""
    width = max(map(len, words), default=1)
    flat = np.array(words, dtype=f"<U{max(width, 1)}")
    return flat.view(np.uint32).reshape(len(words), -1).astype(np.int64)


def subsequence_kernel(words: np.ndarray, landmark: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel of every word (rows of letter numbers, 0 for none) with one landmark."""
    letters = np.ascontiguousarray(words.T)
    width, n = letters.shape
    square = np.float32(decay * decay)
    same = [(letters == x).astype(np.float32) * square for x in landmark]
    # inner[j][i]: weight of the common subsequences so far, up to letter i of the words and j of the landmark
    inner = [np.ones((width + 1, n), np.float32)] * (len(landmark) + 1)
    for _ in range(order - 1):
        nxt = [np.zeros((width + 1, n), np.float32)]
        for j, at in enumerate(same):
            run = np.zeros((width + 1, n), np.float32)
            run[1:] = at * inner[j][:width]
            for i in range(width):
                run[i + 1] += np.float32(decay) * run[i]
            nxt.append(np.float32(decay) * nxt[j] + run)
        inner = nxt
    return np.sum([(at * inner[j][:width]).sum(0) for j, at in enumerate(same)], axis=0)


def _triples(words: np.ndarray) -> np.ndarray:
    """Hashes of gapped letter triples of every word; 0 where letters are missing."""
    n, width = words.shape
    padded = np.zeros((n, width + 4), np.int64)
    padded[:, :width] = words
    found = []
    for b, c in _GAPS:
        x, y, z = padded[:, :width], padded[:, b:b + width], padded[:, c:c + width]
        found.append(np.where((y > 0) & (z > 0), ((x * 31 + y) * 1009 + z) % 65521 + 1, 0))
    return np.hstack(found)


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...] = ()
    order: int = 3
    decay: float = 0.5
    whitening: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 0.0
    shift: float = 0.0
    _known: dict = field(default_factory=dict, compare=False, repr=False)

    def word_kernels(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each landmark; in 0..1."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words or not self.landmarks:
            return out
        marks = [_codes([m])[0] for m in self.landmarks]
        shared = np.zeros(65522, np.uint64)  # by triple: bits of the landmarks that have it
        for k, m in enumerate(marks):
            shared[_triples(m[None, :])] |= np.uint64(1 << k)
        shared[0] = 0
        parts, of = [], []
        for i, w in enumerate(words):
            for a in range(0, max(1, len(w) - _LONGEST // 2), _LONGEST // 2):
                parts.append(w[a:a + _LONGEST])
                of.append(i)
        size = np.fromiter(map(len, parts), int, len(parts))
        for a, b in ((0, 8), (8, 14), (14, _LONGEST)):
            at = np.flatnonzero((size > a) & (size <= b))
            if not len(at):
                continue
            codes = _codes([parts[i] for i in at])
            near = np.bitwise_or.reduce(shared[_triples(codes)], axis=1)
            rows = np.asarray(of)[at]
            for k, m in enumerate(marks):
                some = np.flatnonzero(near & np.uint64(1 << k))
                own = subsequence_kernel(m[None, :], m, self.order, self.decay)[0]
                for i in range(0, len(some), 4096):
                    part = some[i:i + 4096]
                    value = np.minimum(1, subsequence_kernel(codes[part], m, self.order, self.decay) / own)
                    np.maximum.at(out[:, k], rows[part], value)
        return out

    def text_kernels(self, texts: pa.Array) -> np.ndarray:
        """For each text and landmark: the best word's value, and the sum of the fourth powers of all words' values
        as a logarithm and per 50 words."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(self.landmarks)
        best, total = np.zeros((len(texts), n), np.float32), np.zeros((len(texts), n), np.float32)
        words = np.zeros(len(texts))
        for s in slices(pc.binary_length(texts).to_numpy()) if n else ():
            raw = pc.utf8_lower(texts.slice(s.start, s.stop - s.start)).to_pylist()
            raw = [_SPACED.sub(lambda m: m[0].replace(" ", ""), t) for t in raw]
            lists = pc.utf8_split_whitespace(pa.array(raw, pa.large_string()))
            offsets = lists.offsets.to_numpy()
            words[s] = np.diff(offsets)
            coded = lists.flatten().dictionary_encode()
            bare = pc.replace_substring_regex(coded.dictionary, r"[^\pL]", "").to_pylist()
            if len(self._known) > 300_000:
                self._known.clear()
            new = list({w for w in bare if len(w) >= self.order and w not in self._known})
            values = self.word_kernels(new)
            some = values.max(1, initial=0) > 0.2
            self._known.update((w, v if k else None) for w, v, k in zip(new, values, some))
            found = [self._known.get(w) for w in bare]
            kept = [v for v in found if v is not None]
            if not kept:
                continue
            there = np.fromiter((v is not None for v in found), bool, len(found))
            place = np.where(there, np.cumsum(there) - 1, -1)[coded.indices.to_numpy()]
            hit = np.flatnonzero(place >= 0)
            row = np.searchsorted(offsets, hit, "right") - 1
            value = np.asarray(kept)[place[hit]]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best[s.start + row[first]] = np.maximum.reduceat(value, first)
            total[s.start + row[first]] = np.add.reduceat(value**4, first)
        return np.hstack([best, np.log1p(total), np.minimum(3, 50 * total / np.maximum(words, 20)[:, None])])

    def features(self, kernels: np.ndarray) -> np.ndarray:
        n = len(self.landmarks)
        return np.hstack([kernels[:, i:i + n] @ self.whitening for i in (0, n, 2 * n)] + [np.ones((len(kernels), 1))])

    def scores(self, kernels: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(kernels))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.features(kernels) @ self.weights) + self.shift, -30, 30)))

    def score(self, text: Column) -> Column:
        """Probability of label 1 as a column."""
        model = self

        @F.pandas_udf(T.DoubleType())
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(model.scores(model.text_kernels(pa.array(texts, pa.large_string(), from_pandas=True))))

        return run(text)


def find_landmarks(rows: DataFrame, most: int = 32, plain: int = 8, shortest: int = 4, least_rows: int = 4) -> list[str]:
    """Words and word beginnings that tell the rows of y = 1 from those of y = 0."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= shortest))
    counts = (rows.select("y", F.explode(words).alias("word")).groupBy("word")
              .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")))
    counts = stage(counts, "toxicity-words")
    totals = counts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).head()
    if not totals.p or not totals.n:
        return []
    begins = F.transform(F.sequence(F.lit(shortest), F.least(F.length("word"), F.lit(9))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    grams = (counts.select("p", "n", F.explode(begins).alias("gram")).groupBy("gram")
             .agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    lift = F.log((F.col("p") + 0.5) / float(totals.p) / ((F.col("n") + 0.5) / float(totals.n)))
    told = (grams.filter(F.col("p") >= least_rows).withColumn("worth", F.col("p") * lift).filter(lift > 1.2)
            .orderBy(F.desc("worth"), F.desc(F.length("gram")), "gram").limit(40 * most).collect())
    chosen: list[str] = []
    for r in told:
        if len(chosen) < most and not any(r.gram.startswith(c) or c.startswith(r.gram) for c in chosen):
            chosen.append(r.gram)
    others = grams.filter(lift < 0.3).orderBy(F.desc("n"), "gram").limit(4 * plain).collect()
    for r in others:
        if len(chosen) < most + plain and not any(r.gram.startswith(c) or c.startswith(r.gram) for c in chosen):
            chosen.append(r.gram)
    return chosen


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 30) -> np.ndarray:
    """Weights of the squared-hinge machine by Newton steps; the last column of ``x`` is the constant."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) * cost
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ keep @ w + (weight * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        slack = np.maximum(0, 1 - sign * (x @ w))
        active = slack > 0
        gradient = keep @ w - 2 * x.T @ (weight * sign * slack)
        hessian = keep + 2 * (x[active] * weight[active, None]).T @ x[active]
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 16_000, order: int = 3, decay: float = 0.5,
        cost: float = 1.0, seed: int = 7) -> Model:
    docs = small_batches(docs)
    known = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
             .orderBy(F.xxhash64("id", F.lit(seed)), "id", "y").limit(most_rows))
    rows = stage(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
                 .join(F.broadcast(known), "id"), "toxicity-sample")  # at most most_rows small rows
    landmarks = find_landmarks(rows)
    model = Model(tuple(landmarks), order, decay)
    if not landmarks:
        return model

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def kernels(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.text_kernels(pa.array(texts, pa.large_string(), from_pandas=True))))

    sample = rows.select("id", "y", kernels("text").alias("k")).toPandas().sort_values(["id", "y"], kind="stable")
    k, y = np.vstack(list(sample["k"])).astype(float), sample["y"].to_numpy(float)
    between = model.word_kernels(landmarks).astype(float)
    between = (between + between.T) / 2
    value, vector = np.linalg.eigh(between)
    whitening = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    model = Model(tuple(landmarks), order, decay, whitening)
    x = model.features(k)
    kept = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[~kept])) < 2:
        kept[:] = False
    w = support_vector_machine(x[~kept], y[~kept], cost)
    margin, target = (x[kept] @ w, y[kept]) if len(np.unique(y[kept])) == 2 else (x @ w, y)
    positive = target.sum()
    soft = np.where(target > 0, (positive + 1) / (positive + 2), 1 / (len(target) - positive + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # logistic map of the margin, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(p - soft) @ margin, (p - soft).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * margin * margin).sum(), (r * margin).sum()], [(r * margin).sum(), r.sum()]]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return Model(tuple(landmarks), order, decay, whitening, w, max(float(a), 1e-6), float(b))
