"""Groups spelling variants: words one symbol apart, found by bidirectional search in FM-indexes of the vocabulary.

Words and their counts come from the texts by column expressions and one aggregation. A word that is one edit from
another agrees with it in one half: either the first ``length // 2`` symbols begin the other word, or the rest ends it.
So the vocabulary is dealt by the first and by the last symbols (at most four, of the reversed words for the latter),
and words that can agree meet in one shard of bounded size; a beginning that many words share is cut into cells of
index blocks and query blocks. A shard builds both transforms of its words and runs the search scheme: the half
exactly, to the left, then the rest to the right with one error. A pair that the first scheme finds is left out of
the second. Shards return one row a word, its near words counted and the best of them, so no pairs are written.

Defined results: a null text has no words; a null id counts as an empty text in front of the colon; texts are read
whole and rows repeated in full count again, as each is a row; equal counts go to the word that comes first in
code-point order; a word may be as long as a text (its shard takes a step a symbol). Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .fm_index import Index, one_error

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = 4
_FOUND = "word string, n_near long, best_n long, best string"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "[A-Za-zÀ-ÿ]+",
                damage: int | None = 97) -> DataFrame:
    """One row a run of letters, A to Z lower-cased. With ``damage`` the runs whose hash with the id it divides lose a symbol."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("run"))
    if damage is None:
        return runs.select(F.col("run").alias("word"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    return (words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_n))


def _half(side: str, length):
    return F.floor(length / 2) if side == "first" else length - F.floor(length / 2)


def _dealt(vocab: DataFrame, side: str, least_length: int) -> tuple[DataFrame, DataFrame]:
    """Index rows and query rows of a side with their keys. An indexed word stands under the key of every query
    that may be near, whose length differs by one at most."""
    text = F.col("word") if side == "first" else F.reverse("word")
    rows = vocab.select(F.lit(side).alias("side"), "word", "n", text.alias("text"), F.length("word").alias("length"))
    cut = lambda m: F.least(_half(side, m), F.lit(_KEY)).cast("int")
    lengths = F.array_distinct(F.array(*[cut(F.greatest(F.col("length") + d, F.lit(least_length))) for d in (-1, 0, 1)]))
    indexed = rows.withColumn("k", F.explode(lengths)).withColumn("key", F.substring("text", F.lit(1), F.col("k"))).drop("k")
    queries = rows.withColumn("key", F.substring("text", F.lit(1), cut(F.col("length"))))
    return indexed.drop("length"), queries.drop("length")


def _search(pdf: pd.DataFrame, at_once: int = 1 << 14) -> pd.DataFrame:
    """One row a queried word with near words in this shard."""
    indexed = pdf[~pdf["asked"]].sort_values("text")
    texts = indexed["text"].tolist()
    real, n = indexed["word"].to_numpy(object), indexed["n"].to_numpy(np.int64)
    first = len(pdf) > 0 and pdf["side"].iloc[0] == "first"
    place = np.empty(len(real), np.int64)
    place[np.argsort(real, kind="stable")] = np.arange(len(real))
    asked = pdf[pdf["asked"]]
    out = []
    index = Index(texts) if texts else None
    for start in range(0, len(asked) if index else 0, at_once):
        part = asked.iloc[start:start + at_once]
        words, mine = part["word"].tolist(), part["text"].tolist()
        sizes = np.array([len(w) for w in words], np.int64)
        q, w = one_error(index, mine, sizes // 2 if first else sizes - sizes // 2)
        if not first:  # those that begin alike are found by the other scheme
            begin = [x[:len(x) // 2] for x in words]
            own = np.array([not real[j].startswith(begin[i]) for i, j in zip(q.tolist(), w.tolist())], bool)
            q, w = q[own], w[own]
        if len(q):
            order = np.lexsort((place[w], -n[w], q))
            q, w = q[order], w[order]
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            out.append(pd.DataFrame({"word": [words[i] for i in q[starts]], "n_near": np.diff(np.append(starts, len(q))),
                                     "best_n": n[w[starts]], "best": real[w[starts]]}))
    return pd.concat(out) if out else pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}).astype(
        {"word": str, "n_near": np.int64, "best_n": np.int64, "best": str})


def near_words(vocab: DataFrame, least_length: int = 5, shard_words: int = 1 << 14) -> DataFrame:
    """word, n_near, best_n, best: of each word with near words their number, the largest count and its word.

    ``vocab`` has distinct words of at least ``least_length`` symbols and their counts n, and should be a stored table.
    """
    sides = [_dealt(vocab, side, least_length) for side in ("first", "last")]
    indexed, queries = (a.unionByName(b) for a, b in zip(*sides))
    keys = ["side", "key"]
    # a key that fills more than one block is cut; there are few of those, as each has that many rows
    sizes = (indexed.select(*keys, F.lit(1).alias("i"), F.lit(0).alias("q")).unionByName(queries.select(*keys, F.lit(0).alias("i"), F.lit(1).alias("q")))
             .groupBy(*keys).agg(F.sum("i").alias("i"), F.sum("q").alias("q")))
    hot = stage(sizes.filter((F.col("i") > shard_words) | (F.col("q") > shard_words))
                .select(*keys, F.ceil(F.col("i") / shard_words).alias("i_cut"), F.ceil(F.col("q") / shard_words).alias("q_cut")), "hot-keys")
    n = vocab.count()
    shards = max(1, math.ceil(3 * n / shard_words))
    one = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), one(F.col(c)) - 1))
    of = lambda c: F.pmod(F.xxhash64("word"), one(F.col(c)))
    i = indexed.join(hot, keys, "left").withColumn("i", of("i_cut")).withColumn("q", every("q_cut")).withColumn("asked", F.lit(False))
    q = queries.join(hot, keys, "left").withColumn("q", of("q_cut")).withColumn("i", every("i_cut")).withColumn("asked", F.lit(True))
    # cells of one key stay apart: a query that met a block of words twice would count them twice
    cell = F.when(F.col("i_cut").isNotNull(), F.concat_ws(" ", "key", "i", "q")).otherwise(F.lit(""))
    shard = F.when(F.col("i_cut").isNull(), F.pmod(F.xxhash64("side", "key"), F.lit(shards))).otherwise(F.lit(-1).cast("long"))
    dealt = i.unionByName(q).select("side", cell.alias("cell"), shard.alias("shard"), "word", "n", "text", "asked")
    found = dealt.groupBy("side", "cell", "shard").applyInPandas(_unique_index, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _unique_index(pdf: pd.DataFrame) -> pd.DataFrame:
    """A word that two keys of one shard hold is indexed once."""
    return _search(pdf.drop_duplicates(["word", "asked"]))


def variants(vocab: DataFrame, least_length: int = 5, ratio: int = 2, shard_words: int = 1 << 14) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a vocabulary (word, n).

    A form has ``ratio`` times the count of its variant, so a chain of forms is at most 63 long for counts that fit
    into 64 bits, and six rounds in which every word takes its form's form reach its end.
    """
    vocab = stage(vocab, "vocabulary")
    near = near_words(vocab, least_length, shard_words)
    fits = F.col("best_n") >= ratio * F.col("n")
    rows = stage(vocab.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    links = stage(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(links.join(nxt, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if not moved.filter("moved").head(1):
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
