import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import spelling
from orderlens.llm.fm_index import Index, one_error


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def counted(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def grouped(vocab):
    of = {w: [u for u in vocab if near(w, u)] for w in vocab}
    form = {w: min(((-vocab[u], u) for u in of[w]), default=(0, None)) for w in vocab}
    form = {w: u if u and -m >= 2 * vocab[w] else None for w, (m, u) in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), vocab[w], len(of[w]), vocab[form[w]] if form[w] else None) for w in vocab}


def answer(df):
    rows = df.collect()
    out = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in rows}
    assert len(out) == len(rows)
    return out


def test_search_scheme_equals_brute_force():
    r = random.Random(3)
    for t in range(12):
        letters = "abé" if t % 2 else "abcdefgh"
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(5, 9 if t % 3 else 40))) for _ in range(200)})
        asked = words[::2] + ["aaaaa", "zzzzz", "abcdez"]
        q, w = one_error(Index(words), asked, np.array([len(x) // 2 for x in asked]))
        got = list(zip(q.tolist(), w.tolist()))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if near(x, y) and y.startswith(x[:len(x) // 2])}


@pytest.mark.parametrize("shard_words", [64, 1 << 14])
def test_variants_equal_brute_force(spark, shard_words):
    """The small shards cut hot keys into cells."""
    r = random.Random(7)
    base = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(5, 8))) for _ in range(25)] + ["aaaaa", "aaaab", "aaabb", "W" + "x" * 400]
    rows = []
    for i in range(300):
        words = []
        for _ in range(20):
            w = r.choice(base[:r.randint(1, len(base))])
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "a", "Ä", "é" + w[k]]) + w[k + 1:]
            words.append(w)
        rows.append((i, r.choice([" ", "-", "7"]).join(words)))
    vocab = spelling.vocabulary(spelling.occurrences(spark.createDataFrame(rows, "doc_id long, text string")))
    want = grouped(counted(rows))
    assert len(want) > 60 and any(v[0] and v[1] != v[0] for v in want.values())
    assert answer(spelling.variants(vocab, shard_words=shard_words)) == want


def test_odd_documents_and_clashing_columns(odd_docs, no_docs):
    docs = odd_docs.withColumns({"word": F.lit("w"), "n": F.lit(1), "run": F.lit(2)})
    rows = [(x.doc_id, x.text) for x in odd_docs.collect()]
    assert answer(spelling.variants(spelling.vocabulary(spelling.occurrences(docs)))) == grouped(counted(rows))
    assert answer(spelling.variants(spelling.vocabulary(spelling.occurrences(no_docs)))) == {}


def test_roots_of_long_chains(spark):
    chain = [("b" * k + "a" * (9 - k), 3 * 2 ** k) for k in range(10)]
    got = answer(spelling.variants(spark.createDataFrame(chain, "word string, n long")))
    assert {v[1] for v in got.values()} == {"b" * 9} and got["a" * 9][0] == "b" + "a" * 8 and got["b" * 9][0] is None
