import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderlens.llm import bwt_dedup, minhash, quality, secret_scan, toxicity
from orderlens.llm.common import in_fold


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeimnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [" ".join(r.choice(words) for _ in range(30)) + " " + passage + " " + r.choice(words) for _ in range(25)]
    for t in list(texts[:40]):
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts + texts[:15] * 3


def shingle_counts(text):
    w = text.lower().split()
    return Counter([" ".join(w[i:i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else []))


def jaccard(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def classes(texts, threshold=0.8):
    counts = [shingle_counts(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(counts[i], counts[j]) >= threshold and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.integers(0, 6, 60), r.integers(0, 6, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows, weight, hashes = np.repeat([0, 1], 60), np.concatenate([a, b]), np.concatenate([h, h])
    some = weight > 0
    t = minhash.bag_min_hash(hashes[some], rows[some], weight[some], 2, 4000)
    assert abs((t[0] == t[1]).mean() - want) < 0.03


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    rows = minhash.near_duplicates(odd_docs).collect()
    by = {x.doc_id: (x.class_id, x.kept) for x in rows}
    assert len(rows) == odd_docs.count()
    assert by == {1: (1, True), 6: (1, False), 2: (2, True), 3: (2, False), 4: (2, False), None: (None, True), 5: (5, True), 7: (7, True),
                  8: (7, False), 9: (9, True)}


def removed(texts, length=50):
    first, out = {}, []
    data = [(t or "").encode() for t in texts]
    for b in data:
        mine = set()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in first:
                gone[p:p + length] = True
            mine.add(w)
        for w in mine:
            first.setdefault(w, True)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot,shard,files", [(50_000, 12 << 20, 1 << 16), (3, 4000, 4)])
def test_repeats_equal_brute_force(spark, hot, shard, files):
    texts = corpus(2) + ["ab" * 200, "ab" * 150 + "c", "é" * 60, "é" * 60, "", None, "x" * 49, "x" * 49, "x" * 50, "x" * 51]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    cut = bwt_dedup.remove_repeats(df, hot_documents=hot, shard_bytes=shard, most_files=files)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in cut.collect()}
    want = removed(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("text_shards")]


def test_repeats_in_parts_of_a_long_text(spark, monkeypatch):
    from pyspark import cloudpickle
    monkeypatch.setattr(bwt_dedup, "_PART", 700)
    cloudpickle.register_pickle_by_value(bwt_dedup)
    try:
        r = random.Random(3)
        base = "".join(r.choice("abcdef ") for _ in range(3000))
        texts = [base, "q" * 30 + base[100:2900], base[1500:1560] + "zz"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in bwt_dedup.remove_repeats(df).collect()}
        assert [got[i] for i in range(3)] == removed(texts)
    finally:
        cloudpickle.unregister_pickle_by_value(bwt_dedup)


def test_repeats_on_odd_rows(odd_docs, no_docs):
    assert bwt_dedup.remove_repeats(no_docs).count() == 0
    rows = bwt_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {x.doc_id: (x.n_bytes, x.n_removed) for x in rows}
    assert by[1][1] == 0 and by[6] == (by[1][0], by[1][0]) and by[2] == (0, 0) and by[None][1] == 0 and by[8][1] >= by[7][0] - 50


def test_suffix_order_and_merge():
    r = np.random.default_rng(1)
    t = r.integers(97, 100, 200).astype(np.uint8)
    double = np.concatenate([t, t])
    order = bwt_dedup.suffix_order(t, 20)
    keys = [bytes(double[i:i + 20]) for i in order]
    assert sorted(order) == list(range(200)) and keys == sorted(keys)


@pytest.mark.parametrize("length", [20, 21])
def test_least_document_of_equal_windows(length):
    r = np.random.default_rng(length)
    texts, windows, docs = [], [], []
    for k in range(3):
        strings = [r.integers(97, 99, r.integers(length, 90)).astype(np.uint8) for _ in range(12)]
        strings += [np.full(40, 97, np.uint8), np.tile(np.array([97, 98], np.uint8), 30)][k:]
        texts.append(np.concatenate([np.append(s, bwt_dedup._SEPARATOR).astype(np.uint8) for s in strings]))
        start = np.cumsum([0] + [len(s) + 1 for s in strings])
        windows.append(np.concatenate([a + np.arange(len(s) - length + 1) for a, s in zip(start, strings)]))
        docs.append(r.permutation(len(windows[-1])) + 7 * k)
    least = {}
    for t, w, d in zip(texts, windows, docs):
        for i, x in zip(w, d):
            b = t[i:i + length].tobytes()
            least[b] = min(least.get(b, x), x)
    got = bwt_dedup.repeated_windows(texts, windows, docs, length)
    assert [g.tolist() for g in got] == [[least[t[i:i + length].tobytes()] for i in w] for t, w in zip(texts, windows)]


def test_windows_without_an_equal_leave_the_merge(monkeypatch):
    r = np.random.default_rng(4)
    texts = [np.append(r.integers(97, 123, 6000), bwt_dedup._SEPARATOR).astype(np.uint8) for _ in range(2)]
    texts[1][1000:1200] = texts[0][3000:3200]
    windows = [np.arange(len(t) - 50) for t in texts]
    docs = [np.full(len(w), 2 - k) for k, w in enumerate(windows)]
    argsort, passed = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: passed.append(len(x)) or argsort(x, *a, **k))
    got = bwt_dedup.repeated_windows(texts, windows, docs, 50)
    # 50 passes over all windows before those that are alone left
    assert sum(passed) < 8 * sum(map(len, texts))
    assert np.flatnonzero(got[0] == 1).tolist() == list(range(3000, 3151)) and (got[1] == 1).all()


def labelled(spark, n=600):
    r = random.Random(5)
    words = ["".join(r.choice("aeioulnrstm") for _ in range(r.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic, good = int(r.random() < 0.2), int(r.random() < 0.8)
        if toxic:
            for _ in range(max(1, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(["blorgface", "snivelwit", "gnarlhead"])
        text = " ".join(w)
        if not good:
            text = " ".join(x.upper() + "!!" for x in w) if r.random() < 0.5 else " | ".join(w)
        rows.append((i, text, good, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def accuracy(docs, labels, model, label, held):
    x = docs.select("doc_id", model.score(F.col("text")).alias("s")).join(labels, "doc_id").filter(held).collect()
    return sum((r.s >= 0.3) == (r[label] == 1) for r in x) / len(x)


def test_quality_on_held_out_rows(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    held = in_fold("doc_id", 5, 0)
    model = quality.fit(docs, labels.filter(~held))
    assert accuracy(docs, labels, model, "quality", held) > 0.95
    scores = [r.s for r in odd_docs.select(model.score(F.col("text")).alias("s")).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    assert no_docs.select(model.score(F.col("text"))).count() == 0
    blank = quality.fit(docs, labels.limit(0))
    assert {r.s for r in odd_docs.select(blank.score(F.col("text")).alias("s")).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark, odd_docs):
    docs, labels = labelled(spark)
    held = in_fold("doc_id", 4, 2)
    model = toxicity.fit(docs, labels.filter(~held))
    assert accuracy(docs, labels, model, "toxic", held) > 0.95
    near = model.scores(model.text_kernels(pa.array(["lot of blo-rgf-ace here", "lot of blorxgface here", "b l o r g f a c e", "nothing of the kind", "", None])))
    assert (near[:3] > 0.3).all() and (near[3:] < 0.3).all()
    assert all(0 <= r.s <= 1 for r in odd_docs.select(model.score(F.col("text")).alias("s")).collect())
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.s for r in odd_docs.select(blank.score(F.col("text")).alias("s")).collect()} == {0.0}


def test_subsequence_kernel_equals_enumeration():
    from itertools import combinations

    def slow(s, t, p, d):
        def features(x):
            out = Counter()
            for ix in combinations(range(len(x)), p):
                out["".join(x[i] for i in ix)] += d ** (ix[-1] - ix[0] + 1)
            return out
        a, b = features(s), features(t)
        return sum(a[k] * b[k] for k in a)

    for s, t in (("idiot", "idxiot"), ("cat", "cart"), ("abab", "ba"), ("aaaa", "aaa")):
        got = toxicity.subsequence_kernel(toxicity._codes([s]), toxicity._codes([t])[0], 3, 0.5)[0]
        assert abs(got - slow(s, t, 3, 0.5)) < 1e-5


def test_secrets_are_found_and_redacted(spark, odd_docs, no_docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    rows, secrets = [], {}
    for i in range(300):
        w = [word() for _ in range(40)]
        value = "".join(r.choice("0123456789abcdef") for _ in range(40))
        if i % 3 == 0:
            secrets[i] = value
            w[20] = f'token = "{value}"'
        elif i % 3 == 1:
            w[20] = f"user{i}name@mail{i}.example.com {r.randint(10**15, 10**16 - 1)}"
        rows.append((i, " ".join(w), len(" ".join(w))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    found = secret_scan.scan(docs).collect()
    assert {(x.doc_id, x.value) for x in found if x.secret} == set(secrets.items())
    assert all(dict((i, t) for i, t, _ in rows)[x.doc_id][x.first_at - 1:].startswith(x.value) for x in found)
    clean = {x.doc_id: x for x in secret_scan.redact(docs).collect()}
    assert len(clean) == 300 and all(("[SECRET]" in clean[i].text) == (i in secrets) and clean[i].n_chars == len(clean[i].text) for i in clean)
    out = secret_scan.redact(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert secret_scan.scan(no_docs).count() == 0 and secret_scan.redact(no_docs).count() == 0


def test_short_and_plain_secrets_after_a_credential_name(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    given = {1000: ('password = "hunter2ab"', "hunter2ab"), 1001: ("secret: correcthorsebatterystaple", "correcthorsebatterystaple"),
             1002: ('token = "qWErtyUIopASdfGHjklZXcvBNm"', "qWErtyUIopASdfGHjklZXcvBNm"), 1003: ('password = "Tr0ub4dor&3x!9QzLm"', "Tr0ub4dor&3x!9QzLm"),
             1004: ("DB_PASSWORD=hunter2ab", "hunter2ab"), 1005: ("'api_key': 'Zq7&fj,2!x'", "Zq7&fj,2!x")}
    rows = []
    for i in range(200):
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(40))
        put = [f'token = "{hexes}"', f"commit {hexes}", f"user{i}name@mail{i}.example.com", 'the password = "' + hexes[:9] + 'x1"', "token: ${API_TOKEN}"][i % 5]
        rows.append((i, " ".join([*(word() for _ in range(20)), put, *(word() for _ in range(20))])))
    rows += [(i, " ".join([*(word() for _ in range(20)), t, *(word() for _ in range(20))])) for i, (t, _) in given.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x.doc_id, x.value): x for x in secret_scan.scan(docs).collect()}
    texts = dict(rows)
    for i, (_, value) in given.items():
        assert found[i, value].secret and texts[i][found[i, value].first_at - 1:].startswith(value), (i, found[i, value])
    assert not any(x.secret for x in found.values() if "example.com" in x.value or "$" in x.value)
    clean = {x.doc_id: x.text for x in secret_scan.redact(docs).collect()}
    assert all("[SECRET]" in clean[i] and value not in clean[i] for i, (_, value) in given.items())


def test_secrets_of_any_length_are_cut_by_place(spark):
    late = "".join("abcdefghijklmnopqrstuvwxyz"[i * 7 % 26] for i in range(130)) + "7Qx9" + "z" * 3
    phrase = "correct horse battery staple " * 11
    long = "QxZwVk" * 50
    texts = {1: f"token = {late} end", 2: f'passphrase = "{long}" end', 3: 'token = "SECRET9Qab12" and secret = "SECRET" end',
             4: 'password = "monkey" said the monkeys, monkey', 5: r'password = "a\\Eb$1c\\Q" then $1', 6: "nothing here", 7: f'passphrase = "{phrase}" end'}
    labels = spark.createDataFrame([(i, f"w{i} token = \"k{i * 7919 % 100003}Xq{i}z9\" w mail a{i}b{i}@example{i}.com w") for i in range(100, 160)], "doc_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(labels)
    found = {(x.doc_id, x.value) for x in secret_scan.scan(docs).collect() if x.secret}
    assert (7, phrase) in {(x.doc_id, x.value) for x in secret_scan.candidates(docs).collect()}  # the forest judges it
    assert {(1, late), (2, long), (3, "SECRET9Qab12"), (3, "SECRET"), (4, "monkey")} <= found
    clean = {x.doc_id: x.text for x in secret_scan.redact(docs).collect()}
    assert clean[1] == "token = [SECRET] end" and clean[2] == 'passphrase = "[SECRET]" end'
    assert clean[3] == 'token = "[SECRET]" and [SECRET] = "[SECRET]" end'.replace("[SECRET] =", "secret =")
    assert clean[4] == 'password = "[SECRET]" said the monkeys, [SECRET]' and clean[5] == 'password = "[SECRET]" then $1' and clean[6] == texts[6]
