import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from orderlens.llm import mixing, packing


def tokens(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_tokens_equal_the_tokenizer():
    texts = ["Hello, World! it's 3.5%% fine.", "ÉTÉ naïve façade-œuvre", "a_b__c ,. ,, ...", "don't we'll THEY'RE", "x" * 300, "\x1c a\x1db",
             "İstanbul ΣΊΣΥΦΟΣ", "<|startoftext|> mid<|endoftext|>", "½ ² ٣ ⅷ", "tab\tnew\nline\u00a0nb\u2003em", ""]
    w = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), most_words=8)
    got = w(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == tokens(t)[:-1], t


def test_packing_round_trip_on_odd_rows(odd_docs, no_docs):
    assert packing.pack(no_docs, packing.word_tokens).count() == 0
    rows = packing.pack(odd_docs, packing.word_tokens).collect()
    per, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    want = defaultdict(list)
    for r in odd_docs.collect():
        want[r.doc_id].append(tokens(r.text))
    for doc_id, texts in want.items():
        assert sum(r.length for r in per[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            ids = [i for r in sorted(per[doc_id], key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
            assert ids == texts[0]
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_every_limit_holds():
    r = random.Random(2)
    examples = [packing.Example(i, b"\1\0\0\0" * r.randint(1, 90), r.randint(0, 40)) for i in range(400)]
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=40)
    done = defaultdict(int)
    for placed in packing.pack_stream(iter(examples), limits, 16):
        assert sum(p[2] for p in placed) <= 64 and len(placed) <= 3 and sum(p[3] for p in placed) <= 40
        for e, start, length, loss in placed:
            assert start == done[e.doc_id] and loss == max(0, start + length - max(start, e.free))
            done[e.doc_id] += length
    assert all(done[e.doc_id] == e.total for e in examples)


def test_mixing_stays_within_one_block(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * r.randint(1, 300), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string")
    weights = {"hot": 0.4, "s0": 0.2, "s3": 0.15, "s6": 0.1, "s1": 0.05, "s2": 0.05, "s4": 0.03, "s5": 0.02}
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    parts = {x.source: x.parts for x in mixing.parts_of_cycle(w, 720).collect()}
    assert sum(parts.values()) == 720 and all(abs(parts[s] / 720 - weights[s]) < 0.01 for s in weights)
    rows = mixing.mix(docs, w, block_chars=500).collect()
    assert len(rows) == 3000
    slots = defaultdict(set)
    for x in rows:
        assert x.release <= x.slot < x.deadline
        slots[x.source].add(x.slot)
    assert len(set().union(*slots.values())) == sum(map(len, slots.values()))
    turns = mixing.schedule(mixing.parts_of_cycle(w, 720), 720).collect()
    order = [x.source for x in sorted(turns, key=lambda x: x.at)]
    seen = defaultdict(int)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[k] - t * parts[k] / 720) < 1 for k in parts)


def test_mixing_keeps_odd_rows(odd_docs, no_docs):
    assert mixing.in_order(mixing.mix(no_docs)).count() == 0
    out = mixing.in_order(mixing.mix(odd_docs))
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))


def test_no_sources_give_an_empty_schedule(spark):
    parts = mixing.parts_of_cycle(spark.createDataFrame([], "source string, weight double"), 720)
    assert mixing.schedule(parts, 720).collect() == []


def test_sequences_follow_the_mixture_over_several_files(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice([50, 300, 900]))), "hot" if i % 3 else f"s{i % 7}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rank = {x.doc_id: n for n, x in enumerate(mixing.in_order(mixing.mix(docs)).select("doc_id").collect())}
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        corpus_pipeline.source_mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
        packed = corpus_pipeline.sequence_packing(spark, spark.read.parquet(str(tmp_path / "mixed")), "").select("doc_id", "sequence_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = defaultdict(set)
    for x in packed:
        parts[x.sequence_id // packing.TASK_STRIDE].add(rank[x.doc_id])
    assert len(parts) > 3 and [n for k in sorted(parts) for n in sorted(parts[k])] == list(range(len(rows)))
