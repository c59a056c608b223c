"""Buckets and hubs that hold a large part of all documents are dealt over tasks, and lose no pair by it."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderlens.llm import minhash
from orderlens.session import stage


@pytest.fixture(scope="module")
def members(spark):
    """A bucket with 600 of 900 members, the others in small ones; every third member is of another component."""
    rows = [(0, 7 if i < 600 else 1000 + i // 4, i, i % 3) for i in range(900)]
    return stage(spark.createDataFrame(rows, "band int, key long, id long, component long"), "members")


def test_every_two_members_of_a_bucket_meet_in_one_cell(members):
    o, i = minhash.in_cells(stage(members.filter("component > 0"), "o"), members, block=50)
    largest = o.unionByName(i).groupBy("band", "key", "o", "i").count().agg(F.max("count")).head()[0]
    assert largest <= 2 * 50 * 1.5  # two blocks, of even size but for chance
    met = Counter((x.a, x.b) for x in o.withColumnRenamed("id", "a").drop("component")
                  .join(i.withColumnRenamed("id", "b").drop("component"), ["band", "key", "o", "i"]).select("a", "b").collect())
    rows = members.collect()
    bucket = {}
    for x in rows:
        bucket.setdefault(x.key, []).append(x)
    want = {(x.id, y.id) for b in bucket.values() for x in b if x.component > 0 for y in b}
    assert set(met) == want and set(met.values()) == {1}


@pytest.mark.parametrize("block", [40, 100_000])
def test_members_left_by_the_sketches_do_not_depend_on_the_cells(members, block):
    outer = stage(members.filter("component > 0").withColumn("n", F.col("id")), "o")
    inner = stage(members.withColumn("m", F.col("id")), "i")
    near = F.abs(F.col("n") - F.col("m")) % 97 == 1
    got = [{x.id for x in side.collect()} for side in minhash.sketched_apart(outer, inner, near, block)]
    rows = members.collect()
    bucket = {}
    for x in rows:
        bucket.setdefault(x.key, []).append(x)
    pairs = [(x.id, y.id) for b in bucket.values() for x in b if x.component > 0 for y in b
             if x.component != y.component and abs(x.id - y.id) % 97 == 1]
    assert got == [{a for a, _ in pairs}, {b for _, b in pairs}]


def test_one_hub_in_nearly_all_pairs(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(900)}" for _ in range(80)]
    texts = {0: " ".join(base)}
    for i in range(1, 400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 9])):
            w[r.randrange(len(w))] = f"x{i}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = [(i, 0) for i in range(1, 400)] + [(i, i - 1) for i in range(2, 60)]
    got = minhash.verified(stage(spark.createDataFrame(pairs, "u long, v long"), "pairs"), docs, 5, 0.8).collect()

    def bag(i):
        w = texts[i].split()
        return Counter(" ".join(w[j:j + 5]) for j in range(len(w) - 4))

    want = {(u, v) for u, v in pairs if sum((bag(u) & bag(v)).values()) / sum((bag(u) | bag(v)).values()) >= 0.8}
    assert 0 < len(want) < len(pairs) and Counter((x.u, x.v) for x in got) == Counter(want)


def test_large_ids_keep_their_pairs(spark):
    top = 2**63 - 1
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(top, text), (top - 1, text + " tail"), (-top, text + " end"), (-5, "nothing like the others at all here")]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {top: -top, top - 1: -top, -top: -top, -5: -5}
