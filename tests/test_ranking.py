import random

import pandas as pd
import pytest

from orderlens.functions import ranking as rk
from orderlens.functions import skew
from orderlens.functions.prefix import running
from pyspark.sql import functions as F


def frame(spark, n, hot=0.4, seed=1):
    """Values where one value holds a large share of the rows."""
    r = random.Random(seed)
    rows = [(i, 0.0 if r.random() < hot else round(r.expovariate(0.1), 1), "a" if r.random() < 0.7 else "b") for i in range(n)]
    return pd.DataFrame(rows, columns=["id", "v", "k"]), spark.createDataFrame(rows, "id long, v double, k string")


@pytest.mark.parametrize("n", [6, 7, 11, 500])
def test_global_row_number_and_score(spark, n):
    pdf, df = frame(spark, n)
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    got = rk.global_row_number(df, "v", "id", bins=8).orderBy("rn").toPandas()
    assert got["id"].tolist() == want["id"].tolist() and got["rn"].tolist() == list(range(1, n + 1))
    want["s"] = pd.qcut(want.index.to_series() + 1.0, 5, labels=[1, 2, 3, 4, 5]).astype(int)
    score = rk.quantile_score(df, "v", "id", "s").toPandas().set_index("id")["s"]
    assert score.loc[want["id"]].tolist() == want["s"].tolist()


def test_value_ranks(spark):
    pdf, df = frame(spark, 400)
    got = rk.average_rank_pct(df, "v", ["k"]).toPandas().set_index("id")["pct"]
    want = pdf.groupby("k")["v"].rank(method="average", pct=True)
    assert (got.loc[pdf["id"]].values - want.values).max() < 1e-12
    low = rk.min_ranks(df, {"v": "r"}).toPandas().set_index("id")["r"]
    assert low.loc[pdf["id"]].tolist() == pdf["v"].rank(method="min", ascending=False).astype(int).tolist()


def test_exact_quantiles(spark):
    pdf, df = frame(spark, 333)
    got = rk.exact_quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.999}, ["k"], 6).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert got.loc[k].round(6).tolist() == [round(part["v"].quantile(q), 6) for q in (0.1, 0.5, 0.999)]


def test_quantiles_hot_key_takes_the_binned_route(spark):
    pdf, df = frame(spark, 300)
    both = [rk.quantiles(df, {"m": ("v", 0.5), "p": ("v", 0.9)}, ["k"], limit=n).orderBy("k").collect() for n in (150, 10**6)]
    assert both[0] == both[1]


def test_top_k_is_total(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 3), (2, 1, 9)], "k int, v int, i int")
    got = rk.top_k(df, ["k"], [F.desc("v"), "i"], 2).orderBy("k", "rank").collect()
    assert [(r.k, r.i) for r in got] == [(1, 1), (1, 2), (2, 9)]


def test_running(spark):
    rows = [("x", d, i, (i * 7) % 5 - 2) for i, d in enumerate([1, 1, 1, 2, 2, 4, 4, 4])]
    df = spark.createDataFrame(rows, "k string, day int, i int, v int")
    got = running(df, ["k"], ["i"], "day", {"s": (F.sum, F.col("v")), "lo": (F.min, F.col("v")), "hi": (F.max, F.col("v"))})
    seen = []
    for r in got.orderBy("i").collect():
        assert r.s == sum(seen) and r.lo == (min(seen) if seen else None) and r.hi == (max(seen) if seen else None)
        seen.append(r.v)


@pytest.mark.parametrize("shape", ["unique", "single", "mixed", "nulls"])
def test_ranks_shuffle_rows_once_and_repeat_no_table(spark, tmp_path, shape):
    n = 4000
    value = {"unique": F.col("id") * 7 % n, "single": F.lit(3.0), "mixed": F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 900),
             "nulls": F.when(F.col("id") % 3 > 0, F.col("id") % 50)}[shape].cast("double")
    spark.range(n).select("id", value.alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = rk.with_ranks(df, "v", bins=16)
    got = out.toPandas().set_index("id").sort_index()
    v = df.toPandas().set_index("id").sort_index()["v"]
    assert (got["n_smaller"].dropna() == v.rank(method="min").dropna() - 1).all()
    assert (got["n_equal"].dropna() == v.groupby(v).transform("size").dropna()).all() and got["n_smaller"].isna().equals(v.isna())
    # each row goes through one exchange; a value that is frequent does not make one task of it
    x = rk._with_bins(df, "v", 16).agg(F.max("_bin")).head()[0]
    assert x is None or x <= 32
    tasks = out.groupBy("v", F.xxhash64("id", "v") % 64).count().count()
    assert tasks > 16


def test_salted_join_repeats_only_heavy_keys(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"))
    rows.write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    lookup = rows.select("k").distinct().withColumn("w", F.col("k") * 2)
    heavy = skew.heavy_keys(rows, ["k"], 16).collect()
    assert [x["_salts"] for x in heavy] == [8] and heavy[0]["_h"] == rows.filter("k = -1").select(F.xxhash64("k")).head()[0]
    got = skew.salted_join(rows, lookup, ["k"], ["id"], salts=16)
    assert got.count() == 5000 and got.filter("w <> 2 * k").count() == 0
    assert skew.salted_join(rows, lookup.filter("k > 10"), ["k"], ["id"], "left", 16).filter("w IS NULL").count() == rows.filter("k <= 10").count()
    assert skew.heavy_keys(rows.filter("k > 0"), ["k"], 16).count() == 0 and skew.heavy_keys(rows.limit(0), ["k"], 16).count() == 0


@pytest.mark.parametrize("bins", [2, 8, 200])
def test_quantiles_by_histogram(spark, bins):
    pdf, df = frame(spark, 500)
    got = rk.exact_quantiles(df, "v", {"a": 0.0, "m": 0.5, "z": 1.0, "s": 0.37}, bins=bins).head()
    assert [round(x, 9) for x in got] == [round(pdf["v"].quantile(q), 9) for q in (0, 0.5, 1, 0.37)]
    by = rk.exact_quantiles(df, "v", {"m": 0.5, "s": 0.83}, ["k"], bins=bins).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert [round(x, 9) for x in by.loc[k]] == [round(part["v"].quantile(q), 9) for q in (0.5, 0.83)]
    assert rk.exact_quantiles(df.limit(0), "v", {"m": 0.5}).head().m is None
