"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed entry is a host and a path prefix with a verdict. It fits its host and every subdomain when the
path of a URL starts with its path; of several that fit, the longest (host and path together, then host)
holds. For each URL only the host suffixes and path prefixes of sizes that occur in the list are looked up.
Look-ups that the Bloom filter passes go to a join with the list, which removes false positives.

The filter is one array of 64-bit words, eight words a block; a key sets one bit in each word of one block.
Its size follows the list up to ``max_filter_bytes`` and no further: with more entries more look-ups reach
the join, and results stay the same. Null URLs, or ones without ``://``, have an empty host and path and
fit nothing. Null or repeated page ids are kept row by row; an empty list gives everything the default.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _bit(key: Column, word: int) -> Column:
    return (F.xxhash64(key, F.lit(word)).bitwiseAND(F.lit(63))).cast("int")


def block_count(entries: int, bits_per_entry: int = 16, max_filter_bytes: int = 1 << 20) -> int:
    wanted = max(1, math.ceil(entries * bits_per_entry / (64 * _WORDS)))
    return min(1 << (wanted - 1).bit_length(), max_filter_bytes // (8 * _WORDS))


def bloom_words(listed: DataFrame, blocks: int) -> DataFrame:
    """One row, one array: the filter's words by block."""
    spark = listed.sparkSession
    keyed = listed.select(F.xxhash64("host", "path").alias("key"))
    made = keyed.groupBy(F.pmod("key", F.lit(blocks)).alias("block")).agg(*[
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key"), i))).alias(f"w{i}")
        for i in range(_WORDS)])
    every = spark.range(blocks).withColumnRenamed("id", "block").join(made, "block", "left")
    words = F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(_WORDS)])
    rows = every.select(F.struct("block", words.alias("words")).alias("row"))
    return rows.agg(F.flatten(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["words"])).alias("words"))


def _maybe(words: Column, key: Column, blocks: int) -> Column:
    """False only for keys that are not listed."""
    base = (F.pmod(key, F.lit(blocks)) * _WORDS).cast("int")
    found = F.lit(True)
    for i in range(_WORDS):
        word = F.get(words, base + i)
        found = found & (F.call_function("shiftrightunsigned", word, _bit(key, i)).bitwiseAND(F.lit(1)) == 1)
    return found


def listing(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (verdict, host, path) as a table."""
    return spark.createDataFrame([(h, p, v) for v, h, p in entries], "host string, path string, verdict string")


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", max_filter_bytes: int = 1 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, bloom_hits (look-ups the filter passed) for every row of ``pages``."""
    listed = (listed.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
              .filter("host is not null and verdict is not null")
              .groupBy("host", "path").agg(F.min("verdict").alias("verdict")))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("paths"),
                       F.collect_set(_labels(F.col("host"))).alias("labels")).head()
    blocks = block_count(facts.n, max_filter_bytes=max_filter_bytes)
    path_sizes = F.array(*map(F.lit, sorted(facts.paths))).cast("array<int>")
    label_counts = F.array(*map(F.lit, sorted(facts.labels))).cast("array<int>")
    rows = (pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
            .withColumn("words", bloom_words(listed, blocks).scalar()))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(label_counts, lambda n: n <= F.size(parts)),
                           lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(path_sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    lookups = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(
        h.alias("h"), p.alias("p"), F.xxhash64(h, p).alias("key")))))
    probed = rows.withColumn("hits", F.filter(lookups, lambda x: _maybe(F.col("words"), x["key"], blocks))).drop("words")
    missed = probed.filter(F.size("hits") == 0).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        F.lit(0).alias("bloom_hits"))
    rules = listed.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("found"))
    best = F.max(F.when(F.col("found").isNotNull(), F.struct(
        (F.length("h") + F.length("p")).alias("size"), F.length("h").alias("host_size"),
        F.concat("h", "p").alias("rule"), F.col("found"))))
    joined = (probed.filter(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id())
              .withColumn("hit", F.explode("hits"))
              .select("row", "page_id", "host", "path", F.col("hit.h").alias("h"), F.col("hit.p").alias("p"))
              .join(rules, ["h", "p"], "left")
              .groupBy("row", "page_id", "host", "path").agg(best.alias("best"), F.count("*").cast("int").alias("bloom_hits"))
              .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.found", F.lit(default)).alias("verdict"), "bloom_hits"))
    return missed.unionByName(joined)
