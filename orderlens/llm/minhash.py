"""Near-duplicate documents by BagMinHash signatures, bands and a check of multiset overlap.

A document is the multiset of its five-word shingles (lower-cased ASCII, split at white space; a shorter text is one
shingle). Every shingle has Poisson processes over its weight axis, one for each interval [0, 1), [1, 2),
[2, 4), [4, 8) and so on, so points up to any weight are found without listing weights one by one; a point has a
time, a weight level and a signature place, all fixed by the shingle. A document's signature holds, for each
place, its earliest point with a level below the shingle's count. Two documents agree in a place with the
probability of their weighted Jaccard similarity. Points come in order of time, and a shingle stops once
it is past the document's latest signature time.

Equal multisets are joined before anything else. Documents that agree in a whole band are candidates. In
every bucket of a band each member is first compared with one of them, its hub; members of a bucket that are not
connected by then are compared with all members of other components, block by block, sketches first and then texts, so
no candidate pair between different components goes unchecked, large buckets list no pairs, and no bucket or hub is one
task's work: frequent ones are dealt by documents. Pairs whose signatures agree in fewer places
than seven standard deviations below the threshold allows go no further; the others are links if their weighted
Jaccard similarity, computed exactly from the texts, reaches the threshold. With 25 bands of 5 a pair of
similarity 0.8 is missed with probability 5e-5.

Null text counts as empty; texts without words are copies of each other. Rows with a null id are classes of
their own (class_id null, kept true). Repeated ids are one document. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.functions.skew import heavy_keys, salted_join

from .common import mix64, small_batches, stage
from .components import components
from .text_arrays import slices, utf8, word_hashes

_TO_UNIT = 2.0**-53


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and their rows; a row with fewer words has one run."""
    words, row, _ = word_hashes(data, offsets)
    if not len(words):
        return words, row
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    ends = bounds[row + 1]
    total = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            at = np.arange(len(words)) + i
            there = at < ends
            part = np.zeros(len(words), np.uint64)
            part[there] = mix64(words[at[there]], i)
            total = total * np.uint64(0x9E3779B1) + part
    whole = (np.arange(len(words)) + width <= ends) | (np.arange(len(words)) == bounds[row])
    return mix64(total[whole]), row[whole]


def weighted(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts, sorted by row and hash."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) * _TO_UNIT


def bag_min_hash(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, places: int) -> np.ndarray:
    """A row of ``places`` signature values (times of the earliest points; infinite without words)."""
    times = np.full((rows, places), np.inf)
    # one process for each shingle and dyadic interval of its weight
    top = int(weight.max(initial=1)).bit_length()
    h, r, w, low, wide = [], [], [], [], []
    for k in range(top + 1):
        start, size = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        at = np.flatnonzero(weight > start)
        if not len(at):
            break
        h.append(mix64(hashes[at], 1000 + k))
        r.append(row[at])
        w.append(weight[at])
        low.append(np.full(len(at), float(start)))
        wide.append(np.full(len(at), float(size)))
    if not h:
        return times
    h, r, w, low, wide = map(np.concatenate, (h, r, w, low, wide))
    now = np.zeros(len(h))
    step = 0
    while len(h):
        x = mix64(h, 4 * step)
        now = now - np.log(_uniform(x)) / wide
        place = (mix64(h, 4 * step + 1) % np.uint64(places)).astype(np.int64)
        counts = low + _uniform(mix64(h, 4 * step + 2)) * wide < w  # the point's level is within the weight
        np.minimum.at(times, (r[counts], place[counts]), now[counts])
        active = now < times.max(axis=1)[r]
        if not active.all():
            h, r, w, low, wide, now = h[active], r[active], w[active], low[active], wide[active], now[active]
        step += 1
    return times


def elements(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A multiset as a set: a word for each shingle and number of occurrence, sorted."""
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.unique(mix64(np.repeat(hashes, weight) + nth.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))


def _arrays(texts: pa.Array, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct shingles, rows and counts of the texts, about a megabyte of text at a time."""
    data, offsets = utf8(texts)
    for s in slices(np.diff(offsets), 1 << 20):
        o = offsets[s.start:s.stop + 1]
        yield (s, *weighted(*shingles(data[o[0]:o[-1]], o - o[0], width)))


def sketches(values: np.ndarray) -> np.ndarray:
    """Four bits of each signature value, sixteen values to a 64-bit word."""
    rows, places = values.shape
    four = np.zeros((rows, -(-places // 16) * 16), np.uint64)
    four[:, :places] = values & np.uint64(15)
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(four.reshape(rows, -1, 16) << shifts, axis=2).view(np.int64)


def may_reach(a: str, b: str, threshold: float, places: int) -> Column:
    """Whether two sketches agree in enough places."""
    agree = threshold + (1 - threshold) / 16
    least = math.floor(places * agree - 7 * math.sqrt(places * agree * (1 - agree)))
    differ = F.lit(0)
    for i in range(-(-places // 16)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= places - least


def signatures(docs: DataFrame, bands: int, band_rows: int, width: int) -> DataFrame:
    """id, k1 and k2 (a digest of the multiset), n (its size), bands (a hash for each), sketch of the signature."""
    places = bands * band_rows

    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s, h, row, weight in _arrays(batch.column(1), width):
                rows = s.stop - s.start
                times = bag_min_hash(h, row, weight, rows, places)
                values = mix64(times.view(np.uint64))
                sketch = sketches(values)
                values = values.reshape(rows, bands, band_rows)
                keys = np.zeros((rows, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(band_rows):
                        keys = mix64(keys + values[:, :, i], i)
                    part = mix64(h, 77) * weight.astype(np.uint64), mix64(h, 78) * weight.astype(np.uint64)
                sums = [np.zeros(rows, np.uint64) for _ in part]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                for total, p in zip(sums, part):
                    if len(first):
                        total[row[first]] = np.add.reduceat(p, first)
                n = np.bincount(row, weights=weight, minlength=rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s.start, rows), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(n),
                    pa.array(list(keys.view(np.int64)), schema.field("bands").type), pa.array(list(sketch), schema.field("sketch").type)],
                    schema=schema)

    return (docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, "id long, k1 long, k2 long, n long, bands array<long>, sketch array<long>"))


def shingle_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """id and elements of the documents in ``needed``; only these are shuffled, or none if their ids are few."""
    schema = pa.schema([("id", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s, h, row, weight in _arrays(batch.column(1), width):
                bounds = np.searchsorted(row, np.arange(s.stop - s.start + 1))
                sets = [elements(h[a:b], weight[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, len(sets)), pa.array(sets, schema.field(1).type)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    needed = stage(needed.distinct(), "compared")  # so its size is known
    return stage(texts.join(needed, "id", "left_semi").mapInArrow(run, "id long, elements array<long>"), "shingle-sets")


def verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs u, v whose documents are similar enough; a frequent v is dealt over several tasks by u. ``pairs`` is a stored table."""
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")), width)
    heavy = stage(heavy_keys(pairs, ["v"]), "frequent-hubs")  # of bounded size; only these hubs' sets are repeated
    part = F.coalesce(F.pmod(F.xxhash64("u"), F.col("_salts")).cast("int"), F.lit(0)).alias("part")
    dealt = pairs.withColumn("_h", F.xxhash64("v")).join(F.broadcast(heavy), "_h", "left").select("u", "v", part)
    parts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    hubs = (sets.select(F.xxhash64(F.col("id")).alias("_h"), F.col("id").alias("v"), F.col("elements").alias("b"))
            .join(F.broadcast(heavy), "_h", "left").select("v", "b", F.explode(parts).alias("part")))
    both = dealt.join(sets.select(F.col("id").alias("u"), F.col("elements").alias("a")), "u").join(hubs, ["v", "part"])
    common = F.size(F.array_intersect("a", "b"))
    return (both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
            .filter(F.col("common") / F.greatest(F.col("sizes") - F.col("common"), F.lit(1)) >= threshold).select("u", "v").distinct())


def common_counts(a: list[np.ndarray], b: list[np.ndarray], at_once: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set in ``a`` with every set in ``b``, some elements at a time."""
    size = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    values = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    both = np.intersect1d(*values)
    out = np.zeros((len(a), len(b)), np.float32)
    place = []
    for x, n in zip(values, size):
        at = np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0))
        hit = both[at] == x if len(both) else np.zeros(len(x), bool)
        place.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
    for lo in range(0, len(both), at_once):
        sides = []
        for (row, at), n in zip(place, size):
            m = np.zeros((len(n), min(at_once, len(both) - lo)), np.float32)
            some = (at >= lo) & (at < lo + at_once)
            m[row[some], at[some] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


_BUCKET = ["band", "key"]


def in_cells(outer: DataFrame, inner: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with cells o and i: every block of one bucket's outer members meets every block of its inner ones in one cell.

    Both are stored tables. Most buckets are one cell, whose rows are not repeated.
    """
    blocks = [rows.groupBy(*_BUCKET).agg(F.ceil(F.count("*") / block).cast("int").alias(f"{s}_blocks")) for rows, s in ((outer, "o"), (inner, "i"))]
    count = stage(blocks[0].join(blocks[1], _BUCKET), "bucket-blocks")
    dealt = []
    for rows, s, other in ((outer, "o", "i"), (inner, "i", "o")):
        own = F.pmod(F.xxhash64("id"), F.col(f"{s}_blocks")).cast("int").alias(s)
        dealt.append(salted_join(rows, count, _BUCKET, ["id"]).select(
            *rows.columns, own, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)))
    return dealt[0], dealt[1]


def sketched_apart(outer: DataFrame, inner: DataFrame, near: Column, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The outer and the inner members that may be similar (``near``) to one of the other side in another component of their bucket."""
    o, i = (x.alias(s) for x, s in zip(in_cells(outer, inner, block), "oi"))
    meet = (F.col("o.component") != F.col("i.component")) & near
    for c in (*_BUCKET, "o", "i"):
        meet = (F.col(f"o.{c}") == F.col(f"i.{c}")) & meet
    outer = stage(o.join(i, meet, "left_semi").select("o.*"), "outer-cells")
    inner = i.join(outer.alias("o"), meet, "left_semi").select("i.*")
    return tuple(stage(x.select(*_BUCKET, "id", "component").distinct(), "sketched-apart") for x in (outer, inner))


def apart_links(outer: DataFrame, inner: DataFrame, docs: DataFrame, width: int, threshold: float, block: int = 512) -> DataFrame:
    """Links u, v between different components of a bucket; both tables are stored.

    ``outer`` holds the members outside a bucket's main component, ``inner`` all members. Both are dealt into blocks, and
    every two blocks of a bucket meet in one task, which counts common shingles for all of their pairs at once
    and returns, for each document and component, one link; pairs are not listed.
    """
    sides = [rows.select(*_BUCKET, "o", "i", F.lit(s).alias("side"), "id", "component") for rows, s in zip(in_cells(outer, inner, block), "oi")]
    cells = sides[0].unionByName(sides[1])
    sets = shingle_sets(docs, outer.select("id").union(inner.select("id")), width)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, parts, side = t["id"].to_numpy(), t["component"].to_numpy(), np.asarray(t["side"].to_pylist())
        listed = t["elements"].chunk(0) if t["elements"].num_chunks else t["elements"]
        offsets, values = listed.offsets.to_numpy(), listed.values.to_numpy()
        found = [np.zeros(0, np.int64)] * 2
        o, i = (np.flatnonzero(side == s) for s in "oi")
        if len(o) and len(i):
            a, b = ([values[offsets[k]:offsets[k + 1]] for k in at] for at in (o, i))
            common = common_counts(a, b)
            sizes = np.fromiter(map(len, a), float)[:, None] + np.fromiter(map(len, b), float)
            x, y = np.nonzero((common / np.maximum(sizes - common, 1) >= threshold) & (parts[o][:, None] != parts[i]))
            _, one = np.unique(np.stack([x, parts[i][y]]), axis=1, return_index=True)
            found = [ids[o[x[one]]], ids[i[y[one]]]]
        return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})

    return cells.join(sets, "id").groupBy(*_BUCKET, "o", "i").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 25, band_rows: int = 5) -> DataFrame:
    """doc_id, class_id (least id of its class), kept (doc_id = class_id): one row for each row of ``docs``."""
    docs = small_batches(docs)
    signed = stage(signatures(docs, bands, band_rows, width), "signatures")
    distinct = stage(signed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                                                    F.first("sketch").alias("sketch")), "distinct-bags")
    members = distinct.filter("n > 0").select("id", "n", F.posexplode("bands").alias("band", "key"))
    # another hub in every bucket of a document: what one leaves apart, the next ones join
    first = F.min(F.struct(F.xxhash64("id", "band", "key").alias("h"), "id"))
    buckets = members.groupBy("band", "key").agg(first["id"].alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")
    shared = stage(salted_join(members, stage(buckets, "buckets"), _BUCKET, ["id"]), "shared-buckets")
    # sizes within the threshold: a smaller multiset holds at most its own size of the larger
    near = (F.least("n", "m") >= F.greatest("n", "m") * (threshold - 1e-9)) & may_reach("a", "b", threshold, bands * band_rows)
    own = distinct.select("id", F.col("sketch").alias("a"))
    other = distinct.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("b"))
    met = salted_join(shared.filter("id <> hub").select("id", "n", "hub"), other, ["hub"], ["id"]).join(own, "id").filter(near)
    stars = stage(met.groupBy(F.greatest("id", "hub").alias("hi"), F.least("id", "hub").alias("lo")).agg(F.max("hub").alias("v"))
                  .select(F.when(F.col("hi") == F.col("v"), F.col("lo")).otherwise(F.col("hi")).alias("u"), "v"), "star-pairs")
    links = stage(verified(stars, docs, width, threshold), "star-links")
    groups = components(links)
    # what is still apart within a bucket
    placed = stage(shared.join(groups.withColumnRenamed("node", "id"), "id", "left")
                   .withColumn("component", F.coalesce("component", "id")), "placed")
    main = groups.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    apart = (placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo < hi").select("band", "key"))
    rest = stage(placed.filter("id <> hub").join(apart, ["band", "key"], "left_semi").join(main, "hub", "left")
                 .withColumn("main", F.coalesce("main", "hub")).join(own, "id"), "apart")
    outer = rest.filter("component <> main").select("band", "key", "id", "n", "component", "a")
    inner = rest.select("band", "key", "id", F.col("n").alias("m"), "component", F.col("a").alias("b"))
    if not outer.isEmpty():
        outer, inner = sketched_apart(outer, inner, near)
        more = stage(apart_links(outer, inner, docs, width, threshold), "other-links")
        groups = components(links.unionByName(more))
    classes = (distinct.select("k1", "k2", "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
               .select("k1", "k2", F.coalesce("component", "id").alias("class_id")))
    found = signed.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select(F.col("id").alias("doc_id"), "class_id")
    nulls = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(nulls).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
