"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a ``length``-byte string that also starts in a document with a smaller id is removed.

1. Each window of ``length`` bytes has a fingerprint, the least hash of the 16-byte strings in it, so equal windows
   have equal fingerprints, and runs of windows with one fingerprint form a segment. Only fingerprints that occur in
   two documents can hold a match; they are found by counting packed 32-bit parts in as many buckets as the
   input asks for. Documents are kept by shard in bucketed files, which are read three times and not shuffled again;
   a file holds several shards where the input asks for more shards than Spark has buckets.
2. Segments with such a fingerprint, equal ones of a shard joined, go to the bucket of the fingerprint.
   There equal segments of all shards are joined, and those whose fingerprint has several are the strings of a few
   shard texts. Each gets its transform, and the transforms are merged by refining their interleave: one
   stable pass by the preceding symbol a round (two rounds at a time), so after round h all suffixes are in the
   order of their first h bytes without being sorted again; only suffixes that begin h bytes before a window's
   end take part in round h. A boundary that appears in round h divides suffixes with h - 1 bytes in
   common; a suffix alone between two boundaries can equal no other and leaves. The intervals that are left
   after ``length`` rounds are the repeated strings. Each interval's least document id is the answer for its windows.
3. Answers return to the shards as runs of windows, where the bytes are removed.

Memory of a task is that of a shard or bucket, whose number follows the input. A fingerprint of more than
``hot_documents`` documents is dealt out again by the windows themselves, so no bucket gathers them.

Null text counts as empty. Texts of one id are one document to each other (nothing of one is removed for the
other). Rows with a null id have no order: nothing of them is removed, and nothing for them. An empty table gives
no rows. Strings are told apart by their fingerprint and a 64-bit hash of their bytes; whether a fingerprint has
a single string, by 63 bits of that hash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, stage
from orderlens.session import stage_bucketed

GRAM = 16
_PART = 1 << 20  # windows of a long text that are looked at together
_NONE = np.iinfo(np.int64).max
_SEPARATOR = 255
_SEGMENT = np.dtype([("key", "<u8"), ("hash", "<u8"), ("n", "<u4"), ("doc", "<i8")])
_RUN = np.dtype([("string", "<u4"), ("start", "<u4"), ("n", "<u4"), ("doc", "<i8")])
_COUNT = np.dtype([("part", "<u4"), ("docs", "<u4"), ("content", "<u8")])  # content 0: several
_MARK = np.dtype([("part", "<u4"), ("mark", "u1")])
_SEVERAL, _HOT, _SINGLE = 1, 2, 3  # strings with a fingerprint: several; too many documents; one


def _pack(rows: np.ndarray) -> bytes:
    """Rows as planes of bytes, which compress better: sorted and small numbers repeat their high bytes."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes() if len(rows) else b""


def _unpack(data, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)
    prime = 0x9E3779B97F4A7C15
    return run(prime), run(pow(prime, -1, 1 << 64))


def window_minima(data: np.ndarray, length: int) -> np.ndarray:
    """The least hash of the 16-byte strings in each window of ``length`` bytes."""
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    x = x[:-4] | (x[4:] << np.uint64(32))
    with np.errstate(over="ignore"):
        least = mix64(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + (x[8:] ^ (x[8:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    span, want = 1, length - GRAM + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:len(least) - (want - span)], least[want - span:]) if want > span else least


def _runs(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of whole texts, or parts of a long one: where they begin, inner bounds, rows."""
    rows: list[int] = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if rows and b - int(offsets[rows[0]]) > _PART:
            yield int(offsets[rows[0]]), offsets[rows[0]:rows[-1] + 2] - offsets[rows[0]], np.array(rows)
            rows = []
        if b - a > _PART + length:
            for p in range(a, b - length + 1, _PART):
                yield p, np.array([0, min(b, p + _PART + length - 1) - p]), np.array([i])
        else:
            rows.append(i)
    if rows:
        yield int(offsets[rows[0]]), offsets[rows[0]:rows[-1] + 2] - offsets[rows[0]], np.array(rows)


class Segments:
    """Runs of windows with one fingerprint: row, first byte, windows, fingerprint, hash of the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        parts = []
        for at, bounds, rows in _runs(offsets, length):
            b = data[at:at + int(bounds[-1])]
            if len(b) < length:
                continue
            least = window_minima(b, length)
            ends = np.repeat(bounds[1:], np.diff(bounds))[:len(least)]
            valid = np.arange(len(least)) + length <= ends
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            stop = np.ones(len(least), bool)  # the last window of a run
            stop[:-1] = new[1:] | ~valid[1:]
            n = np.flatnonzero(stop & valid) + 1 - first
            power, inverse = _powers(2 * _PART)
            with np.errstate(over="ignore"):
                total = np.zeros(len(b) + 1, np.uint64)
                np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=total[1:])
                content = mix64((total[first + n + length - 1] - total[first]) * inverse[first])
            parts.append((rows[np.searchsorted(bounds, first, "right") - 1], first + at, n, mix64(least[first]), content))
        empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        self.row, self.first, self.n, self.key, self.hash = map(np.concatenate, zip(empty, *parts)) if parts else empty

    def keep(self, at: np.ndarray) -> None:
        self.row, self.first, self.n, self.key, self.hash = (x[at] for x in (self.row, self.first, self.n, self.key, self.hash))

    def single_windows(self, hot: np.ndarray, data: np.ndarray, length: int) -> None:
        """Hot segments become segments of one window, with a key of their own bytes."""
        if not hot.any():
            return
        row, n = np.repeat(self.row[hot], self.n[hot]), self.n[hot]
        first = np.repeat(self.first[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        content = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length):
                content = content * np.uint64(0x9E3779B97F4A7C15) + data[first + i] + np.uint64(1)
        cold = ~hot
        self.row, self.first = np.concatenate([self.row[cold], row]), np.concatenate([self.first[cold], first])
        self.n = np.concatenate([self.n[cold], np.ones(len(first), np.int64)])
        self.key = np.concatenate([self.key[cold], mix64(content, 9)])
        self.hash = np.concatenate([self.hash[cold], mix64(content)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """An order of the segments, and for each in this order whether it is the first of equal ones."""
        order = np.lexsort((self.n, self.hash, self.key))
        k, h, n = self.key[order], self.hash[order], self.n[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])
        return order, new


def _content(seg: Segments) -> np.ndarray:
    """64 bits of a segment's bytes and length, never 0."""
    return mix64(seg.hash + seg.n.astype(np.uint64), 5) | np.uint64(1)


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a shard's documents, in the order of id and bytes."""
    t = t.select(["doc_id", "text"]).combine_chunks()
    ids = t["doc_id"].to_numpy()
    text = t["text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], text[i]))
    data = np.frombuffer(b"".join(text[i] for i in order), np.uint8)
    return ids[order], data, np.concatenate([[0], np.cumsum([len(text[i]) for i in order], dtype=np.int64)]).astype(np.int64)


def _table(columns: dict, types: dict) -> pa.Table:
    return pa.table({c: pa.array(columns[c], types[c]) for c in types})


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


_PACKED = {"shard": pa.int64(), "bucket": pa.int64(), "kind": pa.int32(), "payload": pa.large_binary()}
_PACKED_DDL = "shard long, bucket long, kind int, payload binary"


def _rows(shard: np.ndarray, bucket: np.ndarray, kind: int, payloads: list[bytes]) -> pa.Table:
    t = {**_PACKED, "payload": pa.binary()}
    return _table({"shard": shard, "bucket": bucket, "kind": np.full(len(payloads), kind, np.int32), "payload": payloads}, t)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, for all rows and behind the last; both ends differ."""
    edge = np.ones(len(columns[0]) + 1, bool)
    edge[1:-1] = False
    for c in columns:
        edge[1:-1] |= c[1:] != c[:-1]
    return edge


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text in the order of their next ``depth`` symbols, by doubling of ranks where they are equal so far."""
    n = len(text)
    x = np.concatenate([text] * (1 + -(-(depth + 8) // max(n, 1))))[:n + 8].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    known = min(8, depth)
    for i in range(known):
        key = (key << np.uint64(8)) | x[i:i + n]
    order = np.argsort(key)
    key, equal, rank = key[order], np.arange(n), np.empty(n, np.uint64)
    while known < depth:
        edge = _edges(key)
        first = edge[:-1]
        rank[order[equal]] = equal[first][np.cumsum(first) - 1]
        equal = equal[~(first & edge[1:])]
        step = min(known, depth - known)
        place = order[equal]
        key = (rank[place] << np.uint64(32)) | rank.take(place + step, mode="wrap")
        by = np.argsort(key)
        order[equal], key = place[by], key[by]
        known += step
    return order


def merge_transforms(transforms: list[np.ndarray], steps: list[np.ndarray], rows: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of those windows of the shards that equal another in ``depth`` symbols, in their order, and their intervals.

    ``rows`` are the transforms' rows behind the windows' ends, ``steps`` lead from a row to that of the suffix that begins
    a symbol earlier. Rows are counted through all transforms. Each round all suffixes step; a stable pass by the symbol
    passed keeps the order of what follows. Two symbols go into a pass. A suffix alone in its interval stays alone however
    many symbols come before it, so it leaves.
    """
    base = np.cumsum([0] + [len(t) for t in transforms[:-1]])
    symbol, back, row = (np.concatenate(x) for x in (transforms, [s + at for s, at in zip(steps, base)], [r + at for r, at in zip(rows, base)]))
    pair, back_two = (symbol[back].astype(np.uint16) << np.uint16(8)) | symbol, back[back]
    interval = np.zeros(len(row), np.int32)
    for h in range(0, depth, 2):
        passed, earlier = (pair, back_two) if h + 1 < depth else (symbol, back)
        s = passed[row]
        step = np.argsort(s, kind="stable")
        row = earlier[row[step]]
        edge = _edges(s[step], interval[step])
        several = ~(edge[:-1] & edge[1:])
        row, interval = row[several], np.cumsum(edge[:-1], dtype=np.int32)[several]
    return row, interval


def repeated_windows(texts: list[np.ndarray], windows: list[np.ndarray], docs: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For every shard text the least document of all equal windows, for the windows in the order of their places.

    ``windows`` holds the places where a window begins (in runs, ascending), ``docs`` their documents.
    """
    transforms, steps, rows, begin, base = [], [], [], [], 0
    for t, w in zip(texts, windows):
        order = suffix_order(t, length)
        rank = np.empty(len(t), np.intp)
        rank[order] = np.arange(len(t))
        transforms.append(t[order - 1]), steps.append(rank[order - 1])
        rows.append(np.sort(rank[w + length])), begin.append(rank[w] + base)
        base += len(t)
    row, interval = merge_transforms(transforms, steps, rows, length)
    at = np.concatenate(begin)
    doc = np.empty(base, np.int64)
    doc[at] = np.concatenate(docs)
    first = _edges(interval)[:-1]
    if len(row):
        doc[row] = np.minimum.reduceat(doc[row], np.flatnonzero(first))[np.cumsum(first) - 1]
    return np.split(doc[at], np.cumsum([len(w) for w in windows])[:-1])


def _least_documents(s: np.ndarray, content: np.ndarray, length: int, shards: int = 2, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the strings' windows and the least document of each window.

    ``s`` is sorted by key, all distinct; ``content`` holds the bytes of those with a hash.
    """
    n = s["n"].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)])
    answer = np.repeat(s["doc"], n)
    size = np.where(s["hash"] != 0, n + length - 1, 0)
    begin = np.cumsum(size) - size
    same = np.concatenate([[False], s["key"][1:] == s["key"][:-1]]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(~same)
    several = same.copy()
    several[:-1] |= same[1:]
    at = np.flatnonzero(several & (s["hash"] != 0))
    # whole groups of one fingerprint, about so many symbols at a time
    load = np.cumsum(size[at] + 1) // at_once
    last = np.flatnonzero(np.diff(group[at], append=-1))
    cuts = last[np.flatnonzero(np.diff(load[last], append=-1))] + 1 if len(at) else []
    for lo, hi in zip([0, *cuts[:-1]], cuts):
        strings = at[lo:hi]
        texts, windows, docs, places = [], [], [], []
        for part in np.array_split(strings, min(shards, len(strings))):
            step = size[part] + 1
            start = np.cumsum(step) - step
            t = np.full(int(step.sum()), _SEPARATOR, np.uint8)
            into = np.repeat(start - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(int(size[part].sum()))
            t[into] = _gather(content, begin[part], size[part])
            w = np.repeat(start - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(int(n[part].sum()))
            texts.append(t), windows.append(w), docs.append(np.repeat(s["doc"][part], n[part])), places.append((part, w))
        for (part, w), found in zip(places, repeated_windows(texts, windows, docs, length)):
            answer[np.repeat(bounds[part] - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(len(w))] = found
    return bounds, answer


def sharded(docs: DataFrame, shard_bytes: int, most_files: int = 1 << 16) -> tuple[DataFrame, int]:
    """Documents with an id in files bucketed by shard, and the number of buckets of fingerprints (a power of two).

    There are twice as many shards as buckets. Beyond ``most_files`` buckets a file holds more of them; as its rows are
    sorted by shard, a task still holds one shard at a time. The files stay in the shared folder, as of every stored table.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = 1 << max(3, math.ceil(math.log2(max(1, size / shard_bytes))))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(2 * buckets)))
    return stage_bucketed(shards, "text-shards", "shard", min(buckets, most_files), ["shard"], compression="zstd"), buckets


def remove_repeats(docs: DataFrame, length: int = 50, shard_bytes: int = 12 << 20, hot_documents: int = 50_000, most_files: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of ``docs``."""
    texts, buckets = sharded(docs, shard_bytes, most_files)
    low = np.uint64(buckets - 1)

    def bucket_and_part(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key & low).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)

    def count(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        ids, data, offsets = _texts(t)
        seg = Segments(data, offsets, length)
        bucket, part = bucket_and_part(seg.key)
        order = np.lexsort((ids[seg.row], part, bucket))
        b, p, d = bucket[order], part[order], ids[seg.row][order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        documents = new.copy()
        documents[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new)
        out = np.empty(len(at), _COUNT)
        if len(at):
            out["part"], out["docs"] = p[at], np.add.reduceat(documents.astype(np.int64), at)
            c = _content(seg)[order]
            least, most = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            out["content"] = np.where(least == most, least, 0)
        bounds = np.searchsorted(b[at], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(bounds))
        return _rows(np.full(len(some), shard), some, 0, [_pack(out[bounds[i]:bounds[i + 1]]) for i in some])

    def find_shared(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        shards = t["shard"].to_numpy()
        parts = [_unpack(x, _COUNT) for x in t["payload"].to_pylist()]
        every = np.concatenate(parts)
        values, inverse = np.unique(every["part"], return_inverse=True)
        total = np.bincount(inverse, weights=every["docs"], minlength=len(values))
        # each id is in one shard, so two shards have two documents
        least, most = np.full(len(values), 2**64 - 1, np.uint64), np.zeros(len(values), np.uint64)
        np.minimum.at(least, inverse, every["content"])
        np.maximum.at(most, inverse, every["content"])
        single = (least == most) & (least > 0)
        mark = np.where(total < 2, 0, np.where(single, _SINGLE, np.where(total >= hot_documents, _HOT, _SEVERAL))).astype(np.uint8)[inverse]
        out, at = [], 0
        for p in parts:
            m = mark[at:at + len(p)]
            at += len(p)
            kept = np.empty(int((m > 0).sum()), _MARK)
            kept["part"], kept["mark"] = p["part"][m > 0], m[m > 0]
            out.append(_pack(kept))
        return _rows(shards, np.full(len(shards), bucket), 0, out)

    def shared_segments(t: pa.Table, lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
        """The shard's texts, and segments with a shared fingerprint; those of a single string have hash 0."""
        ids, data, offsets = _texts(t)
        seg = Segments(data, offsets, length)
        lists = lists.filter(pa.compute.equal(lists["kind"], 0))
        found = [_unpack(x, _MARK) for x in lists["payload"].to_pylist()]
        if not found:
            seg.keep(np.zeros(0, np.int64))
            return ids, data, offsets, seg
        where = np.repeat(lists["bucket"].to_numpy(), [len(x) for x in found]).astype(np.uint64)
        every = np.concatenate(found)
        code = (where << np.uint64(32)) | every["part"]
        order = np.argsort(code)
        code, mark = code[order], every["mark"][order]
        bucket, part = bucket_and_part(seg.key)
        mine = (bucket.astype(np.uint64) << np.uint64(32)) | part
        at = np.minimum(np.searchsorted(code, mine), max(len(code) - 1, 0))
        there = np.flatnonzero(code[at] == mine) if len(code) else np.zeros(0, np.int64)
        seg.keep(there)
        if len(there):
            seg.hash[mark[at[there]] == _SINGLE] = 0
            seg.single_windows(mark[at[there]] == _HOT, data, length)
        return ids, data, offsets, seg

    def send(key: tuple, t: pa.Table, lists: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, [])
        ids, data, _, seg = shared_segments(t, lists)
        order, new = seg.distinct()
        at = np.flatnonzero(new)
        out = np.empty(len(at), _SEGMENT)
        if len(at):
            first = order[at]
            out["key"], out["hash"], out["n"] = seg.key[first], seg.hash[first], seg.n[first]
            out["doc"] = np.minimum.reduceat(ids[seg.row[order]], at)
        bucket = (out["key"] & low).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(bounds))
        payloads = []
        for i in some:
            rows = by[bounds[i]:bounds[i + 1]]
            sent = rows[out["hash"][rows] != 0]
            content = _gather(data, seg.first[order[at[sent]]], out["n"][sent].astype(np.int64) + length - 1)
            payloads.append(np.int64(len(rows)).tobytes() + _pack(out[rows]) + content.tobytes())
        return _rows(np.full(len(some), key[0].as_py()), some, 1, payloads)

    def merge(t: pa.Table) -> pa.Table:
        bucket, shards = t["bucket"][0].as_py(), t["shard"].to_numpy()
        heads, bodies = [], []
        for x in t["payload"].to_pylist():
            n = int(np.frombuffer(x, np.int64, 1)[0])
            heads.append(_unpack(memoryview(x)[8:8 + n * _SEGMENT.itemsize], _SEGMENT))
            bodies.append(np.frombuffer(x, np.uint8, -1, 8 + n * _SEGMENT.itemsize))
        every, content = np.concatenate(heads), np.concatenate(bodies)
        size = np.where(every["hash"] != 0, every["n"].astype(np.int64) + length - 1, 0)
        begin = np.cumsum(size) - size
        order = np.lexsort((every["n"], every["hash"], every["key"]))
        s = every[order]
        new = np.ones(len(s), bool)
        new[1:] = (s["key"][1:] != s["key"][:-1]) | (s["hash"][1:] != s["hash"][:-1]) | (s["n"][1:] != s["n"][:-1])
        at = np.flatnonzero(new)
        strings = s[at].copy()
        strings["doc"] = np.minimum.reduceat(s["doc"], at)
        body = _gather(content, begin[order[at]], size[order[at]])
        bounds, least = _least_documents(strings, body, length)
        # runs of windows with the same answer
        new_run = np.diff(least, prepend=least[0] - 1) != 0
        new_run[bounds[:-1]] = True
        runs = np.flatnonzero(new_run)
        string_of = np.searchsorted(bounds, runs, "right") - 1
        run_bounds = np.searchsorted(string_of, np.arange(len(at) + 1))
        run_n = np.diff(np.append(runs, len(least)))
        which = np.empty(len(every), np.int64)
        which[order] = np.cumsum(new) - 1
        payloads, done = [], 0
        for h in heads:
            mine = which[done:done + len(h)]
            done += len(h)
            k = np.diff(run_bounds)[mine]
            rows = np.repeat(run_bounds[mine] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            out = np.empty(len(rows), _RUN)
            out["string"], out["start"] = np.repeat(np.arange(len(h)), k), runs[rows] - bounds[string_of[rows]]
            out["n"], out["doc"] = run_n[rows], least[runs[rows]]
            payloads.append(_pack(out))
        return _rows(shards, np.full(len(shards), bucket), 1, payloads)

    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}

    def cut(key: tuple, t: pa.Table, lists: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table({c: [] for c in types}, types)
        ids, data, offsets, seg = shared_segments(t, lists)
        order, new = seg.distinct()
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        keys = seg.key[order[np.flatnonzero(new)]] if len(order) else np.zeros(0, np.uint64)
        bucket = (keys & low).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        answers = lists.filter(pa.compute.equal(lists["kind"], 1))
        change = np.zeros(len(data) + 1, np.int32)
        runs = []
        for b, x in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()):
            r = _unpack(x, _RUN)
            lo = np.searchsorted(bucket[by], b)
            runs.append((by[lo + r["string"]], r["start"], r["n"], r["doc"]))
        if runs:
            of, start, n, doc = map(np.concatenate, zip(*runs))
            s = np.argsort(of, kind="stable")
            of, start, n, doc = of[s], start[s].astype(np.int64), n[s].astype(np.int64), doc[s]
            bounds = np.searchsorted(of, np.arange(len(keys) + 1))
            k = np.diff(bounds)[string]
            rows = np.repeat(bounds[string] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            where = np.repeat(np.arange(len(string)), k)
            hit = doc[rows] < ids[seg.row[where]]
            begin = seg.first[where[hit]] + start[rows[hit]]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + n[rows[hit]] + length - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        starts[first] = gone[first]
        spans = np.concatenate([[0], np.cumsum(starts)])
        a, b = offsets[:-1], offsets[1:]
        return _table({"doc_id": ids, "n_bytes": b - a, "n_removed": removed[b] - removed[a], "n_spans": spans[b] - spans[a],
                       "kept": [data[i:j][~gone[i:j]].tobytes() for i, j in zip(a.tolist(), b.tolist())]}, types)

    by_shard = texts.groupBy("shard")
    lists = stage(by_shard.applyInArrow(count, _PACKED_DDL)
                  .groupBy("bucket").applyInArrow(find_shared, _PACKED_DDL), "shared-fingerprints")
    sent = by_shard.cogroup(lists.groupBy("shard")).applyInArrow(send, _PACKED_DDL)
    answers = stage(sent.groupBy("bucket").applyInArrow(merge, _PACKED_DDL), "repeated-windows")
    done = by_shard.cogroup(lists.unionByName(answers).groupBy("shard")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    text = F.coalesce("text", F.lit("")).cast("binary")
    nulls = docs.filter(F.col("doc_id").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), text.alias("kept"))
    return done.unionByName(nulls)
