"""Vector bin packing of tokenised examples into fixed-length training sequences.

Every sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Examples are
placed by the dot-product heuristic: the open sequence takes, of the examples that still fit, the one whose
demand vector has the largest inner product with what is left of the limits. When nothing fits as a whole,
the example with the largest product is cut to what is left and its rest goes back to the pool.

Tokenising and packing are one pass over each scan partition, without a shuffle: memory is the pool (``pool_size``
examples) and a bounded cache of words, and a task that runs again gives the same sequences, as
its input split and order are fixed. A partition's end is packed into sequences of falling powers of two.

Null or empty text is an example of the end token alone; null ids stay null; repeated rows are packed
once each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batches, small_batches

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long, ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("loss_tokens", pa.int64()), ("ids", pa.binary())])
#: Texts with these go to the tokenizer whole: the first four split words here and not there, the next two
#: lower-case by context, and the last may begin a special token.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u0130", "\u03a3", "<|")
_BEYOND_LATIN = re.compile("[\u0180-\U0010ffff]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Sequences of one task are numbered from the task's number times this.
TASK_STRIDE = 1 << 36


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


class WordTokens(dict):
    """Ids as little-endian 32-bit words, by white-space separated lower-case word, in a bounded cache.

    For byte-level tokenizers that lower-case, drop white space, split letters from marks and never merge
    across these. A word of letters with marks behind it is the sum of both; other words, and texts beyond
    the plain Latin range, go through the tokenizer's own steps. A full cache keeps the words seen first,
    which are the frequent ones.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most_words = most_words
        # the visible character that the byte-level step gives each byte
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        rest = [c for c in range(256) if c not in set(plain)]
        self.visible = {c: chr(256 + i) for i, c in enumerate(rest)}
        assert set(pre_tokenizers.ByteLevel.alphabet()) == {chr(c) for c in plain} | set(self.visible.values())

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters == word and word.isalpha():
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.visible)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        elif letters != word and letters.isalpha():
            return self[letters] + self[word[len(letters):]]  # not kept: both parts are
        else:
            ids = self.whole(word)
        if len(self) >= self.most_words:
            for w in list(self)[self.most_words // 2:]:
                del self[w]
        self[word] = ids
        return ids

    def plain(self, text: str) -> bool:
        return not any(x in text for x in _ODD) and (text.isascii() or not _BEYOND_LATIN.search(text))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; each distinct word is looked up once, the rest is array work."""
        plain = [self.plain(t) for t in texts]
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())))
        words = lists.flatten().dictionary_encode()
        parts = [self[w] for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        at = words.indices.to_numpy()
        length = sizes[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        first = (np.cumsum(sizes) - sizes)[at]
        out = ids[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()]
        spans = iter(zip(bounds[:-1], bounds[1:]))
        return [out[slice(*next(spans))].tobytes() if p else self.whole(t) for t, p in zip(texts, plain)]


@cache
def word_tokens(path: str | None = None) -> WordTokens:
    """One tokenizer and word cache for all tasks of a Python worker; by default the public 49k-word vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return WordTokens(path)


@dataclass
class Example:
    doc_id: int | None
    ids: bytes
    free: int  # leading tokens without loss
    at: int = 0

    @property
    def total(self) -> int:
        return len(self.ids) // 4

    @property
    def left(self) -> int:
        return self.total - self.at

    def loss(self, length: int) -> int:
        return max(0, self.at + length - max(self.at, self.free))

    def longest(self, tokens: int, loss: int) -> int:
        """Tokens of the longest next piece within both limits."""
        return min(tokens, self.left, max(0, self.free - self.at) + loss)


def pack_stream(examples: Iterable[Example], limits: Limits, pool_size: int = 128) -> Iterator[list[tuple[Example, int, int, int]]]:
    """Sequences as lists of (example, start, length, loss tokens), from a stream of examples."""
    per = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    source, ended = iter(examples), False
    pool: list[Example | None] = [None] * pool_size
    tokens, losses = np.zeros(pool_size), np.zeros(pool_size)  # demand of each place in the pool; 0 tokens: free
    spare, held = list(range(pool_size))[::-1], 0
    while True:
        while spare and not ended:
            e = next(source, None)
            if e is None:
                ended = True
                break
            i = spare.pop()
            pool[i], tokens[i], losses[i] = e, e.left, e.loss(e.left)
            held += e.left
        if not held:
            return
        room = limits.tokens if held >= limits.tokens else 1 << (held.bit_length() - 1)
        segments, loss_room = limits.segments, limits.loss_tokens
        placed: list[tuple[Example, int, int, int]] = []
        while room and segments and len(spare) < pool_size:
            # inner product of demand and what is left, each in parts of its limit
            product = tokens * (room / per[0] ** 2) + losses * (loss_room / per[2] ** 2) + segments / per[1] ** 2
            product[tokens == 0] = -1.0
            fits = (tokens > 0) & (tokens <= room) & (losses <= loss_room)
            i = int(np.argmax(np.where(fits, product, -1.0)))
            if not fits[i] or (segments == 1 and tokens[i] < room):
                i = int(np.argmax(product))  # cut one; the last segment should fill what is left
            e = pool[i]
            length = e.longest(room, loss_room)
            if not length:  # no loss-bearing token may follow; an example with free tokens still may
                able = [j for j, x in enumerate(pool) if x and x.longest(room, loss_room)]
                if not able:
                    break
                i = max(able, key=product.__getitem__)
                e = pool[i]
                length = e.longest(room, loss_room)
            loss = e.loss(length)
            placed.append((e, e.at, length, loss))
            e.at += length
            held, room, segments, loss_room = held - length, room - length, segments - 1, loss_room - loss
            tokens[i], losses[i] = e.left, e.loss(e.left)
            if not e.left:
                pool[i] = None
                spare.append(i)
        yield placed


def _slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[slice]:
    """Runs of rows with about so many bytes of text, or one longer row."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most_bytes:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def pack(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], limits: Limits = Limits(), end_id: int = 1,
         prompt_col: str | None = None, pool_size: int = 128) -> DataFrame:
    """Pieces of all examples with their sequence and place in it.

    ``encode`` makes a tokenizing function on an executor. Tokens of ``prompt_col`` come first and bear no loss.
    """
    prompt = F.coalesce(F.col(prompt_col).cast("string"), F.lit("")) if prompt_col else F.lit("")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), prompt.alias("prompt"))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encode()

        def examples() -> Iterator[Example]:
            for batch in it:
                for at in _slices(batch.column(1)):
                    part = batch.slice(at.start, at.stop - at.start)
                    asked = tokens(part.column(2).to_pylist()) if prompt_col else [b""] * part.num_rows
                    for doc_id, a, ids in zip(part.column(0).to_pylist(), asked, tokens(part.column(1).to_pylist())):
                        yield Example(doc_id, a + ids + end, len(a) // 4)

        def pieces() -> Iterator[tuple]:
            first = TaskContext.get().partitionId() * TASK_STRIDE
            for n, placed in enumerate(pack_stream(examples(), limits, pool_size)):
                offset = 0
                for e, start, length, loss in placed:
                    yield (e.doc_id, start, length, e.total, first + n, offset, loss, e.ids[4 * start:4 * (start + length)])
                    offset += length

        yield from batches(pieces(), _ARROW, 1024)

    return rows.mapInArrow(run, SCHEMA)
