"""Array work over the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

_PRIME = 0x100000001B3
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each begins (with the end)."""
    a = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    a = pc.fill_null(a.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(lengths: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Runs of rows with about ``most`` bytes of text, or one longer row."""
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield slice(start, len(lengths))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)
    return run(_PRIME), run(pow(_PRIME, -1, 1 << 64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each white-space separated word: a hash that ignores ASCII case, its row, its first byte."""
    blank = data <= 32
    starts = ~blank
    starts[1:] &= blank[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[first] = ~blank[first]
    at = np.flatnonzero(starts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    size = max(1 << 16, 1 << int(len(data) - 1).bit_length())
    power, inverse = _powers(size)
    value = _LOWER[data]
    value += np.uint64(1)
    value[blank] = 0
    value *= power[:len(data)]
    sums = np.add.reduceat(value, at) * inverse[at]
    return mix64(sums), np.searchsorted(offsets, at, "right") - 1, at
