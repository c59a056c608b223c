"""Bidirectional FM-index of a delimited vocabulary, and a search scheme that allows one error, in numpy.

The text is ``#word#word#...#`` with the words in order. An index of the words and one of the reversed words are
searched in step: a pattern is a pair of rank intervals of the same size, one in each, so it can grow at either end.
Intervals of many patterns are arrays, and a step works on all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BLOCK = 64


def _flat(words: Sequence[str], codes: dict[str, int]) -> np.ndarray:
    """Codes of ``#word#word#``; the delimiter is 0."""
    joined = "\0" + "\0".join(words) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds, at = np.unique(points, return_inverse=True)
    return np.array([codes[chr(k)] for k in kinds.tolist()], np.uint8)[at]


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes of a delimited text with ordered words, in order.

    A suffix is compared up to its delimiter, and then by place, as the words that follow are in order. The first
    round packs as many symbols as fit into a 64-bit key; each later one doubles the length that is compared.
    """
    n, width = len(text), 62 // bits
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1  # symbols up to and with the delimiter
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | np.where(k < left, padded[k:n + k], 0).astype(np.int64)
    order = np.argsort(key, kind="stable")
    held, longest = width, int(left.max())
    while held < longest:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        after = np.zeros(n, np.int64)
        on = np.flatnonzero(left > held)
        after[on] = rank[on + held]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        held *= 2
    return order


class Ranks:
    """Burrows-Wheeler transform of a delimited text with counts per block: how often a symbol, or a smaller one, occurs before a place."""

    def __init__(self, text: np.ndarray, symbols: int):
        bits = max(1, int(symbols - 1).bit_length())
        order = suffix_order(text, bits)
        self.symbols, self.n = symbols, len(text)
        last = text[order - 1]
        last[order == 0] = 0  # the text goes round: what stands before its first delimiter is one
        blocks = -(-(self.n + 1) // _BLOCK)
        self.rows = np.full(blocks * _BLOCK, 255, np.uint8)
        self.rows[:self.n] = last
        self.rows = self.rows.reshape(blocks, _BLOCK)
        counts = np.zeros((blocks + 1, symbols), np.int32)
        flat = np.repeat(np.arange(blocks), _BLOCK)[:self.n].astype(np.int64) * symbols + last
        counts[1:] = np.bincount(flat, minlength=blocks * symbols).reshape(blocks, symbols)
        counts = np.cumsum(counts, axis=0, dtype=np.int32)
        self.smaller = np.zeros((blocks + 1, symbols + 1), np.int32)  # by block and symbol: smaller symbols before the block
        np.cumsum(counts, axis=1, out=self.smaller[:, 1:])
        self.first = self.smaller[-1].astype(np.int64)  # where the suffixes of a symbol begin

    def below(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols before ``at`` that are smaller than ``symbol``, and those equal to it."""
        block, rest = at // _BLOCK, at % _BLOCK
        rows = self.rows[block]
        inside = np.arange(_BLOCK, dtype=np.int64) < rest[:, None]
        s = symbol.astype(np.uint8)[:, None]
        less = self.smaller[block, symbol] + ((rows < s) & inside).sum(axis=1)
        equal = self.smaller[block, symbol + 1] - self.smaller[block, symbol] + ((rows == s) & inside).sum(axis=1)
        return less.astype(np.int64), equal.astype(np.int64)

    def all_counts(self, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before ``at``."""
        block, rest = at // _BLOCK, at % _BLOCK
        out = np.diff(self.smaller[block], axis=1).astype(np.int64)
        row, col = np.nonzero(np.arange(_BLOCK) < rest[:, None])
        out += np.bincount(row * self.symbols + self.rows[block[row], col], minlength=out.size).reshape(out.shape)
        return out


class Index:
    """Both transforms of the words of a vocabulary; ``words`` are distinct and in code-point order."""

    def __init__(self, words: Sequence[str]):
        kinds = sorted(set("".join(words)))
        self.codes = {"\0": 0, **{c: i + 1 for i, c in enumerate(kinds)}}
        if len(self.codes) > 250:
            raise ValueError("the alphabet of a vocabulary has at most 249 symbols")
        self.words = words
        symbols = len(self.codes)
        self.ahead = Ranks(_flat(words, self.codes), symbols)
        self.back = Ranks(_flat(sorted(w[::-1] for w in words), self.codes), symbols)

    def patterns(self, texts: Sequence[str]) -> np.ndarray:
        """A row of codes for each text: 0 after its end, -1 for symbols that no word has and beyond."""
        out = np.full((len(texts), max(map(len, texts), default=0) + 1), -1, np.int16)
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        kinds, at = np.unique(points, return_inverse=True)
        codes = np.array([self.codes.get(chr(k), -1) for k in kinds.tolist()], np.int16)
        row = np.repeat(np.arange(len(texts)), lengths)
        out[row, np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes[at] if len(points) else 0
        out[np.arange(len(texts)), lengths] = 0
        return out


class States:
    """Patterns as pairs of intervals: ``low`` in one index, ``other`` in the reversed one, of one ``size``."""

    def __init__(self, query, low, other, size):
        self.query, self.low, self.other, self.size = query, low, other, size

    def __len__(self) -> int:
        return len(self.query)

    def take(self, which) -> States:
        return States(self.query[which], self.low[which], self.other[which], self.size[which])

    def turned(self) -> States:
        return States(self.query, self.other, self.low, self.size)

    @staticmethod
    def joined(parts: Sequence[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("query", "low", "other", "size")))


def extend(ranks: Ranks, s: States, symbol: np.ndarray) -> States:
    """The patterns grown by a symbol each at the side that ``ranks`` reads; those that no word has go."""
    s, symbol = s.take(symbol >= 0), symbol[symbol >= 0].astype(np.int64)
    less_low, equal_low = ranks.below(symbol, s.low)
    less_high, equal_high = ranks.below(symbol, s.low + s.size)
    grown = States(s.query, ranks.first[symbol] + equal_low, s.other + less_high - less_low, equal_high - equal_low)
    return grown.take(grown.size > 0)


def children(ranks: Ranks, s: States) -> tuple[States, np.ndarray, np.ndarray]:
    """All one-symbol extensions that occur, which state each comes from, and its symbol."""
    low = ranks.all_counts(s.low)
    size = ranks.all_counts(s.low + s.size) - low
    less = np.cumsum(size, axis=1) - size
    at, symbol = np.nonzero(size)
    return States(s.query[at], ranks.first[symbol] + low[at, symbol], s.other[at] + less[at, symbol], size[at, symbol]), at, symbol


def one_error(index: Index, texts: Sequence[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, word) where the text's first ``half`` symbols begin the word and its rest turns into the word's
    rest by one inserted, deleted or replaced symbol; each pair once."""
    pattern = index.patterns(texts)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(texts) or not len(index.words):
        return none
    n = len(texts)
    whole = np.full(n, index.ahead.n, np.int64)
    s = States(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), whole)
    # the half, from its last symbol to the delimiter before it, to the left
    for k in range(int(halves.max()), -1, -1):
        going = halves[s.query] >= k
        wait, now = s.take(~going), s.take(going)
        symbol = pattern[now.query, k - 1] if k else np.zeros(len(now), np.int16)
        s = States.joined([wait, extend(index.ahead, now, symbol)])
    # then the rest to the right; a turned state has its interval in the reversed index first
    exact, wrong = s.turned(), s.turned().take(slice(0, 0))
    found: list[States] = []
    for j in range(pattern.shape[1]):
        if not len(exact) and not len(wrong):
            break
        place = halves + j  # where each text goes on
        place_of = lambda x: np.minimum(place[x.query], pattern.shape[1] - 1)
        wrong_symbol = pattern[wrong.query, place_of(wrong)]
        grown, at, symbol = children(index.back, exact)
        expected = pattern[exact.query, place_of(exact)]
        due = expected[at]
        inserted = grown.take(symbol != 0)
        forward = [extend(index.back, wrong, wrong_symbol), extend(index.back, inserted, due[symbol != 0])]
        replaced = (symbol != 0) & (due != 0) & (symbol != due)
        forward += [grown.take(replaced), exact.take(expected != 0)]  # the last: the text's symbol is left out
        ended = [wrong_symbol == 0, due[symbol != 0] == 0]
        # states whose delimiter has been matched are words
        done = [_kept(forward[0], wrong, ended[0]), _kept(forward[1], inserted, ended[1])]
        found += [f.take(d) for f, d in zip(forward, done)]
        wrong = States.joined([forward[0].take(~done[0]), forward[1].take(~done[1]), *forward[2:]])
        wrong = _distinct(wrong)
        exact = grown.take((symbol == due) & (symbol != 0))
    pairs = States.joined(found) if found else None
    if pairs is None or not len(pairs):
        return none
    both = np.unique(pairs.query * np.int64(len(index.words) + 1) + pairs.other)
    return both // (len(index.words) + 1), both % (len(index.words) + 1) - 1


def _kept(grown: States, before: States, ended: np.ndarray) -> np.ndarray:
    """Which grown states come from a text at its end; the place of a text is the same for all its states of a step."""
    at_end = np.zeros(int(max(grown.query.max(initial=-1), before.query.max(initial=-1))) + 1, bool)
    at_end[before.query[ended]] = True
    return at_end[grown.query]


def _distinct(s: States) -> States:
    """Equal intervals of a text are the same pattern, however it came about."""
    if len(s) < 2:
        return s
    order = np.lexsort((s.size, s.low, s.query))
    s = s.take(order)
    new = np.concatenate([[True], (s.query[1:] != s.query[:-1]) | (s.low[1:] != s.low[:-1]) | (s.size[1:] != s.size[:-1])])
    return s.take(new)
