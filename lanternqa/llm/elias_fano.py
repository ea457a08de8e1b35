"""Monotone sequences in Elias-Fano code, and a two-level trie of word pairs on top, in a memory-mapped file.

A sequence keeps its low bits packed and its high bits as unary gaps in one bit
vector; look-ups of many positions or values run as array operations.
"""

from __future__ import annotations

import tempfile

import numpy as np

WORD = 64
ONE = np.uint64(1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The position of the k-th set bit (from 0); `before` counts set bits before each word, and all at the end."""
    at = np.searchsorted(before, k, "right") - 1
    rest, word, place = (k - before[at]).astype(np.int64), words[at], np.zeros(len(k), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << half) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = rest >= count
        rest -= np.where(up, count, 0)
        place += np.where(up, half, 0)
        word = np.where(up, word >> np.uint64(half), low)
    return at * WORD + place


class EliasFano:
    """A non-decreasing sequence of numbers. `arrays` are all it needs to be read again."""

    def __init__(self, n: int, bits: int, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.bits, self.arrays = n, bits, arrays
        self.low, self.high = arrays["low"], arrays["high"]
        self.ones, self.zeros = arrays["ones"], arrays["zeros"]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        size = n + (top >> bits) + 2
        high = np.zeros(-(-size // WORD), np.uint64)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, place // WORD, ONE << (place % WORD).astype(np.uint64))
        low = np.zeros(-(-n * bits // WORD) + 1, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at % WORD).astype(np.uint64)
            np.bitwise_or.at(low, at // WORD, part << shift)
            over = (shift > np.uint64(WORD - bits)).nonzero()[0]
            np.bitwise_or.at(low, at[over] // WORD + 1, part[over] >> (np.uint64(WORD) - shift[over]))
        count = np.bitwise_count(high).astype(np.int64)
        ones, zeros = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(WORD - count)))
        return cls(n, bits, {"low": low, "high": high, "ones": ones, "zeros": zeros})

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at // WORD, (at % WORD).astype(np.uint64)
        part = self.low[word] >> shift
        over = shift > np.uint64(WORD - self.bits)
        part[over] |= self.low[word[over] + 1] << (np.uint64(WORD) - shift[over])
        return part & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at some positions."""
        high = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.lows(i)

    def successor(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first position whose value is not smaller, `n` if there is none, and whether it is equal there."""
        high = (value >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        inside = high < last
        high = np.minimum(high, last)
        # Before the h-th zero stand all values whose high part is at most h.
        gaps = ~self.high
        to = _select(gaps, self.zeros, high) - high
        at = np.zeros(len(to), np.int64)
        some = np.flatnonzero(high > 0)
        at[some] = _select(gaps, self.zeros, high[some] - 1) - high[some] + 1
        group = to = np.minimum(to, self.n)
        at = np.minimum(at, self.n)
        low = value & np.uint64((1 << self.bits) - 1)
        to = to.copy()
        open_ = np.flatnonzero((at < to) & inside)
        while len(open_):
            middle = (at[open_] + to[open_]) // 2
            less = self.lows(middle) < low[open_]
            at[open_] = np.where(less, middle + 1, at[open_])
            to[open_] = np.where(less, to[open_], middle)
            open_ = open_[at[open_] < to[open_]]
        equal = inside & (at < group)
        some = np.flatnonzero(equal)
        equal[some] = self.lows(at[some]) == low[some]
        return np.where(inside, at, self.n), equal


class PairTrie:
    """Pairs (context, successor) with a code each: sorted contexts, pointers into the successors, successors.

    A context's successors are stored relative to the last stored value before
    them, which makes the whole level one monotone sequence.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> None:
        """Of distinct pairs sorted by context, then successor."""
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        self.n_contexts = len(first)
        bounds = np.append(first, len(context))
        # Each range starts from where the range before ended.
        base = np.concatenate(([0], np.cumsum(successor[bounds[1:] - 1].astype(np.uint64))[:-1])) if len(first) else first
        moved = successor.astype(np.uint64) + np.repeat(base.astype(np.uint64), np.diff(bounds))
        levels = {"contexts": EliasFano.of(context[first]), "pointers": EliasFano.of(bounds), "successors": EliasFano.of(moved)}
        self._map(levels, codes)

    def _map(self, levels: dict[str, EliasFano], codes: np.ndarray) -> None:
        """Write all arrays to one file without a name and map it."""
        self.file = tempfile.TemporaryFile()
        places = []
        for name, level in [*levels.items(), ("codes", None)]:
            for part, array in (level.arrays if level else {"codes": codes}).items():
                self.file.write(b"\0" * (-self.file.tell() % 8))
                places.append((name, part, self.file.tell(), array.dtype, len(array)))
                self.file.write(array.tobytes())
        self.file.flush()
        mapped: dict[str, dict[str, np.ndarray]] = {}
        for name, part, at, kind, n in places:
            array = np.memmap(self.file, kind, "r", at, (n,)) if n else np.empty(0, kind)
            mapped.setdefault(name, {})[part] = array
        self.contexts, self.pointers, self.successors = (
            EliasFano(level.n, level.bits, mapped[name]) for name, level in levels.items()
        )
        self.codes = mapped["codes"]["codes"]

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The codes of some pairs; 0 for a pair that is not there. Pairs of one context should stand together."""
        out = np.zeros(len(context), self.codes.dtype)
        if not self.n_contexts or not len(context):
            return out
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        run = np.diff(np.append(first, len(context)))
        at, known = self.contexts.successor(context[first].astype(np.uint64))
        at, run, first = at[known], run[known], first[known]
        begin, end = (self.pointers.get(x).astype(np.int64) for x in (at, at + 1))
        base = np.zeros(len(at), np.uint64)
        later = np.flatnonzero(begin > 0)
        base[later] = self.successors.get(begin[later] - 1)
        pair = np.repeat(first - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        place, equal = self.successors.successor(np.repeat(base, run) + successor[pair].astype(np.uint64))
        # The value of successor 0 also stands at the end of the range before.
        begin, end = np.repeat(begin, run), np.repeat(end, run)
        tied = np.flatnonzero(place < begin)
        place[tied] = begin[tied]
        equal[tied] = (successor[pair[tied]] == 0) & (place[tied] < end[tied])
        equal[tied] &= self.successors.get(np.minimum(place[tied], self.successors.n - 1)) == np.repeat(base, run)[tied]
        equal &= place < end
        out[pair[equal]] = self.codes[place[equal]]
        return out

    def close(self) -> None:
        self.file.close()
