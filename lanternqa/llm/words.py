"""Words, windows and their 64-bit keys, worked out for a whole chunk of texts at once.

All functions run inside tasks, on UTF-8 bytes. Every separator is ASCII, so
bytes and code points give the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
LONG_WORD = 64
BLANKS = b" \t\n\x0b\x0c\r"

# Odd 64-bit multipliers of the polynomial keys, and of the final mix.
WORD_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
WINDOW_BASE = 0xFF51AFD7ED558CCD
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def spaced() -> np.ndarray:
    """Bytes that belong to words separated by blanks."""
    table = np.ones(256, bool)
    table[list(BLANKS)] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of ASCII letters and digits and of all other code points from U+0080."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def folded() -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@dataclass
class Words:
    """The words of a chunk: byte ranges in `data`, and `first`, each text's first word index (one more at the end)."""

    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def cut(texts: list[bytes], inside: np.ndarray, fold: bool = False) -> Words:
    """All words of some texts; a text that is empty has none."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if fold:
        data = folded()[data]
    flags = inside[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if flags[0]:
        edges = np.concatenate(([0], edges))
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=offset[1:])
    start, end = edges[0::2], edges[1::2]
    return Words(data, offset, start, end, np.searchsorted(start, offset))


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys; a bijection."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(MIX_1)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(MIX_2)
    return keys ^ (keys >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_keys(words: Words, family: int = 0) -> np.ndarray:
    """One 64-bit key per word, equal for equal words; families are independent of each other.

    Sums of powers modulo 2^64 are told apart by no odd base for some pairs of
    very long words, so words of more than `LONG_WORD` bytes take a keyed digest.
    """
    base = WORD_BASES[family]
    up, down = powers(base, PIECE_BYTES), powers(pow(base, -1, 1 << 64), PIECE_BYTES)
    keys = np.empty(len(words.start), np.uint64)
    at = 0
    while at < len(keys):
        origin = words.start[at]
        to = max(at + 1, int(np.searchsorted(words.end, origin + PIECE_BYTES, "right")))
        start, end = words.start[at:to] - origin, words.end[at:to] - origin
        if end[-1] > PIECE_BYTES:  # one very long word
            up, down = powers(base, end[-1]), powers(pow(base, -1, 1 << 64), end[-1])
        total = np.zeros(end[-1] + 1, np.uint64)
        piece = words.data[origin : origin + end[-1]].astype(np.uint64) + np.uint64(1)
        np.cumsum(piece * up[: end[-1]], out=total[1:])
        keys[at:to] = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        at = to
    salt = base.to_bytes(8, "little")
    for i in np.flatnonzero(words.end - words.start > LONG_WORD).tolist():
        word = words.data[words.start[i] : words.end[i]].tobytes()
        keys[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=salt).digest(), "little")
    return mixed(keys)


def window_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """The key of each run of `n` keys, by its start; runs are built by doubling."""
    done, out, size, part = 0, None, 1, keys
    while True:
        if n & size:
            if out is None:
                out = part
            else:
                tail = part[done:]
                m = min(len(out), len(tail))
                out = out[:m] * np.uint64(pow(WINDOW_BASE, size, 1 << 64)) + tail[:m]
            done += size
        if done == n:
            return mixed(out[: max(0, len(keys) - n + 1)])
        part = part[:-size] * np.uint64(pow(WINDOW_BASE, size, 1 << 64)) + part[size:] if len(part) > size else part[:0]
        size *= 2


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word indexes at which a run of `n` words of one text starts."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - before, counts) + np.arange(total)


def spread(total: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of `total` places some runs cover."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The kept words of each text with one space after each, and each text's byte range (one more at the end)."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    data = words.data.copy()
    data[words.end] = 32
    flags = spread(len(data), start, end + 1 - start)
    sizes = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end + 1 - start, out=sizes[1:])
    kept = np.searchsorted(start, words.offset)
    return data[flags].tobytes(), sizes[kept]


def raw(column: pa.Array) -> list[bytes | None]:
    """A text column's UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut batches with a `text` column into slices of about `limit` bytes (or one text), with their texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            begin = total[at - 1] if at else 0
            to = min(int(np.searchsorted(total, begin + limit)) + 1, batch.num_rows)
            piece = batch.slice(at, to - at)
            yield piece, raw(piece.column("text"))
            at = to
