"""Byte-level byte-pair encoding and decoding by rounds over padded matrices.

A text is cut by the vocabulary's pattern. The different cuts of a stretch are
encoded once: cuts of like length form a padded matrix of ids, one row each, in
which every row merges its leftmost pair of minimum rank, round by round. A round
looks up only the two pairs beside each merge, in a hash table of all pairs that
make a token, and takes one column out of every row; rows without a pair leave.
A cut of more than `LONGEST` bytes would cost its length squared that way and
takes the same merges from a heap instead. Decoding joins the tokens' bytes.

Memory follows the stretch (`CUTS` cuts), not the text.

Defined results: a null or empty text has no ids. Bytes that are no UTF-8 are
read as U+FFFD. Repeated rows and null ids are encoded like any other. Other
columns do not matter. An empty table gives no rows. An id that the vocabulary
lacks is an error when decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W

CUTS = 1 << 17
KNOWN = 1 << 18
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
LONGEST = WIDTHS[-1]
CELLS = 1 << 20
CHUNK_BYTES = 1 << 20
LONG_TEXT = 1 << 20
NONE = np.iinfo(np.int32).max
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class PairTable:
    """Pairs of ids to the id that they merge into, by open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, (2 * len(merged)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        keys = self.key(left, right)
        place, todo = self.home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[place[todo]] == EMPTY
            # Of several keys that want one free place, the first gets it.
            _, first = np.unique(place[todo[free]], return_index=True)
            set_now = todo[free][first]
            self.keys[place[set_now]] = keys[set_now]
            self.merged[place[set_now]] = merged[set_now]
            todo = todo[self.keys[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (W.mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What each pair merges into, or `NONE`."""
        keys = self.key(*pair)
        place = self.home(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.merged[place], NONE)
        todo = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(todo):
            place[todo] = (place[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[place[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.merged[place[todo[hit]]]
            todo = todo[~hit & (found != EMPTY)]
        return out


class Vocabulary:
    """Tokens by id, where an id is the token's rank, and the pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ids[token[:k]], self.ids[token[k:]], rank)
            for token, rank in self.ids.items() for k in range(1, len(token))
            if token[:k] in self.ids and token[k:] in self.ids
        ]
        columns = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(columns[0], columns[1], columns[2].astype(np.int32))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, cuts: list[bytes]) -> list[np.ndarray]:
        """The ids of each cut."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(cuts)
        sizes = np.array([len(c) for c in cuts], np.int64)
        whole = np.array([self.ids.get(c, -1) for c in cuts], np.int64)
        for i in np.flatnonzero(whole >= 0).tolist():  # a token as a whole is never cut
            out[i] = whole[i : i + 1].astype(np.int32)
        low = 0
        for width in WIDTHS:
            bucket = np.flatnonzero((sizes > low) & (sizes <= width) & (whole < 0))
            rows = max(1, CELLS // width)
            for at in range(0, len(bucket), rows):
                some = bucket[at : at + rows].tolist()
                for i, ids in zip(some, self._rounds([cuts[i] for i in some], width)):
                    out[i] = ids
            low = width
        for i in np.flatnonzero((sizes > LONGEST) & (whole < 0)).tolist():
            out[i] = self._heap(cuts[i])
        return out

    def _rounds(self, cuts: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of cuts of up to `width` bytes: a row each, one merge a round in every row."""
        size = np.array([len(c) for c in cuts])
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cuts), np.uint8).reshape(-1, width)
        ids = self.single[text]
        rank = self.pairs[ids[:, :-1].ravel(), ids[:, 1:].ravel()].reshape(len(cuts), -1)
        rank[np.arange(1, width)[None] >= size[:, None]] = NONE
        done: list[np.ndarray] = [ids[0, :0]] * len(cuts)
        row = np.arange(len(cuts))
        while len(row):
            best = rank.argmin(1)  # the leftmost of the least
            least = rank[np.arange(len(row)), best]
            ended = least == NONE
            if ended.any():
                for at in np.flatnonzero(ended).tolist():
                    done[row[at]] = ids[at, : size[at]].copy()
                ids, rank, size, row, best, least = (x[~ended] for x in (ids, rank, size, row, best, least))
                if not len(row):
                    break
            # The merged id takes the left place; the right place goes, in every row one.
            every = np.arange(len(row))
            ids[every, best] = least
            stay = np.ones(ids.shape, bool)
            stay[every, best + 1] = False
            ids = ids[stay].reshape(len(row), -1)
            rank = rank[stay[:, 1:]].reshape(len(row), -1)
            size = size - 1
            for left in (best - 1, best):
                inside = np.flatnonzero((left >= 0) & (left + 1 < size))
                at = left[inside]
                rank[inside, at] = self.pairs[ids[inside, at], ids[inside, at + 1]]
            outside = np.flatnonzero((best + 1 >= size) & (best < rank.shape[1]))
            rank[outside, best[outside]] = NONE
            if not rank.shape[1]:
                for at in range(len(row)):
                    done[row[at]] = ids[at, : size[at]].copy()
                break
        return done

    def _heap(self, cut: bytes) -> np.ndarray:
        """Ids of one long cut: the same merges, by a heap of (rank, place) and links between the places left."""
        n = len(cut)
        start = self.single[np.frombuffer(cut, np.uint8)]
        rank = self.pairs[start[:-1], start[1:]]
        ids, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.flatnonzero(rank != NONE)
        # One number orders by rank, then place.
        heap = ((rank[at].astype(np.int64) << 32) | at).tolist()
        heapify(heap)
        merged = self.pair_dict()
        while heap:
            top = heappop(heap)
            least, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or merged.get((ids[i], ids[j])) != least:
                continue  # one of its ends was merged meanwhile
            ids[i], ids[j] = least, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                new = merged.get((least, ids[j]))
                if new is not None:
                    heappush(heap, new << 32 | i)
            k = before[i]
            if k >= 0:
                new = merged.get((ids[k], least))
                if new is not None:
                    heappush(heap, new << 32 | k)
        return np.array([x for x in ids if x >= 0], np.int32)

    def pair_dict(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            used = self.pairs.keys != EMPTY
            keys = self.pairs.keys[used]
            ends = zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist())
            self._pairs = dict(zip(ends, self.pairs.merged[used].tolist()))
        return self._pairs


class Encoder:
    """Encodes texts; keeps the ids of cuts seen before, up to `KNOWN` of them."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.words = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.first = np.zeros(1, np.int64)

    def _cuts(self, text: str) -> Iterator[str]:
        if len(text) <= LONG_TEXT:  # faster, but holds all cuts at once
            return iter(self.pattern.findall(text))
        return (m[0] for m in self.pattern.finditer(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Cuts are worked a stretch at a time: of many short texts, or of one long text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        cuts: list[str] = []
        spans: list[tuple[int, int]] = []  # text, number of its cuts in the stretch

        def work() -> None:
            ids, first = self._stretch(cuts)
            at = 0
            for text, n in spans:
                parts[text].append(ids[first[at] : first[at + n]])
                at += n
            cuts.clear()
            spans.clear()

        for text, body in enumerate(texts):
            found = self._cuts(body)
            while some := list(islice(found, CUTS - len(cuts))):
                cuts += some
                spans.append((text, len(some)))
                if len(cuts) == CUTS:
                    work()
        work()
        return [np.concatenate(p) if p else self.flat[:0].copy() for p in parts]

    def _stretch(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all cuts end to end, and each one's first (one more at the end)."""
        if len(self.known) > KNOWN or len(self.flat) > 8 * KNOWN:
            self.forget()
        known = self.known
        fresh = [c for c in dict.fromkeys(cuts) if c not in known]
        if fresh:
            ids = self.words.encode([c.encode("utf-8") for c in fresh])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            sizes = np.cumsum([len(x) for x in ids])
            used, need = self.first[-1], self.first[-1] + sizes[-1]
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[:used], np.empty(2 * need - used, np.int32)])
            self.flat[used:need] = np.concatenate(ids)
            self.first = np.concatenate([self.first, used + sizes])
        at = np.fromiter(map(known.__getitem__, cuts), np.int64, len(cuts))
        start, n = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(n)
        before = ends - n
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(start - before, n) + np.arange(total)], np.append(before, total)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, texts in W.chunks(batches, CHUNK_BYTES):
        yield batch, [(x or b"").decode("utf-8", "replace") for x in texts]


def _encode(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, pattern)
    for batch, texts in _texts(batches):
        ids = encoder.encode(texts)
        first = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])


def _decode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = Vocabulary(path)
    for batch in batches:
        for row in range(batch.num_rows):  # a row may hold very many ids
            ids = batch.column("ids").slice(row, 1)
            data = [None if x is None else words.decode(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, 1), pa.array(data, pa.binary())], names=["doc_id", "data"]
            )


def _report(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, pattern)
    for batch, texts in _texts(batches):
        rows = []
        for ids in encoder.encode(texts):
            data = encoder.words.decode(ids.tolist())
            rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()))
        kinds = (pa.int64(), pa.string(), pa.string())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each text. `path` names the ranks, a file that every executor has; `pattern` cuts the texts."""
    return _rows(docs).mapInArrow(lambda batches: _encode(batches, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids of each row stand for; null ids give null."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda batches: _decode(batches, path), "doc_id long, data binary")


def encoding_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _rows(docs).mapInArrow(lambda batches: _report(batches, path, pattern), schema)
