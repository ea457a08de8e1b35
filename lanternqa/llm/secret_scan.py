"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Patterns find assigned values, access ids and hexadecimal runs. Their values are
the labelled random strings; all other stretches of identifier characters are
the labelled ordinary ones. Two first-order Markov models are counted from these
samples over all texts, and a further stretch is a secret if its log-likelihood
ratio exceeds the log odds against a random stretch. Only the table of character
pairs, whose size is fixed, comes to the driver.

Defined results: a null or empty text has no span. With no labelled strings both
models are uniform and nothing is added. Repeated rows each get their own
result; other columns do not matter. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W

# The patterns, the shortest value each accepts, and the order of kinds.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

MIN_RANDOM = 16
MIN_ORDINARY = 6
LOG_ODDS = 12.0
PRIOR = 10.0
SYMBOLS = 68  # 10 digits, 52 letters, 5 signs, and the start of a string


def symbol_table() -> np.ndarray:
    """Each identifier byte's symbol from 0; -1 for all other bytes."""
    table = np.full(256, -1, np.int16)
    signs = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
    table[list(signs)] = np.arange(len(signs))
    return table


def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of at least `least` set flags; the last flag is never set."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edges = np.concatenate(([0], edges))
    start, end = edges[0::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


class Patterns:
    """Base spans of a chunk of texts, as (text, start, end, kind, value start, value end) in bytes of a text."""

    def __init__(self) -> None:
        self.assign, self.access = re.compile(ASSIGN, re.IGNORECASE), re.compile(ACCESS)
        self.hex = np.zeros(256, bool)
        self.hex[list(b"0123456789abcdef")] = True

    def find(self, texts: list[bytes], cut: W.Words) -> list[tuple]:
        spans = []
        for i, text in enumerate(texts):
            lower = text.lower()
            if any(word in lower for word in KEYWORDS):
                spans += [
                    (i, m.start(), m.end(), 0, m.start(2), m.end(2))
                    for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN
                ]
            if b"AKIA" in text:
                spans += [
                    (i, m.start(), m.end(), 1, m.start(), m.end())
                    for m in self.access.finditer(text) if m.end() - m.start() >= MIN_ACCESS
                ]
        start, end = _runs(self.hex[cut.data], MIN_HEX)
        text = np.searchsorted(cut.offset, start, "right") - 1
        start, end = start - cut.offset[text], end - cut.offset[text]
        spans += [(i, a, b, 2, a, b) for i, a, b in zip(text.tolist(), start.tolist(), end.tolist())]
        return spans


def _bytes(texts: list[bytes]) -> W.Words:
    """The texts end to end with a newline after each; no words."""
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=offset[1:])
    none = np.empty(0, np.int64)
    return W.Words(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), offset, none, none, none)


def _pairs(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol pairs of some strings, each with the start symbol before its first, and each string's first pair."""
    size = end - start
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(int(size.sum()))
    before = symbols[at - 1].astype(np.int64)
    before[first] = SYMBOLS - 1
    return before * SYMBOLS + symbols[at], first


def _ordinary(symbols: np.ndarray, covered: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of identifier characters that no base span touches."""
    start, end = _runs(symbols >= 0, least)
    total = np.concatenate(([0], np.cumsum(covered)))
    free = total[end] == total[start]
    return start[free], end[free]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of a task's random and ordinary strings."""
    patterns, table = Patterns(), symbol_table()
    counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for _, texts in W.chunks(batches):
        texts = [x or b"" for x in texts]
        cut = _bytes(texts)
        # A byte before the first text keeps every string's predecessor inside the data.
        symbols = table[cut.data]
        spans = patterns.find(texts, cut)
        covered = np.zeros(len(cut.data) + 1, np.int64)
        if spans:
            text, start, end, _, value, stop = (np.array(x, np.int64) for x in zip(*spans))
            base = cut.offset[text]
            covered = W.spread(len(covered), base + start, end - start).astype(np.int64)
            # A value found by two kinds counts once.
            _, once = np.unique(np.stack([base + value, stop - value]), axis=1, return_index=True)
            inside = symbols.copy()
            inside[inside < 0] = SYMBOLS - 2  # a dot inside a value
            pairs, _ = _pairs(inside, (base + value)[once], (base + stop)[once])
            counts[0] += np.bincount(pairs, minlength=SYMBOLS * SYMBOLS)
        start, end = _ordinary(symbols, covered, MIN_ORDINARY)
        digits = np.concatenate(([0], np.cumsum((symbols >= 0) & (symbols < 10))))
        signs = np.concatenate(([0], np.cumsum(symbols >= 62)))
        n_digits = digits[end] - digits[start]
        pure = (n_digits == 0) | (n_digits + signs[end] - signs[start] == end - start)
        pairs, _ = _pairs(symbols, start[pure], end[pure])
        counts[1] += np.bincount(pairs, minlength=SYMBOLS * SYMBOLS)
    label, pair = np.nonzero(counts)
    columns = [pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(counts[label, pair], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["label", "pair", "n"])


def fit_ratio(docs: DataFrame) -> np.ndarray:
    """For each pair of characters, how much likelier it is in a random string than in an ordinary one (log)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    sums = texts.mapInArrow(_count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SYMBOLS, SYMBOLS))
    for r in sums.collect():
        counts[r["label"], r["pair"] // SYMBOLS, r["pair"] % SYMBOLS] = r["n"]
    # Rare characters follow their own share, and unseen ones have half a count.
    single = counts.sum(1, keepdims=True) + 0.5
    share = (counts + PRIOR * single / single.sum(2, keepdims=True)) / (counts.sum(2, keepdims=True) + PRIOR)
    return np.log(share[0] / share[1]).ravel()


def _scan(batches: Iterable[pa.RecordBatch], ratio: np.ndarray, log_odds: float) -> Iterator[pa.RecordBatch]:
    patterns, table = Patterns(), symbol_table()
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    )
    for batch, texts in W.chunks(batches):
        texts = [x or b"" for x in texts]
        cut = _bytes(texts)
        symbols = table[cut.data]
        spans = patterns.find(texts, cut)
        covered = np.zeros(len(cut.data) + 1, np.int64)
        if spans:
            text, start, end = (np.array(x, np.int64) for x in list(zip(*spans))[:3])
            covered = W.spread(len(covered), cut.offset[text] + start, end - start).astype(np.int64)
        start, end = _ordinary(symbols, covered, MIN_RANDOM)
        found = [(i, a, b, k, None) for i, a, b, k, _, _ in spans]
        if len(start):
            pairs, first = _pairs(symbols, start, end)
            score = np.add.reduceat(ratio[pairs], first)
            for a, b, s in zip(*(x[score > log_odds].tolist() for x in (start, end, score))):
                i = int(np.searchsorted(cut.offset, a, "right")) - 1
                found.append((i, a - int(cut.offset[i]), b - int(cut.offset[i]), 3, s))
        out: list[list[dict]] = [[] for _ in texts]
        for i, a, b, k, s in sorted(found, key=lambda x: (x[0], x[1], x[3])):
            text = texts[i]
            before = a if text.isascii() else len(text[:a].decode("utf-8", "replace"))
            out[i].append({"kind": KINDS[k], "start": before, "end": before + b - a, "score": s})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, ratio: np.ndarray, log_odds: float = LOG_ODDS) -> DataFrame:
    """(doc_id, spans): all secrets of each text by start and kind; those the models add carry their score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"
    return rows.mapInArrow(lambda batches: _scan(batches, ratio, log_odds), schema)


def mask_secrets(docs: DataFrame, ratio: np.ndarray, mark: str = "[SECRET]", log_odds: float = LOG_ODDS) -> DataFrame:
    """(doc_id, text) with every secret replaced by `mark`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches):
        for batch, texts in W.chunks(batches):
            (found,) = _scan([batch], ratio, log_odds)
            out = []
            for text, spans in zip(texts, found.column("spans").to_pylist()):
                plain, parts, at = (text or b"").decode("utf-8", "replace"), [], 0
                for span in spans:
                    if span["start"] >= at:
                        parts += [plain[at : span["start"]], mark]
                    at = max(at, span["end"])
                out.append(None if text is None else "".join([*parts, plain[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(work, "doc_id long, text string")


def secret_report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""

    def work(batches):
        for batch in batches:
            rows = []
            for spans in batch.column("spans").to_pylist():
                words = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
                base = ",".join(w for w, s in zip(words, spans) if s["kind"] != "random")
                kinds = [s["kind"] for s in spans]
                rows.append([*map(kinds.count, KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(words)])
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(
        work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
