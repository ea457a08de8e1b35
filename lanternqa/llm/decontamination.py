"""Benchmark decontamination by a broadcast set of normalised test windows.

Words are runs of ASCII letters and digits, lower-cased, and of all code points
from U+0080. The windows of the test items go to every task as a set; each task
rolls the same windows over its texts, looks them up, and verifies every hit on
the words themselves. Nothing is shuffled unless the test items come in blocks.

Defined results: a null or empty text has no words and no hit. An item without
words is never found; one of fewer words than a window is one window. Repeated
rows each get their own result. A null item_id is left out of the item list but
its windows hit. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.scratch import Scratch

WINDOW = 13
BLOCK_BYTES = 16 << 20
SLOTS = 1 << 20
FOUND = "doc_id long, n_words long, hits array<struct<start: long, length: long>>, items array<string>"


class Windows:
    """The windows of some test items, by length: a slot table, sorted keys, and the exact words."""

    def __init__(self, items: list[tuple[object, str]], size: int) -> None:
        self.names = [None if name is None else str(name) for name, _ in items]
        cut = W.cut([(text or "").encode() for _, text in items], W.alphanumeric(), fold=True)
        self.exact: dict[bytes, set[int]] = {}
        lengths: dict[int, list[int]] = {}
        body, keys = cut.data.tobytes(), W.word_keys(cut)
        for item, (at, to) in enumerate(zip(cut.first[:-1], cut.first[1:])):
            n = min(size, int(to - at))
            for i in range(at, to - n + 1) if n else ():
                lengths.setdefault(n, []).append(i)
                words = b" ".join(body[s:e] for s, e in zip(cut.start[i : i + n], cut.end[i : i + n]))
                self.exact.setdefault(words, set()).add(item)
        self.keys: dict[int, np.ndarray] = {n: np.unique(W.window_keys(keys, n)[at]) for n, at in lengths.items()}

    def slots(self) -> dict[int, np.ndarray]:
        """For each length, which low bits any key has: most windows are ruled out by one look-up."""
        tables = {n: np.zeros(SLOTS, bool) for n in self.keys}
        for n, known in self.keys.items():
            tables[n][(known & np.uint64(SLOTS - 1)).astype(np.int64)] = True
        return tables

    def hits(self, cut: W.Words, slots: dict[int, np.ndarray]) -> Iterator[tuple[int, int, set[int]]]:
        """Verified hits: the word index, the length, the items."""
        keys = W.word_keys(cut)
        body, at = W.joined(cut)
        begin = np.concatenate(([0], np.cumsum(cut.end + 1 - cut.start)))
        for n, known in self.keys.items():
            rolled = W.window_keys(keys, n)
            maybe = np.flatnonzero(slots[n][(rolled & np.uint64(SLOTS - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, rolled[maybe]), len(known) - 1)
            maybe = maybe[known[place] == rolled[maybe]]
            inside = np.searchsorted(cut.first, maybe, "right") == np.searchsorted(cut.first, maybe + n - 1, "right")
            for i in maybe[inside].tolist():
                items = self.exact.get(body[begin[i] : begin[i + n] - 1])
                if items:
                    yield i, n, items


def _find(texts: list[bytes], windows: Windows, slots: dict[int, np.ndarray]) -> tuple[np.ndarray, list, list]:
    """How many words each text has, its hits as (start, length) in order, and the items found in it."""
    cut = W.cut(texts, W.alphanumeric(), fold=True)
    hits: list[list[list[int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for i, n, found in windows.hits(cut, slots):
        doc = int(np.searchsorted(cut.first, i, "right")) - 1
        start = i - int(cut.first[doc])
        last = hits[doc][-1] if hits[doc] else None
        if last and last[0] <= start <= last[0] + last[1] <= start + n:
            last[1] = start + n - last[0]
        else:
            hits[doc].append([start, n])
        items[doc].update(windows.names[k] for k in found if windows.names[k] is not None)
    return cut.counts(), hits, items


def _scan(batches: Iterable[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    slots = windows.slots()
    for batch, texts in W.chunks(batches):
        n_words, hits, items = _find([x or b"" for x in texts], windows, slots)
        spans = [[{"start": a, "length": n} for a, n in own] for own in hits]
        columns = [
            pa.array(n_words, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]
        kept = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), *columns], names=[*kept, "n_words", "hits", "items"]
        )


def covered(hits: list) -> int:
    """How many words some (start, length) cover."""
    total = last = 0
    for start, n in sorted(hits):
        total += max(0, start + n - max(last, start))
        last = max(last, start + n)
    return total


def is_contaminated(n_hit, n_words):
    """Hit words are at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Callable[[int], Windows]]:
    """Into how many blocks the test items fall, and the windows of each."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1

    def windows(block: int) -> Windows:
        of_block = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        return Windows([(r["item_id"], r["text"]) for r in of_block.collect()], window)

    return blocks, windows


def _of_rows(rows: DataFrame, blocks: int, windows: Callable[[int], Windows]) -> DataFrame:
    """FOUND and `row` of written rows (row, doc_id, text): each block is scanned for, and a row's results united."""

    def scan(block: int) -> DataFrame:
        own = windows(block)
        return rows.select("row", "doc_id", "text").mapInArrow(lambda batches: _scan(batches, own), f"row long, {FOUND}")

    found = scan(0)
    for block in range(1, blocks):
        found = found.unionByName(scan(block))
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def _with_row(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, text), written once, so that a row keeps its number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(row's doc_id, n_words, hits, items): where the windows of test items occur in each document.

    Test items up to `block_bytes` of text are one broadcast set. More are cut
    into blocks of about that size; each block is scanned for on its own and the
    results of a row are united. Either way each row has its own result.
    """
    blocks, windows = _blocks(benchmark, window, block_bytes)
    if blocks > 1:
        return _of_rows(_with_row(docs, Scratch(docs.sparkSession)), blocks, windows).drop("row")
    whole = windows(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, whole), FOUND)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, count, digest = [], [], []
        for spans, items in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
            hit.append(covered([(x["start"], x["length"]) for x in spans]))
            count.append(len(items))
            digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        kept = [name for name in batch.schema.names if name not in ("hits", "items")]
        columns = [pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), *columns], names=[*kept, "n_hit", "n_items", "items_sha256"]
        )


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts, a digest of the items, and the verdict: hit words are at least a twentieth of all."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
    return found.mapInArrow(_measure, schema).withColumn(
        "contaminated", is_contaminated(F.col("n_hit"), F.col("n_words"))
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of `docs` that are not contaminated, unchanged; each row is judged on its own text.

    The scan itself leaves them out, so no text moves; items in several blocks
    need the rows written with a number first.
    """
    blocks, windows = _blocks(benchmark, window, block_bytes)
    if blocks > 1:
        number = "row"
        while any(number in c.lower() for c in docs.columns):
            number += "_"
        numbered = Scratch(docs.sparkSession).write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
        rows = numbered.select(
            F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        )
        found = _of_rows(rows, blocks, windows)
        schema = "row long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
        judged = found.mapInArrow(_measure, schema).filter(is_contaminated(F.col("n_hit"), F.col("n_words")))
        bad = judged.select(F.col("row").alias(number))
        return numbered.join(bad, number, "left_anti").select(*docs.columns)
    whole = windows(0)

    def work(batches):
        slots = whole.slots()
        for batch in batches:
            for piece, texts in W.chunks([batch]):
                n_words, hits, _ = _find([x or b"" for x in texts], whole, slots)
                n_hit = np.array([covered(x) for x in hits], np.int64)
                yield piece.filter(pa.array(~is_contaminated(n_hit, n_words)))

    return docs.mapInArrow(work, docs.schema)


def remove_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, text): each row's normalised words without those that a test window covers."""
    blocks, windows = _blocks(benchmark, window, block_bytes)
    rows = _with_row(docs, Scratch(docs.sparkSession))
    spans = _of_rows(rows, blocks, windows).select("row", "hits")

    def work(batches):
        for batch, texts in W.chunks(batches):
            cut = W.cut([x or b"" for x in texts], W.alphanumeric(), fold=True)
            starts, lengths = [], []
            for doc, hits in enumerate(batch.column("hits").to_pylist()):
                starts += [int(cut.first[doc]) + h["start"] for h in hits or ()]
                lengths += [h["length"] for h in hits or ()]
            covered = W.spread(len(cut.start), np.array(starts, np.int64), np.array(lengths, np.int64))
            body, at = W.joined(cut, ~covered)
            kept = [body[a : max(a, b - 1)].decode() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return rows.join(spans, "row").mapInArrow(work, "doc_id long, text string")
