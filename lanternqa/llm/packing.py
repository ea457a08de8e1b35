"""Packing documents into training sequences by the sum-of-squares rule.

Each task packs its own share of the documents online. A document's full
windows leave at once; its rest goes to the fill level at which the sum of the
squared numbers of partly filled windows, kept in an array by level, becomes
smallest (a new window counts as level 0). At the end of a share the windows
still open are emptied into each other: their pieces are cut to fill windows to
the brim, and the last remainder is cut into powers of two, which need no
padding. So nothing is shuffled and no token is padding.

Defined results: a null or empty text is its end token alone. Repeated rows are
packed as often as they occur. A null doc_id stays null. Other columns do not
matter. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.byte_pairs import Encoder

WINDOW = 1024
END_ID = 0
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def vocabulary(path: str, pattern: str):
    """A byte-level vocabulary from its ranks; a text's ids are those of any byte-pair encoder with these ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def text_encoder(path: str, pattern: str) -> Callable[[str], Sequence[int]]:
    """The ids of one text.

    The library's matcher gives up on a run of very many blanks; such a text is
    encoded by rounds instead, to the same ids.
    """
    encode, rounds = vocabulary(path, pattern).encode_ordinary, []

    def ids(text: str) -> Sequence[int]:
        try:
            return encode(text)
        except BaseException as failure:  # the library's own kind, which is no Exception
            if type(failure).__name__ != "PanicException":
                raise
        if not rounds:
            rounds.append(Encoder(path, pattern))
        return rounds[0].encode([text])[0]

    return ids


class Packer:
    """The sum-of-squares rule over fill levels; gives out finished windows as lists of (piece, ids)."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.count = np.zeros(window + 1, np.int64)

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of `size` tokens into the best level; the window, if that fills it."""
        level = self.best(size)
        content = self.open[level].pop() if level else []
        self.count[level] -= bool(level)
        content.append(piece)
        full = level + size
        if full == self.window:
            return content
        self.open[full].append(content)
        self.count[full] += 1
        return None

    def best(self, size: int) -> int:
        """The level, 0 for a new window, whose move up by `size` adds least to the sum of squares.

        Moving a window from level h to h + s changes the sum by
        2 (count[h + s] - count[h] + 1); opening one adds 2 count[s] + 1;
        filling one takes away 2 count[h] - 1. Ties go to the fuller window.
        """
        top = self.window - size
        change = 2 * (self.count[size : self.window + 1] - self.count[: top + 1] + 1)
        change[0] = 2 * self.count[size] + 1 if size < self.window else 0
        if top:
            change[top] = 1 - 2 * self.count[top]
        usable = self.count[: top + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def rest(self) -> list[tuple]:
        """All pieces of the windows still open, fullest window first."""
        return [piece for level in range(self.window, 0, -1) for window in self.open[level] for piece in window]


def _pack(
    batches: Iterable[pa.RecordBatch], path: str, pattern: str, window: int, end_id: int
) -> Iterator[pa.RecordBatch]:
    encode, packer = text_encoder(path, pattern), Packer(window)
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33
    end = array("I", [end_id]).tobytes()
    rows: list[tuple] = []

    def close(pieces: list[tuple]) -> None:
        """Give the pieces of one finished sequence their places."""
        nonlocal sequence
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, ids))
            offset += n
        sequence += 1

    def out() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = [list(x) for x in zip(*rows)] or [[]] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch, texts in W.chunks(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
            own = array("I", encode((text or b"").decode("utf-8", "replace"))).tobytes() + end
            total = len(own) // 4
            whole = total - total % window
            for start in range(0, whole, window):
                close([(doc, start, total, own[4 * start : 4 * (start + window)])])
            if whole < total:
                full = packer.place((doc, whole, total, own[4 * whole :]), total - whole)
                if full:
                    close(full)
        yield out()

    left = packer.rest()
    size = sum(len(x[3]) // 4 for x in left)
    sizes = [window] * (size // window) + [1 << k for k in reversed(range(window.bit_length())) if size % window >> k & 1]
    todo = iter(left)
    piece = next(todo, None)
    for size in sizes:
        pieces = []
        while size:
            doc, start, total, ids = piece
            n = min(size, len(ids) // 4)
            pieces.append((doc, start, total, ids[: 4 * n]))
            size -= n
            piece = (doc, start + n, total, ids[4 * n :]) if 4 * n < len(ids) else next(todo, None)
        close(pieces)
        if len(rows) > 5000:
            yield out()
    yield out()


def pack(docs: DataFrame, ranks: str, pattern: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document, place and ids (little-endian 32-bit), and its sequence and offset there.

    `ranks` is the path of a byte-level vocabulary as ranks, a file that every
    executor has, and `pattern` its pre-split.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _pack(batches, ranks, pattern, window, end_id), PIECES)
