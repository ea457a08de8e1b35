"""Line dedup: line hashes in range order, judged in one stream, given back as keep bitmaps.

Every chunk of texts sends one row per distinct line: its 128-bit hash and where
it stands. The rows are range-partitioned by hash, document and position and
sorted in that order, so a line that holds a third of all rows spreads over many
partitions. Each partition streams its lines. A line that lies inside it is
judged at once; the first and the last, which may reach into a neighbour, are
judged together with it afterwards. The outcome is a compressed bitmap for each
document that loses a line; only it is joined to the texts.

Defined results: a null or empty text is one empty line. Blank lines have no key
and stay. A document is its doc_id: repeated rows count once, and each loses the
same lines. A row without doc_id is not compared and stays whole. Other columns
do not matter; `drop_lines` keeps them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.scratch import Scratch, shuffle_parts

MIN_DOCS = 10
MIN_CHARS = 1
LINES = "hash binary, doc long, pos int, docs binary, places binary"
MARKS = "hash binary, doc_id long, first int, places binary"


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(W.BLANKS).lower()


def _hashes(batches: Iterable[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in W.chunks(batches):
        seen: dict[bytes, list[tuple[int, int]]] = {}
        ids = batch.column("doc_id").to_pylist()
        for doc, text in sorted(zip(ids, texts), key=lambda x: x[0]):  # in the order of documents
            for pos, line in enumerate((text or b"").split(b"\n")):
                key = line_key(line)
                if key and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                    seen.setdefault(key, []).append((doc, pos))
        docs = [np.array([d for d, _ in x], "<i8").tobytes() for x in seen.values()]
        places = [np.array([p for _, p in x], "<i4").tobytes() for x in seen.values()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.blake2b(k, digest_size=16).digest() for k in seen], pa.binary()),
                pa.array([x[0][0] for x in seen.values()], pa.int64()),
                pa.array([x[0][1] for x in seen.values()], pa.int32()),
                pa.array(docs, pa.binary()), pa.array(places, pa.binary()),
            ],
            names=["hash", "doc", "pos", "docs", "places"],
        )


def _by_document(row: dict, skip: tuple[int, int] | None) -> Iterator[tuple[int, np.ndarray]]:
    """The row's places by document, without the one to keep."""
    docs, places = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["places"], "<i4")
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)]):
        own, doc = places[a:b], int(docs[a])
        if skip is not None and skip[0] == doc:
            own = own[own != skip[1]]
        if len(own):
            yield doc, own


def _judge(batches: Iterable[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Stream sorted lines. Marks of judged lines have no hash; those of the partition's first and last line do."""
    out: list[tuple] = []
    key, number, docs, waiting, first = None, 0, set(), [], None

    def give() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        types = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names=["hash", "doc_id", "first", "places"]
        )

    def mark(rows: list[dict], name: bytes | None, skip: tuple[int, int] | None) -> None:
        for row in rows:
            for doc, own in _by_document(row, skip):
                out.append((name, doc, int(own[0]), own.tobytes()))

    for batch in batches:
        for row in batch.to_pylist():
            if row["hash"] != key:
                key, docs, waiting, first = row["hash"], set(), [], (row["doc"], row["pos"])
                number += 1
            if number == 1:
                mark([row], key, None)
            else:
                if len(docs) < min_docs:
                    own = np.frombuffer(row["docs"], "<i8")
                    docs.update(own[np.append(True, own[1:] != own[:-1])][:min_docs].tolist())
                waiting.append(row)
                if len(docs) >= min_docs:
                    mark(waiting, None, first if keep_first else None)
                    waiting = []
            if len(out) > 20_000:
                yield give()
    # The last line may go on in the next partition, which has to know if it is common already.
    if number > 1:
        if len(docs) >= min_docs:
            out.append((key, None, None, None))
        mark(waiting, key, None)
    yield give()


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for marks in batch.column("marks").to_pylist():
            gone = [np.frombuffer(m["places"], "<i4") for m in marks]
            gone = np.concatenate([x if m["stays"] is None else x[x != m["stays"]] for x, m in zip(gone, marks)])
            flags = np.ones(int(gone.max()) // 8 * 8 + 8 if len(gone) else 0, bool)
            flags[gone] = False
            keep.append(zlib.compress(np.packbits(flags).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keep, pa.binary())], names=["doc_id", "keep"])


def line_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """(doc_id, keep) of the documents that lose lines: a compressed bitmap, one bit per line up to the last lost one.

    Lines whose key is in at least `min_docs` documents go, all of them, or all
    but the first by document and position if `keep_first` is set.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = scratch.write(
        rows.filter("doc_id IS NOT NULL").mapInArrow(lambda batches: _hashes(batches, min_chars), LINES), "lines"
    )
    order = ["hash", "doc", "pos"]
    ranged = lines.repartitionByRange(shuffle_parts(lines), *order).sortWithinPartitions(*order)
    marks = scratch.write(ranged.mapInArrow(lambda batches: _judge(batches, min_docs, keep_first), MARKS), "marks")
    scratch.drop("lines")
    open_marks = marks.filter("hash IS NOT NULL")
    # At most two lines per partition are open, so this table is small whatever the lines are.
    verdicts = (
        open_marks.groupBy("hash").agg(
            F.max(F.col("doc_id").isNull()).alias("known"), F.count_distinct("doc_id").alias("n"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "first"))).alias("kept"),
        ).filter(F.col("known") | (F.col("n") >= min_docs))
    )
    stays = F.when(~F.col("known") & (F.col("kept.doc_id") == F.col("doc_id")), F.col("kept.first"))
    judged = open_marks.filter("doc_id IS NOT NULL").join(F.broadcast(verdicts), "hash").select(
        "doc_id", "places", (stays if keep_first else F.lit(None).cast("int")).alias("stays")
    )
    closed = marks.filter("hash IS NULL").select("doc_id", "places", F.lit(None).cast("int").alias("stays"))
    by_doc = closed.unionByName(judged).groupBy("doc_id").agg(F.collect_list(F.struct("places", "stays")).alias("marks"))
    return by_doc.mapInArrow(_bitmaps, "doc_id long, keep binary")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return lines, len(lines)
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(flags) or flags[i]], len(lines)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """Documents with their bitmap in a column of a new name."""
    name = "keep"
    while any(name in c.lower() for c in docs.columns):
        name += "_"
    key = name + "doc"
    renamed = bitmaps.select(F.col("doc_id").alias(key), F.col("keep").alias(name))
    return docs.join(renamed, F.col("doc_id") == F.col(key), "left").drop(key), name


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with the lost lines taken out of `text`, and `n_chars`, if there is one, counted anew."""
    rows, name = _with_bitmaps(docs, bitmaps)

    def work(batches):
        for batch in batches:
            for piece, texts in W.chunks([batch]):
                keep = piece.column(name).to_pylist()
                new = [
                    None if t is None else b"\n".join(kept_lines(t, k)[0]).decode("utf-8", "replace")
                    for t, k in zip(texts, keep)
                ]
                columns = []
                for field in piece.schema:
                    column = piece.column(field.name)
                    if field.name == "text":
                        column = pa.array(new, field.type)
                    elif field.name == "n_chars" and pa.types.is_integer(field.type):
                        counts = zip(column.to_pylist(), new, keep)
                        column = pa.array([n if k is None or x is None else len(x) for n, x, k in counts], field.type)
                    if field.name != name:
                        columns.append(column)
                yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return rows.mapInArrow(work, docs.schema)


def line_report(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Lines before, lines lost, and a digest of the text that stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, name = _with_bitmaps(rows, bitmaps)

    def work(batches):
        for batch, texts in W.chunks(batches):
            lines, lost, digest = [], [], []
            for text, keep in zip(texts, batch.column(name).to_pylist()):
                stay, n = kept_lines(text, keep)
                lines.append(n)
                lost.append(n - len(stay))
                digest.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return rows.mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
