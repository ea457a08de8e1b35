"""Substring dedup by compaction of a De Bruijn graph of words.

Edges are runs of `k` words. All occurrences of an edge meet in the task that
holds its key and are joined to the edge's source: its earliest occurrence, by
doc_id and start. Runs repeated inside one chunk of texts meet there already, so
an edge that a third of all documents hold sends one row per chunk. An occurrence
that follows another at the same distance from the same source continues its
path; where the walk of a document branches off, source or distance change. So
nonbranching repeated paths become single rows (document, start, edges, source,
source start). Each path is then verified: both ends are joined to the texts by
their coordinates and compared by a 128-bit fingerprint of other hash families.

An edge key is 64 bits; two different runs that share a key fail verification
and lose nothing, so unique text is never removed.

Defined results: null or empty texts have no words. Documents are their doc_id:
a repeated row has the same coordinates, is no earlier copy of itself, and loses
the same words. A row without doc_id is not compared and stays whole. Other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.scratch import Scratch, shuffle_parts

EDGE_WORDS = 20
CHUNK_BYTES = 3 << 20
# A row of edges: to which part, and by document the number of edges, their starts and their keys. A row of
# links (no keys): the occurrences' documents and starts, their sources' documents, and the distances to them.
EDGES = "part int, keys binary, docs binary, counts binary, starts binary, sources binary, shifts binary"
LINKS = "part int, docs binary, counts binary, starts binary, sources binary, shifts binary"


def _binary(*arrays: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in arrays]


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else np.empty(0, np.int64)
    first = np.concatenate(([0], cuts)) if len(values) else cuts
    return values[first], np.diff(np.append(first, len(values))).astype(np.int32)


def _link_row(part: int, doc, start, source, source_start) -> tuple:
    order = np.lexsort((start, doc))
    docs, counts = _runs_of(doc[order])
    shift = (source_start - start)[order].astype(np.int32)
    return (part, None, *_binary(docs, counts, start[order].astype(np.int32), source[order], shift))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith("int") else pa.binary() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _edges(batches: Iterable[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in W.chunks(batches, CHUNK_BYTES):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        cut = W.cut([texts[i] or b"" for i in order], W.spaced())
        at = W.window_starts(cut.first, k)
        if not len(at):
            continue
        keys = W.window_keys(W.word_keys(cut), k)[at]
        text = np.searchsorted(cut.first, at, "right") - 1
        doc, start = ids[text], at - cut.first[text]
        # Within the chunk only each edge's first occurrence goes on; the others are linked to it here.
        sort = np.argsort(keys, kind="stable")
        same = np.append(False, keys[sort][1:] == keys[sort][:-1])
        head = sort[np.maximum.accumulate(np.where(same, 0, np.arange(len(sort))))]
        again, source = sort[same], head[same]
        moved = (doc[again] != doc[source]) | (start[again] != start[source])
        again, source = again[moved], source[moved]
        rows = []
        if len(again):
            rows.append(_link_row(int(ids[0]) % parts, doc[again], start[again], doc[source], start[source]))
        first = np.ones(len(keys), bool)
        first[sort[same]] = False
        first = np.flatnonzero(first)
        # The high bits of a key name its part; a stable sort of small numbers keeps the order of the texts.
        part = ((keys[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 65536 else np.uint32)
        by_part = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
        first = first[by_part]
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            own = first[bounds[p] : bounds[p + 1]]
            docs, counts = _runs_of(doc[own])
            rows.append((p, *_binary(keys[own], docs, counts, start[own].astype(np.int32)), None, None))
        yield _rows(rows, EDGES)


def _links_of(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """All links of some rows: documents, starts, source documents, distances to the source starts."""
    columns = []
    for row in rows:
        counts = np.frombuffer(row["counts"], np.int32)
        columns.append(
            (np.repeat(np.frombuffer(row["docs"], np.int64), counts), np.frombuffer(row["starts"], np.int32),
             np.frombuffer(row["sources"], np.int64), np.frombuffer(row["shifts"], np.int32))
        )
    empty = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32))
    return tuple(np.concatenate(x) for x in zip(*columns, empty))


def _meet(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Join the occurrences of each edge of a part to the earliest one; the links leave by parts of the documents."""
    keys, docs, starts, known = [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["keys"] is None:
                known.append(row)
                continue
            keys.append(np.frombuffer(row["keys"], np.uint64))
            docs.append(np.repeat(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["counts"], np.int32)))
            starts.append(np.frombuffer(row["starts"], np.int32))
    links = [_links_of(known)]
    if keys:
        key, doc, start = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts)
        del keys, docs, starts
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        own = order[np.append(same, False) | np.append(False, same)]
        own = own[np.lexsort((start[own], doc[own], key[own]))]
        follows = np.append(False, key[own][1:] == key[own][:-1])[: len(own)]
        head = own[np.maximum.accumulate(np.where(follows, 0, np.arange(len(own))))]
        moved = (doc[own] != doc[head]) | (start[own] != start[head])
        own, head = own[moved], head[moved]
        links.append((doc[own], start[own], doc[head], start[head] - start[own]))
    doc, start, source, shift = (np.concatenate(x) for x in zip(*links))
    part = (W.mixed(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[p] : bounds[p + 1]]
        row = _link_row(p, doc[own], start[own], source[own], start[own] + shift[own])
        rows.append((p, *row[2:]))
    yield _rows(rows, LINKS)


def _compact(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Nonbranching paths of whole documents: successive starts with one source document and one distance."""
    doc, start, source, shift = _links_of([row for batch in batches for row in batch.to_pylist()])
    if len(doc):
        start = start.astype(np.int64)
        order = np.lexsort((start, doc))
        doc, start, source, shift = doc[order], start[order], source[order], shift[order].astype(np.int64)
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))  # a repeated row links twice
        doc, start, source, shift = doc[fresh], start[fresh], source[fresh], shift[fresh]
        breaks = np.append(
            True,
            (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]),
        )
        first = np.flatnonzero(breaks)
        edges = np.diff(np.append(first, len(doc)))
        columns = [doc[first], start[first], edges + k - 1, source[first], start[first] + shift[first]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "source_id", "source_start"]
        )


def repeated_paths(docs: DataFrame, scratch: Scratch, k: int = EDGE_WORDS) -> DataFrame:
    """(doc_id, start, length, source_id, source_start): spans of words that also stand earlier, not yet verified."""
    parts = shuffle_parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    edges = rows.filter("doc_id IS NOT NULL").mapInArrow(lambda batches: _edges(batches, k, parts), EDGES)
    links = edges.repartitionById(parts, F.col("part")).mapInArrow(lambda batches: _meet(batches, parts), LINKS)
    schema = "doc_id long, start long, length long, source_id long, source_start long"
    walks = links.repartitionById(parts, F.col("part")).mapInArrow(lambda batches: _compact(batches, k), schema)
    return scratch.write(walks, "paths")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the asked spans: two polynomials over word keys of two families, from running sums."""
    schema = ["doc_id", "start", "length", "print_1", "print_2"]
    for batch, texts in W.chunks(batches):
        cut = W.cut([x or b"" for x in texts], W.spaced())
        asked = [
            (doc, int(cut.first[i]) + s["start"], s["start"], s["length"])
            for i, (doc, spans) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()))
            for s in spans if s["start"] + s["length"] <= cut.first[i + 1] - cut.first[i]
        ]
        if not asked:
            continue
        doc, at, start, length = (np.array(x, np.int64) for x in zip(*asked))
        prints = []
        for family in (1, 2):
            base = W.WORD_BASES[family]
            total = np.zeros(len(cut.start) + 1, np.uint64)
            np.cumsum(W.word_keys(cut, family) * W.powers(base, len(cut.start)), out=total[1:])
            down = W.powers(pow(base, -1, 1 << 64), len(cut.start) + 1)
            prints.append(((total[at + length] - total[at]) * down[at]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, *prints)], names=schema)


def verified_paths(docs: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """The paths whose words equal those at their source's coordinates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends = paths.select("doc_id", "start", "length").unionByName(
        paths.select(F.col("source_id").alias("doc_id"), F.col("source_start").alias("start"), "length")
    )
    asked = ends.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    prints = scratch.write(
        rows.join(asked, "doc_id").mapInArrow(
            _fingerprints, "doc_id long, start long, length long, print_1 long, print_2 long"
        ).dropDuplicates(["doc_id", "start", "length", "print_1", "print_2"]),
        "prints",
    )
    of_source = prints.select(
        F.col("doc_id").alias("source_id"), F.col("start").alias("source_start"), "length", "print_1", "print_2"
    )
    own = paths.join(prints, ["doc_id", "start", "length"])
    same = ["source_id", "source_start", "length", "print_1", "print_2"]
    return scratch.write(own.join(of_source, same, "left_semi").select(paths.columns).distinct(), "verified")


def repeated_spans(docs: DataFrame, k: int = EDGE_WORDS) -> DataFrame:
    """(doc_id, start, length, source_id, source_start): all verified spans of `k` or more words that stand earlier."""
    scratch = Scratch(docs.sparkSession)
    paths = repeated_paths(docs, scratch, k)
    verified = verified_paths(docs, paths, scratch)
    scratch.drop("paths", "prints")
    return verified


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return rows.join(lists, "doc_id", "left")


def _keep(batch: pa.RecordBatch, texts: list) -> tuple[W.Words, np.ndarray]:
    """The words of some texts and which of them stay."""
    cut = W.cut([x or b"" for x in texts], W.spaced())
    found = [
        (int(cut.first[i]) + s["start"], s["length"])
        for i, spans in enumerate(batch.column("spans").to_pylist()) for s in spans or ()
    ]
    at, length = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return cut, ~W.spread(len(cut.start), at, length)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text): the kept words of each document, joined by blanks."""

    def work(batches):
        for batch, texts in W.chunks(batches):
            cut, keep = _keep(batch, texts)
            body, at = W.joined(cut, keep)
            kept = [body[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return _with_spans(docs, spans).mapInArrow(work, "doc_id long, text string")


def span_report(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Words before, words removed, and a digest of the words that stay."""

    def work(batches):
        for batch, texts in W.chunks(batches):
            cut, keep = _keep(batch, texts)
            body, at = W.joined(cut, keep)
            digest = [hashlib.sha256(body[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            gone = np.concatenate(([0], np.cumsum(~keep)))[cut.first]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(cut.counts(), pa.int64()), pa.array(np.diff(gone), pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _with_spans(docs, spans).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
