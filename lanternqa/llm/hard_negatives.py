"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Vectors of one label and length are packed into tiles of bounded size, sorted by
id. Tiles of anchors meet tiles of candidates on a grid of bounded cells, and the
scores of two tiles are one matrix product: Strassen's recursion with zero rows
and columns where a side is odd, all sums in 64-bit integers. Its smallest blocks
multiply in doubles where every sum is proved to stay below 2^53, which is exact,
and in integers otherwise.

The first pass joins tiles of equal label and keeps each anchor's best positives
in a heap; the second joins tiles of other labels and keeps, for each positive,
the best candidates inside its window of scores. Heaps of tiles merge into those
of a task, and those of tasks by a ranked limit, so no group is ever gathered.

Every anchor meets every candidate, as the result asks; a cell holds at most
`CELL_TILES` tiles a side, so an anchor travels once for each `CELL_TILES`
candidate tiles, and the reverse.

Defined results: rows without id, label or vector, or with a null component take
no part. Rows of one id are one row, that of the smallest label, then vector.
Vectors of different length are not compared. Ties go to the smaller id. Scores
that 64 bits might not hold are an error. Other columns do not matter. An empty
table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternqa.llm.scratch import Scratch
from lanternqa.operators.spread import grid_join

POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90, 100)
LEAF = 32
TILE_ROWS = 1024
TILE_BYTES = 2 << 20
BUFFER_BYTES = 32 << 20
CELL_TILES = 16
HEAP_CELLS = 1 << 21
EXACT = 1 << 53
NOTHING = np.iinfo(np.int64).min
TILE = "label string, dims int, n int, ids binary, vectors binary, wanted binary, bounds binary"


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    largest = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices; exact whenever the product itself fits 64 bits, since sums wrap around."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return leaf_product(a, b)
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best `size` (score, id) of each of some rows: higher scores first, ties by smaller id."""

    def __init__(self, rows: int, size: int) -> None:
        self.size = size
        self.scores = np.full((rows, size), NOTHING)
        self.ids = np.zeros((rows, size), np.int64)

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in rows of scores, `NOTHING` where there is none, of ascending `ids` (one row for all, or a row each)."""
        if scores.shape[1] > self.size:
            least = np.partition(scores, scores.shape[1] - self.size, axis=1)[:, -self.size]
            better = (scores >= np.maximum(least, self.scores[:, -1])[:, None]) & (scores != NOTHING)
        else:
            better = scores != NOTHING
        row, column = np.nonzero(better)
        if not len(row):
            return
        new = ids[column] if ids.ndim == 1 else ids[row, column]
        old_row, old_column = np.nonzero(self.scores != NOTHING)
        rows = np.concatenate([old_row, row])
        score = np.concatenate([self.scores[old_row, old_column], scores[row, column]])
        name = np.concatenate([self.ids[old_row, old_column], new])
        order = np.lexsort((name, ~score, rows))  # ~x falls as x rises, without overflow
        rows, score, name = rows[order], score[order], name[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.size
        self.scores[rows[kept], place[kept]] = score[kept]
        self.ids[rows[kept], place[kept]] = name[kept]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column end to end, and each row's first (one more at the end)."""
    first = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]].astype(np.int64), first - first[0]


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack rows (id, label, vector, wanted, scores) into tiles of one label and length, a buffer at a time."""
    names = [x.split()[0] for x in TILE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["id"].to_numpy()
        label = table["label"].combine_chunks().dictionary_encode()
        code, texts = label.indices.to_numpy(), label.dictionary.to_pylist()
        values, first = _lists(table["vector"].combine_chunks())
        extra = [_lists(table[c].combine_chunks()) for c in ("wanted", "bounds")]
        dims = np.diff(first)
        order = np.lexsort((ids, code, dims))
        changed = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
        for run in np.split(order, changed):
            width = int(dims[run[0]])
            rows = max(1, min(TILE_ROWS, TILE_BYTES // (8 * max(width, 1))))
            for at in range(0, len(run), rows):
                some = run[at : at + rows]
                vectors = values[(first[some][:, None] + np.arange(width)).ravel()]
                parts = [
                    np.concatenate([x[f[i] : f[i + 1]] for i in some.tolist()]) if len(x) else x[:0] for x, f in extra
                ]
                row = [texts[code[some[0]]], width, len(some), *(x.tobytes() for x in (ids[some], vectors, *parts))]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            held.append(batch.slice(at, TILE_ROWS))
            size += held[-1].get_total_buffer_size() if batch.num_rows <= TILE_ROWS else held[-1].nbytes
            if size > BUFFER_BYTES:
                yield from pack(held)
                held, size = [], 0
    if held:
        yield from pack(held)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of an anchor tile against a candidate tile, and the ids of both."""
    ours, theirs = (np.frombuffer(row[c], np.int64).reshape(n, row["dims"]) for c, n in (("a_vectors", row["a_n"]), ("vectors", row["n"])))
    largest = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (ours, theirs)]
    if largest[0] * largest[1] * max(row["dims"], 1) >= 1 << 63:
        raise OverflowError("inner products of these vectors may not fit 64 bits")
    return strassen(ours, theirs.T), np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["ids"], np.int64)


def _keep(
    batches: Iterable[pa.RecordBatch], size: int, slots: int, feed: Callable[[Heaps, dict], None], names: list[str],
    give: Callable[[np.ndarray, np.ndarray, Heaps, dict], tuple],
) -> Iterator[pa.RecordBatch]:
    """Fold the pairs of tiles of a task into one heap set for each anchor tile; give out what they hold."""
    heaps: dict[int, tuple[Heaps, dict]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for held, row in heaps.values():
            at = np.nonzero(held.scores != NOTHING)
            columns = give(*at, held, row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        heaps.clear()

    for batch in batches:
        for at in range(batch.num_rows):  # a row holds two tiles
            (row,) = batch.slice(at, 1).to_pylist()
            if row["a_tile"] not in heaps:
                if sum(h.scores.size for h, _ in heaps.values()) > HEAP_CELLS:
                    yield from out()
                own = {k: row[k] for k in ("a_ids", "a_wanted", "a_bounds")}
                heaps[row["a_tile"]] = Heaps(row["a_n"] * slots, size), own
            feed(heaps[row["a_tile"]][0], row)
    yield from out()


def _positives(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def feed(heaps: Heaps, row: dict) -> None:
        scores, ours, theirs = _scores(row)
        scores[ours[:, None] == theirs[None]] = NOTHING
        heaps.merge(scores, theirs)

    def give(row: np.ndarray, place: np.ndarray, heaps: Heaps, own: dict) -> tuple:
        return np.frombuffer(own["a_ids"], np.int64)[row], heaps.ids[row, place], heaps.scores[row, place]

    return _keep(batches, size, 1, feed, ["anchor_id", "positive_id", "positive_score"], give)


def _negatives(batches: Iterable[pa.RecordBatch], size: int, slots: int, window: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    low, high, whole = window

    def feed(heaps: Heaps, row: dict) -> None:
        scores, ours, theirs = _scores(row)
        bounds = np.frombuffer(row["a_bounds"], np.int64).reshape(len(ours), slots)
        part = Heaps(len(ours) * slots, size)
        for slot in range(slots):
            score = bounds[:, slot]
            there = score != NOTHING
            score = np.where(there, score, 0)
            # Whole numbers between the two shares of the positive's score.
            lowest, highest = -(-low * score // whole), high * score // whole
            inside = there[:, None] & (scores >= lowest[:, None]) & (scores <= highest[:, None])
            own = Heaps(len(ours), size)
            own.merge(np.where(inside, scores, NOTHING), theirs)
            part.scores[slot::slots], part.ids[slot::slots] = own.scores, own.ids
        heaps.merge(part.scores, part.ids)

    def give(row: np.ndarray, place: np.ndarray, heaps: Heaps, own: dict) -> tuple:
        anchors, wanted, bounds = (np.frombuffer(own[c], np.int64) for c in ("a_ids", "a_wanted", "a_bounds"))
        return anchors[row // slots], wanted[row], heaps.ids[row, place], bounds[row], heaps.scores[row, place]

    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    return _keep(batches, size, slots, feed, names, give)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int, int] = WINDOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` is (id, label, vector) of whole numbers; `is_anchor` says by the
    id which rows are anchors. An anchor's positives are its `positives` best
    other rows of its label. For each, the `negatives` best rows of other labels
    are given whose score lies between window[0] / window[2] and window[1] /
    window[2] of the positive's.
    """
    scratch = Scratch(vectors.sparkSession)
    none = F.array().cast("array<long>")
    rows = vectors.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("vector").cast("array<long>").alias("vector"),
    )
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    one = rows.filter(whole & F.forall("vector", lambda x: x.isNotNull())).groupBy("id").agg(
        F.min(F.struct("label", "vector")).alias("own")
    )
    one = scratch.write(one.select("id", "own.*"), "vectors")

    def tiles(table: DataFrame, name: str, prefix: str = "") -> DataFrame:
        """Packed rows, each with a number; those of anchors under other names."""
        packed = table.mapInArrow(_tiles, TILE).withColumn("tile", F.monotonically_increasing_id())
        kept = ("label", "dims") if prefix else ()
        return scratch.write(packed.select(*[F.col(c).alias(c if c in kept else prefix + c) for c in packed.columns]), name)

    plain = one.withColumn("wanted", none).withColumn("bounds", none)
    theirs = tiles(plain, "candidate_tiles").drop("wanted", "bounds")
    ours = tiles(plain.filter(is_anchor), "anchor_tiles", "a_")
    pairs = grid_join(theirs, ours, ["label", "dims"], ["tile"], ["a_tile"], CELL_TILES)
    found = pairs.mapInArrow(
        lambda batches: _positives(batches, positives), "anchor_id long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    # One slot for each of a few positives; an empty one holds the least number.
    slots = F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    wanted = first.groupBy(F.col("anchor_id").alias("id")).agg(slots.alias("slots"))
    missing = F.array_repeat(F.lit(NOTHING), F.lit(positives) - F.size("slots"))
    anchors = one.join(wanted, "id").select(
        "id", "label", "vector", F.concat("slots.positive_id", missing).alias("wanted"),
        F.concat("slots.positive_score", missing).alias("bounds"),
    )
    asking = tiles(anchors, "asking_tiles", "a_").withColumnRenamed("label", "a_label")
    pairs = grid_join(theirs, asking, ["dims"], ["tile"], ["a_tile"], CELL_TILES).filter("label <> a_label")
    found = pairs.mapInArrow(
        lambda batches: _negatives(batches, negatives, positives, window),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
