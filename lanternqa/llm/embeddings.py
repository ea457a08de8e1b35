"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks.

Vectors of equal label and equal components are one class. Each class's
normalised vector is projected on Gaussian directions; the quantised projections
of one table are its bucket there. Vectors that share a bucket in any table are
compared exactly, in double precision. A bucket beyond `block` vectors is cut
into blocks, and each pair of blocks is a task's share, so no bucket has to fit
into one task and none is capped. A pair is counted in the first table in which
it meets, so no list of pairs is ever made: a task gives out the number of links
of each vector and a spanning forest of the links.

Directions, widths and the number of tables are chosen so that a pair at the
threshold is missed with a probability below 0.001 (`miss_probability`).

Defined results: a vector that is null, empty, zero, or has null or non-finite
components, and one without label, links with nothing. Vectors of different
length never link. A repeated vec_id is one vector: the smallest of its rows by
label and content. Rows without vec_id are left out. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.components import UnionFind, components
from lanternqa.llm.scratch import Scratch, shuffle_parts

THRESHOLD = 0.93
TABLES = 64
HASHES = 10
WIDTH = 1.5
BLOCK = 2048
SEED = 20
VECTORS = "vec_id long, label string, class binary, vector binary, keys array<long>"


def miss_probability(cosine: float, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> float:
    """How likely two unit vectors at this cosine share no bucket (Gaussian projections, quantised by `width`)."""
    gap = math.sqrt(max(2 - 2 * cosine, 1e-18))
    r = width / gap
    meet = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return (1 - meet**hashes) ** tables


def _hash(batches: Iterable[pa.RecordBatch], tables: int, hashes: int, width: float) -> Iterator[pa.RecordBatch]:
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        rows = []
        for vec_id, label, vector in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector"))):
            unit = None
            if label is not None and vector and None not in vector:
                x = np.array(vector, np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    unit = x / top + 0.0  # neither too large nor too small to square, and no negative zero
                    unit /= np.linalg.norm(unit)
            if unit is None:
                rows.append((vec_id, None, None, None, None))
                continue
            if len(unit) not in planes:
                rng = np.random.default_rng([SEED, len(unit)])
                planes[len(unit)] = rng.normal(size=(tables * hashes, len(unit))), rng.uniform(0, width, tables * hashes)
            direction, shift = planes[len(unit)]
            cell = np.floor((direction @ unit + shift) / width).astype(np.int64).view(np.uint64).reshape(tables, hashes)
            key = np.full(tables, len(unit), np.uint64) + (np.arange(tables, dtype=np.uint64) << np.uint64(32))
            for k in range(hashes):
                key = W.mixed(key * np.uint64(W.WINDOW_BASE) + cell[:, k])
            name = hashlib.blake2b((np.array(vector, np.float64) + 0.0).tobytes(), digest_size=16).digest()
            rows.append((vec_id, str(label), name, unit.tobytes(), key.view(np.int64).tolist()))
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["vec_id", "label", "class", "vector", "keys"]
        )


def _compare(rows: list[dict], threshold: float) -> Iterator[tuple[int, int | None, int]]:
    """The links of one bucket, or of one pair of its blocks: (class, other class or null, number of links)."""
    table = rows[0]["at"]
    ids = np.array([r["rep"] for r in rows], np.int64)
    sizes = np.array([r["size"] for r in rows], np.int64)
    x = np.stack([np.frombuffer(r["vector"], np.float64) for r in rows])
    keys = np.array([r["keys"][:table] for r in rows], np.int64).reshape(len(rows), table)
    block = np.array([r["block"] for r in rows])
    low, high = rows[0]["low"], rows[0]["high"]
    left, right = (np.flatnonzero(block == b) for b in (low, high))
    counts, sets = np.zeros(len(rows), np.int64), UnionFind()
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        i, j = np.nonzero(x[some] @ x[right].T >= threshold - 1e-9)
        i, j = some[i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        # The product of whole blocks may round otherwise than a pair's own sum; the edge is decided by the latter.
        if not len(i):
            continue
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
        if table:
            fresh = np.concatenate(
                [~(keys[i[k : k + 65536]] == keys[j[k : k + 65536]]).any(1) for k in range(0, len(i), 65536)] or [[]]
            ).astype(bool)
            i, j = i[fresh], j[fresh]
        np.add.at(counts, i, sizes[j])
        np.add.at(counts, j, sizes[i])
        for a, b in zip(ids[i].tolist(), ids[j].tolist()):
            if sets.join(a, b):
                yield a, b, 0
    for k in np.flatnonzero(counts).tolist():
        yield int(ids[k]), None, int(counts[k])


def _buckets(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by bucket and pair of blocks."""
    key, rows, out = None, [], []

    def give() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["a", "b", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            own = (row["bucket"], row["low"], row["high"])
            if own != key:
                if rows:
                    out.extend(_compare(rows, threshold))
                key, rows = own, []
                if len(out) > 20_000:
                    yield give()
            rows.append(row)
    if rows:
        out.extend(_compare(rows, threshold))
    yield give()


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES,
    width: float = WIDTH, block: int = BLOCK, vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).filter("vec_id IS NOT NULL")
    hashed = rows.mapInArrow(lambda batches: _hash(batches, tables, hashes, width), VECTORS)
    best = F.min(F.struct("label", "class", "vector", "keys")).alias("own")
    marks = scratch.write(hashed.groupBy("vec_id").agg(best).select("vec_id", "own.*"), "vectors")
    valid = marks.filter("class IS NOT NULL")
    classes = scratch.write(
        valid.groupBy("label", "class").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"),
            F.first("vector").alias("vector"), F.first("keys").alias("keys"),
        ),
        "classes",
    )
    places = classes.select("rep", "label", F.posexplode("keys").alias("at", "key")).select(
        "rep", "at", F.xxhash64("label", "at", "key").alias("bucket")
    )
    crowded = scratch.write(
        places.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("bucket", "blocks"), "crowded",
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    shares = (
        places.join(crowded, "bucket").withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "at", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    work = shares.join(classes.select("rep", "size", "vector", "keys"), "rep")
    parts = shuffle_parts(vectors)
    order = ["bucket", "low", "high"]
    met = scratch.write(
        work.repartition(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _buckets(batches, threshold), "a long, b long, n long"),
        "met",
    )
    counts = met.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    found = components(met.filter("b IS NOT NULL").select("a", "b"), scratch)
    reps = classes.select("label", "class", "rep", "size").join(counts, "rep", "left").join(
        found.withColumnRenamed("id", "rep"), "rep", "left"
    )
    ends = scratch.write(
        reps.select(
            "label", "class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        ),
        "ends",
    )
    linked = marks.select("vec_id", "label", "class").join(ends, ["label", "class"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))
