"""Connected components of links that never come together in one place.

Each task first folds its own links with a union-find into stars around the
smallest id, which turns a clique into a few rows. The stars are dealt by their
larger ids and folded again, which joins the centres that share a member. Rounds
of a large-star join and such a fold, in place of a small star, then pull every
node to the smallest id it can reach. A round writes two tables: each step has
its fixed cost for each partition. The join reads both sides from written tables,
so a hot centre can be split among tasks; a larger id has a row a task at most.

Defined results: without links there are no rows. Links with a null end, loops
and repeated links change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm.scratch import Scratch

LINK = "a long, b long"
NODES = 500_000


class UnionFind:
    """Disjoint sets of ids; the root of a set is its smallest id."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _rows(sets: UnionFind) -> Iterator[pa.RecordBatch]:
    ids = [x for x in sets.parent if sets.root(x) != x]
    for at in range(0, len(ids), 100_000):
        part = ids[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([sets.root(x) for x in part], pa.int64())], names=["a", "b"]
        )


def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links `a`, `b` as stars: each larger id `a` with the smallest id `b` that it reaches here.

    Stars are handed on beyond `NODES` ids, but never between two links of one `a` that follow each other.
    """
    sets, last = UnionFind(), None
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if len(sets.parent) >= NODES and a != last:
                yield from _rows(sets)
                sets = UnionFind()
            last = a
            sets.join(a, b)
    yield from _rows(sets)


def _settled(stars: DataFrame) -> bool:
    """Whether every node points to one centre, and no centre points further."""
    ends = stars.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(
        stars.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("to"))
    )
    around = ends.groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("centre"))
    return around.filter("low IS NOT NULL AND (centre OR low <> high)").isEmpty()


def connect(stars: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Written stars (larger id `a`, smaller id `b`) from those folded in tasks; a component may be left in several connected ones."""
    return scratch.write(stars.repartition("a").sortWithinPartitions("a").mapInArrow(fold, LINK), name)


def settle(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """One star for each component; a row may come twice. `stars` is a written table, which stays."""
    turn = 0
    while not _settled(stars):
        turn += 1
        # Large star: all larger neighbours of a node move to the smallest id around it.
        low = scratch.write(stars.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low")), f"low_{turn}")
        large = stars.join(low.hint("merge"), "b", "left").select("a", F.coalesce("low", "b").alias("b"))
        # Small star and more: what the links of a task's larger ids connect.
        stars = connect(large, scratch, f"stars_{turn}")
        scratch.drop(f"low_{turn}", *([f"stars_{turn - 1}"] if turn > 1 else []))
    return stars


def centres(stars: DataFrame) -> DataFrame:
    """(id, component) of each larger id."""
    return stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for each end `a`, `b` of a link that is not its component's smallest id, that id."""
    real = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    return centres(settle(connect(real.mapInArrow(fold, LINK), scratch, "stars_0"), scratch))
