"""The trie of conversations that begin alike, by truncation peeling.

A conversation is a path: a 128-bit digest for each turn, end to end, so that
sorting paths puts all conversations with a common beginning next to each other.
Paths are range-partitioned; equal ones fold into one with a digest of their
members' ids. A task then peels stretches of its sorted paths: it descends from
the deepest turn, merges what ends at that depth with the nodes that survive from
below, aggregates each node as it is found, strips the last turn and regroups.

Only nodes on the first and the last path of a stretch can have members outside
it. They leave as two rows, each a path with what is known at every depth, and
these rows are peeled again in the same way until one stretch holds them all. So
neither a beginning that a third of all conversations share nor a very deep
conversation gathers in one task, and there is no round for each depth.

Memory in a task follows a stretch (`STRETCH` paths or `STRETCH_BYTES`). A
conversation is one row of some 50 bytes a turn while its turns are put in order;
beyond some ten million turns a single conversation would not fit a row.

Defined results: a null role or text is empty; turns go by number, null first,
ties by role, then by the digest of role and text. Rows without conv_id are left
out. Repeated rows are turns of their own. Other columns do not matter. An empty
table has no conversations and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternqa.llm.scratch import Scratch, shuffle_parts
from lanternqa.operators.spread import spread_join
from lanternqa.session import fits_broadcast

DIGEST = 16
SECTION = 4096
STRETCH = 4096
STRETCH_BYTES = 8 << 20
FEW = 8
BIG = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
STATS = ("n", "low", "kids", "leaves", "saved")
SECTIONS = "path binary, sizes array<long>, first long, n long, ids string"
NODES = (
    "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
EDGES = "path binary, sizes array<long>, stats array<long>, ends array<string>"


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests of role and text, and the texts' lengths."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(F.sha2(whole, 256), 1, 2 * DIGEST).alias("digest"), F.length(text).cast("long").alias("size"),
    )
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).filter("conv_id IS NOT NULL")
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def with_heads(turns: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Each conversation with its first `head` turns (at most `longest`) replaced by those of the conversation `base`.

    A base that is missing has no turns, a shorter one gives all it has.
    """
    asked = turns.withColumn("_base", base).withColumn("_head", head)
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, longest).alias("_first"))
    # Only conversations that are a base somewhere travel.
    heads = heads.join(asked.select("_base").distinct(), "_base", "left_semi")
    first = F.slice(F.coalesce("_first", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), F.col("_head"))
    own = F.slice("turns", F.col("_head") + 1, F.size("turns"))
    return asked.join(heads, "_base", "left").select("conv_id", F.concat(first, own).alias("turns"))


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the digests end to end, and the texts' lengths."""
    joined = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    return turns.select(
        "conv_id", F.unhex(joined).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")
    )


def _stream(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from batch.slice(at, rows).to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _sections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and id: the ids of one path in strings of up to `SECTION` ids."""

    def sections() -> Iterator[tuple]:
        path, sizes, ids = None, None, []
        for row in _stream(batches):
            if ids and (row["path"] != path or len(ids) == SECTION):
                yield path, sizes, ids[0], len(ids), ",".join(map(str, ids))
                ids = []
            path, sizes = row["path"], row["sizes"]
            ids.append(row["conv_id"])
        if ids:
            yield path, sizes, ids[0], len(ids), ",".join(map(str, ids))

    return _batches(sections(), _schema(SECTIONS))


class Stretch:
    """Sorted different paths, and what is known of nodes on them: one row of statistics for each (path, depth)."""

    def __init__(self) -> None:
        self.paths: list[bytes] = []
        self.sizes: list[np.ndarray] = []
        self.item: list[int] = []
        self.depth: list[int] = []
        self.stats: list[tuple] = []
        self.ends: list[str | None] = []
        self.bytes = 0

    def add(self, path: bytes, sizes: list[int], known: Iterable[tuple[int, tuple, str | None]]) -> None:
        self.paths.append(path)
        self.sizes.append(np.array(sizes, np.int64))
        self.bytes += 3 * len(path) + 200
        for depth, stats, ends in known:
            self.item.append(len(self.paths) - 1)
            self.depth.append(depth)
            self.stats.append(stats)
            self.ends.append(ends)

    def full(self) -> bool:
        n = len(self.paths)
        return n >= STRETCH or (n >= FEW and self.bytes > STRETCH_BYTES)


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // DIGEST if differ.any() else n // DIGEST


def _keys(path: bytes) -> list[bytes]:
    """The key of the node at each depth of a path, the root first."""
    running = hashlib.sha256()
    keys = [running.digest()[:DIGEST]]
    for at in range(0, len(path), DIGEST):
        running.update(path[at : at + DIGEST])
        keys.append(running.digest()[:DIGEST])
    return keys


def peel(stretch: Stretch, whole: bool, named: bool) -> tuple[list[tuple], list[tuple]]:
    """The nodes of a stretch that have no members outside it, and its two edges.

    A stretch that is the `whole` has no edges. Nodes are `named` by key where
    nodes of earlier rounds may lie below them.
    """
    m = len(stretch.paths)
    length = np.array([len(p) // DIGEST for p in stretch.paths])
    common = np.array([_common(a, b) for a, b in zip(stretch.paths, stretch.paths[1:])], np.int64)
    flat = np.concatenate([*stretch.sizes, np.zeros(1, np.int64)])
    begin = np.cumsum([0, *map(len, stretch.sizes)])
    item, depth = np.array(stretch.item), np.array(stretch.depth)
    known = np.array(stretch.stats, np.int64).reshape(-1, len(STATS))
    order = np.argsort(-depth, kind="stable")
    item, known = item[order], known[order]
    until = np.searchsorted(-depth[order], -np.arange(int(length.max(initial=0)) + 2), "right")  # rows at least so deep
    keys: dict[int, list[bytes]] = {}

    def key(i: int, d: int) -> bytes:
        if i not in keys:
            keys[i] = _keys(stretch.paths[i])
        return keys[i][d]

    edges = {0: {}, m - 1: {}}
    nodes: list[tuple] = []
    # Nodes that survive from below: first and last path, what they add to their parent, and the rows to be given out.
    first = last = np.empty(0, np.int64)
    adds = np.empty((0, len(STATS)), np.int64)
    waiting: list[tuple | None] = []
    for d in range(int(length.max(initial=0)), -1, -1):
        a, b = until[d + 1], until[d]
        firsts, lasts = np.concatenate([item[a:b], first]), np.concatenate([item[a:b], last])
        stats = np.concatenate([known[a:b], adds])
        said = order[a:b].tolist() + [-1] * len(first)
        place = np.argsort(firsts, kind="stable")
        # Neighbours whose paths part before this depth are different nodes.
        parted = np.concatenate(([0], np.cumsum(common < d)))
        reach = np.maximum.accumulate(lasts[place])
        fresh = np.ones(len(place), bool)
        fresh[1:] = parted[np.maximum(firsts[place][1:], reach[:-1])] > parted[reach[:-1]]
        starts = np.flatnonzero(fresh)
        group = np.empty(len(place), np.int64)
        group[place] = np.cumsum(fresh) - 1
        total = np.add.reduceat(stats[place], starts)
        total[:, 1] = np.minimum.reduceat(stats[place][:, 1], starts)
        first, last = firsts[place][starts], np.maximum.reduceat(lasts[place], starts)
        ends: list[str | None] = [None] * len(starts)
        for at, g in zip(said, group.tolist()):
            if at >= 0 and stretch.ends[at] is not None:
                ends[g] = stretch.ends[at]
        edge = np.zeros(len(starts), bool) if whole else (first == 0) | (last == m - 1)
        # Children learn their parent's name, or its key if that is not settled.
        for row, g in zip(waiting, group[b - a :].tolist()):
            if row is not None:
                settled = not edge[g]
                side = int(first[g]) if first[g] == 0 else m - 1
                nodes.append((row[0], None if settled else key(side, d), *row[1:3], int(total[g, 1]) if settled else None, *row[3:]))
        kids, leaves = total[:, 2], np.where(total[:, 2] == 0, 1, total[:, 3])
        own = flat[begin[first] + d - 1] if d else 0
        saved = total[:, 4] + (total[:, 0] - 1) * own
        waiting = []
        for g, (i, on_edge) in enumerate(zip(first.tolist(), edge.tolist())):
            if on_edge:
                edges[0 if i == 0 else m - 1][d] = (tuple(total[g].tolist()), ends[g])
                waiting.append(None)
            else:
                waiting.append((
                    key(i, d) if named else None, int(total[g, 1]), d, int(total[g, 0]), int(kids[g]), int(leaves[g]),
                    int(saved[g]), ends[g] or NO_ENDS,
                ))
        one = np.ones(len(starts), np.int64)
        adds = np.stack([total[:, 0], total[:, 1], one, leaves, saved], 1)
        adds[edge] = (0, BIG, 0, 0, 0)
    nodes += [(row[0], None, *row[1:3], None, *row[3:]) for row in waiting if row is not None]
    nothing = ((0, BIG, 0, 0, 0), None)
    left = []
    for i in {0, m - 1} if not whole and m else ():
        at_depth = [edges[i].get(d, nothing) for d in range(int(length[i]) + 1)]
        left.append((
            stretch.paths[i], stretch.sizes[i].tolist(), [x for stats, _ in at_depth for x in stats],
            [ends for _, ends in at_depth],
        ))
    return nodes, left


def _peeled(stretches: Iterable[Stretch], whole: bool, named: bool) -> Iterator[pa.RecordBatch]:
    n_nodes, n_edges = NODES.count(",") + 1, EDGES.count(",") + 1

    def rows() -> Iterator[tuple]:
        for stretch in stretches:
            nodes, edges = peel(stretch, whole, named)
            for node in nodes:
                yield (*node, *[None] * n_edges)
            for edge in edges:
                yield (*[None] * n_nodes, *edge)

    return _batches(rows(), _schema(f"{NODES}, {EDGES}"), 4096)


def _ended(batches: Iterable[pa.RecordBatch]) -> Iterator[Stretch]:
    """Sections sorted by path and first id, as stretches of different paths with their members' digest."""
    stretch, path, sizes, n, low, running = Stretch(), None, None, 0, 0, hashlib.sha256()
    for row in _stream(batches):
        if n and row["path"] == path:
            running.update(b"," + row["ids"].encode())
            n += row["n"]
            continue
        if n:
            stretch.add(path, sizes, [(len(sizes), (n, low, 0, 0, 0), running.hexdigest())])
            if stretch.full():
                yield stretch
                stretch = Stretch()
        path, sizes, n, low, running = row["path"], row["sizes"], row["n"], row["first"], hashlib.sha256(row["ids"].encode())
    if n:
        stretch.add(path, sizes, [(len(sizes), (n, low, 0, 0, 0), running.hexdigest())])
        yield stretch


def _again(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[Stretch]:
    """Edges sorted by path, as stretches; the whole is one."""
    stretch = Stretch()
    for row in _stream(batches):
        stats = np.array(row["stats"], np.int64).reshape(-1, len(STATS))
        stretch.add(row["path"], row["sizes"], ((d, tuple(s), e) for d, (s, e) in enumerate(zip(stats.tolist(), row["ends"]))))
        if not whole and stretch.full():
            yield stretch
            stretch = Stretch()
    if stretch.paths:
        yield stretch


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node: every different beginning of the paths (conv_id, path, sizes), from the empty one.

    conv_id is a node's smallest member; members are the conversations that
    begin with it. saved_tokens adds up, over a node and all below it, the
    members but one times the length of the last text. ends_sha256 is of the ids
    of the conversations that end there, in numeric order, joined by commas.
    """
    scratch, parts = Scratch(paths.sparkSession), shuffle_parts(paths)
    paths = scratch.write(paths.select("conv_id", "path", "sizes"), "paths")
    order = ["path", "conv_id"]
    sections = scratch.write(
        paths.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sections, SECTIONS), "sections"
    )
    scratch.drop("paths")
    ranged = sections.repartitionByRange(parts, "path").sortWithinPartitions("path", "first")
    schema = f"{NODES}, {EDGES}"
    found = scratch.write(ranged.mapInArrow(lambda b: _peeled(_ended(b), False, False), schema), "peeled_0")
    scratch.drop("sections")
    node_columns = [x.split()[0] for x in NODES.split(", ")]
    tables, turn = [], 0
    while True:
        tables.append(found.filter("depth IS NOT NULL").select(*node_columns))
        edges = found.filter("path IS NOT NULL").select(*[x.split()[0] for x in EDGES.split(", ")])
        size = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("path")).alias("bytes")).first()
        if not size["n"]:
            break
        turn += 1
        whole = size["n"] <= FEW or (size["n"] <= STRETCH and size["bytes"] <= STRETCH_BYTES)
        dealt = edges.coalesce(1) if whole else edges.repartitionByRange(-(-size["n"] // STRETCH), "path")
        peeled = dealt.sortWithinPartitions("path").mapInArrow(
            lambda b, whole=whole: _peeled(_again(b, whole), whole, True), schema
        )
        found = scratch.write(peeled, f"peeled_{turn}")
    nodes = tables[0]
    for table in tables[1:]:
        nodes = nodes.unionByName(table)
    settled, open_ = nodes.filter("parent IS NULL"), nodes.filter("parent IS NOT NULL").drop("parent_conv_id")
    named = nodes.filter("key IS NOT NULL").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    if fits_broadcast(named):
        joined = open_.join(F.broadcast(named), "parent")
    else:
        joined = spread_join(open_, named, ["parent"], by=["conv_id", "depth"])
    return settled.unionByName(joined.select(*node_columns)).drop("key", "parent")
