"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A SuperMinHash signature gives each element of a set one pseudo-random
permutation of the slots, and a value in each slot that grows with the slot's
rank in it; a slot keeps the smallest value. Ranks are correlated, so signatures
vary less than with independent hashes, and an element stops as soon as its rank
exceeds every slot: a long text takes a few ranks per element. Documents with
equal sets are one class. Classes that agree on all slots of a band are
candidates, and a link needs the full sets to agree.

Buckets are not expanded into pairs. In the first rounds each bucket compares
its members with one leader. What is then still in different components of a
bucket is compared in cells of bounded size, one or two blocks of members with
their full sets: partners whose signatures do not rule out a link are compared
exactly, likeliest first, unless a union-find has joined them already, and only
links that join two sets leave the cell. So all candidates end up linked, in one
component, or refuted, and a refuted pair never becomes a row. A link at the
limit shares no band, or is ruled out by its signatures, with a probability below
0.0001 (`miss_probability`).

Joins of tables that grow with the corpus are shuffled at every size, so that what
they cost shows on small inputs already.

Defined results: a null or blank text has an empty set and links with nothing; a
single word is a set of one. Rows with one doc_id are one document, that of the
smallest set by key; rows without doc_id are left out of the result. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.components import LINK, UnionFind, centres, connect, fold, settle
from lanternqa.llm.scratch import Scratch, shuffle_parts

WORDS = 2
SIMILARITY = (80, 100)
BANDS = 32
ROWS = 5
GROUP = 1 << 16
STAR_ROUNDS = 2
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
DEVIATIONS = 4.5
SHORT = 0x5851F42D4C957F2D
PLACES = "bucket long, band int, rep long, component long, block int, low int, high int"
SETS = "doc_id long, n_shingles long, high long, low long, bands array<long>, slots binary"


def lowest_share(similarity: tuple[int, int], slots: int) -> float:
    """The share of equal slots below which a link is ruled out: some standard deviations under the limit."""
    limit = similarity[0] / similarity[1]
    return limit - DEVIATIONS * math.sqrt(limit * (1 - limit) / slots)


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """How likely two sets share no band, or too few slots (normal tail)."""
    return (1 - similarity**rows) ** bands + math.erfc(DEVIATIONS / math.sqrt(2)) / 2


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle keys of each text, end to end, and each text's first (one more at the end).

    A text of fewer words, but not none, has the key of its whole sequence.
    """
    cut = W.cut(texts, W.spaced(), fold=True)
    keys = W.word_keys(cut)
    at = W.window_starts(cut.first, words)
    shingle = W.window_keys(keys, words)[at]
    text = np.searchsorted(cut.first, at, "right") - 1
    for n in range(1, words):
        of_n = np.flatnonzero(cut.counts() == n)
        if len(of_n):
            short = W.window_keys(keys, n)[cut.first[of_n]] ^ np.uint64(SHORT)
            shingle, text = np.concatenate([shingle, short]), np.concatenate([text, of_n])
    order = np.argsort(shingle)
    shingle, text = shingle[order], text[order]
    order = np.argsort(text.astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")
    shingle, text = shingle[order], text[order]
    fresh = np.append(True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1]))[: len(shingle)]
    shingle, text = shingle[fresh], text[fresh]
    return shingle, np.searchsorted(text, np.arange(len(texts) + 1))


def super_minhash(keys: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """The signature of each set; infinite for an empty set. `first` as from `shingle_sets`."""
    sizes = np.diff(first)
    out = np.full((len(sizes), slots), np.inf)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    # Sets of like size share a group, so that its long ones stop together.
    group = np.cumsum(sizes[order]) // GROUP if len(order) else order
    for g in np.unique(group):
        sets = order[group == g]
        n = sizes[sets]
        at = np.repeat(first[sets] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[sets] = _group_signature(keys[at], np.repeat(np.arange(len(sets)), n), len(sets), slots)
    return out


def _group_signature(keys: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    best = np.full(n * slots, np.inf)
    rank_of = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(keys), 1))
    row = np.arange(len(keys))
    for rank in range(slots):
        draw = W.mixed(keys + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = rank + (draw >> np.uint64(32)).astype(np.float64) / 4294967296.0
        swap = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        slot = rank_of[row, swap]
        rank_of[row, swap] = rank_of[row, rank]
        np.minimum.at(best, owner * slots + slot, value)
        # No later rank can lower a set whose slots are all below it.
        open_sets = best.reshape(n, slots).max(1) >= rank + 1
        if not open_sets.any():
            break
        stay = open_sets[owner]
        if not stay.all():
            keys, owner, row = keys[stay], owner[stay], row[stay]
    return best.reshape(n, slots)


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = signature.view(np.uint64).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), cells.shape[:2]).copy()
    for k in range(rows):
        keys = W.mixed(keys * np.uint64(W.WINDOW_BASE) + cells[:, :, k])
    return keys.view(np.int64)


def _names(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """A name of each set: two sums of independently mixed keys."""
    names = []
    for salt in W.WORD_BASES[:2]:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mixed(keys ^ np.uint64(salt)))))
        names.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return names


def _sign(batches: Iterable[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in W.chunks(batches):
        keys, first = shingle_sets([x or b"" for x in texts], words)
        sizes = np.diff(first)
        names = _names(keys, first)
        # Copies inside the chunk are signed once.
        seen: dict[tuple, int] = {}
        same = [seen.setdefault(x, i) for i, x in enumerate(zip(*(n.tolist() for n in names), sizes.tolist()))]
        once = np.array(sorted(seen.values()), np.int64)
        kept = sizes[once]
        at = np.repeat(first[once] - (np.cumsum(kept) - kept), kept) + np.arange(int(kept.sum()))
        begin = np.concatenate(([0], np.cumsum(kept)))
        signature = super_minhash(keys[at], begin, bands * rows)
        signed = _bands(signature, bands, rows)
        slots = (W.mixed(signature.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
        place = np.searchsorted(once, same)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(signed[place].ravel(), pa.int64())
        )
        columns = [pa.array(sizes, pa.int64()), *map(pa.array, names), lists, pa.array([x.tobytes() for x in slots[place]], pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], names=["doc_id", "n_shingles", "high", "low", "bands", "slots"]
        )


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in W.chunks(batches):
        keys, first = shingle_sets([x or b"" for x in texts], words)
        body = keys.tobytes()
        sets = [body[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, _names(keys, first)), pa.array(sets, pa.binary())],
            names=["rep", "high", "low", "keys"],
        )


def agree(left: np.ndarray, right: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets share enough of their union, in whole numbers."""
    if similarity[1] * min(len(left), len(right)) < similarity[0] * max(len(left), len(right)):
        return False
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return similarity[1] * shared >= similarity[0] * (len(both) - shared)


def _verify(batches: Iterable[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets agree."""
    for batch in batches:
        a, b = [], []
        for x, y, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "keys_a", "keys_b"))):
            if agree(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by bucket and pair of blocks, a cell at a time."""
    key, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            for row in batch.slice(at, 100).to_pylist():
                own = (row["bucket"], row["low"], row["high"])
                if own != key:
                    if rows:
                        yield rows
                    key, rows = own, []
                rows.append(row)
    if rows:
        yield rows


def _likely(rows: list[dict], lowest: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of members in different components whose signatures do not rule out a link, and their equal slots.

    A pair is given in the first band that it shares.
    """
    component = np.array([r["component"] for r in rows], np.int64)
    block = np.array([r["block"] for r in rows])
    slots = np.stack([np.frombuffer(r["slots"], np.uint8) for r in rows])
    bands = np.stack([np.array(r["bands"], np.int64) for r in rows])
    low, high, band = rows[0]["low"], rows[0]["high"], rows[0]["band"]
    _, place = np.unique(component, return_inverse=True)
    # Members of the largest component need not be compared with each other.
    small = np.flatnonzero(place != np.argmax(np.bincount(place)))
    columns = np.ascontiguousarray(slots.T)
    least = max(1, math.ceil(lowest * len(columns)))
    step = max(1, (2 << 20) // len(rows))
    for at in range(0, len(small), step):
        some = small[at : at + step]
        equal = np.zeros((len(some), len(rows)), np.uint16)
        for column in columns:  # slot by slot: whole rows of bytes at once
            equal += column[some][:, None] == column[None]
        equal[place[some][:, None] == place[None]] = 0
        if low != high:
            equal[block[some][:, None] == block[None]] = 0
        i, j = np.nonzero(equal >= least)
        share = equal[i, j]
        i = some[i]
        first = (bands[i] == bands[j]).argmax(1) == band
        yield i[first], j[first], share[first]


def _flag(batches: Iterable[pa.RecordBatch], lowest: float) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a likely partner there: as many rows as members at most."""
    names = [x.split()[0] for x in PLACES.split(", ")]
    for rows in _by_cell(batches):
        wanted: set[int] = set()
        for i, j, _ in _likely(rows, lowest):
            wanted.update(i.tolist(), j.tolist())
        if wanted:
            columns = [pa.array([rows[k][name] for k in sorted(wanted)]) for name in names]
            yield pa.RecordBatch.from_arrays(
                [c.cast(pa.int32() if n in ("band", "block", "low", "high") else pa.int64()) for n, c in zip(names, columns)],
                names=names,
            )


def _cells(batches: Iterable[pa.RecordBatch], lowest: float, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of a cell: sets are compared unless links found before have joined them."""
    for rows in _by_cell(batches):
        place = [r["component"] for r in rows]
        sets = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        joined, out = UnionFind(), []
        for i, j, share in _likely(rows, lowest):
            order = np.argsort(-share.astype(np.int64), kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if joined.root(place[x]) != joined.root(place[y]) and agree(sets[x], sets[y], similarity):
                    joined.join(place[x], place[y])
                    out.append((rows[x]["rep"], rows[y]["rep"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every doc_id; `similarity` is a fraction of whole numbers."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter("doc_id IS NOT NULL")
    signed = texts.mapInArrow(lambda batches: _sign(batches, words, bands, rows), SETS)
    # One set for each document; classes are made of these sets only.
    marks = ["high", "low", "n_shingles", "bands", "slots"]
    smallest = F.min(F.struct(*marks)).alias("own")
    own = scratch.write(
        signed.groupBy("doc_id").agg(smallest, F.count(F.lit(1)).alias("copies")).select("doc_id", "own.*", "copies"), "own"
    )
    classes = scratch.write(
        own.filter("n_shingles > 0").groupBy("high", "low", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("slots").alias("slots")
        ),
        "classes",
    )
    places = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key")).select(
        "rep", "n_shingles", "band", F.xxhash64("band", "key").alias("bucket")
    )
    # Buckets with a single member go at once; the first round's leader is the smallest one.
    counts = places.groupBy("bucket").agg(
        F.min("rep").alias("leader"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")
    )
    crowded = scratch.write(counts.filter("leader <> high").drop("high"), "crowded")
    members = scratch.write(places.join(crowded.select("bucket", "leader").hint("merge"), "bucket"), "members")
    wanted = members.select("rep").distinct().join(own.hint("merge"), F.col("rep") == F.col("doc_id"))
    reps = scratch.write(wanted.select("rep", "high", "low", "copies"), "reps")

    def sets_of(some: DataFrame) -> DataFrame:
        found = texts.join(some.select("rep").hint("merge"), F.col("doc_id") == F.col("rep"), "left_semi")
        return found.mapInArrow(lambda batches: _sets(batches, words), "rep long, high long, low long, keys binary")

    # Of several rows of a doc_id, only one with its own set.
    many = reps.filter("copies > 1")
    of_many = sets_of(many).join(many.hint("merge"), ["rep", "high", "low"], "left_semi").groupBy("rep").agg(F.min("keys").alias("keys"))
    sets = scratch.write(sets_of(reps.filter("copies = 1")).select("rep", "keys").unionByName(of_many), "sets")
    parts = shuffle_parts(docs)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = scratch.write(pairs.distinct(), f"pairs_{turn}")
        if turn:
            scratch.drop(f"pairs_{turn - 1}")
        left = sets.select(F.col("rep").alias("a"), F.col("keys").alias("keys_a"))
        right = sets.select(F.col("rep").alias("b"), F.col("keys").alias("keys_b"))
        full = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "keys_a", "keys_b")
        return full.mapInArrow(lambda batches: fold(_verify(batches, similarity)), LINK)

    lowest = lowest_share(similarity, bands * rows)
    order = ["bucket", "low", "high"]

    def in_cells(placed: DataFrame, split: DataFrame) -> DataFrame:
        """Links of different components; a large bucket is shared out by pairs of blocks.

        Signatures go first: only members with a likely partner bring their sets.
        """
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        cells = (
            placed.join(split.select("bucket", blocks.alias("blocks")).hint("merge"), "bucket")
            .withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", "band", "rep", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        )
        marked = classes.select("rep", "bands", "slots")
        flagged = cells.join(marked.hint("merge"), "rep").repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(
            lambda batches: _flag(batches, lowest), PLACES
        )
        flagged = scratch.write(flagged, "flagged")
        wanted = scratch.write(
            sets.join(marked.hint("merge"), "rep").join(flagged.select("rep").distinct().hint("merge"), "rep", "left_semi"), "wanted"
        )
        return flagged.join(wanted.hint("merge"), "rep").repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(
            lambda batches: fold(_cells(batches, lowest, similarity)), LINK
        )

    stars = None
    for turn in range(STAR_ROUNDS + 1):
        # The component of each member so far; a bucket in a single component has nothing left to compare.
        # Before the cells it is the whole one; until then a piece only costs comparisons.
        if stars is None:
            placed, split = members.withColumn("component", F.col("rep")), crowded
            led = members.filter("rep <> leader")
        else:
            stars = settle(stars, scratch) if turn == STAR_ROUNDS else stars
            found = centres(stars).withColumnRenamed("id", "rep")
            placed = members.drop("leader").join(found.hint("merge"), "rep", "left")
            placed = scratch.write(placed.withColumn("component", F.coalesce("component", "rep")), f"placed_{turn}")
            lead = F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("draw"), "rep", "component")).alias("lead")
            split = scratch.write(
                placed.groupBy("bucket").agg(
                    F.min("component").alias("low"), F.max("component").alias("high"), lead, F.count(F.lit(1)).alias("n"),
                    F.sum("n_shingles").alias("shingles"),
                ).filter("low <> high").select("bucket", "n", "shingles", F.col("lead.rep").alias("leader"), F.col("lead.component").alias("of_leader")),
                f"split_{turn}",
            )
            led = placed.join(split.hint("merge"), "bucket").filter("component <> of_leader")
        if split.isEmpty():
            break
        if turn < STAR_ROUNDS:
            links = verified(led.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")))
        else:
            links = in_cells(placed, split)
        # The stars found so far stand for all earlier links.
        stars = connect(links if stars is None else links.unionByName(stars), scratch, f"links_{turn}")
        scratch.drop(*(["crowded"] if not turn else [f"placed_{turn}", f"split_{turn}"]))
    ends = classes.select("high", "low", "n_shingles", "rep")
    if stars is not None:
        found = centres(settle(stars, scratch)).withColumnRenamed("id", "rep")
        ends = ends.join(found.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        ends = ends.withColumn("component", F.col("rep"))
    ends = scratch.write(ends.select("high", "low", "n_shingles", "component"), "ends")
    linked = own.join(ends.hint("merge"), ["high", "low", "n_shingles"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return linked.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component; a row without doc_id stays."""
    gone = near_duplicates(docs, **options).filter("NOT kept")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
