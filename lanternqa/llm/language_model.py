"""Scores of texts under a word-pair model kept as Elias-Fano tries.

The training texts' words are counted in parts of the key space, which numbers
the vocabulary in the order of keys. Word pairs are counted in shards by their
context; a context with very many uses is spread over several shards. Each shard
puts its pairs into a trie of compact, memory-mapped levels with quantised
smoothed probabilities, and answers the pairs that the texts ask for, trained on
or not. Nothing is gathered whole: texts travel as compressed blocks, what a
block asks and gets is proportional to it, and equal pairs of a block fold
before the shuffle.

The probability of a word after a context seen c times, n of them before this
word, is (n + m p) / (c + m), with p the word's own smoothed share and m the
prior. n / (c + m) is what the tries hold, in steps of `STEP` of its log10.

Defined results: A-Z are lower-cased; a null or empty text is its end token
alone. A row without doc_id is scored but neither trained on nor held out.
Repeated rows count and are scored as often as they occur. Other columns do not
matter. With no training text every share is that of an unseen word. A
vocabulary of 2^32 words or more is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.elias_fano import PairTrie
from lanternqa.llm.scratch import Scratch, shuffle_parts

PRIOR = 4.0
STEP = 1 / 4000
LOWEST = -16.0
BLOCKS = "block long, n_train long, ids array<long>, train array<boolean>, lengths array<int>, body binary"
COUNTS = "part int, block long, keys binary, counts binary"
PAIRS = "part int, block long, pairs binary, counts binary, hot binary"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their ids, compressed together."""
    from pyspark import TaskContext

    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 33
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch, texts in W.chunks(batches):
        texts = [x or b"" for x in texts]
        train = [bool(x) for x in batch.column("train").to_pylist()]
        columns = [
            pa.array([block], pa.int64()), pa.array([sum(train)], pa.int64()),
            pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
            pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([squeeze.compress(b"".join(texts))], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])
        block += 1


class Block:
    """A block's words by their place among its distinct keys."""

    def __init__(self, row: dict) -> None:
        body = zstandard.ZstdDecompressor().decompress(row["body"])
        to = np.cumsum(row["lengths"]).tolist()
        self.ids, self.train = row["ids"], np.array(row["train"], bool)
        cut = W.cut([body[b - n : b] for b, n in zip(to, row["lengths"])], W.spaced(), fold=True)
        self.first, self.counts = cut.first, cut.counts()
        keys = W.word_keys(cut)
        self.distinct, self.word = _distinct(keys)
        self.in_training = np.repeat(self.train, self.counts)

    def sequences(self, ids: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts end to end: each token's id, its context's id, and whether it trains.

        Every text has its words, then `edge` as its end token; `edge` is also the context of its first token.
        """
        last = np.cumsum(self.counts + 1) - 1
        token = np.full(len(self.word) + len(self.counts), edge, np.int64)
        inner = np.ones(len(token), bool)
        inner[last] = False
        token[inner] = ids[self.word]
        context = np.concatenate(([edge], token[:-1]))
        return token, context, np.repeat(self.train, self.counts + 1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


def _slices(parts: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """The non-empty ranges of sorted part numbers."""
    bounds = np.searchsorted(parts, np.arange(n + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, int(bounds[p]), int(bounds[p + 1])


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_counts(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words with their number in training texts, by part of the key space."""
    for row in _rows_of(batches):
        block = Block(row)
        counts = np.bincount(block.word[block.in_training], minlength=len(block.distinct)).astype(np.uint32)
        part = ((block.distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        rows = [(p, row["block"], block.distinct[a:b].tobytes(), counts[a:b].tobytes()) for p, a, b in _slices(part, parts)]
        yield _table(rows, COUNTS)


WORDS = "part int, block long, ranks binary, totals binary, vocabulary long, tokens long"


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum a part's counts; each block gets its words' totals and ranks in the part's vocabulary (-1: not trained)."""
    blobs = [(r["part"], r["block"], r["keys"], r["counts"]) for b in batches for r in b.to_pylist()]
    for part in sorted({x[0] for x in blobs}):
        own = [x for x in blobs if x[0] == part]
        keys = np.concatenate([np.frombuffer(x[2], np.uint64) for x in own])
        counts = np.concatenate([np.frombuffer(x[3], np.uint32) for x in own]).astype(np.int64)
        distinct, place = _distinct(keys)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)
        rank = np.where(total > 0, np.cumsum(total > 0) - 1, -1).astype(np.int32)
        at, rows = 0, []
        for _, block, blob, _ in own:
            here = place[at : at + len(blob) // 8]
            at += len(here)
            rows.append((part, block, rank[here].tobytes(), total[here].tobytes(), None, None))
        rows.append((part, None, None, None, int((total > 0).sum()), int(total.sum())))
        yield _table(rows, WORDS)


class Vocabulary:
    """Numbers of the training words: each part's first id, the tokens with end tokens, and the distinct ones."""

    def __init__(self, starts: np.ndarray, tokens: int, distinct: int, texts: int) -> None:
        self.starts, self.texts = starts, texts
        self.edge = distinct
        self.tokens, self.distinct = tokens + texts, distinct + (texts > 0)

    def share(self, totals: np.ndarray) -> np.ndarray:
        """The smoothed share of words by their number."""
        return (totals + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def of(self, answers: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not trained) and totals of a block's distinct words, from its parts' answers."""
        ids, totals = np.empty(n, np.int64), np.empty(n, np.int64)
        at = 0
        for x in sorted(answers, key=lambda x: x["part"]):
            rank = np.frombuffer(x["ranks"], np.int32).astype(np.int64)
            ids[at : at + len(rank)] = np.where(rank >= 0, rank + self.starts[x["part"]], -1)
            totals[at : at + len(rank)] = np.frombuffer(x["totals"], np.int64)
            at += len(rank)
        return ids, totals


def _asked(block: Block, vocabulary: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's tokens and contexts, and its distinct pairs of known words with each token's place there (-1: none)."""
    token, context, trains = block.sequences(ids, vocabulary.edge)
    known = (token >= 0) & (context >= 0)
    pairs, place = _distinct((context[known].astype(np.uint64) << np.uint64(32)) | token[known].astype(np.uint64))
    where = np.full(len(token), -1, np.int64)
    where[known] = place
    return token, context, pairs, where


def _shard(pairs: np.ndarray, uses: np.ndarray, limit: int, parts: int) -> np.ndarray:
    """The shard of each pair: by context, and for contexts with over `limit` uses also by the word."""
    context, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    pieces = (uses // limit + 1).astype(np.uint64)
    return (W.mixed(context * np.uint64(W.WINDOW_BASE) + W.mixed(word) % pieces) % np.uint64(parts)).astype(np.int64)


def _uses(pairs: np.ndarray, totals_by_id: tuple[np.ndarray, np.ndarray], vocabulary: Vocabulary) -> np.ndarray:
    """How often each pair's context occurs as a context in training texts."""
    ids, totals = totals_by_id
    context = (pairs >> np.uint64(32)).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, context), max(0, len(ids) - 1))
    return np.where(context == vocabulary.edge, vocabulary.texts, totals[at] if len(ids) else 0)


def _known(ids: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of known words, which ascend as their keys do, and their totals."""
    return ids[ids >= 0], totals[ids >= 0]


def _pair_counts(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary, limit: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct pairs with their number in training texts, by shard."""
    for row in _rows_of(batches):
        block = Block(row)
        ids, totals = vocabulary.of(row["words"] or [], len(block.distinct))
        _, _, pairs, where = _asked(block, vocabulary, ids)
        trains = np.repeat(block.train, block.counts + 1) & (where >= 0)
        counts = np.bincount(where[trains], minlength=len(pairs)).astype(np.uint32)
        uses = _uses(pairs, _known(ids, totals), vocabulary)
        shard = _shard(pairs, uses, limit, parts)
        order = np.argsort(shard, kind="stable")
        rows = []
        for p, a, b in _slices(shard[order], parts):
            own = order[a:b]
            # A context in several shards needs its uses told; elsewhere they are the sum of its pairs.
            split = own[uses[own] >= limit]
            context, first = np.unique(pairs[split] >> np.uint64(32), return_index=True)
            hot = np.stack([context.astype(np.int64), uses[split][first]]) if len(split) else np.empty((2, 0), np.int64)
            rows.append((p, row["block"], pairs[own].tobytes(), counts[own].tobytes(), hot.tobytes()))
        yield _table(rows, PAIRS)


CODES = "part int, block long, codes binary"


def quantised(share: np.ndarray) -> np.ndarray:
    """Codes from 1 of positive shares: steps of their log10 above the lowest."""
    return (np.round((np.log10(share) - LOWEST) / STEP) + 1).astype(np.uint16)


def shares(codes: np.ndarray) -> np.ndarray:
    """The share of each code; 0 for code 0."""
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) * STEP + LOWEST), 0.0)


def _answer_pairs(batches: Iterable[pa.RecordBatch], prior: float) -> Iterator[pa.RecordBatch]:
    """Build a shard's trie of trained pairs and look up all pairs that blocks ask for."""
    blobs = [(r["part"], r["block"], r["pairs"], r["counts"], r["hot"]) for b in batches for r in b.to_pylist()]
    for part in sorted({x[0] for x in blobs}):
        own = [x for x in blobs if x[0] == part]
        pairs = np.concatenate([np.frombuffer(x[2], np.uint64) for x in own])
        counts = np.concatenate([np.frombuffer(x[3], np.uint32) for x in own]).astype(np.int64)
        distinct, place = _distinct(pairs)
        del pairs
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)
        context, word = distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF)
        seen = np.flatnonzero(total > 0)
        of_seen, run = _distinct(context[seen])
        uses = np.bincount(run, total[seen], len(of_seen)).astype(np.int64)
        hot = np.concatenate([np.frombuffer(x[4], np.int64).reshape(2, -1) for x in own], axis=1)
        if hot.shape[1] and len(of_seen):
            at = np.minimum(np.searchsorted(of_seen, hot[0].astype(np.uint64)), len(of_seen) - 1)
            there = of_seen[at] == hot[0].astype(np.uint64)
            uses[at[there]] = hot[1][there]
        trie = PairTrie(context[seen], word[seen], quantised(total[seen] / (uses[run] + prior)))
        codes = trie.find(context, word)
        trie.close()
        at, rows = 0, []
        for _, block, blob, _, _ in own:
            here = place[at : at + len(blob) // 8]
            at += len(here)
            rows.append((part, block, codes[here].tobytes()))
        yield _table(rows, CODES)


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(
    batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary, limit: int, parts: int, prior: float
) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        block = Block(row)
        ids, totals = vocabulary.of(row["words"] or [], len(block.distinct))
        token, context, pairs, where = _asked(block, vocabulary, ids)
        uses = _uses(pairs, _known(ids, totals), vocabulary)
        order = np.argsort(_shard(pairs, uses, limit, parts), kind="stable")
        codes = np.empty(len(pairs), np.uint16)
        answers = sorted(row["pairs"] or [], key=lambda x: x["part"])
        codes[order] = np.concatenate([np.frombuffer(x["codes"], np.uint16) for x in answers] or [np.empty(0, np.uint16)])
        # Numbers of all tokens, and of all contexts, with the edge's at the end of the block's own words.
        own = np.append(totals, vocabulary.texts)
        last = np.cumsum(block.counts + 1) - 1
        at = np.full(len(token), len(totals), np.int64)
        inner = np.ones(len(token), bool)
        inner[last] = False
        at[inner] = block.word
        count = own[at]
        before = own[np.concatenate(([len(totals)], at[:-1]))]
        share = vocabulary.share(count)
        found = np.where(where >= 0, np.append(shares(codes), 0.0)[where], 0.0)
        full = found + prior / (before + prior) * share
        first = last - block.counts
        columns = [
            pa.array(block.ids, pa.int64()), pa.array(block.counts + 1, pa.int64()),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), first), pa.int64()),
            pa.array(np.full(len(first), vocabulary.tokens), pa.int64()),
            pa.array(np.add.reduceat(np.log10(share), first)), pa.array(np.add.reduceat(np.log10(full), first)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])


def score_texts(docs: DataFrame, train: str, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all texts.

    `train` is a condition on `doc_id` that picks the texts to learn from.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("train", F.coalesce(F.expr(train), F.lit(False)))
    parts = shuffle_parts(docs)
    blocks = scratch.write(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    words = scratch.write(
        blocks.mapInArrow(lambda batches: _word_counts(batches, parts), COUNTS)
        .repartitionById(parts, F.col("part")).mapInArrow(_count_words, WORDS),
        "words",
    )
    # One row per part comes to the driver.
    sums = words.filter("block IS NULL").select("part", "vocabulary", "tokens").collect()
    texts = blocks.agg(F.sum("n_train")).first()[0] or 0
    sizes = np.zeros(parts, np.int64)
    for r in sums:
        sizes[r["part"]] = r["vocabulary"]
    if sizes.sum() >= (1 << 32) - 1:
        raise ValueError("the vocabulary has 2^32 words or more")
    vocabulary = Vocabulary(np.cumsum(sizes) - sizes, sum(r["tokens"] for r in sums), int(sizes.sum()), texts)
    limit = max(1000, vocabulary.tokens // (8 * parts))
    by_block = words.filter("block IS NOT NULL").groupBy("block").agg(
        F.collect_list(F.struct("part", "ranks", "totals")).alias("words")
    )
    # Blocks meet their words once; both tables go, and the pairs are read off without another shuffle of texts.
    known = scratch.write(blocks.join(by_block, "block", "left"), "known")
    scratch.drop("blocks", "words")
    asked = known.mapInArrow(lambda batches: _pair_counts(batches, vocabulary, limit, parts), PAIRS)
    codes = scratch.write(
        asked.repartitionById(parts, F.col("part")).mapInArrow(lambda batches: _answer_pairs(batches, prior), CODES), "codes"
    )
    pairs = codes.groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("pairs"))
    full = known.join(pairs, "block", "left")
    return full.mapInArrow(lambda batches: _score(batches, vocabulary, limit, parts, prior), SCORES)
