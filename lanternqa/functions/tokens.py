"""Model tokens: counts, and cuts of a text that hold at most so many of them.

A text is split by the vocabulary's own pattern, and each part's number of
tokens is taken once. A part encodes alike wherever it stands, so a run of
parts has the sum of their tokens and is an exact slice of the text. Only a part
that alone exceeds a budget is cut inside, between two characters, and each
of its slices is encoded anew to keep the budget.

Tasks work on stretches of about a megabyte of text and hand each on, so what a
task holds does not depend on how many texts came in one batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = pa.struct([("n_tokens", pa.int32()), ("chunk", pa.string())])
CUTS = T.ArrayType(T.StructType().add("n_tokens", T.IntegerType()).add("chunk", T.StringType()))
KNOWN = 1 << 17
STRETCH_BYTES = 1 << 20
PARTS = 1 << 17
# Longer parts are counted a stretch at a time while they are cut.
LONG_PART = 1 << 12


class Tokenizer:
    """Token counts by a byte-level vocabulary given as ranks, a file that every executor has."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        # Parts are already split; each goes in as a whole.
        self.encoding = tiktoken.Encoding("parts", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def size(self, part: str) -> int:
        """How many tokens one part has."""
        n = self.known.get(part)
        if n is None:
            n = len(self.encoding._encode_single_piece(part))
            if len(part) < 64:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[part] = n
        return n

    def parts(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, some at a time."""
        found = (m[0] for m in self.pattern.finditer(text))
        while some := list(islice(found, PARTS)):
            yield some

    def count(self, text: str) -> int:
        return sum(sum(map(self.size, some)) for some in self.parts(text))

    def slices(self, part: str, budget: int) -> Iterator[tuple[int, str]]:
        """A part beyond the budget, cut between characters: as long slices as doubling and halving find."""
        at = 0
        while at < len(part):
            width = max(1, min(budget, len(part) - at))
            while width > 1 and self.size(part[at : at + width]) > budget:
                width //= 2
            while at + width < len(part):
                more = min(2 * width, len(part) - at)
                if more > LONG_PART or self.size(part[at : at + more]) > budget:
                    break
                width = more
            piece = part[at : at + width]
            yield self.size(piece), piece
            at += width

    def chunks(self, text: str, budget: int) -> list[tuple[int, str]]:
        """Slices of at most `budget` tokens that make up the text; only a single character may need more."""
        out: list[tuple[int, str]] = []
        held: list[str] = []
        total = 0

        def close() -> None:
            nonlocal total
            if not held:
                return
            # Blanks before a word are two parts, but one where nothing follows them.
            k = len(held)
            while k and held[k - 1].isspace():
                k -= 1
            blanks = "".join(held[k:])
            if len(held) - k > 1:
                total += self.size(blanks) - sum(map(self.size, held[k:]))
            if total <= budget:
                out.append((total, "".join(held)))
            else:
                if k:
                    out.append((total - self.size(blanks), "".join(held[:k])))
                out.extend(self.slices(blanks, budget))
            held.clear()
            total = 0

        for some in self.parts(text):
            sizes = np.fromiter(map(self.size, some), np.int64, len(some))
            ends, at = np.cumsum(sizes), 0
            while at < len(some):
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + budget - total, "right"))
                if to > at:
                    held += some[at:to]
                    total += int(ends[to - 1]) - before
                    at = to
                    continue
                close()
                if sizes[at] > budget:
                    out += self.slices(some[at], budget)
                    at += 1
        close()
        return out


def stretches(texts: pa.Array) -> Iterator[slice]:
    """Consecutive parts of an array of texts that hold about `STRETCH_BYTES` each, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes.astype(np.int64) + 1), 0
    while at < len(total):
        before = total[at - 1] if at else 0
        to = min(int(np.searchsorted(total, before + STRETCH_BYTES)) + 1, len(total))
        yield slice(at, to)
        at = to


def token_cuts(text: Column, budget: int | Column, path: str, pattern: str) -> Column:
    """array<struct<n_tokens, chunk>>: slices of at most `budget` model tokens that join back to the text."""

    @F.arrow_udf(CUTS)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = Tokenizer(path, pattern)
        for texts, budgets in batches:
            for some in stretches(texts):
                out = [
                    None if x is None or n is None else [{"n_tokens": k, "chunk": c} for k, c in words.chunks(x, max(n, 1))]
                    for x, n in zip(texts[some].to_pylist(), budgets[some].to_pylist())
                ]
                yield pa.array(out, pa.list_(CUT))

    return cut(text, (budget if isinstance(budget, Column) else F.lit(budget)).cast("int"))


def count_tokens(text: Column, path: str, pattern: str) -> Column:
    """How many model tokens a text has."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Tokenizer(path, pattern)
        for texts in batches:
            for some in stretches(texts):
                yield pa.array([None if x is None else words.count(x) for x in texts[some].to_pylist()], pa.int64())

    return count(text)


def token_budget(limit: int, prompt: Column, path: str, pattern: str, reserve: int = 0) -> Column:
    """Chunk size left beside a prompt, both in model tokens."""
    return F.greatest(F.lit(limit) - count_tokens(prompt, path, pattern) - F.lit(reserve), F.lit(1))
