"""Word, window and code helpers against plain Python."""

import random
import re

import numpy as np
import pytest

from lanternqa.llm import words as W
from lanternqa.llm.elias_fano import EliasFano, PairTrie
from lanternqa.llm.near_dups import shingle_sets, super_minhash

TEXTS = ["", "a", " a  b\n", "é à\tB c d e\x0bf", "x" * 600_000 + " y", "the same the same the same", "\n\n", "a b c"]


def test_words_and_windows_have_equal_keys_iff_equal():
    cut = W.cut([t.encode() for t in TEXTS], W.spaced())
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in TEXTS]
    assert cut.counts().tolist() == [len(w) for w in want]
    flat = [w for own in want for w in own]
    keys = W.word_keys(cut)
    assert len(set(zip(flat, keys.tolist()))) == len(set(flat)) == len(set(keys.tolist()))
    for n in (1, 2, 3, 5, 13):
        at = W.window_starts(cut.first, n)
        rolled = W.window_keys(keys, n)[at] if len(at) else []
        runs = [tuple(own[i : i + n]) for own in want for i in range(len(own) - n + 1)]
        assert len(runs) == len(at)
        assert len(set(zip(runs, np.array(rolled).tolist()))) == len(set(runs))


def test_joined_words_are_the_kept_ones():
    cut = W.cut([t.encode() for t in TEXTS], W.spaced())
    keep = np.arange(len(cut.start)) % 3 != 1
    body, at = W.joined(cut, keep)
    flat = iter(keep.tolist())
    for text, a, b in zip(TEXTS, at[:-1], at[1:]):
        assert body[a : max(a, b - 1)].decode() == " ".join(w for w in re.findall(r"[^\x20\x09-\x0D]+", text) if next(flat))


@pytest.mark.parametrize("n,top", [(1, 0), (1, 9), (10, 10), (500, 60), (500, 10**9), (3000, 2**40)])
def test_elias_fano_reads_back_and_finds_successors(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
    code = EliasFano.of(values)
    assert (code.get(np.arange(n)) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 9, 300).astype(np.uint64)])
    at, equal = code.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_finds_all_pairs_and_no_others():
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(40), rng.randrange(30)) for _ in range(300)})
    context, word = (np.array(x, np.uint64) for x in zip(*pairs))
    trie = PairTrie(context, word, np.arange(1, len(pairs) + 1, dtype=np.uint16))
    known = {p: i + 1 for i, p in enumerate(pairs)}
    every = [(c, w) for c in range(42) for w in range(32)]
    a, b = (np.array(x, np.uint64) for x in zip(*every))
    assert trie.find(a, b).tolist() == [known.get(p, 0) for p in every]
    trie.close()
    assert PairTrie(context[:0], word[:0], np.empty(0, np.uint16)).find(a, b).tolist() == [0] * len(every)


def _plain_signature(keys, slots):
    """SuperMinHash one element at a time, without early stop."""
    best = np.full(slots, np.inf)
    for key in keys:
        order = list(range(slots))
        for rank in range(slots):
            step = np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            draw = int(W.mixed(np.array([key]) + step)[0])
            swap = rank + ((draw & 0xFFFFFFFF) * (slots - rank) >> 32)
            order[rank], order[swap] = order[swap], order[rank]
            best[order[rank]] = min(best[order[rank]], rank + (draw >> 32) / 2**32)
    return best


def test_signature_equals_the_plain_one_and_estimates_similarity():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 2, 7, 0, 120, 400)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    signed = super_minhash(np.concatenate(sets), first, 32)
    for own, got in zip(sets, signed):
        assert (got == _plain_signature(own, 32)).all()
    base = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    both = [base[:900], base[100:]]
    a, b = super_minhash(np.concatenate(both), np.array([0, 900, 1800]), 256)
    assert abs((a == b).mean() - 0.8) < 0.08


def test_shingle_sets_are_the_distinct_shingles():
    texts = ["a b a b a", "A b", "one", "", "a B a b a"]
    keys, first = shingle_sets([t.encode() for t in texts], 2)
    sets = [set(keys[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 2]
    assert sets[0] == sets[4] and sets[1] < sets[0] and not sets[2] & sets[0]
