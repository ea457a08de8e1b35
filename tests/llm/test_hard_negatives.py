"""Hard negatives against brute force; Strassen products and heaps against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternqa.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (8, 8, 8), (17, 33, 9), (40, 64, 130), (5, 0, 4)])
def test_strassen_equals_the_plain_product(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for bound in (300, 1 << 24, 1 << 29):
        a, b = rng.integers(-bound, bound, (m, k)), rng.integers(-bound, bound, (k, n))
        want = (a.astype(object) @ b.astype(object)).astype(np.int64) if k else np.zeros((m, n), np.int64)
        for leaf in (1, 2, 4, 32):
            got = hn.strassen(a, b, leaf)
            assert got.dtype == np.int64 and got.shape == (m, n) and (got == want).all()


def test_strassen_multiplies_seven_times(monkeypatch):
    calls = []
    real = hn.leaf_product
    monkeypatch.setattr(hn, "leaf_product", lambda a, b: calls.append(a.shape) or real(a, b))
    hn.strassen(np.ones((64, 64), np.int64), np.ones((64, 128), np.int64), 16)
    assert len(calls) == 49


def test_heaps_merge_like_sorting():
    rng = np.random.default_rng(2)
    heaps, seen = hn.Heaps(6, 4), [[] for _ in range(6)]
    for turn in range(30):
        ids = np.sort(rng.choice(10_000, 9, replace=False)) * 31 + turn
        scores = rng.integers(-3, 4, (6, 9))
        scores[rng.random(scores.shape) < 0.3] = hn.NOTHING
        heaps.merge(scores, ids)
        for r in range(6):
            seen[r] += [(-int(s), int(i)) for s, i in zip(scores[r], ids) if s != hn.NOTHING]
    for r in range(6):
        assert list(zip((-heaps.scores[r]).tolist(), heaps.ids[r].tolist())) == sorted(seen[r])[:4]


def brute(rows, anchor, positives=5, negatives=10, window=(30, 90, 100)):
    one = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and None not in x:
            one[i] = min(one.get(i, (str(label), x)), (str(label), x))
    out = set()
    for a, (label, x) in one.items():
        if not anchor(a):
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in one.items() if i != a and len(y) == len(x)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == label][:positives]:
            inside = [
                i for i in order if one[i][0] != label
                and window[0] * score[p] <= window[2] * score[i] <= window[1] * score[p]
            ]
            out |= {(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(inside[:negatives], 1)}
    return out


def table(spark, rows):
    full = [(i, label, x, 1, "t", 3, "w") for i, label, x in rows]
    return spark.createDataFrame(full, "id long, label int, vector array<long>, tile int, n string, dims int, wanted string")


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.randrange(-9, 10) for _ in range(6)]) for i in range(150)]
    rows += [(i, 3, [rng.randrange(-9, 10) for _ in range(4)]) for i in range(150, 170)]  # another length
    rows += [(200 + i, rng.choice([0, 1]), list(rows[i][2])) for i in range(20)]  # ties
    rows += [(7, 1, rows[7][2]), rows[10], rows[10], (300, 0, []), (310, 1, []), (320, 0, [])]
    rows += [(None, 0, [1] * 6), (400, None, [1] * 6), (410, 0, None), (420, 0, [1, None, 1, 1, 1, 1]), (430, 0, [0] * 6)]
    monkeypatch.setattr(hn, "TILE_ROWS", 7)
    monkeypatch.setattr(hn, "CELL_TILES", 2)
    docs = table(spark, rows).repartition(4)
    for options in ({}, {"positives": 2, "negatives": 3, "window": (-50, 100, 100)}):
        got = [tuple(r) for r in hn.hard_negatives(docs, F.col("id") % 10 == 0, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 10 == 0, **options)
    assert hn.hard_negatives(docs, F.col("id") < 0).count() == 0
    assert hn.hard_negatives(docs.filter("id > 1000"), F.col("id") % 10 == 0).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    docs = table(spark, [(0, 0, [1 << 40] * 3), (1, 0, [1 << 40] * 3)])
    with pytest.raises(Exception, match="may not fit 64 bits"):
        hn.hard_negatives(docs, F.col("id") == 0).collect()
