"""What a step costs grows in step with its input, from the smallest input on."""

import random

import brute
import pytest
from test_operators import by_id, frame, prose

from lanternqa.llm import components as stars
from lanternqa.llm import near_dups
from lanternqa.llm.components import components
from lanternqa.llm.near_dups import near_duplicates
from lanternqa.llm.scratch import Scratch


def test_joins_of_growing_tables_are_shuffled_at_every_size(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(30)]
    rows = [(i, t, None) for i, t in enumerate(texts + [t + " tail" for t in texts])]
    plans, real = {}, Scratch.write

    def watch(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(Scratch, "write", watch)
    for rounds in (2, 0):
        monkeypatch.setattr(near_dups, "STAR_ROUNDS", rounds)
        found = near_duplicates(frame(spark, rows))
        plans["result"] = found._jdf.queryExecution().executedPlan().toString()
        assert by_id(found, "component_id") == {i: (i % 30,) for i in range(60)}
    growing = {"members", "reps", "sets", "flagged", "wanted", "links_0", "placed_1", "ends", "result"}
    assert growing <= set(plans)
    assert [n for n in sorted(growing) if "Broadcast" in plans[n] or "SortMergeJoin" not in plans[n]] == []


@pytest.fixture
def apart(spark):
    """Small shuffles stay in many partitions, as large ones do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_few_tables_are_written_whatever_the_partitions(spark, monkeypatch, apart):
    """Each table costs a task for every partition, so a round of components writes two, and a set has one table."""
    rng = random.Random(11)
    written, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (written.append(name), real(self, df, name))[1])
    links = [(i, i + 1) for i in range(200)]
    rng.shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(9), Scratch(spark)).collect())
    assert got == {i: 0 for i in range(1, 201)}
    rounds = sum(name.startswith("low_") for name in written)
    assert 1 <= rounds <= 8 and len(written) == 1 + 2 * rounds
    written.clear()
    texts = [prose(rng, 60) for _ in range(10)]
    rows = [(i, t, None) for i, t in enumerate(texts + [t + " tail" for t in texts])]
    assert by_id(near_duplicates(frame(spark, rows)), "component_id") == {i: (i % 10,) for i in range(20)}
    assert len(written) <= 11


@pytest.mark.parametrize("nodes", [1, 40])
def test_long_tasks_hand_stars_on(monkeypatch, nodes):
    """However few ids a task may hold, components end up whole."""
    import pyarrow as pa

    rng = random.Random(13)
    links = {(i, i + rng.randrange(1, 5)) for i in range(300)} | {(900, i) for i in range(500, 700)}
    monkeypatch.setattr(stars, "NODES", nodes)
    rows = sorted((max(x), min(x)) for x in links)
    turn = 0
    while True:  # sorted by the larger id in one task, as after an exchange
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])
        out = sorted((a, b) for x in stars.fold([batch]) for a, b in zip(*(c.to_pylist() for c in x.columns)))
        assert brute.roots({x for r in rows for x in r}, out) == brute.roots({x for r in rows for x in r}, rows)
        low = {}
        for a, b in out:
            low[a] = min(b, low.get(a, b))
        new = sorted({(a, low.get(b, b)) for a, b in out})
        if new == rows:
            break
        rows, turn = new, turn + 1
        assert turn < 100
    ids = {x for pair in links for x in pair}
    assert dict(rows) == {x: c for x, c in brute.roots(ids, links).items() if x != c} and len(dict(rows)) == len(rows)


def test_chains_are_whole_after_any_number_of_rounds(spark, monkeypatch, apart):
    """Links run from text to text; components that a first fold leaves in pieces are joined."""
    rng = random.Random(12)
    texts = {}
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(120)]
        for i in range(25):
            words = words[4:] + [f"c{chain}n{i}x{k}" for k in range(4)]
            texts[len(texts)] = " ".join(words)
    ids = rng.sample(range(1000), len(texts))
    texts = {ids[i]: t for i, t in texts.items()}
    want = brute.near_copies(texts)
    assert len({c for _, c in want.values()}) == 4
    df = frame(spark, [(i, t, None) for i, t in texts.items()])
    for rounds in (0, 1, 2):
        monkeypatch.setattr(near_dups, "STAR_ROUNDS", rounds)
        assert by_id(near_duplicates(df), "n_shingles", "component_id") == want
