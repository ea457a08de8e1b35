"""The prefix trie against brute force, with stretches of a few paths so that edges meet over several rounds."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lanternqa.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, parent string, sizes int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows, head=None, every=100):
    """Rows as tuples in the order of COLUMNS, from (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: [(r[2], r[4]) for r in sorted(turns)] for c, turns in own.items()}
    if head:
        rebuilt = {c: tuple(own.get(c - c % every, [])[: head(c)] + turns[head(c) :]) for c, turns in own.items()}
    else:
        rebuilt = {c: tuple(turns) for c, turns in own.items()}
    members, ends = {}, {}
    for conv, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
        ends.setdefault(path, []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[k] for k in children.get(node, [])]
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
            sum(k[5] for k in below) or 1, own_saved + sum(k[6] for k in below),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 2) for r in rows], SCHEMA).repartition(3)


def nodes(paths):
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.prefix_trie(paths).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for conv in range(160):
        deep = 40 if conv % 50 == 3 else rng.randrange(1, 7)
        for turn in range(deep):
            out.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a", "bb", "é🙂", "c" * 9]) if turn < 3 or conv % 5 else "same"))
    out += [(500 + i, t, "user", f"copy {t}") for i in range(60) for t in range(4)]  # a group of copies
    out += [(600 + i, t, "user", "hot" if t < 2 else f"{i} {t}") for i in range(70) for t in range(3)]  # a hot beginning
    out += [(900, None, None, None), (900, 3, "user", "x"), (901, 1, "", ""), (902, 2, "a", "b"), (902, 2, "a", "a")]
    out += [(903, 1, "u", "x"), (903, 1, "u", "x"), (None, 1, "u", "x"), (-7, 0, "user", "neg"), (904, 0, "1:", ""), (905, 0, "1", ":")]
    out += [(1000 + 30 * i, t, "u", f"deep {t if t < 150 else i}") for i in range(3) for t in range(200)]
    return out


@pytest.mark.parametrize("stretch", [24, 4096])
def test_trie_against_brute_force(spark, rows, monkeypatch, stretch):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    monkeypatch.setattr(pt, "FEW", 4)
    monkeypatch.setattr(pt, "SECTION", 7)
    turns = pt.conversation_turns(frame(spark, rows))
    assert nodes(pt.conversation_paths(turns)) == brute(rows)


def test_heads_of_a_base_conversation(spark, rows):
    def head(c):
        return zlib.crc32(str(c).encode()) % 6

    conv = F.col("conv_id")
    turns = pt.conversation_turns(frame(spark, rows))
    rebuilt = pt.with_heads(turns, conv - (conv - F.floor(conv / 100) * 100), (F.crc32(conv.cast("string")) % 6).cast("int"), 5)
    assert nodes(pt.conversation_paths(rebuilt)) == brute(rows, head)


def test_peeling_in_rounds_equals_one_round():
    """Pure peeling: stretches of any size give the nodes that a single one gives."""
    rng = random.Random(4)
    paths = sorted({b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(12))) for _ in range(300)})
    ended = [(p, [i % 5 + 1 for i in range(len(p) // 16)], (rng.randrange(1, 4), n, 0, 0, 0), f"e{n}") for n, p in enumerate(paths)]

    def named(nodes):
        key = {n[0]: n[2] for n in nodes if n[0]}
        return sorted((n[2], n[3], n[4] if n[1] is None else key[n[1]], *n[5:]) for n in nodes)

    def run(size):
        found, todo = [], [(p, s, [(len(s), st, e)]) for p, s, st, e in ended]
        while todo:
            whole = len(todo) <= size
            left = []
            for at in range(0, len(todo), size):
                stretch = pt.Stretch()
                for path, sizes, known in todo[at : at + size]:
                    stretch.add(path, sizes, known)
                nodes, edges = pt.peel(stretch, whole, True)
                found += nodes
                for path, sizes, stats, ends in edges:
                    rows = [tuple(stats[5 * d : 5 * d + 5]) for d in range(len(ends))]
                    left.append((path, sizes, list(zip(range(len(ends)), rows, ends))))
            todo = sorted(left)
        return named([tuple(-1 if x is None and i == 4 else x for i, x in enumerate(n)) for n in found])

    want = run(10_000)
    assert len(want) == len({p[: 16 * d] for p in paths for d in range(len(p) // 16 + 1)})
    for size in (3, 5, 17, 100):
        assert run(size) == want


def test_long_texts_and_empty_tables(spark):
    rows = [(i, t, "u", "long " * 100_000 if t == 0 else None) for i in range(3) for t in range(2)]
    assert nodes(pt.conversation_paths(pt.conversation_turns(frame(spark, rows)))) == brute(rows)
    assert nodes(pt.conversation_paths(pt.conversation_turns(frame(spark, []).coalesce(1)))) == []
    lone = [(5, 0, "u", "x")]
    turns = pt.conversation_turns(frame(spark, lone))
    rebuilt = pt.with_heads(turns, F.lit(0).cast("long"), F.lit(5), 5)
    assert nodes(pt.conversation_paths(rebuilt)) == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
