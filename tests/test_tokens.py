"""Model-token chunks: slices of the text, within the budget, whatever the text."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lanternqa.functions import tokens as tk
from lanternqa.operators import chunks as ch
from lanternqa.plans import gather

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def words():
    return tk.Tokenizer(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=words.encoding._mergeable_ranks, special_tokens={})


def random_text(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return "".join(rng.choice("abcdefgh  \n\t'sre19_-é🙂") for _ in range(rng.randrange(200)))
    if kind == 1:
        return "".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(60)))
    return rng.choice(["z", " ", "etaoin", "é", "🙂", "\n", "-"]) * rng.randrange(600)


def test_chunks_join_to_the_text_and_keep_the_budget(words, library):
    rng = random.Random(1)
    for _ in range(1500):
        text, budget = random_text(rng), rng.randrange(1, 40)
        chunks = words.chunks(text, budget)
        assert "".join(c for _, c in chunks) == text
        for n, chunk in chunks:
            assert chunk and n == len(library.encode_ordinary(chunk)) and (n <= budget or len(chunk) == 1)
        assert words.count(text) == len(library.encode_ordinary(text))


def test_chunks_are_well_filled(words):
    text = "Some words, of different lengths; 12 numbers and\nlines. " * 400
    chunks = words.chunks(text, 100)
    assert len(chunks) <= -(-words.count(text) // 95)


def test_long_runs(words):
    for text in (" " * 1_000_000, "z" * 200_000, "\n" * 300_000 + "x"):
        chunks = words.chunks(text, 512)
        assert "".join(c for _, c in chunks) == text and max(n for n, _ in chunks) <= 512


def test_columns(spark, library):
    rows = [(1, "one two  three\n\nfour five", 3), (2, "", 3), (3, None, 3), (4, "x" * 50_000, None), (5, "é" * 9, 0)]
    df = spark.createDataFrame(rows, "i int, x string, n int")
    got = ch.model_token_chunks(df, "x", F.col("n"), PATH, PATTERN, keep=["i"]).orderBy("i", "chunk_no").collect()
    assert [(r.chunk_no, r.n_tokens, r.chunk) for r in got if r.i == 1] == [
        (k, len(library.encode_ordinary(c)), c) for k, c in enumerate(r.chunk for r in got if r.i == 1)
    ]
    assert "".join(r.chunk for r in got if r.i == 1) == rows[0][1] and all(r.n_tokens <= 3 for r in got if r.i == 1)
    assert {r.i for r in got} == {1, 5}
    counts = {r.i: r.n for r in df.select("i", tk.count_tokens(F.col("x"), PATH, PATTERN).alias("n")).collect()}
    assert counts == {r[0]: None if r[1] is None else len(library.encode_ordinary(r[1])) for r in rows}
    room = df.select(tk.token_budget(10, F.col("x"), PATH, PATTERN, 1).alias("n")).collect()
    assert [r.n for r in room][:2] == [max(1, 9 - counts[1]), 9]


def test_prompts_of_a_flow_keep_the_limit_in_tokens(spark, library):
    text = " ".join(f"word{i} und é{i}" for i in range(400))
    evidence = spark.createDataFrame([(1, "find word7", text), (2, "none", "")], "k int, question string, text string")
    limit = 200

    def reader():
        def complete(prompt):
            assert len(encode(prompt)) <= limit
            return '{"relevant_information": "' + str(len(encode(prompt)) > limit // 2) + '"}'

        path, pattern = PATH, PATTERN
        own = tk.Tokenizer(path, pattern).encoding._mergeable_ranks
        encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=own, special_tokens={}).encode_ordinary
        return complete

    told = gather.relevant_information(evidence, ["k"], reader, limit, vocabulary=(PATH, PATTERN)).collect()
    assert [(r.k, "True" in r.information) for r in told] == [(1, True)]


def test_tasks_hold_a_stretch_of_texts(spark, words, monkeypatch):
    """A batch of any number of texts is worked on a stretch at a time; nulls, blanks and long texts stay in place."""
    import pyarrow as pa

    texts = ["word " * (i % 9) if i % 5 else None for i in range(300)] + ["", "long " * 400]
    column = pa.array(texts, pa.string())
    monkeypatch.setattr(tk, "STRETCH_BYTES", 200)
    held = [column[s].to_pylist() for s in tk.stretches(column)]
    assert sum(held, []) == texts and list(tk.stretches(column[:0])) == []
    assert len(held) > 20 and all(len(x) == 1 or sum(len(t or "") + 1 for t in x[:-1]) <= 200 for x in held)
    df = spark.createDataFrame([(i, t, 3 + i % 4) for i, t in enumerate(texts)], "i int, x string, n int").coalesce(1)
    asked = df.select("i", tk.token_cuts(F.col("x"), F.col("n"), PATH, PATTERN).alias("c"), tk.count_tokens(F.col("x"), PATH, PATTERN).alias("k"))
    for r in asked.collect():
        t = texts[r.i]
        want = None if t is None else words.chunks(t, 3 + r.i % 4)
        assert (None if r.c is None else [tuple(x) for x in r.c]) == want and r.k == (None if t is None else words.count(t))
