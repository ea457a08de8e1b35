"""Byte-pair encoding against the tiktoken library, and back."""

import hashlib
import random
import struct

import numpy as np
import pytest

from lanternqa.llm.byte_pairs import CUTS, LONGEST, Encoder, decode, encode, encoding_report
from lanternqa.llm.packing import vocabulary as tiktoken_vocabulary
from lanternqa.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, ids string, data int, n_tokens string"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*vocabulary())


@pytest.fixture(scope="module")
def library():
    return tiktoken_vocabulary(*vocabulary())


def random_text(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(60)))
    if kind == 1:
        return "".join(rng.choice("abcdefgh  \n\t'sre19_-\x1c\x85　​") for _ in range(rng.randrange(300)))
    if kind == 2:
        return "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4 * LONGEST)))
    return rng.choice(["ab", "z", " ", "\n", "-=", "0", "\r\n"]) * rng.randrange(800) + "x" * rng.randrange(2)


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(600)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert encoder.words.decode(ids.tolist()) == text.encode()


def test_every_code_point(encoder, library):
    blocks = ["a".join(chr(c) for c in range(low, low + 0x800)) for low in range(0, 0x110000, 0x800) if low != 0xD800]
    assert [x.tolist() for x in encoder.encode(blocks)] == [library.encode_ordinary(x) for x in blocks]


def test_rounds_and_heap_agree(encoder):
    rng = random.Random(5)
    for _ in range(60):
        cut = bytes(rng.choice(b"abcdeost") for _ in range(rng.randrange(2, LONGEST + 1)))
        assert encoder.words._rounds([cut], LONGEST)[0].tolist() == encoder.words._heap(cut).tolist()


def test_a_vocabulary_whose_merges_open_lower_ranks(tmp_path):
    """A token may be made of parts of higher rank; the leftmost pair of least rank still goes first."""
    import base64

    import tiktoken

    rng = random.Random(8)
    for trial in range(20):
        tokens = [bytes([b]) for b in range(256)]
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        tokens += rng.sample(sorted(extra), len(extra))
        path = tmp_path / f"ranks{trial}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
        own = Encoder(str(path), r"\S+|\s+")
        other = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice([3, 9, 30, 90]))) for _ in range(60)]
        assert [x.tolist() for x in own.encode(texts)] == [other.encode_ordinary(x) for x in texts]


def test_very_long_texts(encoder):
    """Longer than the library can take; ids of a repeated part are those of the part."""
    part = "One two, 33 four.\n" * 10
    want = encoder.encode([part])[0].tolist()
    many = CUTS // 8
    got = encoder.encode([part * many, " " * 2_000_000, "z" * 500_000])
    assert got[0].tolist() == want * many
    for ids, text in zip(got[1:], (b" " * 2_000_000, b"z" * 500_000)):
        assert encoder.words.decode(ids.tolist()) == text
    mixed = "\t \n" * 300_000 + "word"
    assert encoder.words.decode(encoder.encode([mixed])[0].tolist()) == mixed.encode()


def test_forgetting_changes_nothing(encoder, library, monkeypatch):
    from lanternqa.llm import byte_pairs

    monkeypatch.setattr(byte_pairs, "KNOWN", 5)
    rng = random.Random(9)
    small = Encoder(*vocabulary())
    for _ in range(5):
        texts = [random_text(rng) for _ in range(20)]
        assert [x.tolist() for x in small.encode(texts)] == [library.encode_ordinary(x) for x in texts]


def test_report_and_round_trip(spark, library):
    texts = {0: None, 1: "", 2: " \n", 3: "Hello  world's 123 é🙂", 4: "z" * 5000, 5: "<|endoftext|>", 6: "x " * 3000}
    rows = [(i, t, "x", 1, "y") for i, t in texts.items()] + [(None, "no id", "x", 1, "y"), (3, texts[3], "x", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path, pattern = vocabulary()
    want = set()
    for i, text in [*texts.items(), (None, "no id")]:
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.add((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in encoding_report(docs, path, pattern).collect()]
    assert len(got) == len(rows) and set(got) == want
    encoded = encode(docs, path, pattern)
    assert {r.doc_id: r.ids for r in encoded.collect()}[3] == library.encode_ordinary(texts[3])
    back = [(r.doc_id, bytes(r.data).decode()) for r in decode(encoded, path).collect()]
    assert sorted(back, key=str) == sorted([(r[0], r[1] or "") for r in rows], key=str)
    assert decode(spark.sql("SELECT 1L AS doc_id, cast(null AS array<int>) AS ids"), path).first().data is None
    empty = docs.filter("doc_id > 100")
    assert encoding_report(empty, path, pattern).count() == 0 and decode(encode(empty, path, pattern), path).count() == 0


def test_pair_table_holds_all_pairs():
    from lanternqa.llm.byte_pairs import NONE, PairTable

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    left, right = keys >> 20, keys & 0xFFFFF
    table = PairTable(left, right, np.arange(len(keys), dtype=np.int32))
    assert (table[left, right] == np.arange(len(keys))).all()
    assert (table[left + (1 << 21), right] == NONE).all()
