"""Cases that once went wrong: repeated ids, crowds below the limit, colliding words, long blank runs, unlabelled tables."""

import random

import brute
import pytest
from pyspark.sql import functions as F
from test_operators import by_id, frame, prose

from lanternqa.llm import near_dups, packing
from lanternqa.llm import words as W
from lanternqa.llm.language import fit_languages, identify, keep_identified
from lanternqa.llm.lines import drop_lines, line_bitmaps
from lanternqa.llm.near_dups import agree, drop_near_duplicates, near_duplicates
from lanternqa.llm.queries import vocabulary
from lanternqa.llm.substrings import repeated_spans, span_report


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, None), (1, b, None), (2, a + " more", None), (3, a, None), (4, b, None), (5, b + " more", None)]
    got = by_id(near_duplicates(frame(spark, rows)), "component_id")
    assert got[2] == got[3] and got[4] == got[5] and got[2] != got[4] and got[1] in (got[2], got[4])


def test_a_family_below_the_limit_gives_no_rows(spark, monkeypatch):
    """Members lie between 0.66 and 0.8 of each other: none is a link, and no pair of them leaves a cell."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(160):
        own = list(base)
        for k in rng.sample(range(200), 12):
            own[k] = f"x{i}y{k}"
        texts[i] = " ".join(own)
    texts[500] = texts[3] + " tail"
    rows = spark.sparkContext.accumulator(0)
    real = near_dups._cells

    def counted(batches, *options):
        for batch in real(batches, *options):
            rows.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(near_dups, "_cells", counted)
    monkeypatch.setattr(near_dups, "STAR_ROUNDS", 0)  # cells do all the work
    for block in (2048, 40):
        monkeypatch.setattr(near_dups, "BLOCK", block)
        got = by_id(near_duplicates(frame(spark, [(i, t, None) for i, t in texts.items()])), "n_shingles", "component_id")
        assert got == brute.near_copies(texts)
        assert 1 <= rows.value <= 32
        rows.value = 0


def test_agree():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert agree(a, a[:80], (80, 100)) and not agree(a, a[:79], (80, 100)) and not agree(a[:80], a[20:], (80, 100))


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_no_odd_base_tells_apart(spark):
    """A Thue-Morse word and its complement: their sums of powers modulo 2^64 are equal for every odd base."""
    one, other = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    cut = W.cut([f"{one} {other} {one}".encode()], W.spaced())
    for family in range(3):
        keys = W.word_keys(cut, family).tolist()
        assert keys[0] == keys[2] != keys[1]
    shared = " ".join(f"w{i}" for i in range(19))
    docs = frame(spark, [(0, f"{shared} {one}", None), (1, f"{shared} {other}", None), (2, f"{shared} {one}", None)])
    removed = by_id(span_report(docs, repeated_spans(docs)), "n_removed")
    assert removed == {0: (0,), 1: (0,), 2: (20,)}


@pytest.mark.parametrize("blank", [" ", "\n", "\t \n"])
def test_long_runs_of_blanks_are_packed(blank):
    from tokenizers import Tokenizer

    path, pattern = vocabulary()
    encode = packing.text_encoder(path, pattern)
    reader = Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    text = "before" + blank * (1_000_000 // len(blank)) + "after"
    assert list(encode(text)) == reader.encode(text, add_special_tokens=False).ids
    assert list(encode("plain text")) == reader.encode("plain text", add_special_tokens=False).ids


def test_nothing_learned_keeps_texts_with_letters(spark):
    docs = frame(spark, [(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "éa", None)])
    model = fit_languages(docs)
    assert sorted(r.doc_id for r in keep_identified(docs, model).collect()) == [1, 4]
    assert by_id(identify(docs, model), "lang_pred") == {i: ("und",) for i in (1, 2, 3, 4)}


def test_columns_named_like_inner_ones(spark):
    rng = random.Random(3)
    text = prose(rng, 40)
    rows = [(i, text if i < 3 else prose(rng, 40) + "\nshared line", "x", "y", "z", "w", 1) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _line_doc string, keep string, keep_ string, KEEP__doc int")
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == 13
    kept = drop_lines(docs, line_bitmaps(docs))
    assert kept.columns == docs.columns and kept.filter(F.col("text").contains("shared")).isEmpty()


def test_any_number_of_languages(spark):
    """Seventy labels, each with its own letters; two of them in one family."""
    rng = random.Random(7)
    langs = [f"x{i}" for i in range(68)] + ["de", "nl"]
    letters = {lang: [chr(0x4E00 + 7 * k + j) for j in range(5)] for k, lang in enumerate(langs)}
    rows = []
    for i in range(70 * 8):
        lang = langs[i % 70]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(6)) for _ in range(10)), lang))
    docs = frame(spark, rows)
    model = fit_languages(docs.filter("doc_id >= 140"), bins=1 << 10)
    got = by_id(identify(docs.filter("doc_id < 140"), model), "lang_pred")
    right = sum(got[i] == (lang,) for i, _, lang in rows[:140])
    assert len(model.languages) == 70 and right >= 133
    with pytest.raises(ValueError, match="more than 64"):
        fit_languages(docs, max_languages=64)


def test_a_machine_takes_no_more_than_its_share(spark, monkeypatch):
    from lanternqa.llm import language

    sizes = spark.sparkContext.accumulator(0)
    real = language.fit_machine

    def counted(yes, no, x, y, **options):
        sizes.add(len(x))
        return real(yes, no, x, y, **options)

    monkeypatch.setattr(language, "fit_machine", counted)
    rng = random.Random(8)
    rows = [(i, prose(rng, 12) + f" {i}", ("de", "nl", "fr")[i % 3]) for i in range(300)]
    model = fit_languages(frame(spark, rows), per_language=20)
    assert len(model.families) == 1 and len(model.within["germanic"]) == 1
    assert sizes.value == 2 * (20 + 20)


def test_contamination_judges_each_row_on_either_side_of_the_block_limit(spark):
    """Repeated ids with other texts, and rows without id, each have their own result, in one block or many."""
    from lanternqa.llm.decontamination import contamination_report, drop_contaminated, find_contamination, remove_hits

    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(8)] + [(9, "three short words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = [prose(rng, 50) for _ in range(6)]
    texts = [(1, clean[0]), (1, items[0][1]), (2, f"{clean[1]} {items[1][1]}"), (None, clean[2]), (None, items[2][1]),
             (3, f"{clean[3]} {items[3][1]} {items[0][1]}"), (4, None), (5, ""), (6, "Three short WORDS"), (7, " ".join(clean * 9) + " " + items[4][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, row int, ROW_ string")
    want = sorted(brute.contamination({k: t for k, (_, t) in enumerate(texts)}, items).items())
    for limit in (16 << 20, 200):
        report = contamination_report(find_contamination(docs, benchmark, block_bytes=limit)).collect()
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report)
        assert got == sorted((str(texts[k][0]), *x) for k, x in want)
        left = drop_contaminated(docs, benchmark, block_bytes=limit)
        kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
        assert left.columns == docs.columns and kept == sorted((texts[k] for k, x in want if not x[4]), key=str)
        cleaned = sorted(r.text for r in remove_hits(docs, benchmark, block_bytes=limit).collect())
        assert len(cleaned) == len(texts) and items[0][1].lower() not in cleaned
        assert cleaned.count("") == 5
    plan = drop_contaminated(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
