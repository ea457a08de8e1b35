"""Meetings, decomposition and multi-hop answering."""

import json

import pytest
from pyspark.sql import functions as F

from lanternqa.functions import meetings as fm
from lanternqa.functions.prompts import meeting_prompt
from lanternqa.operators import hops, readers
from lanternqa.operators import meetings as mt
from lanternqa.plans import answer, gather


def test_meeting_fields_and_event(spark):
    rows = [
        (0, '{"location":"virtual","start_time":"2024-01-01T00:00","duration":1.5,"topic":"t"}'),
        (1, '{"location":"virtual","start_time":"2024-12-31T23:30","topic":"t"}'),
        (2, '{"location":"None","start_time":"None","duration":"None","topic":"t"}'),
        (3, "not json"),
    ]
    df = spark.createDataFrame(rows, "i int, reply string").withColumn("attendees", F.array(F.lit("a@b.c")))
    got = mt.event_record(mt.meeting_fields(df), "America/Los_Angeles").orderBy("i").collect()
    assert got[0].event.asDict(True) == {
        "summary": "t", "location": "virtual",
        "start": {"dateTime": "2024-01-01T00:00:00", "timeZone": "America/Los_Angeles"},
        "end": {"dateTime": "2024-01-01T01:30:00", "timeZone": "America/Los_Angeles"},
        "attendees": [{"email": "a@b.c"}],
    }
    assert (got[1].duration, got[1].event.end.dateTime) == (1.0, "2025-01-01T00:30:00")
    assert (got[2].start_time, got[2].duration, got[2].event.end.dateTime) == (None, None, None)
    assert (got[3].location, got[3].topic, got[3].duration) == (None, None, 1.0)


def test_iso_text_keeps_a_fraction(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.179575' AS t")
    assert df.select(fm.iso_text(F.col("t")).alias("x")).first().x == "2024-01-01T00:00:07.179575"


def test_meeting_prompt_leaves_quotes(spark):
    df = spark.sql("SELECT 'it''s on' AS m")
    prompt = df.select(meeting_prompt(F.col("m"), F.lit("2024-02-29").cast("date")).alias("p")).first().p
    assert "2024-02-29 Day of the week: 3" in prompt and "it's on" in prompt


def test_decompose_handles_cycles_and_depth(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("b", "b")] + [(f"n{i}", f"n{i + 1}") for i in range(9)],
        "question string, followup string",
    )
    seeds = spark.createDataFrame([(x, x) for x in ("a", "n0", "lone")], "root string, question string")
    got = hops.decompose_questions(seeds, hops.table_followups(edges), 5)
    short = [("a", "a", 0, False), ("a", "b", 1, False), ("a", "c", 1, False), ("lone", "lone", 0, False)]
    assert sorted(map(tuple, got.collect())) == sorted(short + [("n0", f"n{i}", i, i == 5) for i in range(6)])
    whole = hops.decompose_questions(seeds, hops.table_followups(edges))
    assert sorted(map(tuple, whole.collect())) == sorted([x[:3] for x in short] + [("n0", f"n{i}", i) for i in range(10)])


CORPUS = [
    (1, "Acme was founded by Jane Doe in a garage."),
    (2, "Jane Doe died in 1999 at home."),
    (3, "Nothing else matters here, founded or not."),
]


def test_two_hops_find_the_answer(spark):
    """The second question is made from the first finding."""

    def reasoner():
        def complete(prompt):
            found = prompt.rpartition("Are follow up questions needed here:")[2].split("Intermediate answer: ")[1:]
            if not found:
                return " Yes.\nFollow up: Who founded Acme?\nIntermediate answer: invented"
            if len(found) == 1:
                return "\nFollow up: When did " + ("Jane Doe" if "Jane Doe" in found[0] else "nobody") + " died?"
            return "\nSo the final answer is: " + ("1999" if "1999" in found[1] else "unknown")

        return complete

    texts = spark.createDataFrame(CORPUS, "page_id int, text string")
    asked = spark.createDataFrame([(1, "When did the founder of Acme die?"), (2, "Again: founder of Acme?"), (3, "When did the founder of Acme die?")], "q_id int, question string")
    got = answer.multi_hop_answer(asked, texts, reasoner, max_hops=4).orderBy("q_id").collect()
    assert [(r.q_id, r.answer, r.hops, r.forced) for r in got] == [(i, "\n1999", 2, False) for i in (1, 2, 3)]


def test_any_number_of_hops_cuts_the_corpus_once(spark):
    """The texts are cut into words for the index only; each hop then reads just the pages it hit."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def reasoner():
        def complete(prompt):
            found = prompt.count("Intermediate answer: ") - prompt.partition("Question: x")[0].count("Intermediate answer: ")
            return "\nSo the final answer is: ok" if found >= 3 else f"\nFollow up: Who founded Acme {found}?"

        return complete

    texts = spark.createDataFrame(CORPUS, "page_id int, text string").mapInPandas(count, "page_id int, text string")
    index = gather.index_of(texts)
    assert seen.value == len(CORPUS)
    plain = spark.createDataFrame(CORPUS, "page_id int, text string")
    asked = spark.createDataFrame([(1, "x?"), (2, None)], "q_id int, question string")
    got = {r.q_id: tuple(r)[1:] for r in answer.multi_hop_answer(asked, plain, reasoner, index=index).collect()}
    assert got == {1: ("\nok", 3, False), 2: (None, None, None)}
    assert seen.value == len(CORPUS)


def test_hop_limit_forces_an_answer(spark):
    def reasoner():
        return lambda p: "forced\nrest" if p.endswith("So the final answer is: ") else "\nFollow up: Who founded Acme?"

    texts = spark.createDataFrame(CORPUS, "page_id int, text string")
    asked = spark.createDataFrame([(1, "x?")], "q_id int, question string")
    got = answer.multi_hop_answer(asked, texts, reasoner, max_hops=2).first()
    assert (got.answer, got.hops, got.forced) == ("forced", 2, True)


def test_unreadable_followup_ends_the_loop(spark):
    def reasoner():
        return lambda p: "done" if p.endswith("So the final answer is: ") else "Follow up: no question mark"

    texts = spark.createDataFrame(CORPUS, "page_id int, text string")
    asked = spark.createDataFrame([(1, "x?")], "q_id int, question string")
    assert answer.multi_hop_answer(asked, texts, reasoner).first().answer == "done"


def test_answer_question_uses_every_part(spark):
    texts = spark.createDataFrame(CORPUS, "page_id int, text string")
    asked = spark.createDataFrame([(1, "Who founded Acme. When did Jane Doe die"), (2, "zebra")], "q_id int, question string")

    def echo():
        return lambda p: json.dumps({"answer": p.partition("\n\nText:\n")[2]})

    got = {r.q_id: r.answer for r in answer.answer_question(asked, texts, answerer=echo).collect()}
    assert "Jane Doe" in got[1] and "1999" in got[1] and got[2].strip() == ""


def test_gather_drops_unusable_replies(spark):
    texts = spark.createDataFrame(CORPUS, "page_id int, text string")
    asked = spark.createDataFrame([(1, "Acme founded"), (2, "Jane Doe")], "q_id int, question string")

    def model():
        return lambda p: '{"relevant_information": "yes"}' if "Query:\nAcme" in p else "cannot say"

    assert sorted(map(tuple, gather.gather_info(asked, texts, model).collect())) == [(1, "yes"), (2, "")]
    none = spark.createDataFrame([(3, None), (4, "zebra")], "q_id int, question string")
    assert sorted(map(tuple, gather.gather_info(none, texts, model).collect())) == [(3, ""), (4, "")]

    def broken():
        def complete(prompt):
            raise RuntimeError("model is down")

        return complete

    with pytest.raises(Exception, match="model is down"):
        gather.gather_info(asked, texts, broken).collect()
    default = {r.q_id: r.information for r in gather.gather_info(asked, texts).collect()}
    assert "Acme was founded" in default[1] and readers.best_piece("a", "x")()("\n\nQuery:\nq\n\nText:\nz\n").startswith("Nothing")


def test_findings_keep_the_order_of_their_chunks(spark):
    evidence = spark.createDataFrame([(1, "q", "z1 z2 a1 a2 z1 z2")], "k int, question string, text string")

    def reader():
        return lambda p: json.dumps({"relevant_information": p.partition("\n\nText:\n")[2].strip().split()[0]})

    limit = len(gather.prompts.RELEVANCE) - 6 + 1 + 1 + 2  # two words a chunk
    told = gather.relevant_information(evidence, ["k"], reader, limit, in_order=True).first()
    assert told.information == "z1 a1 z1"
    assert gather.relevant_information(evidence, ["k"], reader, limit).first().information == "a1 z1"


def test_long_information_is_answered_in_pieces(spark):
    from lanternqa.functions.prompts import ANSWER

    limit = len(ANSWER) - 6 + len("find x7") + 40
    rows = [(1, "find x7", " ".join(f"x{i}" for i in range(100))), (2, "find x7", "x7 here"), (3, "none", "")]
    known = spark.createDataFrame(rows, "q_id int, question string, information string")
    def answerer():
        def complete(prompt):
            assert len(prompt) <= limit
            text = prompt.partition("\n\nText:\n")[2]
            return json.dumps({"answer": "found"}) if "x7 " in text or "found" in text else "no idea"

        return complete

    got = {r.q_id: r.answer for r in answer.answer_from(known, "q_id", answerer, limit).collect()}
    assert got == {1: "found", 2: "found", 3: None}

    def parrot():
        return lambda p: json.dumps({"answer": p.partition("\n\nText:\n")[2]})

    # Answers that never get shorter end as what they are.
    same = answer.answer_from(known.filter("q_id = 1"), "q_id", parrot, limit).first().answer
    assert len(same) >= len(rows[0][2])
