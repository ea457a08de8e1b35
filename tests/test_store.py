"""A store of completions: no prompt is asked twice, in one run or the next, broken off or not."""

from collections import Counter

import pytest
from test_flows import CORPUS

from lanternqa.operators.inference import batched, complete_batch, keep_completions, stored_completions
from lanternqa.plans import answer, gather


def asked(path):
    return Counter(path.read_text().split("\x00")[:-1]) if path.exists() else Counter()


def reply_model(log, fail_on=None):
    """Replies with the prompt's length, and writes down what it was asked."""

    def factory():
        def complete(prompt):
            if prompt == fail_on:
                raise RuntimeError("lost")
            with open(log, "a") as f:
                f.write(prompt + "\x00")
            return f"{len(prompt)}"

        return complete

    return factory


def test_a_second_run_asks_only_what_is_new(spark, tmp_path):
    log, store = tmp_path / "asked", str(tmp_path / "store")
    rows = [(i, f"p{i % 70}") for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "i int, prompt string")
    model = reply_model(str(log))
    first = complete_batch(df, "prompt", model, by=["i"], store=store)
    want = {i: None if p is None else str(len(p)) for i, p in rows}
    assert {r.i: r.reply for r in first.collect()} == want and max(asked(log).values()) == 1 and len(asked(log)) == 70
    more = df.unionByName(spark.createDataFrame([(1000, "new")], "i int, prompt string"))
    again = complete_batch(more, "prompt", model, by=["i"], store=store, on_error="mark")
    assert {r.i: r.reply for r in again.collect()} == want | {1000: "3"}
    assert asked(log)["new"] == 1 and max(asked(log).values()) == 1
    complete_batch(df, "prompt", model, by=["i"], store=store, name="other")
    assert sum(asked(log).values()) == 71 + 70


def test_a_run_that_breaks_off_keeps_what_it_paid_for(spark, tmp_path):
    log, store = tmp_path / "asked", str(tmp_path / "store")
    df = spark.createDataFrame([(i, f"p{i:03}") for i in range(300)], "i int, prompt string")
    with pytest.raises(Exception, match="lost"):
        complete_batch(df, "prompt", reply_model(str(log), "p150"), by=["i"], store=store, partitions=2)
    done = len(asked(log))
    assert done > 20
    complete_batch(df, "prompt", reply_model(str(log)), by=["i"], store=store, partitions=2)
    # What a task had in hand when it was stopped from outside may be lost, the rest is not.
    assert len(asked(log)) == 300 and sum(asked(log).values()) <= 300 + 50
    assert stored_completions(spark, store, "model").count() == 300


def test_batched_models_and_repeated_tasks(spark, tmp_path):
    store = str(tmp_path / "store")

    @batched
    def model():
        return lambda prompts: [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(130)], "i int, prompt string")
    complete_batch(df, "prompt", model, by=["i"], store=store)
    held = stored_completions(spark, store, "model").collect()
    assert sorted(r.reply for r in held) == sorted(f"P{i}" for i in range(130))
    keep_completions(store, "model", [r["_key"] for r in held[:3]], [(r.reply, None) for r in held[:2]] + [(None, "error")])
    assert stored_completions(spark, store, "model").count() == 130


def test_a_broken_flow_goes_on_where_it_ended(spark, tmp_path):
    """The model is lost at the second hop; a second call asks nothing that was answered."""
    log, store = tmp_path / "asked", str(tmp_path / "store")

    def reasoner(broken):
        def factory():
            def complete(prompt):
                found = prompt.rpartition("Are follow up questions needed here:")[2].count("Intermediate answer: ")
                if broken and found == 2:
                    raise RuntimeError("lost")
                with open(log, "a") as f:
                    f.write(prompt + "\x00")
                return "\nSo the final answer is: ok" if found == 3 else f"\nFollow up: Who founded Acme {found}?"

            return complete

        return factory

    texts = spark.createDataFrame(CORPUS, "page_id int, text string")
    questions = spark.createDataFrame([(i, f"question {i}?") for i in range(4)], "q_id int, question string")
    index = gather.index_of(texts)
    with pytest.raises(Exception, match="lost"):
        answer.multi_hop_answer(questions, texts, reasoner(True), index=index, store=store).collect()
    before = sum(asked(log).values())
    assert before == 8
    got = answer.multi_hop_answer(questions, texts, reasoner(False), index=index, store=store).collect()
    assert sorted((r.q_id, r.answer, r.hops) for r in got) == [(i, "\nok", 3) for i in range(4)]
    assert sum(asked(log).values()) == 16 and max(asked(log).values()) == 1
    answer.multi_hop_answer(questions, texts, reasoner(True), index=index, store=store).collect()
    assert sum(asked(log).values()) == 16
