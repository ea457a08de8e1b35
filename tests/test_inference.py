import json
import os

import pytest
from pyspark.sql import functions as F

from lanternqa.functions import replies
from lanternqa.operators import inference as inf


def python_parse(raw):
    try:
        value = json.loads(raw)
    except Exception:
        return None
    return value.get("answer") if isinstance(value, dict) else None


def test_strict_replies(spark):
    rows = [
        '{"answer":"x"}', '{"answer":"x"} junk', "{'answer':'x'}", '{"b":1}', "", ' \n{"answer": "y"} ', '[{"answer":"x"}]',
        '"x"', "12", "null", '{"answer":"a"},{"answer":"b"}', '{"answer":"q\\"uote \\u00e9"}', "{", '{"answer":null}',
        '{"answer":"x",}', "true", '{"answer":"x"}] junk', '{"answer":"x"}][', '{"answer":"x"}]//', '{"answer":"x"}}',
        '{"answer":"x"},"k":1', '{"answer":"x"}],"z":[1', '{"answer":"x"}, "end":1}', '{"answer":"x"} // c', "[]", "{}",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    got = df.select("i", replies.parse_reply(F.col("x"), replies.ANSWER)["answer"].alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == [python_parse(r) for r in rows]


def test_reply_defaults(spark):
    df = spark.createDataFrame(
        [(0, '{"needs_followup": true, "questions": ["a", "b"]}'), (1, "bad"), (2, '{"needs_followup": "true"}')],
        "i int, x string",
    )
    got = df.select("i", replies.parse_reply(F.col("x"), replies.DECOMPOSE).alias("r")).orderBy("i").collect()
    assert [(r.r.needs_followup, r.r.questions) for r in got] == [(True, ["a", "b"]), (False, []), (False, [])]


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_equal_prompts_complete_once(spark, tmp_path, monkeypatch, hot_rows):
    monkeypatch.setattr("lanternqa.operators.spread.HOT_ROWS", hot_rows)
    log = str(tmp_path)

    def model():
        def complete(prompt):
            with open(os.path.join(log, f"{os.getpid()}.txt"), "a") as f:
                f.write(prompt + "\n")
            return prompt.upper()

        return complete

    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("prompt"))
    df = df.unionByName(spark.range(300, 303).select("id", F.lit(None).cast("string").alias("prompt")))
    got = inf.complete_batch(df, "prompt", model, by=["id"]).collect()
    assert len(got) == 303
    assert all(r.reply == (None if r.prompt is None else r.prompt.upper()) for r in got)
    calls = [line for name in os.listdir(log) for line in open(os.path.join(log, name))]
    assert len(calls) == len(set(calls)) == len({r.prompt for r in got} - {None})


def test_failing_model(spark):
    def model():
        def complete(prompt):
            if prompt == "bad":
                raise ValueError("no")
            return "ok"

        return complete

    df = spark.createDataFrame([("bad",), ("good",)], "prompt string")
    marked = inf.complete_batch(df, "prompt", model, on_error="mark").collect()
    assert {r.prompt: (r.reply, r.error) for r in marked} == {"bad": (None, "ValueError: no"), "good": ("ok", None)}
    with pytest.raises(Exception, match="no"):
        inf.complete_batch(df, "prompt", model)
    with pytest.raises(ValueError):
        inf.complete_batch(df, "prompt", model, on_error="ignore")


def test_batched_model_sees_lists_and_is_logged(spark, tmp_path):
    from lanternqa.sources.traces import read_traces

    @inf.batched
    def model():
        def complete(prompts):
            if "bad" in prompts and len(prompts) > 1:
                raise ValueError("one of them")
            return [f"{p}!" for p in prompts]

        return complete

    rows = [(f"p{i}",) for i in range(40)] + [("bad",), (None,)]
    df = spark.createDataFrame(rows, "prompt string")
    log = str(tmp_path / "log")
    got = inf.complete_batch(df, "prompt", model, on_error="mark", partitions=2, batch=8, log=log).collect()
    assert {r.prompt: r.reply for r in got} == {p: None if p is None else f"{p}!" for (p,) in rows}
    assert sorted(map(tuple, read_traces(spark, log).collect())) == sorted((p, f"{p}!") for (p,) in rows if p)


def test_input_of_a_batch_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(50).selectExpr("concat('p', id % 7) AS prompt").mapInPandas(count, "prompt string")
    assert inf.complete_batch(df, "prompt", lambda: str.upper).count() == 50
    assert seen.value == 50


def test_model_keywords_are_all_used(spark):
    from lanternqa.operators.readers import long_words

    df = spark.createDataFrame([(1, "the longest sentences matter"), (2, "a b")], "q_id int, question string")
    got = {r.q_id: r.keywords for r in inf.model_keywords(df, long_words(6)).collect()}
    assert got == {1: ["longest", "sentences", "matter"], 2: []}


def test_any_sufficient(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, None), (2, None)], "k int, is_sufficient boolean")
    assert sorted(map(tuple, inf.any_sufficient(df, ["k"]).collect())) == [(1, True), (2, False)]
