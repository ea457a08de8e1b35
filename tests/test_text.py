import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternqa.functions import prompts as pr
from lanternqa.functions import text as tx
from lanternqa.operators import chunks as ch


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_clean_whitespace(spark):
    assert values(spark, ["a\n\nb", "a   b", "a\tb\rc", "a    b", None], tx.clean_whitespace) == [
        "ab", "a b", "a b c", "ab", None,
    ]
    assert values(spark, ["a\n\nb", "a   b"], lambda x: tx.clean_whitespace(x, True)) == ["a b", "a b"]


def test_clean_reply(spark):
    rows = ["<s>[INST] q [/INST] a\nb ", "[/INST]  a  b [/INST] c", "no marker"]
    assert values(spark, rows, tx.clean_reply) == ["a b", "ab", None]


def python_last_line(text):
    lines = text.split("\n")
    later = [line for line in lines[1:] if line != ""]
    return text if len(lines) == 1 else (later[-1] if later else "")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\n", max_size=8), min_size=30, max_size=60))
def test_last_line_any_text(spark, rows):
    assert values(spark, rows, tx.last_line) == [python_last_line(r) for r in rows]


def test_last_line(spark):
    assert values(spark, ["a\nb\n\n", "a\n", "a", "", "\n\nb"], tx.last_line) == ["b", "", "a", "", "b"]


def test_followup_question(spark):
    rows = [
        "x\nFollow up: Who is y?", "Follow up: Film: who directed?", "Follow up: Who is y", "Follow up:",
        "Follow up: ", "x", "Follow up:?", "Follow up:  two spaces?", "Who: really?",
    ]
    assert values(spark, rows, tx.followup_question) == [
        "Who is y?", "who directed?", None, None, None, None, "?", " two spaces?", None,
    ]


def test_final_answer_and_stops(spark):
    assert values(spark, ["So the final answer is: Paris", "No.\nSo the final answer is: x"], tx.final_answer) == [
        "Paris", "x",
    ]
    stops = ["\nFollow up:", "\nSo the final"]
    rows = ["abc\nSo the final answer: x\nFollow up: y", "abc", "\nFollow up: z"]
    assert values(spark, rows, lambda x: tx.truncate_at_stop(x, stops)) == ["abc", "abc", ""]


def test_normalize_for_match(spark):
    assert values(spark, ["  Été, 12_a! ", "A-B", "Жx", ""], tx.normalize_for_match) == ["t  12_a", "a b", "жx", ""]


def python_windows(text, keywords, n):
    return [
        (no, k, i, w)
        for no, k in enumerate(keywords) if k
        for i, w in enumerate(re.findall(".{0,%d}%s.{0,%d}" % (n, re.escape(k), n), text))
    ]


def spark_windows(spark, rows, keywords, n, **kw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    got = ch.keyword_windows(df, "x", keywords, n, **kw).collect()
    return sorted((r.i, r.kw_no, r.keyword, r.match_no, r.window) for r in got)


def test_keyword_windows_cases(spark):
    assert [w[-1] for w in spark_windows(spark, ["aaa kw bbb kw ccc"], ["kw"], 3)] == ["aa kw bb", "b kw cc"]
    assert [w[-1] for w in spark_windows(spark, ["ab\nkw cd"], ["kw"], 3)] == ["kw cd"]
    assert [w[-1] for w in spark_windows(spark, ["a\rkw\rb"], ["kw"], 3)] == ["a\rkw\rb"]
    assert spark_windows(spark, ["abc"], [""], 3) == []
    assert [w[-1] for w in spark_windows(spark, ["xab ycb"], ["[ac]."], 0, regex=True)] == ["ab", "cb"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text(alphabet="ab.(\n\r é\U0001f600", max_size=30), min_size=10, max_size=30),
    st.lists(st.sampled_from(["a", "ab", "aa", ".", "a.", "(", "é", "\U0001f600", " "]), min_size=1, max_size=3),
    st.integers(0, 4),
)
def test_keyword_windows_any_text(spark, rows, keywords, n):
    want = sorted((i, *w) for i, r in enumerate(rows) for w in python_windows(r, keywords, n))
    assert spark_windows(spark, rows, keywords, n) == want


def test_token_chunks_budget_per_row_and_blank(spark):
    df = spark.createDataFrame([(1, "a b c d e", 2), (2, " \n ", 2), (3, "x", 5), (4, None, 1)], "i int, x string, n int")
    got = sorted((r.i, r.chunk_no, r.chunk) for r in ch.token_chunks(df, "x", F.col("n"), keep=["i"]).collect())
    assert got == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (3, 0, "x")]
    overlapped = ch.token_chunks(df, "x", 3, overlap=1, keep=["i"]).filter("i = 1").orderBy("chunk_no").collect()
    assert [r.chunk for r in overlapped] == ["a b c", "c d e"]


def test_chunk_tokens_are_all_there(spark):
    text = " ".join(f"w{i}" for i in range(20000))
    df = spark.createDataFrame([(1, text)], "i int, x string")
    got = ch.token_chunks(df, "x", 333, keep=["i"]).orderBy("chunk_no").collect()
    assert " ".join(r.chunk for r in got) == text


def test_render_prompt_fills_once(spark):
    df = spark.createDataFrame([("say {2}", "it")], "a string, b string")
    got = df.select(pr.render_prompt("<{1}|{2}>", F.col("a"), F.col("b")).alias("p")).first().p
    assert got == "<say {2}|it>"


def test_truncate_to_budget(spark):
    df = spark.createDataFrame([("pp", "abcdef")], "p string, x string")
    fit = [df.select(pr.truncate_to_budget(F.col("p"), F.col("x"), n).alias("y")).first().y for n in (9, 8, 5, 1)]
    assert fit == ["abcdef", "abcdef", "abc", ""]


def test_stops_that_overlap_cut_at_the_first(spark):
    df = spark.createDataFrame([("xab: y",), ("none",), ("ab:",)], "x string")
    for stops in (["b:", "ab:"], ["ab:", "b:"]):
        got = [r[0] for r in df.select(tx.truncate_at_stop(F.col("x"), stops)).collect()]
        assert got == ["x", "none", ""]


def test_many_keywords_give_the_windows_of_few(spark):
    """One pass over a text finds what matching each keyword finds."""
    rng = random.Random(12)

    def word(letters, low, high):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))

    rows = [
        (i, word("aab c\né🙂.", 0, 60), [word("aabc\n🙂.", 0, 4) for _ in range(rng.randrange(0, 12))] + [None] * (i % 2), rng.randrange(6))
        for i in range(400)
    ]
    rows += [(1000, None, ["a"], 3), (1001, "aa", None, 3), (1002, "x" * 200_000 + "key" + "y" * 200_000, ["key", "x"], 50)]
    df = spark.createDataFrame(rows, "i int, x string, k array<string>, n int").repartition(4)

    def cut(few):
        got = tx.keyword_windows(F.col("x"), F.expr("filter(k, w -> w is not null)"), F.col("n"), few=few)
        return {r.i: r.w for r in df.select("i", got.alias("w")).collect()}

    each = cut(1000)
    assert cut(0) == each and cut(5) == each
    assert sum(len(w) for w in each.values() if w) > 300


def test_a_keyword_list_is_matched_in_one_pass(spark):
    df = spark.createDataFrame([(1, "one two\nthree two"), (2, None)], "i int, x string")
    keywords = [f"w{i}" for i in range(300)] + ["two", "", "e"]
    got = df.select("i", tx.keyword_windows(F.col("x"), keywords, 2).alias("w"))
    assert got.filter("i = 1").selectExpr("inline(w)").collect() == [
        (300, "two", 0, "e two"), (300, "two", 1, "e two"), (302, "e", 0, "one t"), (302, "e", 1, "hree "),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
