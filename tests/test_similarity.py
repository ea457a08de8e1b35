from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternqa.catalog.registry import exchanges
from lanternqa.functions import similarity as sm
from lanternqa.operators import scoring as sc
from conftest import SF


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_ratio(a, b):
    if a == b:
        return 100
    total = len(a) + len(b)
    return round(100 * (1.0 - (total - 2 * slow_lcs(a, b)) / total)) if a and b else 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=40), st.text(alphabet="abcé ", max_size=40))
def test_subsequence_is_exact_and_symmetric(a, b):
    assert sm.common_subsequence(a, b) == slow_lcs(a, b) == sm.common_subsequence(b, a)


def test_subsequence_of_long_texts():
    a, b = "abcd " * 700, "bcda  " * 500
    assert sm.common_subsequence(a, b) == slow_lcs(a, b)


def score(spark, fn, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r.s for r in df.select("i", fn(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]


def test_scores(spark):
    assert score(spark, sm.similarity_ratio, ("a", "a"), ("", "a"), ("ab", "cd"), (None, "a"), ("abcd", "bcde")) == [
        100, 0, 0, 0, 75,
    ]
    assert score(spark, sm.token_sort_ratio, ("b a", "A b"), ("a!", "a"), ("x", "")) == [100, 100, 0]
    assert score(spark, sm.token_set_ratio, ("paris france", "Paris"), ("a", "b"), ("", ""), ("a b c", "c d")) == [
        100, 0, 0, 50,
    ]


def test_whole_exchanges_against_brute_force(spark):
    df = exchanges(spark, SF)
    a, b = F.col("prompt"), F.col("response")
    rows = df.select(
        sm.normalize_for_match(a).alias("a"), sm.normalize_for_match(b).alias("b"),
        sm.token_sort_ratio(a, b).alias("sort"), sm.token_set_ratio(a, b).alias("set"),
    ).collect()
    assert rows
    for r in rows:
        assert r.sort == slow_ratio(" ".join(sorted(r.a.split())), " ".join(sorted(r.b.split())))
        x, y = set(r.a.split()), set(r.b.split())
        both = sorted(x & y)
        texts = [" ".join(both), " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))]
        assert r.set == max(slow_ratio(texts[i], texts[j]) for i, j in ((0, 1), (0, 2), (1, 2)))


def test_best_option_mean_and_comparison(spark):
    df = spark.createDataFrame(
        [(1, "Paris", ["London", "Paris, France"]), (2, "x y", ["y", "x"]), (3, "q", ["r"])],
        "k int, answer string, answers array<string>",
    )
    best = sc.best_option_score(df, ["k"], "answer", "answers")
    assert sorted((r.k, r.token_set_ratio) for r in best.collect()) == [(1, 100), (2, 100), (3, 0)]
    assert abs(sc.mean_score(best, "token_set_ratio").first().mean_score - 200 / 3) < 1e-9
    tuned = best.select("k", F.lit(50).alias("similarity_score_tuned")).filter("k < 3")
    both = sc.compare_models(best.withColumnRenamed("token_set_ratio", "similarity_score"), tuned, ["k"]).first()
    assert (both.n, both.mean_base, both.mean_tuned) == (2, 100.0, 50.0)


def plain_set_ratio(a, b):
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0
    core = " ".join(sorted(left & right))
    one, two = (" ".join(sorted(left & right) + sorted(own)) for own in (left - right, right - left))
    return max(slow_ratio(core, one), slow_ratio(core, two), slow_ratio(one, two))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc ", max_size=30), st.text(alphabet="abc ", max_size=30), st.integers(0, 100))
def test_bounds_change_no_score(a, b, least):
    assert sm.ratio(a, b, least) == max(least, slow_ratio(a, b))
    assert sm.set_ratio(a, b) == plain_set_ratio(a, b)
    assert sm.set_ratio(a, b, least) == max(least, plain_set_ratio(a, b))


def test_options_that_cannot_win_are_not_compared(monkeypatch):
    calls = []
    real = sm.common_subsequence
    monkeypatch.setattr(sm, "common_subsequence", lambda a, b: calls.append(1) or real(a, b))
    best = plain_set_ratio("paris is big", "paris was big")
    assert sm.set_ratio("paris is big", "paris was big", 0) == best > 80 and len(calls) == 1
    assert sm.set_ratio("paris is big", " ".join(f"x{i}" for i in range(300)), best) == best  # too long
    assert sm.set_ratio("paris is big", "qwq wqwq qw", best) == best  # other letters
    assert sm.set_ratio("paris is big", "paris", best) == 100 and len(calls) == 1
