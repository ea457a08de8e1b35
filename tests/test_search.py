import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from lanternqa.catalog.registry import questions, table
from lanternqa.operators import retrieval as rt

WORDS = re.compile(r"\w+")


def slow_search(queries, corpus, k):
    docs = {d: Counter(WORDS.findall(t.lower())) for d, t in corpus if t is not None}
    size = {d: sum(c.values()) for d, c in docs.items()}
    mean = sum(size.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = []
    for q, text in queries:
        scores = Counter()
        for t in set(WORDS.findall(text.lower())):
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            for d, c in docs.items():
                if t in c:
                    w = c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[d] / mean))
                    scores[d] += math.floor(idf * w * 1_000_000 + 0.5)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, i + 1, d, s / 1_000_000) for i, (d, s) in enumerate(best)]
    return sorted(out)


def run(queries, corpus, k):
    hits = rt.search_top_k(queries, corpus, k, "doc_id").collect()
    return sorted((r.q_id, r["rank"], r.doc_id, r.score) for r in hits)


@pytest.fixture(scope="module")
def hot_case(spark):
    """A third of the texts are copies, one word is in every text, one question asks only for it."""
    corpus = [(i, "common filler page " + ("copy of the day" if i % 3 == 0 else f"item{i % 17} word{i} word{i % 5}"))
              for i in range(300)]
    asked = [(0, "common"), (1, "copy day"), (2, "item3 word5 common"), (3, "word7 word8 filler"), (4, "absent"),
             (5, "common common Copy"), (6, "")] + [(i, f"common item{i % 17} copy") for i in range(10, 60)]
    return (
        asked, corpus, spark.createDataFrame(asked, "q_id int, question string"),
        spark.createDataFrame(corpus, "doc_id int, text string"),
    )


@pytest.mark.parametrize("path", ["direct", "pruned", "pruned, nothing small, all hot"])
@pytest.mark.parametrize("k", [1, 3])
def test_every_path_finds_the_same(spark, hot_case, monkeypatch, path, k):
    if path != "direct":
        monkeypatch.setattr(rt, "DIRECT_MATCHES", 0)
    if "nothing small" in path:
        monkeypatch.setattr(rt, "fits_broadcast", lambda df: False)
        monkeypatch.setattr("lanternqa.operators.spread.HOT_ROWS", 5)
        monkeypatch.setattr(rt, "LOOKUP_CELLS", 0)
    asked, corpus, queries, docs = hot_case
    assert run(queries, docs, k) == slow_search(asked, corpus, k)


def test_pruned_on_whole_documents(spark, monkeypatch):
    queries, docs = questions(spark, SF), table(spark, SF, "documents").select("doc_id", "text")
    direct = run(queries, docs, 5)
    monkeypatch.setattr(rt, "DIRECT_MATCHES", 0)
    assert run(queries, docs, 5) == direct


def test_pruning_forms_fewer_candidates(spark, monkeypatch):
    queries, docs = questions(spark, SF), table(spark, SF, "documents").select("doc_id", "text")
    seen = {}
    real = rt.materialize

    def watch(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(rt, "materialize", watch)
    monkeypatch.setattr(rt, "DIRECT_MATCHES", 0)
    run(queries, docs, 1)
    pairs = seen["postings"].join(seen["rated-terms"], "term_id").select("q_id", "doc_id").distinct().count()
    assert seen["candidates"].count() < pairs


def test_keywords_alike_for_large_vocabulary(spark, hot_case, monkeypatch):
    _, _, queries, docs = hot_case
    small = sorted(map(tuple, rt.create_keywords(queries, docs, 2, "doc_id").collect()))
    monkeypatch.setattr(rt, "fits_broadcast", lambda df: False)
    assert sorted(map(tuple, rt.create_keywords(queries, docs, 2, "doc_id").collect())) == small
    assert ("Copy" in {r[2] for r in small}) and all(r[1] <= 2 for r in small)


def test_unfiltered_texts_are_not_moved(spark):
    """Without broadcasts, hits meet only the texts of the pages that were hit."""
    from pyspark.sql import functions as F

    texts = spark.range(2000).select(F.col("id").alias("page_id"), F.repeat(F.lit("text "), 50).alias("text"))
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "q_id int, rank int, page_id bigint")
    plan = rt.join_pages(hits, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert [tuple(r)[0] for r in rt.join_pages(hits, texts).collect()] == [1]


def test_index_counts_only_rows_with_an_id(spark):
    df = spark.createDataFrame([(1, "a b a"), (None, "c c c c"), (2, None)], "page_id int, text string")
    index = rt.corpus_index(df)
    assert (index.n_docs, index.mean_len) == (2, 1.5)
    assert sorted(map(tuple, index.words.collect())) == [(1, 3, "a", 2), (1, 3, "b", 1)]


def test_site_host_rules(spark):
    from pyspark.sql import functions as F

    urls = ["https://a.org/x", "http://b.a.org", "http://ba.org/a.org", "http://A.org:80/", "not a url", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.ok for r in df.select(F.coalesce(rt.on_site(F.col("url"), "a.org"), F.lit(False)).alias("ok")).collect()]
    assert got == [True, True, False, True, False, False]


def test_hits_counted_and_pages_joined(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "q_id int")
    hits = spark.createDataFrame([(1, 2, 20), (1, 1, 10), (2, 1, 10)], "q_id int, rank int, page_id int")
    texts = spark.createDataFrame([(10, "ten"), (20, "twenty"), (30, "x")], "page_id int, text string")
    assert sorted(map(tuple, rt.require_results(queries, hits).collect())) == [(1, 2, True), (2, 1, False), (3, 0, False)]
    assert sorted(map(tuple, rt.join_pages(hits, texts).collect())) == [(1, "ten twenty"), (2, "ten")]


def test_distinct_join(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, x string")
    assert [tuple(r) for r in rt.distinct_join(df, ["k"], "x").collect()] == [(1, "a b")]


def test_a_part_of_an_index_equals_its_own(spark):
    rows = [(i, f"http://{'a.org' if i % 3 else 'b.c.org'}/{i}", " ".join(["alpha"] * (i % 4) + [f"w{i % 5}"] * (i % 3))) for i in range(30)]
    corpus = spark.createDataFrame([*rows, (30, "http://c.org", None), (31, "http://x.c.org", "")], "page_id int, url string, text string")
    site = corpus.filter(rt.on_site(F.col("url"), "c.org"))
    whole = rt.corpus_index(corpus.select("page_id", "text"))
    part, own = rt.part_index(whole, site), rt.corpus_index(site.select("page_id", "text"))
    assert (part.n_docs, part.mean_len) == (own.n_docs, own.mean_len)
    assert sorted(map(tuple, part.words.select("page_id", "dl", "term", "tf").collect())) == sorted(
        map(tuple, own.words.select("page_id", "dl", "term", "tf").collect())
    )
    nothing = rt.part_index(whole, corpus.filter("page_id < 0"))
    assert nothing.n_docs == 0
    asked = spark.createDataFrame([(1, "alpha w1"), (2, "none")], "q_id int, question string")
    got = rt.search_site_plus_general(asked, corpus, "c.org", index=whole).collect()
    want = rt.search_site(asked, corpus, "c.org").first()
    assert [(r.q_id, r.page_id) for r in got if r.source_rank == 1] == [(want.q_id, want.page_id)]
    assert rt.search_top_k(asked, nothing, 1).count() == 0
