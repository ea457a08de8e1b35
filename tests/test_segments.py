"""An index that grows equals one built anew, and reads only what is new."""

import random

from lanternqa.operators import retrieval as rt
from lanternqa.operators.segments import GrowingIndex

SCHEMA = "page_id bigint, text string"


def found(questions, index):
    return sorted(map(tuple, rt.search_top_k(questions, index, 3).collect())), sorted(
        map(tuple, rt.create_keywords(questions, index, 4).collect())
    )


def test_changes_equal_an_index_built_anew(spark, tmp_path):
    rng = random.Random(5)

    def text():
        return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randrange(9)))

    held, live = GrowingIndex(spark, str(tmp_path / "index")), {}
    questions = spark.createDataFrame([(i, text() + " alpha Beta") for i in range(6)], "q_id int, question string")
    assert held.commits() == [] and held.index().n_docs == 0
    steps = [("add", range(0, 12)), ("add", range(8, 20)), ("remove", range(3, 10)), ("remove", [99]), ("merge", ()),
             ("add", [4, 30, 31]), ("remove", [30]), ("add", [30])]
    for kind, ids in steps:
        if kind == "add":
            new = {i: rng.choice([text(), "", None]) if i % 7 == 0 else text() for i in ids}
            held.add(spark.createDataFrame([*new.items(), (None, "alpha")], SCHEMA))
            live |= new
        elif kind == "remove":
            held.remove(spark.createDataFrame([(i,) for i in ids], "page_id bigint"))
            live = {i: t for i, t in live.items() if i not in ids}
        else:
            held.merge()
        if kind == "merge" or ids == [30]:
            anew = rt.corpus_index(spark.createDataFrame([*live.items()], SCHEMA))
            own = held.index()
            assert (own.n_docs, own.mean_len) == (anew.n_docs, anew.mean_len) and found(questions, own) == found(questions, anew)
    assert [kind for _, kind, _ in held.commits()] == ["merged", "struck", "texts", "struck", "texts"] or held.commits()[0][1] == "merged"


def test_only_new_texts_are_read(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def texts(ids):
        rows = spark.createDataFrame([(i, f"alpha word{i}") for i in ids], SCHEMA)
        return rows.mapInPandas(count, SCHEMA)

    held = GrowingIndex(spark, str(tmp_path / "index"))
    held.add(texts(range(20)))
    first = seen.value
    assert 20 <= first <= 40  # once, or once more to find the ranges
    held.add(texts(range(20, 23)))
    assert seen.value - first <= 6
    before = seen.value
    questions = spark.createDataFrame([(1, "alpha word21")], "q_id int, question string")
    assert rt.search_top_k(questions, held.index(), 1).first().page_id == 21
    assert seen.value == before


def test_a_change_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    import pytest

    held = GrowingIndex(spark, str(tmp_path / "index"))
    held.add(spark.createDataFrame([(1, "alpha")], SCHEMA))

    def broken(self, kind, name):
        raise RuntimeError("lost")

    monkeypatch.setattr(GrowingIndex, "_commit", broken)
    with pytest.raises(RuntimeError):
        held.add(spark.createDataFrame([(1, "beta"), (2, "beta")], SCHEMA))
    monkeypatch.undo()
    assert held.index().n_docs == 1
    assert sorted(r.term for r in held.index().words.collect()) == ["alpha"]


def test_a_change_moves_texts_and_not_their_words(spark, tmp_path, monkeypatch):
    """Words are counted where a text lies: one exchange of texts to add them, none of words to merge."""
    from pyspark.sql import DataFrameWriter

    plans, real = [], DataFrameWriter.parquet

    def watch(self, path, *options, **named):
        plans.append((path.rsplit("/", 1)[-1], self._df._jdf.queryExecution().executedPlan().toString()))
        return real(self, path, *options, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", watch)
    held = GrowingIndex(spark, str(tmp_path / "index"))
    rows = [(1, "b a b"), (1, "b a b"), (1, "c"), (2, ""), (3, None), (None, "a")]
    held.add(spark.createDataFrame(rows, SCHEMA))
    held.remove(spark.createDataFrame([(3,)], "page_id bigint"))
    held.merge()
    moved = [plan.count("Exchange") - plan.count("BroadcastExchange") for name, plan in plans if name == "words"]
    assert moved == [1, 0]
    # Texts of one id add up if they are as long; a text without words is one, too.
    assert sorted(map(tuple, held.index().words.collect())) == [(1, 1, "c", 1), (1, 3, "a", 2), (1, 3, "b", 4)]
    assert (held.index().n_docs, held.index().mean_len) == (3, 4 / 3)
