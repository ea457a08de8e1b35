"""The pipeline against a plain one, stage by stage, and without its subpackage."""

import random
import subprocess
import sys
from pathlib import Path

import brute
import pytest
from test_operators import prose

import corpus_pipeline

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, 20)) for i in range(5)]
    rows = []
    for i in range(150):
        lines = [prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.append("Shared licence LINE")
        if i % 30 == 3:
            lines.insert(0, items[i % 5][1])
        rows.append([i, "\n".join(lines), rng.choice(["en", "de", None])])
    rows += [[200 + i, rows[i][1] + (" tail" if i % 2 else ""), "en"] for i in range(0, 40, 3)]
    rows += [[300, None, "en"], [301, "", "en"], [302, "12 34 !", "en"], [303, "Shared licence line", "en"]]
    path = tmp_path_factory.mktemp("tables")
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: t for i, t, _ in rows}, items


def test_stages_equal_plain_ones(spark, folder, tmp_path):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    schema, left = docs.schema, texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.schema == schema
        if name == "language_id":
            left = {d: t for d, t in left.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            left = brute.common_lines(left)[1]
        elif name == "near_dedup":
            left = {d: left[d] for d, (_, c) in brute.near_copies(left).items() if c == d}
        else:
            left = {d: left[d] for d, x in brute.contamination(left, items).items() if not x[4]}
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == left and len(rows) == len(left), name
        assert all(r.n_chars == len(r.text) for r in rows)
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in pieces} == set(left)
    assert {r.doc_id: r.doc_tokens for r in pieces} == {
        d: sum(r.length for r in pieces if r.doc_id == d) for d in left
    }


def test_near_dedup_takes_five_words(spark, folder):
    """Alike in word pairs only: one changed word in 20, and logs over few words. Both stay; a real copy goes."""
    rng = random.Random(8)
    long = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(long), 1: " ".join(x + "x" if i % 20 == 9 else x for i, x in enumerate(long)), 2: " ".join([*long, "end"])}
    texts |= {10 + i: " ".join(rng.choice("get put ok err up".split()) for _ in range(400)) for i in range(4)}
    stay = {d for d, (_, c) in brute.near_copies(texts, 5).items() if c == d}
    assert stay == set(texts) - {2} and {c for _, c in brute.near_copies(texts).values()} == {0, 10}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder[0]).collect()} == stay


def test_stages_take_an_empty_table(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_registry_does_without_the_subpackage():
    """With the pipeline and the operators gone, the other queries are still there."""
    code = (
        "import sys; sys.modules['lanternqa.llm'] = None; import importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; assert 'gather_info' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in e.oracle_sql())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
