from lanternqa.sources import tables as tb
from lanternqa.sources import traces as tr
from lanternqa.streaming import traces as st

LOG = (
    "stray<task>\n<prompt>\n a\nb \n</prompt>\n<response>\nr1\n</response>\n</task>\nnoise\n"
    "<task>\n<prompt>\ncut off\n<task>\n<prompt>\np2\n</prompt>\n<response>\n\n</response>\n</task>\n"
    "<task>\n<prompt>\nno response\n</prompt>\n</task>\n"
)


def test_traces_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    want = [("a\nb", "r1"), ("p2", "")]
    assert sorted(map(tuple, tr.read_traces(spark, str(tmp_path)).collect())) == want
    tiny = spark.newSession()
    tiny.conf.set("spark.sql.files.maxPartitionBytes", "7")
    tiny.conf.set("spark.sql.files.openCostInBytes", "1")
    assert sorted(map(tuple, tr.read_traces(tiny, str(tmp_path)).collect())) == want


def test_trace_round_trip_and_append(spark, tmp_path):
    rows = [("p\n1", "r 1"), ("p2", "<odd>"), ("ü", "")]
    df = spark.createDataFrame(rows, "prompt string, response string")
    path = str(tmp_path / "log")
    tr.write_traces(df, path)
    tr.write_traces(df.limit(1), path)
    assert sorted(map(tuple, tr.read_traces(spark, path).collect())) == sorted(rows + rows[:1])


def test_stream_adds_only_new_files(spark, tmp_path):
    log, out, seen = (str(tmp_path / n) for n in ("log", "out", "seen"))
    df = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "prompt string, response string")
    for roll, expected in ((True, 2), (True, 4), (False, 4)):
        if roll:
            tr.write_traces(df, log)
        st.stream_traces(spark, log, out, seen).awaitTermination()
        got = spark.read.schema(df.schema).parquet(out)
        assert got.count() == expected
    batch = tr.read_traces(spark, log)
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_stream_unprocessed_is_done_once(spark, tmp_path):
    source, done = str(tmp_path / "in"), str(tmp_path / "done")
    spark.range(10).write.parquet(source)
    seen = []

    def work(batch):
        seen.extend(r.id for r in batch.collect())
        return batch

    for checkpoint in ("a", "b"):  # a lost checkpoint replays everything
        stream = spark.readStream.schema("id bigint").parquet(source)
        st.stream_unprocessed(stream, done, ["id"], work, str(tmp_path / checkpoint)).awaitTermination()
        assert spark.read.parquet(done).count() == 10
    assert sorted(seen) == list(range(10))  # nothing is worked on twice


def test_scratch_without_a_named_folder(spark, monkeypatch):
    from lanternqa import session

    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    real = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None if key == "spark.checkpoint.dir" else real(key, *a))
    monkeypatch.setattr(session, "_LOCAL", [])
    table = session.materialize(spark.range(3), "three")
    assert table.count() == 3 and session.scratch_root(spark) == session._LOCAL[0]
    assert session.exists(spark, session.scratch_root(spark))
    session.release(table)
    assert not any(session.exists(spark, f.rsplit("/", 1)[0]) for f in table.inputFiles())
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: "/given")
    assert session.scratch_root(spark) == "/given"


def test_blanks_of_all_kinds_are_stripped(spark):
    df = spark.createDataFrame([("\u00a0\u2003 a b\u3000\x85\n",), ("\x1c",), ("x",)], "x string")
    assert [r[0] for r in df.select(tr.strip(df.x)).collect()] == ["a b", "", "x"]


def test_csv_keeps_hard_values(spark, tmp_path):
    rows = [(1, 'say "hi", ok\nnext'), (2, " padded "), (3, ""), (4, None), (5, "a\r\nb"), (6, "\\"), (7, "#x")]
    df = spark.createDataFrame(rows, "i int, x string").repartition(1)
    path = str(tmp_path / "csv")
    tb.write_table(df, path, order="i")
    got = tb.read_table(spark, path, "index bigint, i int, x string").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(i, *row) for i, row in enumerate(rows)]


def test_pages_and_resume(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(1, "u", "<p>"), (2, "u", ""), (3, "u", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(path)
    assert [r.page_id for r in tb.read_pages(spark, path).collect()] == [1]
    todo = spark.range(5)
    done = spark.createDataFrame([(1,), (1,), (9,)], "id bigint")
    assert sorted(r.id for r in tb.resume_unprocessed(todo, done, ["id"]).collect()) == [0, 2, 3, 4]
