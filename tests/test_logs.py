"""Logs that grow: pieces, offsets and the stream over them."""

import io
import random

import pytest

from lanternqa.sources import traces as tr
from lanternqa.streaming import logs
from lanternqa.streaming import traces as st

MARK = b"</task>"


class Stream(io.BytesIO):
    """As much of a native file as the reader uses."""


def random_log(rng):
    parts = ["</", "task>", "</task>", "<", "x", "é", "task", "</tas", "\n"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60))).encode()


def test_pieces_give_each_block_once():
    rng = random.Random(1)
    for _ in range(400):
        body = random_log(rng)
        end = body.rfind(MARK) + len(MARK) if MARK in body else 0
        # A batch starts where an earlier one ended: after a mark, or at the beginning.
        starts = [0] + [i + len(MARK) for i in range(end) if body[i : i + len(MARK)] == MARK]
        first = rng.choice(starts)
        if first >= end:
            continue
        want = body[first:end].split(MARK)[:-1]
        size, step = rng.randrange(1, 30), rng.randrange(1, 12)
        got = []
        for at in range(first, end, size):
            piece = logs.Piece("f", first, at, min(at + size, end), end)
            got += logs.blocks(Stream(body), MARK, piece, step)
        assert got == want


def test_closed_until_finds_the_last_mark(monkeypatch):
    rng = random.Random(2)
    for step in (1, 3, 8, 100):
        monkeypatch.setattr(logs, "STEP_BYTES", step)
        for _ in range(200):
            body = random_log(rng)
            at = body.rfind(MARK)
            assert logs.closed_until(Stream(body), MARK, 0, len(body)) == (at + len(MARK) if at >= 0 else 0)


def test_a_file_that_lost_blocks_is_an_error():
    reader = logs.GrowingLogReader("/none", "</task>", 10)
    assert reader.partitions({"files": {"a": 5}}, {"files": {"a": 25}}) == [
        logs.Piece("a", 5, 5, 15, 25), logs.Piece("a", 5, 15, 25, 25)
    ]
    with pytest.raises(ValueError, match="only appended to"):
        reader.partitions({"files": {"a": 5}}, {"files": {"a": 3}})


def block(i):
    return f"<task>\n<prompt>\np{i} é\n</prompt>\n<response>\nr{i}\n</response>\n</task>\n"


def test_blocks_appended_between_and_during_runs_come_once(spark, tmp_path, monkeypatch):
    log, out, seen = (str(tmp_path / n) for n in ("log", "out", "seen"))
    (tmp_path / "log" / "inner").mkdir(parents=True)
    files = [tmp_path / "log" / "a.txt", tmp_path / "log" / "inner" / "b.txt"]
    (tmp_path / "log" / "_SUCCESS").write_text(block(1000))
    n, open_part = 0, ["", ""]

    def read():
        st.stream_traces(spark, log, out, seen).awaitTermination()
        return sorted(r.prompt for r in spark.read.schema("prompt string, response string").parquet(out).collect())

    for step in range(4):
        closed = []
        for k, file in enumerate(files):
            cut = 10 + 15 * step
            with file.open("a") as f:  # the rest of an open block, whole blocks, and the beginning of one
                f.write(open_part[k] + block(n) + block(n + 1) + block(n + 2)[:cut])
            open_part[k] = block(n + 2)[cut:]
            closed += [n + 2]
            n += 3
        assert read() == sorted(f"p{i} é" for i in range(n) if i not in closed)
    for k, file in enumerate(files):
        with file.open("a") as f:
            f.write(open_part[k])
    whole = sorted(f"p{i} é" for i in range(n))
    assert read() == whole and read() == whole  # nothing new, nothing twice
    batch = tr.read_traces(spark, log + "/a.txt").unionByName(tr.read_traces(spark, log + "/inner/b.txt"))
    assert sorted(r.prompt for r in batch.collect()) == whole
    files[0].write_text(block(0))
    with pytest.raises(Exception, match="only appended to"):
        st.stream_traces(spark, log, out, seen).awaitTermination()


def test_a_large_file_is_read_in_pieces(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("".join(block(i) for i in range(3000)))
    spark.dataSource.register(logs.GrowingLog)
    rows = (
        spark.readStream.format("growing_log").option("path", f"file://{path}").option("mark", "</task>")
        .option("pieceBytes", 1000).load()
    )
    query = (
        tr.parse_blocks(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "seen"))
        .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.response for r in got.collect()) == sorted(f"r{i}" for i in range(3000))


def test_rolled_files_are_read_once(spark, tmp_path):
    log, out, seen = (str(tmp_path / n) for n in ("log", "out", "seen"))
    df = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "prompt string, response string")
    for expected in (2, 4):
        tr.write_traces(df, log)
        st.stream_traces(spark, log, out, seen, growing=False).awaitTermination()
        assert spark.read.schema(df.schema).parquet(out).count() == expected
