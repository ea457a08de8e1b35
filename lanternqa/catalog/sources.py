"""Readers and writers, on files that Spark renders from the given tables."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from lanternqa.catalog.registry import EXCHANGES_SQL, exchanges, query, strip_sql, table
from lanternqa.session import scratch_path
from lanternqa.sources import tables as tb
from lanternqa.sources import traces as tr
from lanternqa.sources.files import store_of
from lanternqa.streaming import traces as st

_PARSED = f"""WITH {EXCHANGES_SQL}
SELECT {strip_sql('prompt')} AS prompt, {strip_sql('response')} AS response FROM exchanges"""


@query(_PARSED)
def read_traces(spark, sf):
    log = scratch_path(spark, "trace-log")
    tr.write_traces(exchanges(spark, sf), log)
    return tr.read_traces(spark, log)


@query(
    rf"""WITH {EXCHANGES_SQL} SELECT E'<task>\n<prompt>\n' || {strip_sql('prompt')} || E'\n</prompt>\n<response>\n'
  || {strip_sql('response')} || E'\n</response>\n' AS value FROM exchanges"""
)
def write_traces(spark, sf):
    log = scratch_path(spark, "trace-log")
    turns = exchanges(spark, sf)
    tr.write_traces(turns.filter("turn < 2"), log)
    tr.write_traces(turns.filter("turn >= 2"), log)
    return spark.read.option("lineSep", "</task>\n").text(log)


def _append_blocks(rows, folder):
    """Each task appends its blocks to one file of a log, as the programs that are logged do."""

    def work(batches):
        context = TaskContext.get()
        store, root = store_of(folder)
        store.create_dir(root)
        with store.open_append_stream(f"{root}/log-{context.partitionId() if context else 0}.txt") as log:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    log.write(block.encode())
        yield from ()

    blocks = rows.select(F.concat(tr.render_block(F.col("prompt"), F.col("response")), F.lit("\n")).alias("block"))
    blocks.repartition(4, "block").mapInArrow(work, "block string").write.format("noop").mode("overwrite").save()


@query(_PARSED)
def stream_traces(spark, sf):
    """Logs whose files are appended to between the runs, and to which a folder of new files is added."""
    log, out, seen = (scratch_path(spark, n) for n in ("trace-log", "traces", "traces-seen"))
    turns = exchanges(spark, sf)
    for roll in ("turn < 2", "turn >= 2 AND turn < 4", "turn = 4"):
        _append_blocks(turns.filter(roll), log)
        st.stream_traces(spark, log, out, seen).awaitTermination()
    tr.write_traces(turns.filter("turn > 4"), f"{log}/rolled")
    st.stream_traces(spark, log, out, seen).awaitTermination()
    return spark.read.schema("prompt string, response string").parquet(out)


@query(_PARSED)
def stream_rolled_traces(spark, sf):
    """The same log in whole files only, for stores that only Spark reads."""
    log, out, seen = (scratch_path(spark, n) for n in ("trace-log", "traces", "traces-seen"))
    turns = exchanges(spark, sf)
    for roll in ("turn < 2", "turn >= 2"):
        tr.write_traces(turns.filter(roll), log)
        st.stream_traces(spark, log, out, seen, growing=False).awaitTermination()
    return spark.read.schema("prompt string, response string").parquet(out)


@query("SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents")
def read_write_table(spark, sf):
    path = scratch_path(spark, "table")
    tb.write_table(table(spark, sf, "documents"), path, order="doc_id")
    return tb.read_table(
        spark, path, "index bigint, doc_id bigint, text string, lang string, source string, n_chars bigint"
    )


@query(
    f"""WITH {EXCHANGES_SQL}
SELECT conv_id * 1000 + turn AS row_id, prompt AS question, array_to_string(string_split(response, chr(10)), '|') AS answers
FROM exchanges"""
)
def read_qa(spark, sf):
    path = scratch_path(spark, "qa")
    exchanges(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("prompt").alias("question"),
        F.split("response", "\n", -1).alias("answers"),
    ).write.parquet(path)
    return tb.read_qa(spark, path, "row_id").withColumn("answers", F.array_join("answers", "|"))


@query("SELECT page_id, url, html FROM pages WHERE html IS NOT NULL AND html <> ''")
def read_pages(spark, sf):
    return tb.read_pages(spark, f"{sf}/pages.parquet")


@query("SELECT doc_id, source, n_chars, doc_id IN (SELECT doc_id FROM labels) AS earlier FROM documents")
def stream_unprocessed(spark, sf):
    """The labelled documents are done first; a stream of all documents then works on the others only."""
    done, first, second = (scratch_path(spark, n) for n in ("done", "seen", "seen"))
    todo = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    labelled = scratch_path(spark, "labelled")
    todo.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").write.parquet(labelled)
    every = scratch_path(spark, "every")
    todo.write.parquet(every)
    for source, seen, earlier in ((labelled, first, True), (every, second, False)):
        rows = spark.readStream.schema(todo.schema).parquet(source)
        work = lambda batch, earlier=earlier: batch.withColumn("earlier", F.lit(earlier))
        st.stream_unprocessed(rows, done, ["doc_id"], work, seen).awaitTermination()
    return spark.read.schema("doc_id bigint, source string, n_chars bigint, earlier boolean").parquet(done)


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_unprocessed(spark, sf):
    todo = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return tb.resume_unprocessed(todo, table(spark, sf, "labels"), ["doc_id"])
