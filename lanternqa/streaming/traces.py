"""Following a growing trace log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lanternqa.session import exists
from lanternqa.sources.tables import resume_unprocessed
from lanternqa.sources.traces import BLOCK_END, parse_blocks
from lanternqa.streaming.logs import GrowingLog


def stream_traces(
    spark: SparkSession, source: str, out: str, checkpoint: str, growing: bool = True, max_files: int = 1000
) -> StreamingQuery:
    """Parse every closed block of a log, a file or a folder, not seen before into a Parquet table, then stop.

    `checkpoint` remembers how far each file was read, so calling again after
    blocks were appended or files added gives just these. A block that is not
    closed yet waits for the next call. A file that has become shorter than what
    was read of it is an error, and a file under a new name is a new file.

    With `growing=False` each file is read once, whole, when it is first seen:
    for logs that roll to new files and lie in a store that only Spark reads.
    """
    if growing:
        spark.dataSource.register(GrowingLog)
        records = spark.readStream.format("growing_log").option("path", source).option("mark", BLOCK_END).load()
    else:
        records = (
            spark.readStream.option("lineSep", BLOCK_END).option("maxFilesPerTrigger", max_files).text(source)
        )
    return (
        parse_blocks(records).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(availableNow=True).start()
    )


def stream_unprocessed(stream: DataFrame, done_path: str, key: list[str], work, checkpoint: str) -> StreamingQuery:
    """Run `work(batch)` on rows whose key the table at `done_path` lacks, and append its result there.

    Rows done before never reach `work`: a batch replayed after a failure is
    filtered first and adds nothing twice. Only the keys of the done table are
    read, and of these only the ones that the batch asks for are kept. A table
    that does not exist yet is empty.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*key).schema)
        todo = batch
        if exists(spark, done_path):
            done = spark.read.schema(keys).parquet(done_path)
            todo = resume_unprocessed(batch, done.join(batch.select(*key).distinct(), key, "left_semi"), key)
        work(todo).write.mode("append").parquet(done_path)

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
