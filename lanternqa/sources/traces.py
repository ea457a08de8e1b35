"""Prompt/response trace logs: append-only text of tagged blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternqa.functions.text import strip

# Fixed value: a block ends here, so it is also the record separator.
BLOCK_END = "</task>"


def render_block(prompt: Column, response: Column) -> Column:
    return F.concat(
        F.lit("<task>\n<prompt>\n"), strip(prompt), F.lit("\n</prompt>\n<response>\n"), strip(response),
        F.lit("\n</response>\n</task>"),
    )


def parse_blocks(records: DataFrame, value: str = "value") -> DataFrame:
    """prompt and response of each block; text outside blocks and unfinished blocks are skipped.

    Works alike on a batch and on a stream, one record at a time.
    """

    def inside(block: Column, tag: str) -> Column:
        opened = F.get(F.split(block, f"<{tag}>", -1), F.lit(1))
        return strip(F.substring_index(opened, f"</{tag}>", 1))

    parts = F.split(F.col(value), "<task>", -1)
    blocks = records.select(F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("block"))
    return blocks.select(
        inside(F.col("block"), "prompt").alias("prompt"), inside(F.col("block"), "response").alias("response")
    ).filter(F.col("prompt").isNotNull() & F.col("response").isNotNull())


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A log as (prompt, response). Logs split over tasks like any text file."""
    return parse_blocks(spark.read.option("lineSep", BLOCK_END).text(path))


def write_traces(df: DataFrame, path: str, prompt: str = "prompt", response: str = "response") -> None:
    """Append one block per row; each task adds its own file to the log folder."""
    df.select(render_block(F.col(prompt), F.col(response)).alias("value")).write.mode("append").text(path)
