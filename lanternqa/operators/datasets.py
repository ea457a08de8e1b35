"""Preparing training and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.functions.hashing import mix
from lanternqa.functions.text import tokens
from lanternqa.operators.spread import with_position


def random_split(df: DataFrame, key: str, percent: int = 65, seed: int = 0) -> DataFrame:
    """Mark rows `train` or `eval` by an integer key: the same on every run and layout."""
    part = F.when(mix(F.col(key), seed) % 100 < percent, "train").otherwise("eval")
    return df.withColumn("split", part)


def tail_split(df: DataFrame, key: str, offset: int = 800, name: str = "index") -> DataFrame:
    """Rows from a position on, numbered anew from 0 in key order."""
    placed = with_position(df, [key], "_position")
    return placed.filter(F.col("_position") >= offset).withColumn(name, F.col("_position") - offset).drop("_position")


def add_result_columns(df: DataFrame, reply: str = "llm_response", score: str = "similarity_score") -> DataFrame:
    """Empty reply and zero score, to be filled by a scoring run."""
    return df.withColumn(reply, F.lit("")).withColumn(score, F.lit(0))


def length_buckets(
    df: DataFrame, text: str, key: str, batch: int = 4, max_len: int | None = None, width: int = 64
) -> DataFrame:
    """Batches of texts of like token length: `key`, n_tokens, text, bucket, batch_no.

    Texts are whole and bucketed by length; a trainer that takes `max_len`
    tokens at most gets them cut, with a column `cut` that says which were.
    Rows are ranged by (bucket, key), so a bucket that holds much of the table
    spans many tasks; only its last batch can be short.
    """
    every = df.select(key, tokens(F.col(text)).alias("_every"))
    some = F.col("_every") if max_len is None else F.slice("_every", 1, max_len)
    mark = [] if max_len is None else ["cut"]
    cut = every.select(key, some.alias("_tokens"), *([(F.size("_every") > max_len).alias("cut")] if mark else [])).select(
        key, F.size("_tokens").alias("n_tokens"), F.array_join("_tokens", " ").alias(text), *mark
    )
    placed = with_position(
        cut.withColumn("bucket", F.floor(F.col("n_tokens") / width).cast("long")), ["bucket", key], "_position"
    )
    starts = placed.groupBy("bucket").agg(F.min("_position").alias("_start"))
    return (
        placed.join(F.broadcast(starts), "bucket")
        .withColumn("batch_no", F.floor((F.col("_position") - F.col("_start")) / batch).cast("long"))
        .select(key, "n_tokens", text, "bucket", "batch_no", *mark)
    )
