"""A training-data pipeline of five stages over `documents`: STAGES in order, each on all that the one before kept.

The first four return the columns of their input; the last returns one row per
packed piece. The SQL for the whole run would need the tokenizer, so there is
none; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternqa.llm.decontamination import drop_contaminated
from lanternqa.llm.language import fit_languages, keep_identified
from lanternqa.llm.lines import drop_lines, line_bitmaps
from lanternqa.llm.near_dups import drop_near_duplicates
from lanternqa.llm.packing import pack
from lanternqa.llm.queries import vocabulary
from lanternqa.llm.scratch import Scratch

# The query's two words are for its SQL; documents are lost only for being copies in runs of five words.
NEAR_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language: null texts and texts without a letter."""
    learnt = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return keep_identified(docs, fit_languages(learnt))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents share."""
    return drop_lines(docs, line_bitmaps(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return drop_near_duplicates(docs, words=NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which test windows cover a twentieth or more."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed training sequences."""
    return pack(docs, *vocabulary()).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's result is written and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if done:
            scratch.drop(done)
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
