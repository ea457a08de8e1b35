"""CSV tables, question sets, pages and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternqa.operators.spread import with_position

# Quotes are doubled, newlines kept, no value trimmed, and null is told from "".
_CSV = {
    "header": True, "escape": '"', "quoteAll": True, "nullValue": "\\N", "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a declared schema; quoted fields may span lines.

    Such files do not split, so large tables should come as many files or as
    Parquet.
    """
    return spark.read.schema(schema).options(**_CSV, multiLine=True, lineSep="\n").csv(path)


def write_table(df: DataFrame, path: str, order: str | None = None, index: str = "index") -> None:
    """Write CSV; with `order`, a leading positional index column in that order."""
    if order is not None:
        df = with_position(df, [order], "_index").select(F.col("_index").alias(index), *df.columns)
    df.write.options(**_CSV).csv(path)


def read_qa(
    spark: SparkSession, path: str, key: str, limit: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Question rows (question, answers): all, or the first `limit` by key, a bounded top-n and not a sort."""
    schema = f"`{key}` bigint, question string, answers array<string>"
    rows = spark.read.format(fmt).schema(schema).load(path)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html); a page without content is skipped."""
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def resume_unprocessed(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `todo` whose key is not in `done`."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")
