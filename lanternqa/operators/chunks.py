"""Cutting texts into chunks and keyword windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternqa.functions import text as tx
from lanternqa.functions.tokens import token_cuts


def token_chunks(
    df: DataFrame, text: str, size: int | Column, overlap: int = 0, keep: list[str] | None = None
) -> DataFrame:
    """Runs of at most `size` whitespace tokens: `keep` columns, chunk_no, n_tokens, chunk."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    size = F.lit(size) if isinstance(size, int) else size
    step = F.greatest(F.col("_size") - F.lit(overlap), F.lit(1))
    some = df.filter(F.col(text).rlike(tx.TOKEN))
    cut = some.select(*keep, tx.tokens(F.col(text)).alias("_tokens"), size.cast("int").alias("_size"))
    last = F.greatest(F.size("_tokens") - 1 - F.lit(overlap), F.lit(0))
    starts = F.sequence(F.lit(1), last + 1, step)
    runs = F.transform(starts, lambda start: F.slice("_tokens", start, F.col("_size")))
    return (
        cut.select(*keep, F.posexplode(runs).alias("chunk_no", "_run"))
        .select(*keep, "chunk_no", F.size("_run").alias("n_tokens"), F.array_join("_run", " ").alias("chunk"))
    )


def model_token_chunks(
    df: DataFrame, text: str, size: int | Column, path: str, pattern: str, keep: list[str] | None = None
) -> DataFrame:
    """Runs of at most `size` model tokens: `keep` columns, chunk_no, n_tokens, chunk.

    Chunks are slices of the text: in order they join back to it. `path` names
    the vocabulary's ranks, a file that every executor has, and `pattern` its split.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    cuts = token_cuts(F.col(text), size, path, pattern)
    return df.select(*keep, F.posexplode(cuts).alias("chunk_no", "_cut")).select(
        *keep, "chunk_no", F.col("_cut.n_tokens").alias("n_tokens"), F.col("_cut.chunk").alias("chunk")
    )


def keyword_windows(
    docs: DataFrame, text: str, keywords: list[str] | Column, n: int = 100, regex: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per window: `keep` columns, kw_no, keyword, match_no, window.

    `keywords` is one list for all rows or an array column for each row. Either
    way the work stays inside the row: no join and no shuffle. Many keywords are
    found in one pass over a text.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return docs.select(
        *keep, F.inline(tx.keyword_windows(F.col(text), keywords, n, regex))
    )


def relevant_chunks(
    chunks: DataFrame, keywords: list[str] | Column, by: list[str], k: int = 1, chunk: str = "chunk"
) -> DataFrame:
    """The `k` chunks of each text with most keyword hits; chunks without a hit are left out.

    Only the best `k` rows of each task cross the shuffle.
    """
    if not isinstance(keywords, Column):
        keywords = F.array(*[F.lit(x) for x in keywords]).cast("array<string>")
    body = F.col(chunk)

    def hits(keyword: Column) -> Column:
        removed = F.length(body) - F.length(F.replace(body, keyword, F.lit("")))
        return F.when(keyword == "", 0).otherwise((removed / F.length(keyword)).cast("int"))

    counts = F.transform(keywords, hits)
    total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    best = Window.partitionBy(*by).orderBy(F.desc("hits"), "chunk_no")
    ranked = chunks.withColumn("hits", total).withColumn("rank", F.row_number().over(best))
    return ranked.filter((F.col("rank") <= k) & (F.col("hits") > 0))
