"""Evaluating answers against gold texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternqa.functions.similarity import best_token_set_ratio, token_set_ratio

HUGE_OPTIONS = 10_000


def options_of(answers: str) -> Column:
    """All gold answers joined, then each."""
    return F.array_distinct(F.concat(F.array(F.array_join(answers, " ")), F.col(answers)))


def spread_rows(df: DataFrame) -> DataFrame:
    """Even out rows before scoring: the score costs far more than the move, and
    its cost follows text length squared, which byte-sized partitions do not show."""
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width)


def best_option_score(df: DataFrame, key: list[str], answer: str, answers: str, out: str = "token_set_ratio") -> DataFrame:
    """Best token-set score over each gold answer and all of them joined: `key`, the score.

    The options already lie in their row and are scored there. Only lists of
    more than `HUGE_OPTIONS` spread over the cluster as rows and fold back as a
    partial maximum, so that no answer is a single task's work.
    """
    rows = df.select(*key, F.col(answer).alias("_answer"), options_of(answers).alias("_options"))
    huge = F.size("_options") > HUGE_OPTIONS
    in_row = rows.filter(~huge | F.col("_options").isNull()).select(
        *key, best_token_set_ratio(F.col("_answer"), F.col("_options")).alias(out)
    )
    spread = spread_rows(rows.filter(huge).select(*key, "_answer", F.explode("_options").alias("_option")))
    scored = spread.select(*key, token_set_ratio(F.col("_answer"), F.col("_option")).alias("_score"))
    return in_row.unionByName(scored.groupBy(*key).agg(F.max("_score").alias(out)))


def mean_score(df: DataFrame, score: str, by: list[str] | None = None, out: str = "mean_score") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(score).alias(out))


def compare_models(
    base: DataFrame, tuned: DataFrame, key: list[str], base_score: str = "similarity_score",
    tuned_score: str = "similarity_score_tuned",
) -> DataFrame:
    """Both models' means over the rows both have scored."""
    rows = base.select(*key, base_score).join(tuned.select(*key, tuned_score), key)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(base_score).alias("mean_base"), F.avg(tuned_score).alias("mean_tuned")
    )
