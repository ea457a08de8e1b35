"""Scoring a model on logged exchanges, or answers on a question set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.functions.similarity import token_sort_ratio
from lanternqa.functions.text import clean_reply, wrap_chat_turn
from lanternqa.operators.inference import Complete, complete_batch
from lanternqa.operators.scoring import best_option_score, compare_models, spread_rows
from lanternqa.session import exists, materialize
from lanternqa.sources.tables import resume_unprocessed


def evaluate_model(
    rows: DataFrame, key: list[str], model: Callable[[], Complete], reply: str = "llm_response",
    score: str = "similarity_score",
) -> DataFrame:
    """Add a model's reply to each prompt and its token-sort score against the logged response.

    `rows` holds `key`, prompt and response; the model returns the whole turn,
    prompt included. Run again on the result with other column names to put a
    tuned model beside the base one.
    """
    told = complete_batch(rows.withColumn("_turn", wrap_chat_turn(F.col("prompt"))), "_turn", model, "_said", by=key)
    replied = spread_rows(told.withColumn(reply, clean_reply(F.col("_said"))).drop("_turn", "_said"))
    return replied.withColumn(score, token_sort_ratio(F.col(reply), F.col("response")))


def compare_replies(
    rows: DataFrame, key: list[str], base: Callable[[], Complete], tuned: Callable[[], Complete]
) -> tuple[DataFrame, DataFrame]:
    """Both models' replies and scores on the same logged exchanges, and their means over all rows."""
    first = evaluate_model(rows, key, base)
    both = materialize(
        evaluate_model(first, key, tuned, "llm_response_tuned", "similarity_score_tuned"), "compared"
    )
    return both, compare_models(both, both, key)


def evaluate_questions(
    qa: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], key: str = "q_id"
) -> DataFrame:
    """Answer and score the questions of a set that are not scored yet, append them, and return all scores.

    `qa` is (`key`, question, answers); `work` answers (`key`, question) rows
    with (`key`, answer). The table at `done_path` may not exist yet; a run that
    was broken off goes on where it ended. An unanswered question scores 0.
    """
    spark = qa.sparkSession
    todo = qa
    if exists(spark, done_path):
        todo = resume_unprocessed(qa, spark.read.parquet(done_path), [key])
    todo = materialize(todo, "questions")
    if not todo.isEmpty():
        answered = todo.select(key).join(work(todo.select(key, "question")), key, "left")
        evaluate_answers(todo, answered, key).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def evaluate_answers(qa: DataFrame, answered: DataFrame, key: str = "q_id") -> DataFrame:
    """question, answer, dataset_answers and token_set_ratio of each answered question.

    `qa` is (`key`, question, answers), `answered` is (`key`, answer).
    """
    rows = qa.join(answered.select(key, "answer"), key)
    scores = best_option_score(rows, [key], "answer", "answers")
    return rows.join(scores, key).select(
        key, "question", "answer", F.array_join("answers", " ").alias("dataset_answers"), "token_set_ratio"
    )
