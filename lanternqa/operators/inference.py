"""Running a model function over a table of prompts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternqa.functions import prompts, replies
from lanternqa.functions.hashing import text_key
from lanternqa.operators.chunks import token_chunks
from lanternqa.operators.spread import spread_join
from lanternqa.session import exists, materialize
from lanternqa.sources.files import store_of
from lanternqa.sources.traces import write_traces

Complete = Callable[[str], str]
PROMPTS_PER_TASK = 1000
# Completions of a task that go to the store together.
STORED_TOGETHER = 50
STORED = pa.schema([("_key", pa.binary()), ("model", pa.string()), ("reply", pa.string())])


def batched(factory: Callable) -> Callable:
    """Mark a model factory whose function takes a list of prompts and returns as many replies."""
    factory.takes_lists = True
    return factory


def complete_batch(
    df: DataFrame, prompt: str, model: Callable[[], Complete], out: str = "reply", on_error: str = "raise",
    by: list[str] | None = None, partitions: int | None = None, batch: int = 32, log: str | None = None,
    store: str | None = None, name: str = "model",
) -> DataFrame:
    """Add the model's completion of each prompt.

    `model()` runs once per task and returns the function that completes one
    prompt, or a list of up to `batch` prompts if the factory is `batched`, so
    weights load once. The input is written once. Equal prompts are completed
    once: copies are folded before the shuffle and the completions joined back
    with hot prompts split. Tasks follow the number of prompts, so a lost one
    repeats few calls. Completions are written out, so a lost executor or a
    later stage never asks the model again. `by` names key columns that tell
    rows of one prompt apart.

    A failing model ends the run, or with `on_error="mark"` leaves a null
    reply and its message in a column `error`. With `log`, each prompt asked and
    its completion are appended to the trace log at that path.

    With `store`, completions are kept at that path under the model's `name`, and
    a prompt found there is not asked again, by this or any later run. Tasks keep
    what they have every few prompts, so a run that breaks off, with its driver
    even, leaves all that it paid for. A store is read by its keys; it holds for
    one version of a model.
    """
    if on_error not in ("raise", "mark"):
        raise ValueError("on_error is 'raise' or 'mark'")
    lists = getattr(model, "takes_lists", False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = model()

        def some(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(reply, None) for reply in (complete(texts) if lists else [complete(texts[0])])]
            except Exception as failure:
                if on_error == "raise":
                    raise
                if len(texts) == 1:
                    return [(None, f"{type(failure).__name__}: {failure}")]
                return [x for text in texts for x in some([text])]

        size = batch if lists else 1
        for frame in batches:
            texts, keys = frame["_prompt"].tolist(), frame["_key"].tolist()
            told: list[tuple[str | None, str | None]] = []
            kept = 0
            try:
                for at in range(0, len(texts), size):
                    told += some(texts[at : at + size])
                    if store is not None and len(told) - kept >= STORED_TOGETHER:
                        keep_completions(store, name, keys[kept : len(told)], told[kept:])
                        kept = len(told)
            finally:
                if store is not None and kept < len(told):
                    keep_completions(store, name, keys[kept : len(told)], told[kept:])
            yield pd.DataFrame(
                {"_key": frame["_key"], "_prompt": texts, out: [x[0] for x in told], "_error": [x[1] for x in told]}
            )

    keyed = materialize(df.withColumn("_key", text_key(prompt)), "prompts")
    distinct = keyed.filter(F.col(prompt).isNotNull()).select("_key", F.col(prompt).alias("_prompt")).distinct()
    before = None
    if store is not None and exists(df.sparkSession, store):
        held = stored_completions(df.sparkSession, store, name).withColumnRenamed("reply", out)
        before = materialize(distinct.join(held, "_key"), "known-completions")
        distinct = materialize(distinct.join(before.select("_key"), "_key", "left_anti"), "open-prompts")
    if partitions is None:
        n = distinct.agg(F.approx_count_distinct("_key").alias("n")).first()["n"]
        partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PROMPTS_PER_TASK))
    schema = f"_key binary, _prompt string, `{out}` string, _error string"
    done = materialize(distinct.repartition(partitions, "_key").mapInPandas(run, schema), "completions")
    if log is not None:
        write_traces(done.filter(F.col(out).isNotNull()), log, "_prompt", out)
    if before is not None:
        done = done.unionByName(before.withColumn("_error", F.lit(None).cast("string")))
    told = done.select("_key", out, *([F.col("_error").alias("error")] if on_error == "mark" else []))
    return spread_join(keyed, told, ["_key"], "left", by).drop("_key")


def keep_completions(store: str, name: str, keys: list[bytes], told: list[tuple[str | None, str | None]]) -> None:
    """Add a task's completions to a store, as one file that is there whole or not at all."""
    rows = [(key, name, reply) for key, (reply, error) in zip(keys, told) if error is None]
    if not rows:
        return
    files, root = store_of(store)
    files.create_dir(root, recursive=True)
    part = uuid.uuid4().hex
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), STORED)], schema=STORED)
    pq.write_table(table, f"{root}/_{part}", filesystem=files)  # readers pass over names like this one
    files.move(f"{root}/_{part}", f"{root}/{part}.parquet")


def stored_completions(spark: SparkSession, store: str, name: str) -> DataFrame:
    """(_key, reply) of one model. A task that ran twice has left two completions, of which one counts."""
    rows = spark.read.schema("_key binary, model string, reply string").parquet(store).filter(F.col("model") == name)
    return rows.groupBy("_key").agg(F.min("reply").alias("reply"))


def any_sufficient(replies: DataFrame, by: list[str], flag: str = "is_sufficient") -> DataFrame:
    """Whether any chunk of a group was judged sufficient; no verdict counts as no."""
    return replies.groupBy(*by).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("any_sufficient"))


def judge_sufficiency(
    evidence: DataFrame, key: list[str], model: Callable[[], Complete], size: int, question: str = "question",
    text: str = "text", log: str | None = None, store: str | None = None,
) -> DataFrame:
    """Whether the model finds any chunk of up to `size` tokens of a row's text sufficient: `key`, any_sufficient.

    A row without text has no chunk and no verdict.
    """
    chunks = token_chunks(evidence, text, size, keep=[*key, question])
    asked = chunks.select(
        *key, "chunk_no",
        prompts.render_prompt(prompts.SUFFICIENCY, F.col(question), F.col("chunk")).alias("prompt"),
    )
    told = complete_batch(asked, "prompt", model, by=[*key, "chunk_no"], log=log, store=store, name="judge")
    verdict = replies.parse_reply(F.col("reply"), replies.SUFFICIENCY)["is_sufficient"]
    return any_sufficient(told.select(*key, verdict.alias("is_sufficient")), key)


def model_keywords(
    questions: DataFrame, model: Callable[[], Complete], log: str | None = None, store: str | None = None
) -> DataFrame:
    """All keywords that the model names for each question (q_id, question): q_id, keywords."""
    asked = questions.select("q_id", prompts.render_prompt(prompts.KEYWORDS, F.col("question")).alias("prompt"))
    told = complete_batch(asked, "prompt", model, by=["q_id"], log=log, store=store, name="keywords")
    return told.select("q_id", replies.parse_reply(F.col("reply"), replies.KEYWORDS)["keywords"].alias("keywords"))
