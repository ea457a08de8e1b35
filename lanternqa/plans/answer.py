"""Answering: decompose first, or hop by hop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.functions import prompts, replies
from lanternqa.functions import text as tx
from lanternqa.functions.hashing import text_key
from lanternqa.operators.hops import decompose_questions
from lanternqa.operators.inference import complete_batch
from lanternqa.operators.readers import best_piece, sentence_questions
from lanternqa.operators.retrieval import per_question
from lanternqa.operators.spread import spread_join
from lanternqa.plans.gather import (
    MODEL_LIMIT, Model, evidence_windows, gather_distinct, index_of, relevant_information,
)
from lanternqa.session import materialize


def ask_followups(
    model: Model, log: str | None = None, store: str | None = None
) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Follow-ups of a level of questions, from the model: root, followup."""

    def expand(level: DataFrame, reached: DataFrame) -> DataFrame:
        before = F.array_sort(F.collect_list(F.struct("depth", "question")))
        asked = reached.groupBy("root").agg(F.transform(before, lambda x: x["question"]).alias("asked"))
        todo = spread_join(level, asked, ["root"], by=["question"]).select(
            "root", "question", prompts.followup_context(F.col("question"), F.col("asked")).alias("prompt")
        )
        told = complete_batch(todo, "prompt", model, by=["root", "question"], log=log, store=store, name="planner")
        reply = replies.parse_reply(F.col("reply"), replies.DECOMPOSE)
        return told.select("root", reply.alias("r")).filter("r.needs_followup").select(
            "root", F.explode("r.questions").alias("followup")
        )

    return expand


def answer_from(
    known: DataFrame, key: str, answerer: Model, limit: int, sep: str = ". ", log: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Answer each (`key`, question, information) from all its information: `key`, answer.

    Information that does not fit into one prompt of `limit` characters is cut
    into pieces that do. Each piece is answered, and the question is then
    answered from these answers, until they fit. Answers that are no shorter
    than what they were made of are joined as they are.
    """
    bare = F.length(prompts.render_prompt(prompts.ANSWER, F.col("question"), F.lit("")))
    room = F.greatest(F.lit(limit) - bare, F.lit(1))
    todo = materialize(known.select(key, "question", "information", F.lit(None).cast("int").alias("before")), "known")
    done = []
    while True:
        size = F.ceil(F.length("information") / room).cast("int")
        sized = todo.withColumn("pieces", F.greatest(size, F.lit(1))).withColumn("room", room)
        stuck = F.coalesce((F.col("before") > 1) & (F.col("pieces") >= F.col("before")), F.lit(False))
        done.append(sized.filter(stuck).select(key, F.col("information").alias("answer")))
        cut = sized.filter(~stuck).select(
            key, "question", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            "information", "room",
        )
        part = F.substring(F.col("information"), F.col("piece") * F.col("room") + 1, F.col("room"))
        asked = cut.select(
            key, "question", "pieces", "piece", prompts.render_prompt(prompts.ANSWER, F.col("question"), part).alias("prompt")
        )
        told = complete_batch(asked, "prompt", answerer, by=[key, "piece"], log=log, store=store, name="answerer")
        answer = replies.parse_reply(F.col("reply"), replies.ANSWER)["answer"]
        told = materialize(told.select(key, "question", "pieces", "piece", answer.alias("answer")), "answers")
        done.append(told.filter("pieces = 1").select(key, "answer"))
        more = told.filter("pieces > 1")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        in_order = F.array_sort(F.collect_list(F.struct("piece", "answer")))
        joined = F.array_join(F.transform(in_order, lambda x: x["answer"]), sep)  # a null answer adds nothing
        todo = materialize(
            more.groupBy(key, "question", F.col("pieces").alias("before")).agg(joined.alias("information")), "known"
        )


def answer_question(
    questions: DataFrame, texts: DataFrame, planner: Model = sentence_questions, reader: Model | None = None,
    answerer: Model | None = None, k: int = 2, n: int = 25, n_keywords: int | None = None, max_depth: int | None = None,
    limit: int = MODEL_LIMIT, log: str | None = None, store: str | None = None, **options,
) -> DataFrame:
    """Split each question into its parts, gather on every part, answer from all: q_id, answer.

    Copies of a question are answered once, and a part that several questions
    share is searched once. Findings keep the order of the chunks they come
    from. Every question has a row; one without text has a null answer.
    With a `store` no prompt is asked twice, by later runs either. `options` go
    to `evidence_windows`.
    """
    reader = reader or best_piece("relevant_information", "---")
    answerer = answerer or best_piece("answer", ". ")

    def work(once: DataFrame) -> DataFrame:
        roots = once.withColumnRenamed("q_id", "root")
        parts = decompose_questions(roots, ask_followups(planner, log, store), max_depth).select(
            "root", "question", text_key("question").alias("q_id")
        )
        once_each = parts.select("q_id", "question").distinct()
        windows = evidence_windows(once_each, texts, k, n, n_keywords, " ", log=log, store=store, **options)
        found = spread_join(parts, materialize(windows, "windows"), ["q_id"], "left", by=["root"])
        in_order = F.array_sort(F.collect_list(F.struct("question", F.coalesce("windows", F.lit("")).alias("w"))))
        evidence = found.groupBy("root").agg(in_order.alias("p")).select(
            "root",
            F.array_join(F.transform("p", lambda x: x["question"]), " ").alias("question"),
            F.array_join(F.transform("p", lambda x: x["w"]), "").alias("text"),
        )
        told = relevant_information(materialize(evidence, "evidence"), ["root"], reader, limit, in_order=True, log=log, store=store)
        known = roots.join(told, "root", "left").withColumn("information", F.coalesce("information", F.lit("")))
        return answer_from(known, "root", answerer, limit, log=log, store=store).withColumnRenamed("root", "q_id")

    return per_question(questions, work, "left").select("q_id", "answer")


def multi_hop_answer(
    questions: DataFrame, texts: DataFrame, reasoner: Model, reader: Model | None = None, max_hops: int | None = None,
    k: int = 2, n: int = 100, n_keywords: int | None = None, examples: str = prompts.FEW_SHOT, limit: int = MODEL_LIMIT,
    log: str | None = None, store: str | None = None, **options,
) -> DataFrame:
    """Let the model ask follow-ups until it answers: q_id, answer, hops, forced.

    All open questions advance together, one batch per hop; copies of a
    question are one. The corpus is indexed once, before the first hop. A hop
    ends in a written table, so no hop is ever run twice and the plan stays
    short. Questions that stop asking leave the batch. With `max_hops`, those
    still asking after it are made to answer, and marked `forced`. Every
    question has a row; one without text has only nulls. With a `store` of
    completions, a run that was broken off at any hop is taken up by calling
    again: hops already paid for ask no prompt twice. `options` go to
    `evidence_windows`.
    """
    options.setdefault("index", index_of(texts))

    def ask(state: DataFrame, stops: str | list[str]) -> DataFrame:
        told = complete_batch(state, "prompt", reasoner, out="response", by=["q_id"], log=log, store=store, name="reasoner")
        return told.withColumn("response", tx.truncate_at_stop(F.coalesce("response", F.lit("")), stops))

    def gather(state: DataFrame, hop: int) -> DataFrame:
        """Prompts grown by what the corpus says on each row's follow-up; an equal follow-up is gathered once."""
        asked = materialize(state.withColumn("part", text_key("question")), f"hop-{hop}-questions")
        once = asked.select(F.col("part").alias("q_id"), "question").distinct()
        found = gather_distinct(once, texts, reader, k, n, n_keywords, limit, log=log, store=store, **options)
        info = found.withColumnRenamed("q_id", "part")
        finding = F.concat(F.lit("\n" + tx.INTERMEDIATE + " "), F.coalesce("information", F.lit("")))
        grown = spread_join(asked, info, ["part"], "left", by=["q_id"])
        return materialize(
            grown.select("q_id", F.concat("prompt", "response", finding).alias("prompt")), f"hop-{hop}-prompts"
        )

    def work(once: DataFrame) -> DataFrame:
        start = once.select("q_id", prompts.few_shot_prompt(F.col("question"), examples).alias("prompt"))
        state = materialize(ask(start, tx.INTERMEDIATE), "hop-0")
        finished, hop = [], 0
        while True:
            followup = tx.followup_question(F.col("response"))
            ended = state.filter(followup.isNull())
            finished.append(ended.withColumn("hops", F.lit(hop)).withColumn("forced", F.lit(False)))
            state = state.filter(followup.isNotNull())
            if hop == max_hops or state.isEmpty():
                finished.append(state.withColumn("hops", F.lit(hop)).withColumn("forced", F.lit(True)))
                break
            hop += 1
            grown = gather(state.withColumn("question", followup), hop)
            state = materialize(ask(grown, tx.INTERMEDIATE), f"hop-{hop}")

        ended = reduce(DataFrame.unionByName, finished)
        concluded = F.contains(F.col("response"), F.lit(tx.FINAL.rstrip()))
        said = ended.filter(concluded).select("q_id", "hops", "forced", "response")
        led = ended.filter(~concluded).select(
            "q_id", "hops", "forced", F.concat("prompt", F.lit("\n" + tx.FINAL)).alias("prompt")
        )
        led = ask(led, "\n").select("q_id", "hops", "forced", "response")
        return said.unionByName(led).select("q_id", tx.final_answer(F.col("response")).alias("answer"), "hops", "forced")

    return per_question(questions, work, "left").select("q_id", "answer", "hops", "forced")
