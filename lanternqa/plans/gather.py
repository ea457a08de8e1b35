"""Evidence for a question: search, keywords, windows, relevance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.functions import prompts, replies
from lanternqa.functions import text as tx
from lanternqa.functions.tokens import token_budget
from lanternqa.operators.chunks import model_token_chunks, token_chunks
from lanternqa.operators.inference import Complete, complete_batch, model_keywords
from lanternqa.operators.readers import best_piece
from lanternqa.operators.retrieval import (
    CorpusIndex, corpus_index, distinct_join, index_keywords, index_terms, join_pages, keyword_lists, ordered_join,
    per_question, search_index,
)
from lanternqa.session import materialize

MODEL_LIMIT = 4096
# Tokens kept back for the places where a chunk meets its prompt.
BORDER_TOKENS = 4
WINDOW_SEP = "---"

Model = Callable[[], Complete]
# From questions (q_id, question) to hits (q_id, rank, page_id).
Search = Callable[[DataFrame], DataFrame]


def evidence_windows(
    questions: DataFrame, texts: DataFrame, k: int = 2, n: int = 100, n_keywords: int | None = None, sep: str = WINDOW_SEP,
    index: CorpusIndex | None = None, keywords: Model | None = None, search: Search | None = None,
    log: str | None = None, store: str | None = None,
) -> DataFrame:
    """Keyword windows over each question's best pages: q_id, windows.

    The corpus, or its `index` if one is given, is read once for search and
    keywords together. Page text meets only the questions it was found for, and
    the windows of a question are cut and joined inside one row. `keywords` is a
    model all of whose keywords are used; without one they are the question's
    words that the corpus holds, weightiest first, or the first `n_keywords` of
    them. `search` replaces the plain search for the `k` best pages.
    """
    terms = None if keywords and search else index_terms(questions, index or texts.select("page_id", "text"))
    hits = materialize(search(questions) if search else search_index(terms, k), "hits")
    words = model_keywords(questions, keywords, log, store) if keywords else keyword_lists(index_keywords(terms, n_keywords))
    found = join_pages(hits, texts).join(words, "q_id")
    windows = tx.keyword_windows(F.col("page_text"), F.col("keywords"), n)
    return found.select("q_id", tx.merge_windows(windows, sep).alias("windows"))


def relevant_information(
    evidence: DataFrame, key: list[str], model: Model, limit: int = MODEL_LIMIT, in_order: bool = False,
    log: str | None = None, vocabulary: tuple[str, str] | None = None, store: str | None = None,
) -> DataFrame:
    """Ask the model what matters in each chunk of (`key`, question, text): `key`, information.

    Unusable replies are dropped. Findings are joined in the order of their
    chunks, copies included, or else as a sorted set. With the model's own
    `vocabulary`, the path of its ranks and its pattern, `limit` is in its
    tokens, and chunks are exact slices that fill what a prompt leaves of it;
    otherwise it is in characters, and chunks are of words.
    """
    base = prompts.render_prompt(prompts.RELEVANCE, F.col("question"), F.lit(""))
    kept = [*key, "question"]
    if vocabulary is None:
        chunks = token_chunks(evidence, "text", tx.chunk_budget(limit, base, 1), keep=kept)
    else:
        room = token_budget(limit, base, *vocabulary, BORDER_TOKENS)
        chunks = model_token_chunks(evidence.filter("text <> ''"), "text", room, *vocabulary, keep=kept)
    asked = chunks.select(
        *key, "chunk_no",
        prompts.render_prompt(prompts.RELEVANCE, F.col("question"), F.col("chunk")).alias("prompt"),
    )
    told = complete_batch(asked, "prompt", model, by=[*key, "chunk_no"], log=log, store=store, name="reader")
    reply = replies.parse_reply(F.col("reply"), replies.RELEVANCE)["relevant_information"]
    found = told.select(*key, "chunk_no", reply.alias("information"))
    return ordered_join(found, key, "chunk_no", "information") if in_order else distinct_join(found, key, "information")


def gather_distinct(
    questions: DataFrame, texts: DataFrame, model: Model | None = None, k: int = 2, n: int = 100,
    n_keywords: int | None = None, limit: int = MODEL_LIMIT, vocabulary: tuple[str, str] | None = None, **options,
) -> DataFrame:
    """`gather_info` for questions already known to differ; those without a finding have no row."""
    model = model or best_piece("relevant_information", WINDOW_SEP)
    windows = evidence_windows(questions, texts, k, n, n_keywords, **options)
    evidence = materialize(questions.join(windows.withColumnRenamed("windows", "text"), "q_id"), "evidence")
    return relevant_information(
        evidence, ["q_id"], model, limit, log=options.get("log"), vocabulary=vocabulary, store=options.get("store")
    )


def gather_info(
    questions: DataFrame, texts: DataFrame, model: Model | None = None, k: int = 2, n: int = 100,
    n_keywords: int | None = None, limit: int = MODEL_LIMIT, **options,
) -> DataFrame:
    """What the corpus (page_id, text) says on each question (q_id, question): q_id, information.

    Every question has a row; the information is empty if nothing was found, or
    if the question has no text. Copies of a question are searched, cut and put
    to the model once. `limit` is what one prompt may hold, in characters, or in
    tokens with `vocabulary=` (see `relevant_information`). Other `options` go to
    `evidence_windows`: an index of the corpus, a model for keywords, another
    search, a trace log, a store of completions.
    """
    found = per_question(
        questions, lambda once: gather_distinct(once, texts, model, k, n, n_keywords, limit, **options), "left"
    )
    return found.select("q_id", F.coalesce("information", F.lit("")).alias("information"))


def index_of(texts: DataFrame) -> CorpusIndex:
    """The index of page texts (page_id, text) for flows that search more than once."""
    return corpus_index(texts.select("page_id", "text"))
