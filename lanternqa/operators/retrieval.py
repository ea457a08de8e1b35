"""Ranked search, keywords and evidence joining."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lanternqa.functions.hashing import text_key
from lanternqa.functions.text import WORD, words
from lanternqa.operators.spread import copy_keys, grid_join, hot_keys, rows_of_bytes, split_keys, spread_join
from lanternqa.session import fits_broadcast, materialize

# The published BM25 parameters, and the whole units per point in
# which scores are added, so that sums do not depend on their order.
K1 = 1.2
B = 0.75
UNITS = 1_000_000

# None of these changes a result. Weightiest terms of a question that seed its bound.
SEED_TERMS = 8
# Up to this many (question, term, text) matches a core, all are scored at once.
DIRECT_MATCHES = 2_000_000
# Largest product of two maps' sizes that is joined by looking up each key.
LOOKUP_CELLS = 10_000


def query_terms(queries: DataFrame, question: str = "question") -> DataFrame:
    """(q_id, term, n, first_pos, surface): a question's distinct words."""
    surface = F.regexp_extract_all(F.col(question), F.lit(WORD), F.lit(0))
    return (
        queries.select("q_id", F.posexplode(surface).alias("pos", "surface"))
        .groupBy("q_id", F.lower("surface").alias("term"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
            F.min_by("surface", "pos").alias("surface"),
        )
    )


def _with_terms(rows: DataFrame, terms: DataFrame, on: str, by: list[str], small: bool) -> DataFrame:
    if small:
        return rows.join(F.broadcast(terms), on)
    return spread_join(rows, terms, [on], by=by)


def per_question(
    queries: DataFrame, work: Callable[[DataFrame], DataFrame], how: str = "inner"
) -> DataFrame:
    """Do `work` once per distinct question text and give its rows to all who ask it.

    `work` sees (q_id, question) with a text key as q_id. Copies fold before
    the shuffle; the way back splits a text that very many ask. With
    `how="left"` a question without result, or without text, keeps one row.
    """
    key = text_key("question")
    once = queries.filter(F.col("question").isNotNull()).select(key.alias("q_id"), "question").distinct()
    found = work(once).withColumnRenamed("q_id", "_text")
    asked = queries.select("q_id", key.alias("_text"))
    return spread_join(asked, found, ["_text"], how, by=["q_id"]).drop("_text")


@dataclass
class CorpusIndex:
    """The words of a corpus, counted once: any number of searches and keyword rankings read only this."""

    words: DataFrame  # doc, dl, term, tf
    n_docs: int
    mean_len: float
    doc: str


def corpus_index(corpus: DataFrame, doc: str = "page_id", terms: DataFrame | None = None) -> CorpusIndex:
    """Read a corpus (`doc`, text) once and write its word counts.

    Texts and words are counted on the way. Rows without `doc` are no texts.
    With `terms` (term), a table measured small, only these are written.
    """
    seen = Observation()
    cut = corpus.filter(F.col(doc).isNotNull()).select(doc, words(F.coalesce("text", F.lit(""))).alias("ws"))
    counted = cut.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.size("ws")).alias("words"))
    exploded = counted.select(doc, F.size("ws").alias("dl"), F.explode("ws").alias("term"))
    if terms is not None:
        exploded = exploded.join(F.broadcast(terms), "term", "left_semi")
    kept = materialize(exploded.groupBy(doc, "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "corpus-words")
    # An empty result can take the counting out of the plan; then nothing can be found and nothing is rated.
    n, total = (0, 0) if kept.isEmpty() else (seen.get["n"], seen.get["words"] or 0)
    return CorpusIndex(kept, n, total / max(n, 1) or 1.0, doc)


def part_index(index: CorpusIndex, ids: DataFrame) -> CorpusIndex:
    """The index of some of the texts, by their ids, from that of all: as if only these had been indexed."""
    own = materialize(ids.select(index.doc).filter(F.col(index.doc).isNotNull()).distinct(), "part-ids")
    words = materialize(_of_ids(index.words, own, index.doc), "part-words")
    sizes = words.select(index.doc, "dl").distinct().agg(F.sum("dl").alias("n")).first()["n"] or 0
    n = own.count()
    return CorpusIndex(words, n, sizes / max(n, 1) or 1.0, index.doc)


@dataclass
class TermIndex:
    """A corpus seen through the words of some questions."""

    postings: DataFrame  # doc, term_id, weight
    rated: DataFrame  # q_id, term_id, n, first_pos, surface, df, idf, most
    n_docs: int
    small: bool  # the question words were measured to fit a broadcast
    doc: str


def index_terms(queries: DataFrame, corpus: DataFrame | CorpusIndex, doc: str = "page_id") -> TermIndex:
    """What a corpus, or its index, holds of the words of (q_id, question), in written tables.

    A corpus (`doc`, text) that is searched once is read once, for these words
    only; one that is searched again should be indexed before.
    """
    terms = materialize(query_terms(queries), "question-terms")
    small = fits_broadcast(terms)
    # written, since the ids would differ from one computation to the next
    vocab = materialize(
        terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary"
    )
    if not isinstance(corpus, CorpusIndex):
        corpus = corpus_index(corpus, doc, vocab.select("term") if small else None)
    doc, n_docs = corpus.doc, corpus.n_docs
    tf = F.col("tf")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / corpus.mean_len))
    postings = materialize(
        _with_terms(corpus.words, vocab, "term", [doc], small).select(doc, "term_id", weight.alias("weight")), "postings"
    )

    stats = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = vocab.join(stats, "term_id").select(
        "term", "term_id", "df", idf.alias("idf"), _units(idf, F.col("top")).alias("most")
    )
    rated = materialize(_with_terms(terms, stats, "term", ["q_id"], small).drop("term"), "rated-terms")
    return TermIndex(postings, rated, n_docs, small, doc)


def search_top_k(
    queries: DataFrame, corpus: DataFrame | CorpusIndex, k: int = 2, doc: str = "page_id", direct: int | None = None
) -> DataFrame:
    """The `k` best texts for each question by BM25: q_id, rank, `doc`, score.

    `queries` is (q_id, question), `corpus` is (`doc`, text) or its index. Ties
    go to the smaller `doc`. A question asked many times is searched once.
    `direct` is the number of matches a core up to which all are scored.
    """
    return per_question(queries, lambda once: search_index(index_terms(once, corpus, doc), k, direct)).select(
        "q_id", "rank", doc, "score"
    )


def search_index(index: TermIndex, k: int, direct: int | None = None) -> DataFrame:
    """The `k` best texts of each indexed question.

    The matches are counted from the terms' statistics: if they are few for
    the cores at hand, each is scored; else the pruned way, with the same
    result, forms only a fraction of them.
    """
    postings, rated, doc, small = index.postings, index.rated, index.doc, index.small
    matches = rated.agg(F.sum("df").alias("n")).first()["n"] or 0
    limit = DIRECT_MATCHES if direct is None else direct
    if matches <= limit * rated.sparkSession.sparkContext.defaultParallelism:
        scored = _score_terms(postings, rated, doc, small)
    else:
        scored = _score_pruned(postings, rated, k, doc, small)
    return (
        scored.withColumn("rank", F.row_number().over(_best_first(doc))).filter(F.col("rank") <= k)
        .select("q_id", "rank", doc, (F.col("score") / UNITS).alias("score"))
    )


def _score_pruned(postings: DataFrame, rated: DataFrame, k: int, doc: str, small: bool) -> DataFrame:
    """Full scores of every text that can be among a question's `k` best.

    1. Each term's best `k` texts give seed texts per question, whose full
       scores bound the k-th best score from below.
    2. A question's commonest terms whose highest possible contributions add
       up to less than that bound cannot lift a text into the result alone, so
       candidates come from the other terms.
    3. Candidates that cannot reach the bound even with all the common terms
       are dropped before those are looked up.

    Each step ends in a written table that the next ones read.
    """
    ranked = Window.partitionBy("term_id").orderBy(F.desc("weight"), doc)
    leaders = postings.withColumn("pos", F.row_number().over(ranked)).filter(F.col("pos") <= k)
    heavy = Window.partitionBy("q_id").orderBy(F.desc("most"), "term_id")
    lead = rated.withColumn("pos", F.row_number().over(heavy)).filter(F.col("pos") <= SEED_TERMS)
    seeds = spread_join(lead.select("q_id", "term_id"), leaders.select("term_id", doc), ["term_id"], by=["q_id"])
    seeds = materialize(seeds.select("q_id", doc).distinct(), "seeds")
    seeds = _add_terms(seeds.withColumn("score", F.lit(0).cast("long")), rated, postings, doc, small)
    bound = (
        seeds.withColumn("pos", F.row_number().over(_best_first(doc))).filter(F.col("pos") == k)
        .select("q_id", F.col("score").alias("bound"))
    )

    light = Window.partitionBy("q_id").orderBy("most", "term_id").rowsBetween(Window.unboundedPreceding, 0)
    split = (
        rated.select("q_id", "term_id", "idf", "most").join(bound, "q_id", "left")
        .withColumn("bound", F.coalesce("bound", F.lit(0)))
        .withColumn("upto", F.sum("most").over(light))
        .withColumn("essential", F.col("upto") >= F.col("bound"))
    )
    split = materialize(split, "split-terms")
    spare = split.groupBy("q_id").agg(
        F.max("bound").alias("bound"),
        F.sum(F.when(F.col("essential"), 0).otherwise(F.col("most"))).alias("spare"),
    )
    found = _score_terms(postings, split.filter("essential"), doc, small)
    if not small:  # read twice below
        found = materialize(found, "found")
    live = (
        _with_terms(found, spare, "q_id", [doc], small)
        .filter(F.col("score") + F.col("spare") >= F.col("bound")).select("q_id", doc, "score")
    )
    live = materialize(live, "candidates")
    return _add_terms(live, split.filter("NOT essential"), postings, doc, small)


def _best_first(doc: str) -> WindowSpec:
    return Window.partitionBy("q_id").orderBy(F.desc("score"), doc)


def _score_terms(postings: DataFrame, rated: DataFrame, doc: str, small: bool) -> DataFrame:
    """Add up the given terms' contributions for every text that holds one."""
    asked = rated.select("q_id", "term_id", "idf")
    if small:
        matched = postings.join(F.broadcast(asked), "term_id")
    else:  # a term may fill most texts and most questions
        matched = grid_join(postings, asked, ["term_id"], [doc], ["q_id"])
    return matched.groupBy("q_id", doc).agg(F.sum(_units(F.col("idf"), F.col("weight"))).alias("score"))


def _of_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows with one of some ids, which were written: filtered in place if the ids were measured small."""
    return rows.join(F.broadcast(ids) if fits_broadcast(ids) else ids, on, "left_semi")


def _units(idf: Column, weight: Column) -> Column:
    return F.floor(idf * weight * UNITS + 0.5)


def _add_terms(pairs: DataFrame, rated: DataFrame, postings: DataFrame, doc: str, small: bool) -> DataFrame:
    """Add the given terms' contributions to the score of each (q_id, doc, score).

    A text's weights for these terms come to its pairs as one map and meet the
    question's map inside the row, so pairs are never multiplied by terms. A
    text wanted by very many questions is split by question.
    """
    vocab = rated.select("term_id").distinct()
    # Only texts that are in a pair get a map.
    own = _of_ids(postings, materialize(pairs.select(doc).distinct(), "paired"), doc)
    wanted = (
        own.join(F.broadcast(vocab), "term_id", "left_semi") if small else spread_join(own, vocab, ["term_id"], by=[doc])
    )
    entries = F.map_from_entries(F.collect_list(F.struct("term_id", "weight")))
    texts = wanted.groupBy(doc).agg(entries.alias("_weights"))
    asked = rated.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("term_id", "idf"))).alias("_idfs"))
    if small:
        both = spread_join(pairs, texts, [doc], "left", by=["q_id"]).join(F.broadcast(asked), "q_id", "left")
    else:
        mapped = spread_join(pairs, asked, ["q_id"], "left", by=[doc])
        hot = hot_keys(pairs, [doc])
        both = split_keys(mapped, hot, [doc], ["q_id"], "_piece").join(
            copy_keys(texts, hot, [doc], "_piece"), [doc, "_piece"], "left"
        )
    zero = F.lit(0).cast("long")
    looked_up = F.aggregate(
        F.map_entries("_idfs"), zero,
        lambda total, e: total + F.coalesce(_units(e["value"], F.try_element_at("_weights", e["key"])), F.lit(0)),
    )
    zipped = F.map_zip_with("_idfs", "_weights", lambda _, idf, weight: F.coalesce(_units(idf, weight), F.lit(0)))
    hashed = F.aggregate(F.map_values(zipped), zero, lambda total, x: total + x)
    # a look-up reads a small map faster than hashing both; large ones are hashed
    more = F.when(F.size("_idfs") * F.size("_weights") <= LOOKUP_CELLS, looked_up).otherwise(hashed)
    return both.select("q_id", doc, (F.col("score") + F.coalesce(more, F.lit(0))).alias("score"))


def on_site(url: Column, site: str) -> Column:
    """Whether a URL's host is the site or lies below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return (host == site.lower()) | host.endswith("." + site.lower())


def search_site(
    queries: DataFrame, corpus: DataFrame, site: str, k: int = 1, doc: str = "page_id", url: str = "url"
) -> DataFrame:
    """Search the pages of one site only; the filter runs before anything is ranked."""
    return search_top_k(queries, corpus.filter(on_site(F.col(url), site)).select(doc, "text"), k, doc)


def search_site_plus_general(
    queries: DataFrame, corpus: DataFrame, site: str, doc: str = "page_id", url: str = "url",
    index: CorpusIndex | None = None,
) -> DataFrame:
    """The site's best page first, the best page of all second; a page may come twice.

    Both searches share one index of the corpus, which is read for it once; with
    an `index` given, only the URLs are read.
    """
    whole = index or corpus_index(corpus.select(doc, "text"), doc)
    own = part_index(whole, corpus.filter(on_site(F.col(url), site)))
    first = search_top_k(queries, own, 1, doc).withColumn("source_rank", F.lit(1))
    second = search_top_k(queries, whole, 1, doc).withColumn("source_rank", F.lit(2))
    return first.unionByName(second).withColumn("rank", F.col("source_rank"))


def ordered_join(df: DataFrame, by: list[str], order: str, col: str, sep: str = " ") -> DataFrame:
    """One line per group: its snippets in order, copies included. A group only ever holds the text it outputs."""
    kept = df.filter(F.col(col).isNotNull())
    in_order = F.array_sort(F.collect_list(F.struct(order, col)))
    return kept.groupBy(*by).agg(F.array_join(F.transform(in_order, lambda x: x[col]), sep).alias(col))


def require_results(queries: DataFrame, hits: DataFrame, n: int = 2) -> DataFrame:
    """Per question: hits found and whether they are enough. A short one is marked, not raised."""
    counts = hits.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_hits"))
    found = F.coalesce("n_hits", F.lit(0))
    return queries.select("q_id").join(counts, "q_id", "left").select(
        "q_id", found.alias("n_hits"), (found >= n).alias("ok")
    )


def join_pages(hits: DataFrame, texts: DataFrame, doc: str = "page_id") -> DataFrame:
    """Each question's page texts in rank order, joined by a space: q_id, page_text.

    The texts are filtered to the pages that were hit before they are moved. A
    page that answers many questions is split over tasks, by the bytes that its
    copies would weigh; a question has only its top few hits, so its list is short.
    """
    hits = hits.select("q_id", "rank", doc)
    hit = materialize(hits.select(doc).distinct(), "hit-pages")
    found = _of_ids(texts.select(doc, "text"), hit, doc)
    widest = found.agg(F.max(F.octet_length("text")).alias("n")).first()["n"]
    pages = spread_join(hits, found, [doc], by=["q_id", "rank"], hot_rows=rows_of_bytes(widest))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return pages.groupBy("q_id").agg(
        F.array_join(F.transform(in_order, lambda p: p["text"]), " ").alias("page_text")
    )


def distinct_join(df: DataFrame, by: list[str], col: str, sep: str = " ", out: str | None = None) -> DataFrame:
    """One line per group: its distinct snippets, sorted and joined.

    Copies are dropped before and across the shuffle, spread by snippet, so a
    group only ever holds the text it outputs.
    """
    kept = df.filter(F.col(col).isNotNull()).select(*by, col).distinct()
    return kept.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(out or col))


def create_keywords(
    questions: DataFrame, corpus: DataFrame | CorpusIndex, k: int | None = 3, doc: str = "page_id"
) -> DataFrame:
    """Each question's `k` weightiest words by TF-IDF over a corpus or its index, or all: q_id, kw_no, keyword, score.

    The keyword keeps the spelling of its first use in the question. Words the
    corpus lacks are left out, earlier words win ties.
    """
    return index_keywords(index_terms(questions, corpus, doc), k)


def index_keywords(index: TermIndex, k: int | None = 3) -> DataFrame:
    """The same keywords from an index already built; the corpus is not read again."""
    return _best_keywords(index.rated, F.lit(index.n_docs), k)


def _best_keywords(rated: DataFrame, n_docs: Column, k: int | None) -> DataFrame:
    score = F.round(F.col("n") * F.log(1 + n_docs / F.col("df")) * UNITS).cast("long")
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "first_pos")
    ranked = rated.withColumn("score", score).withColumn("kw_no", F.row_number().over(best))
    return (
        (ranked if k is None else ranked.filter(F.col("kw_no") <= k))
        .select("q_id", "kw_no", F.col("surface").alias("keyword"), (F.col("score") / UNITS).alias("score"))
    )


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """Fold ranked keywords into one short array per question: q_id, keywords."""
    in_order = F.array_sort(F.collect_list(F.struct("kw_no", "keyword")))
    return keywords.groupBy("q_id").agg(F.transform(in_order, lambda x: x["keyword"]).alias("keywords"))
