"""Text operators over documents, pages and conversations."""

from pyspark.sql import functions as F

from lanternqa.catalog.registry import (
    EXCHANGES_SQL, TEXTS_SQL, TRANSCRIPTS_SQL, clean_sql, documents, exchanges, pages, query, quoted, strip_sql, table, transcripts,
)
from lanternqa.functions import prompts as pr
from lanternqa.functions import text as tx
from lanternqa.functions.tokens import count_tokens
from lanternqa.operators import chunks as ch
from lanternqa.sources.html import page_text as extract_text

KEYWORDS = ["tion", "ou, ", "eau."]
_TOKENS = r"regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')"


@query(f"WITH {TEXTS_SQL} SELECT page_id, text FROM texts")
def page_text(spark, sf):
    return extract_text(pages(spark, sf))


@query(
    f"""SELECT doc_id, {clean_sql('text')} AS cleaned,
  regexp_replace(replace(replace(replace(text, chr(10), ' '), chr(9), ' '), chr(13), ' '), ' +', ' ', 'g') AS collapsed
FROM documents"""
)
def clean_whitespace(spark, sf):
    x = F.col("text")
    return documents(spark, sf).select(
        "doc_id", tx.clean_whitespace(x).alias("cleaned"), tx.clean_whitespace(x, collapse=True).alias("collapsed")
    )


@query(
    f"""WITH {EXCHANGES_SQL} SELECT conv_id, turn,
  replace(replace({strip_sql("string_split('<s>[INST] ' || prompt || ' [/INST] ' || response, '[/INST]')[2]")}, chr(10), ' '), '  ', '') AS reply
FROM exchanges"""
)
def clean_reply(spark, sf):
    turn = F.concat(tx.wrap_chat_turn(F.col("prompt")), F.lit(" "), F.col("response"))
    return exchanges(spark, sf).select("conv_id", "turn", tx.clean_reply(turn).alias("reply"))


def _chunks_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH t AS (SELECT doc_id, {_TOKENS} AS tk FROM documents),
c AS (SELECT doc_id, tk, unnest(range(greatest(len(tk) - 1 - {overlap}, 0) // {step} + 1)) AS chunk_no FROM t WHERE len(tk) > 0)
SELECT doc_id, chunk_no, len(tk[chunk_no * {step} + 1 : chunk_no * {step} + {size}]) AS n_tokens,
  array_to_string(tk[chunk_no * {step} + 1 : chunk_no * {step} + {size}], ' ') AS chunk FROM c"""


@query(_chunks_sql(128, 0), ints=('chunk_no', 'n_tokens'))
def token_chunks(spark, sf):
    return ch.token_chunks(documents(spark, sf), "text", 128, keep=["doc_id"])


@query(_chunks_sql(96, 32), ints=('chunk_no', 'n_tokens'))
def token_chunks_overlap(spark, sf):
    return ch.token_chunks(documents(spark, sf), "text", 96, overlap=32, keep=["doc_id"])


@query("SELECT doc_id, length(text) AS n_chars, sha256(text) AS joined_sha256, true AS within_budget FROM documents")
def model_token_chunks(spark, sf):
    """Chunks of at most 128 tokens of a byte-level vocabulary: joined again they are the text."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    chunks = ch.model_token_chunks(documents(spark, sf), "text", 128, path, pattern, keep=["doc_id"])
    recounted = count_tokens(F.col("chunk"), path, pattern)
    checked = chunks.withColumn("fits", (recounted == F.col("n_tokens")) & (F.col("n_tokens") <= 128))
    in_order = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    joined = F.array_join(F.transform(in_order, lambda x: x["chunk"]), "")
    return checked.groupBy("doc_id").agg(joined.alias("text"), F.bool_and("fits").alias("within_budget")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("joined_sha256"), "within_budget"
    )


_HEAD, _MID, _TAIL = pr.RELEVANCE.partition("{1}")[0], *pr.RELEVANCE.partition("{1}")[2].split("{2}")


@query(
    f"""SELECT item_id,
  greatest(512 - length({quoted(_HEAD)} || text || {quoted(_MID + _TAIL)}) - 1, 1) AS budget FROM benchmark""",
    ints=('budget',),
)
def chunk_budget(spark, sf):
    prompt = pr.render_prompt(pr.RELEVANCE, F.col("text"), F.lit(""))
    return table(spark, sf, "benchmark").select("item_id", tx.chunk_budget(512, prompt, 1).alias("budget"))


# Every pair of two frequent endings: far more keywords than are matched one by one.
MANY_KEYWORDS = KEYWORDS + [f"{a}{b}" for a in ("en", "on", "er", "an", "in", "es") for b in (" a", " t", "d ", "e", "s", ".")]


def _windows_sql(n: int, keywords: list[str] = KEYWORDS) -> str:
    one = [
        f"SELECT doc_id, {i} AS kw_no, {quoted(k)} AS keyword, "
        f"regexp_extract_all(text, '.{{0,{n}}}' || regexp_escape({quoted(k)}) || '.{{0,{n}}}') AS ws FROM documents"
        for i, k in enumerate(keywords)
    ]
    return f"""w AS ({' UNION ALL '.join(one)}),
windows AS (SELECT doc_id, kw_no, keyword, unnest(range(len(ws))) AS match_no, unnest(ws) AS "window" FROM w)"""


@query(f"WITH {_windows_sql(100)} SELECT * FROM windows", ints=('match_no',))
def keyword_windows(spark, sf):
    return ch.keyword_windows(documents(spark, sf), "text", KEYWORDS, 100, keep=["doc_id"])


@query(f"WITH {_windows_sql(40, MANY_KEYWORDS)} SELECT * FROM windows", ints=('kw_no', 'match_no'))
def keyword_windows_many(spark, sf):
    return ch.keyword_windows(documents(spark, sf), "text", MANY_KEYWORDS, 40, keep=["doc_id"])


@query(
    f"""WITH {_windows_sql(25)} SELECT d.doc_id,
  coalesce(string_agg("window", '---' ORDER BY kw_no, match_no), '') AS merged
FROM documents d LEFT JOIN windows USING (doc_id) GROUP BY d.doc_id"""
)
def merge_windows(spark, sf):
    return documents(spark, sf).select(
        "doc_id", tx.merge_windows(tx.keyword_windows(F.col("text"), KEYWORDS, 25)).alias("merged")
    )


_LATER = "list_filter(string_split(transcript, chr(10))[2:], lambda x: x <> '')"
_LAST_SQL = f"""lines AS (SELECT conv_id, turn, transcript,
  CASE WHEN contains(transcript, chr(10)) THEN coalesce({_LATER}[-1], '') ELSE transcript END AS line FROM transcripts)"""


@query(f"WITH {TRANSCRIPTS_SQL}, {_LAST_SQL} SELECT conv_id, turn, line FROM lines")
def last_line(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", tx.last_line(F.col("transcript")).alias("line"))


@query(
    f"""WITH {TRANSCRIPTS_SQL}, {_LAST_SQL},
q AS (SELECT *, regexp_replace(string_split(line, ':')[-1], '^ ', '') AS question FROM lines)
SELECT conv_id, turn, CASE WHEN contains(line, 'Follow up:') AND question LIKE '%?' THEN question END AS question FROM q"""
)
def followup_question(spark, sf):
    return transcripts(spark, sf).select(
        "conv_id", "turn", tx.followup_question(F.col("transcript")).alias("question")
    )


@query(
    rf"""WITH {TRANSCRIPTS_SQL} SELECT conv_id, turn,
  replace(replace(transcript, 'So the final answer is: ', ''), E'No.\n', '') AS answer FROM transcripts"""
)
def final_answer(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", tx.final_answer(F.col("transcript")).alias("answer"))


@query(
    rf"""WITH {TRANSCRIPTS_SQL} SELECT conv_id, turn, substr(transcript, 1, coalesce(list_min(list_filter(
  [instr(transcript, 'ow up:'), instr(transcript, 'Follow up'), instr(transcript, E'\nSo the final answer is:')],
  lambda p: p > 0)) - 1, length(transcript))) AS completion FROM transcripts"""
)
def truncate_at_stop(spark, sf):
    cut = tx.truncate_at_stop(F.col("transcript"), ["ow up:", "Follow up", "\nSo the final answer is:"])
    return transcripts(spark, sf).select("conv_id", "turn", cut.alias("completion"))


@query(
    r"""SELECT doc_id, trim(lower(regexp_replace(
  regexp_replace(text, '[\x{80}-\x{FF}]', '', 'g'), '[^\p{L}\p{N}_]', ' ', 'g'))) AS normalized FROM documents"""
)
def normalize_for_match(spark, sf):
    return documents(spark, sf).select("doc_id", tx.normalize_for_match(F.col("text")).alias("normalized"))


_HITS = " + ".join(
    f"CAST((length(chunk) - length(replace(chunk, {quoted(k)}, ''))) // {len(k)} AS INTEGER)" for k in KEYWORDS
)


@query(
    f"""WITH chunked AS ({_chunks_sql(128, 0)}),
scored AS (SELECT doc_id, chunk_no, n_tokens, chunk, {_HITS} AS hits FROM chunked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk_no) AS rank FROM scored WHERE hits > 0)
SELECT * FROM ranked WHERE rank <= 2""",
    ints=('chunk_no', 'n_tokens', 'rank'),
)
def relevant_chunks(spark, sf):
    chunks = ch.token_chunks(documents(spark, sf), "text", 128, keep=["doc_id"])
    return ch.relevant_chunks(chunks, KEYWORDS, ["doc_id"], 2)
