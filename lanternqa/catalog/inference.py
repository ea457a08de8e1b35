"""Batch completion and strict reply parsing."""

from pyspark.sql import functions as F

from lanternqa.catalog.registry import EXCHANGES_SQL, best_piece_sql, exchanges, query, table, words_sql
from lanternqa.functions import prompts as pr
from lanternqa.functions import replies
from lanternqa.operators import inference as inf
from lanternqa.operators import readers


def _broken(good, shape):
    """A reply in one of ten shapes, of which only the first and the last are usable."""
    return (
        F.when(shape == 0, good)
        .when(shape == 7, F.concat(good, F.lit("] junk")))
        .when(shape == 8, F.concat(good, F.lit('}, "x": {"y": 1')))
        .when(shape == 9, F.concat(good, F.lit('], "x": [1')))
        .when(shape == 1, F.concat(good, F.lit(" as asked")))
        .when(shape == 2, F.lit("{'answer': 'x', 'keywords': ['x'], 'is_sufficient': true}"))
        .when(shape == 3, F.lit('{"other": 1}'))
        .when(shape == 4, F.lit(""))
        .when(shape == 5, F.concat(F.lit("Sure: "), good))
        .otherwise(F.concat(F.lit(" \n"), good, F.lit("\n")))
    )


_RAW_SQL = r"""raw AS (
  SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 10
    WHEN 0 THEN good
    WHEN 7 THEN good || '] junk'
    WHEN 8 THEN good || '}, "x": {"y": 1'
    WHEN 9 THEN good || '], "x": [1'
    WHEN 1 THEN good || ' as asked'
    WHEN 2 THEN '{''answer'': ''x'', ''keywords'': [''x''], ''is_sufficient'': true}'
    WHEN 3 THEN '{"other": 1}'
    WHEN 4 THEN ''
    WHEN 5 THEN 'Sure: ' || good
    ELSE E' \n' || good || E'\n' END AS raw
  FROM (SELECT conv_id, turn, CAST(to_json({
    'relevant_information': text, 'answer': split_part(text, '.', 1), 'keywords': string_split(text, ' '),
    'needs_followup': turn > 1, 'questions': string_split(text, '. '), 'is_sufficient': role = 'user'}) AS VARCHAR) AS good
    FROM conversations)),
reply AS (SELECT conv_id, turn, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM raw)"""


@query(
    f"""WITH {_RAW_SQL} SELECT conv_id, turn,
  json_extract_string(j, '$.relevant_information') AS relevant_information,
  json_extract_string(j, '$.answer') AS answer,
  coalesce(array_to_string(json_extract_string(j, '$.keywords[*]'), '|'), '') AS keywords,
  coalesce(json_extract_string(j, '$.needs_followup') = 'true', false) AS needs_followup,
  coalesce(array_to_string(json_extract_string(j, '$.questions[*]'), '|'), '') AS questions,
  coalesce(json_extract_string(j, '$.is_sufficient') = 'true', false) AS is_sufficient
FROM reply"""
)
def parse_reply(spark, sf):
    turns = table(spark, sf, "conversations")
    good = F.to_json(
        F.struct(
            F.col("text").alias("relevant_information"),
            F.substring_index("text", ".", 1).alias("answer"),
            F.split("text", " ", -1).alias("keywords"),
            (F.col("turn") > 1).alias("needs_followup"),
            F.split("text", r"\. ", -1).alias("questions"),
            (F.col("role") == "user").alias("is_sufficient"),
        )
    )
    raw = turns.select(
        "conv_id", "turn", _broken(good, F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(10))).alias("raw")
    )
    x = F.col("raw")
    parsed = {
        **{n: replies.parse_reply(x, s)[n] for s in (replies.RELEVANCE, replies.ANSWER, replies.SUFFICIENCY) for n in s},
        "keywords": F.array_join(replies.parse_reply(x, replies.KEYWORDS)["keywords"], "|"),
        "needs_followup": replies.parse_reply(x, replies.DECOMPOSE)["needs_followup"],
        "questions": F.array_join(replies.parse_reply(x, replies.DECOMPOSE)["questions"], "|"),
    }
    return raw.select("conv_id", "turn", *[c.alias(name) for name, c in parsed.items()])


@query(
    f"""WITH {EXCHANGES_SQL} SELECT conv_id, turn, {best_piece_sql('prompt', 'response', '. ')} AS answer FROM exchanges"""
)
def complete_batch(spark, sf):
    asked = exchanges(spark, sf).select(
        "conv_id", "turn", pr.render_prompt(pr.ANSWER, F.col("prompt"), F.col("response")).alias("prompt")
    )
    told = inf.complete_batch(asked, "prompt", readers.best_piece("answer", ". "), by=["conv_id", "turn"])
    return told.select("conv_id", "turn", replies.parse_reply(F.col("reply"), replies.ANSWER)["answer"].alias("answer"))


_WANTED = f"list_distinct({words_sql('prompt')})"


@query(
    rf"""WITH {EXCHANGES_SQL},
t AS (SELECT *, regexp_extract_all(response, '[^ \t\n\r\f\x0B]+') AS tk FROM exchanges),
c AS (SELECT conv_id, turn, prompt, tk, unnest(range((len(tk) - 1) // 32 + 1)) AS no FROM t WHERE len(tk) > 0),
x AS (SELECT conv_id, turn, prompt, array_to_string(tk[no * 32 + 1 : no * 32 + 32], ' ') AS chunk FROM c)
SELECT conv_id, turn, bool_or(len(list_intersect({_WANTED}, list_distinct({words_sql('chunk')})))
  >= 0.25e0 * len({_WANTED})) AS any_sufficient FROM x GROUP BY conv_id, turn"""
)
def any_sufficient(spark, sf):
    return inf.judge_sufficiency(
        exchanges(spark, sf), ["conv_id", "turn"], readers.covers_query(0.25), 32, "prompt", "response"
    )
