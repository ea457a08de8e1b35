"""Prompt rendering over questions and exchanges."""

import re

from pyspark.sql import functions as F

from lanternqa.catalog.registry import EXCHANGES_SQL, exchanges, query, quoted, table
from lanternqa.functions import prompts as pr
from lanternqa.functions import text as tx

TEMPLATES = {
    "relevance": pr.RELEVANCE, "keywords": pr.KEYWORDS, "decompose": pr.DECOMPOSE,
    "sufficiency": pr.SUFFICIENCY, "answer": pr.ANSWER,
}
AS_OF = "2024-02-29"


def rendered_sql(template: str, first: str, second: str = "''") -> str:
    parts = [p for p in re.split(r"(\{[12]\})", template) if p]
    return " || ".join({"{1}": first, "{2}": second}.get(p) or quoted(p) for p in parts)


@query(
    f"WITH {EXCHANGES_SQL} "
    + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{name}' AS template, {rendered_sql(t, 'prompt', 'response')} AS rendered FROM exchanges"
        for name, t in TEMPLATES.items()
    )
)
def render_prompt(spark, sf):
    rows = [
        F.struct(
            F.lit(name).alias("template"),
            pr.render_prompt(t, F.col("prompt"), F.col("response")).alias("rendered"),
        )
        for name, t in TEMPLATES.items()
    ]
    return exchanges(spark, sf).select("conv_id", "turn", F.inline(F.array(*rows)))


@query(
    f"""WITH {EXCHANGES_SQL}, p AS (SELECT *, {rendered_sql(pr.ANSWER, 'prompt')} AS bare FROM exchanges)
SELECT conv_id, turn, CASE WHEN length(bare) + length(response) < 900 THEN response
  ELSE substr(response, 1, greatest(900 - length(bare), 0)) END AS fitted FROM p"""
)
def truncate_to_budget(spark, sf):
    bare = pr.render_prompt(pr.ANSWER, F.col("prompt"), F.lit(""))
    return exchanges(spark, sf).select(
        "conv_id", "turn", pr.truncate_to_budget(bare, F.col("response"), 900).alias("fitted")
    )


@query(
    f"""SELECT item_id, {quoted(pr.FEW_SHOT)} || 'Question: ' || text || {quoted(pr.FOLLOW_UP_GATE)} AS prompt FROM benchmark"""
)
def few_shot_prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", pr.few_shot_prompt(F.col("text")).alias("prompt"))


@query(
    f"""WITH {EXCHANGES_SQL} SELECT conv_id, turn,
  {rendered_sql(pr.DECOMPOSE, 'prompt', "array_to_string(string_split(response, '. '), ' - ')")} AS context FROM exchanges"""
)
def followup_context(spark, sf):
    asked = F.split("response", r"\. ", -1)
    return exchanges(spark, sf).select("conv_id", "turn", pr.followup_context(F.col("prompt"), asked).alias("context"))


@query(
    f"""WITH {EXCHANGES_SQL} SELECT conv_id, turn,
  {quoted(pr.INSTRUCTION_HEAD)} || prompt || {quoted(pr.INSTRUCTION_MID)} || response AS text FROM exchanges"""
)
def format_instruction(spark, sf):
    return exchanges(spark, sf).select(
        "conv_id", "turn", pr.format_instruction(F.col("prompt"), F.col("response")).alias("text")
    )


@query("SELECT conv_id, turn, '<s>[INST] ' || text || ' [/INST]' AS wrapped FROM conversations WHERE role = 'user'")
def wrap_chat_turn(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", tx.wrap_chat_turn(F.col("text")).alias("wrapped"))


_DAY = f"strftime(DATE '{AS_OF}', '%Y-%m-%d') || ' Day of the week: ' || CAST(isodow(DATE '{AS_OF}') - 1 AS VARCHAR)"


@query(
    f"SELECT conv_id, turn, {rendered_sql(pr.MEETING, _DAY, 'text')} AS prompt FROM conversations WHERE role = 'user'"
)
def meeting_prompt(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    as_of = F.lit(AS_OF).cast("date")
    return asked.select("conv_id", "turn", pr.meeting_prompt(F.col("text"), as_of).alias("prompt"))
