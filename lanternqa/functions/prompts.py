"""Prompt texts and the columns that render them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording is this package's own; the reply keys are fixed values, since every
# reply schema in `replies` is read by them. Callers may pass other templates.
_TAIL = "\n\nQuery:\n{1}\n\nText:\n{2}\n"
RELEVANCE = (
    "Act as a search engine reading page text. Copy out whatever bears on the query.\n"
    'Reply with JSON only: {"relevant_information": "..."}' + _TAIL
)
KEYWORDS = (
    "List the topic words of the query.\n"
    'Reply with JSON only: {"keywords": ["...", "..."]}\n\nQuery:\n{1}\n'
)
DECOMPOSE = (
    "Say whether the query needs simpler questions answered first, and which; one fact per question.\n"
    'Reply with JSON only: {"needs_followup": true, "questions": ["...", "..."]}\n\n'
    "Query:\n{1}\n\nAlready asked, do not repeat:\n{2}\n"
)
SUFFICIENCY = (
    "Judge whether the text answers every part of the query.\n"
    'Reply with JSON only: {"is_sufficient": true}' + _TAIL
)
ANSWER = (
    "Answer the query from the text, directly and in full; compare if it asks to compare.\n"
    'Reply with JSON only: {"answer": "..."}' + _TAIL
)
MEETING = (
    "Find the meeting the message settles on. Today is {1}. Write None for anything not said. "
    "Call an online meeting's location virtual. A meeting lasts 1 hour unless the message says otherwise.\n"
    'Reply with JSON only: {"location": "...", "start_time": "YYYY-MM-DDTHH:MM", '
    '"duration": hours, "topic": "..."}\n\nMessage:\n{2}\n'
)

# The instruction text that tuned models were trained on.
INSTRUCTION_HEAD = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request. ### Instruction: "
)
INSTRUCTION_MID = " ### Response: "

FEW_SHOT = """Question: Is the river through Cairo longer than the river through Paris?
Are follow up questions needed here: Yes.
Follow up: How long is the river that flows through Cairo?
Intermediate answer: The Nile is about 6,650 kilometres long.
Follow up: How long is the river that flows through Paris?
Intermediate answer: The Seine is about 777 kilometres long.
So the final answer is: Yes

Question: In which country was the author of Dracula born?
Are follow up questions needed here: Yes.
Follow up: Who wrote Dracula?
Intermediate answer: Dracula was written by Bram Stoker.
Follow up: Where was Bram Stoker born?
Intermediate answer: Bram Stoker was born in Dublin, Ireland.
So the final answer is: Ireland

"""
FOLLOW_UP_GATE = "\nAre follow up questions needed here:"


def render_prompt(template: str, first: Column, second: Column | None = None) -> Column:
    """Fill `{1}` and `{2}` in one pass, so filled-in text is never filled again."""
    slots = {"{1}": first, "{2}": second}
    parts = [p for p in re.split(r"(\{[12]\})", template) if p]
    columns = [slots[p] if slots.get(p) is not None else F.lit(p) for p in parts]
    return F.concat(*columns)


def truncate_to_budget(prompt: Column, text: Column, limit: int) -> Column:
    """The text if it fits beside the prompt, else its first characters that do."""
    room = F.greatest(F.lit(limit) - F.length(prompt), F.lit(0))
    return F.when(F.length(prompt) + F.length(text) < limit, text).otherwise(F.left(text, room))


def few_shot_prompt(question: Column, examples: str = FEW_SHOT) -> Column:
    return F.concat(F.lit(examples + "Question: "), question, F.lit(FOLLOW_UP_GATE))


def followup_context(question: Column, asked: Column, template: str = DECOMPOSE) -> Column:
    """The decompose prompt with the questions already asked."""
    return render_prompt(template, question, F.array_join(asked, " - "))


def format_instruction(prompt: Column, response: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION_HEAD), prompt, F.lit(INSTRUCTION_MID), response)


def meeting_prompt(message: Column, as_of: Column, template: str = MEETING) -> Column:
    """Message plus the date and weekday (Monday = 0) it is read on."""
    day = F.concat(
        F.date_format(as_of, "yyyy-MM-dd"), F.lit(" Day of the week: "), F.weekday(as_of).cast("string")
    )
    return render_prompt(template, day, message)
