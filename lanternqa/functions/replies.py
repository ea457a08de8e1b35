"""Strict parsing of JSON replies."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply fields and the default each takes when a reply is unusable.
RELEVANCE = {"relevant_information": ("string", None)}
KEYWORDS = {"keywords": ("array<string>", [])}
DECOMPOSE = {"needs_followup": ("boolean", False), "questions": ("array<string>", [])}
SUFFICIENCY = {"is_sufficient": ("boolean", False)}
ANSWER = {"answer": ("string", None)}
# The name of the field that carries the mark; no reply's field is called so.
MARK = "reply-end"
MEETING = {
    "location": ("string", None),
    "start_time": ("string", None),
    "duration": ("string", None),
    "topic": ("string", None),
}


def _default(value: Any, type_: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(type_)
    return F.lit(value).cast(type_)


def parse_reply(raw: Column, fields: dict[str, tuple[str, Any]]) -> Column:
    """One struct per reply: a JSON object's fields, or their defaults.

    A reply may not close what wraps it, nor bring a second value. It is parsed
    once, as the first element of an array whose second and last one carries a
    mark made of the reply itself; what leaves the mark in its place is one value.
    """
    inner = ", ".join(f"`{name}`: {type_}" for name, (type_, _) in fields.items())
    mark = F.md5(raw)
    wrapped = F.concat(F.lit("["), raw, F.lit(f',{{"{MARK}":"'), mark, F.lit('"}]'))
    both = F.from_json(wrapped, f"array<struct<{inner}, `{MARK}`: string>>", {"allowSingleQuotes": "false"})

    def filled(reply: Column) -> Column:
        return F.struct(
            *[F.coalesce(reply[name], _default(value, type_)).alias(name) for name, (type_, value) in fields.items()]
        )

    # one lambda argument, so the text is parsed once for all fields
    def checked(two: Column) -> Column:
        return filled(F.when((F.size(two) == 2) & (F.get(two, F.lit(1))[MARK] == mark), F.get(two, F.lit(0))))

    return F.get(F.transform(F.array(both), checked), F.lit(0))
