"""Chat messages to calendar events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternqa.functions.prompts import meeting_prompt
from lanternqa.operators.inference import Complete, complete_batch
from lanternqa.operators.meetings import event_record, meeting_fields
from lanternqa.operators.readers import first_sentence_meeting


def extract_meetings(
    messages: DataFrame, key: list[str], as_of: Column, zone: str, message: str = "text",
    attendees: str = "attendees", model: Callable[[], Complete] = first_sentence_meeting,
) -> DataFrame:
    """Typed meeting fields and the event of each message: `key`, `attendees`, the fields, event."""
    asked = messages.select(*key, attendees, meeting_prompt(F.col(message), as_of).alias("prompt"))
    told = complete_batch(asked, "prompt", model, by=key)
    return event_record(meeting_fields(told), zone, attendees).drop("prompt", "reply")
