"""Meeting replies to calendar event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.functions import meetings as mt


def meeting_fields(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """Add the typed location, start_time, duration and topic of each reply."""
    parsed = replies.withColumn("_r", mt.meeting_reply(F.col(raw)))
    return parsed.withColumn("_m", mt.meeting_fields(F.col("_r"))).select("*", "_m.*").drop("_r", "_m")


def event_record(meetings: DataFrame, zone: str, attendees: str = "attendees") -> DataFrame:
    """Add the nested event of each typed meeting."""
    c = F.col
    return meetings.withColumn(
        "event", mt.event_record(c("topic"), c("location"), c("start_time"), c("duration"), c(attendees), zone)
    )
