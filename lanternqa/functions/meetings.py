"""Typed meeting fields and calendar event records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternqa.functions.replies import MEETING, parse_reply

DEFAULT_HOURS = 1.0


def meeting_reply(raw: Column) -> Column:
    return parse_reply(raw, MEETING)


def meeting_fields(reply: Column) -> Column:
    """A parsed reply as location, wall-clock start, hours and topic; bad fields are null."""
    well_formed = reply["start_time"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$")
    start = F.try_to_timestamp(F.when(well_formed, reply["start_time"]), F.lit("yyyy-MM-dd'T'HH:mm"))
    hours = F.when(reply["duration"].isNull(), F.lit(DEFAULT_HOURS)).otherwise(reply["duration"].try_cast("double"))
    return F.struct(
        reply["location"].alias("location"),
        start.cast("timestamp_ntz").alias("start_time"),
        hours.alias("duration"),
        reply["topic"].alias("topic"),
    )


def iso_text(ts: Column) -> Column:
    """ISO text of a wall-clock time; a zero fraction of a second is left out."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def event_end(start: Column, hours: Column) -> Column:
    """Start plus hours on the wall clock, with no daylight-saving shift."""
    seconds = (hours * 3600).try_cast("decimal(18,6)")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def event_record(
    topic: Column, location: Column, start: Column, hours: Column, attendees: Column, zone: str
) -> Column:
    """A nested calendar event."""

    def moment(ts: Column) -> Column:
        return F.struct(iso_text(ts).alias("dateTime"), F.lit(zone).alias("timeZone"))

    return F.struct(
        topic.alias("summary"),
        location.alias("location"),
        moment(start).alias("start"),
        moment(event_end(start, hours)).alias("end"),
        F.transform(attendees, lambda email: F.struct(email.alias("email"))).alias("attendees"),
    )
