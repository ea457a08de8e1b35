"""Meetings and calendar events."""

from pyspark.sql import functions as F

from lanternqa.catalog.registry import query, table
from lanternqa.operators import meetings as mt
from lanternqa.plans import meetings as plan

ZONE = "America/Los_Angeles"
AS_OF = "2024-02-29"


def _iso(x: str) -> str:
    return (
        f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({x}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({x}, '.%f') END"
    )


def _flat(df, *keep):
    return df.select(
        *keep,
        F.col("event.summary").alias("summary"),
        F.col("event.location").alias("location"),
        F.col("event.start.dateTime").alias("start_at"),
        F.col("event.start.timeZone").alias("start_zone"),
        F.col("event.end.dateTime").alias("end_at"),
        F.col("event.end.timeZone").alias("end_zone"),
        F.array_join(F.transform("event.attendees", lambda a: a["email"]), ",").alias("emails"),
    )


_SHAPES = """CASE event_id % 6
    WHEN 0 THEN '{"location": "' || event_type || '", "start_time": "' || starts || '", "duration": ' || hours || ', "topic": "topic ' || user_id || '"}'
    WHEN 1 THEN '{"location": "' || event_type || '", "start_time": "' || starts || '", "duration": "' || hours || '", "topic": "t"}'
    WHEN 2 THEN '{"location": "' || event_type || '", "start_time": "' || starts || '", "topic": "t"}'
    WHEN 3 THEN '{"location": "virtual", "start_time": "None", "duration": "None", "topic": "t"}'
    WHEN 4 THEN '{"location": "virtual", "start_time": "' || starts || '", "duration": 1, "topic": "t"} ok'
    ELSE '{"start_time": "' || starts || ':00", "duration": 0.5}' END"""
_REPLIES_SQL = f"""replies AS (SELECT event_id, {_SHAPES} AS reply FROM (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M') AS starts, CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) AS hours FROM events))"""


@query(
    f"""WITH {_REPLIES_SQL}, j AS (SELECT event_id, CASE WHEN json_valid(reply) THEN reply END AS j FROM replies)
SELECT event_id, json_extract_string(j, '$.location') AS location,
  strftime(CASE WHEN regexp_full_match(json_extract_string(j, '$.start_time'), '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}')
    THEN try_strptime(json_extract_string(j, '$.start_time'), '%Y-%m-%dT%H:%M') END, '%Y-%m-%d %H:%M') AS start_time,
  CASE WHEN json_extract_string(j, '$.duration') IS NULL THEN 1e0
    ELSE TRY_CAST(json_extract_string(j, '$.duration') AS DOUBLE) END AS duration,
  json_extract_string(j, '$.topic') AS topic FROM j""".replace("\\\\d", "\\d")
)
def meeting_fields(spark, sf):
    starts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    rows = table(spark, sf, "events").withColumn("starts", starts).withColumn(
        "hours", (F.col("value") * 100).cast("decimal(18,0)").cast("string")
    )
    replies = rows.select("event_id", F.expr(_SHAPES).alias("reply"))
    typed = mt.meeting_fields(replies)
    return typed.select(
        "event_id", "location", F.date_format("start_time", "yyyy-MM-dd HH:mm").alias("start_time"), "duration", "topic"
    )


@query(
    f"""WITH e AS (SELECT *, ts + to_microseconds(CAST(round(value * 3600 * 1000000) AS BIGINT)) AS until FROM events)
SELECT event_id, event_type AS summary, props AS location, {_iso('ts')} AS start_at, '{ZONE}' AS start_zone,
  {_iso('until')} AS end_at, '{ZONE}' AS end_zone,
  'user' || user_id || '@example.com,desk@example.com' AS emails FROM e"""
)
def event_record(spark, sf):
    meetings = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("topic"), F.col("props").alias("location"),
        F.col("ts").cast("timestamp_ntz").alias("start_time"), F.col("value").alias("duration"),
        F.array(
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")), F.lit("desk@example.com")
        ).alias("attendees"),
    )
    return _flat(mt.event_record(meetings, ZONE), "event_id")


@query(
    rf"""WITH m AS (
  SELECT *, '{AS_OF}T' || coalesce(nullif(regexp_extract(text, '\b([01][0-9]|2[0-3]):([0-5][0-9])\b'), ''), '09:00') AS starts
  FROM conversations WHERE role = 'user'),
t AS (SELECT *, strptime(starts, '%Y-%m-%dT%H:%M') AS ts FROM m)
SELECT conv_id, turn, regexp_split_to_array(text, '[.\n]')[1] AS summary, 'virtual' AS location,
  {_iso('ts')} AS start_at, '{ZONE}' AS start_zone, {_iso('ts + INTERVAL 1 HOUR')} AS end_at, '{ZONE}' AS end_zone,
  'user' || conv_id || '@example.com' AS emails FROM t"""
)
def extract_meetings(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'").withColumn(
        "attendees", F.array(F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.com")))
    )
    found = plan.extract_meetings(asked, ["conv_id", "turn"], F.lit(AS_OF).cast("date"), ZONE)
    return _flat(found, "conv_id", "turn")
