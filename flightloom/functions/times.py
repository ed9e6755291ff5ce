"""Timestamps kept as text, durations and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How logs write times, and dates in names.
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
_DATE_IN_NAME = r"(\d{2}\s+\w{3}\s+\d{4}|\d{4}-\d{2}-\d{2})"
_CHARTER = r"Flight\s+(\w{3,9})\s+(\d{1,2})\s+(\d{4})\s+(\d{2}):(\d{2})(AM|PM)"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parsed(text: Column) -> Column:
    """The instant of ISO text with a T between date and time, null for all else; without a zone it counts as UTC."""
    whole = F.regexp_replace(F.trim(text), r"^(.{16})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    zoned = F.when(whole.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), whole).otherwise(F.concat(whole, F.lit("Z")))
    return F.when(whole.rlike(_ISO), F.try_to_timestamp(zoned))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one text to another; 0 if either is no timestamp."""
    return F.coalesce((F.unix_micros(parsed(end)) - F.unix_micros(parsed(start))) / 1e6, F.lit(0.0))


def year_of(text: Column) -> Column:
    """The year as written, in the text's own offset; else a year 20xx that stands alone in the text."""
    iso = F.regexp_extract(text, r"^(\d{4})-\d{2}-\d{2}T", 1)
    loose = F.regexp_extract(text, r"\b(20\d{2})\b", 1)
    return F.when(text.contains("T") & (iso != ""), iso).otherwise(F.nullif(loose, F.lit(""))).cast("int")


def date_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, _DATE_IN_NAME, 1), F.lit(""))


def charter_start(description: Column) -> Column:
    """ISO text of `Flight Jan 12 2026 03:01PM`, month short or full, in any case; null for days and hours that there are none
    of. It is put together from the numbers as written, so no time zone of a session has a say."""
    part = lambda i: F.regexp_extract(description, _CHARTER, i)
    named = F.lower(part(1))
    month = F.greatest(*[F.array_position(F.array(*[F.lit(m[:n]) for m in _MONTHS]), named) for n in (3, 99)])
    clock = part(4).try_cast("int")
    hour = F.when((part(6) == "PM") & (clock != 12), clock + 12).when((part(6) == "AM") & (clock == 12), F.lit(0)).otherwise(clock)
    day = F.format_string("%s-%02d-%02d", part(3), month, part(2).try_cast("int"))
    sound = (month > 0) & (hour <= 23) & (part(5).try_cast("int") <= 59) & day.try_cast("date").isNotNull()
    return F.when(sound, F.concat(day, F.format_string("T%02d:", hour), part(5), F.lit(":00+00:00")))


def flight_time_report(seconds: Column) -> Column:
    """`2h 5m`, `5m`, or `---` for nothing."""
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    return F.when(seconds <= 0, "---").when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def flight_time_panel(seconds: Column) -> Column:
    """`0h 5m`, always with hours."""
    return F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60))


def clock(seconds: Column) -> Column:
    """`h:mm:ss`, or `m:ss` below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
