"""Calendar files (RFC 5545) to their events, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a content line; parameters may hold quoted colons.
PARAMETERS = r'(?:;(?:"[^"\r\n]*"|[^":\r\n])*+)?+'


def _unescaped(value: Column) -> Column:
    r"""\n, \, \; and \\ as what they stand for; the backslash itself last. A NUL of the text reads as a backslash."""
    out = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    out = F.regexp_replace(F.regexp_replace(out, r"\\[nN]", "\n"), r"\\([,;])", "$1")
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def _line(name: str) -> str:
    return rf"(?im)^{name}{PARAMETERS}:([^\r\n]*+)"


def _value(part: Column, name: str) -> Column:
    return F.nullif(_unescaped(F.regexp_extract(part, _line(name), 1)), F.lit(""))


def _mailbox(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(value, "(?i)^mailto:", ""))), F.lit(""))


def calendar(text: Column) -> Column:
    """struct(method, events) of a calendar file; each event has uid, summary, description, location, url, starts, ends, organizer and
    attendees, the first line of a name deciding. Dates stay as written. Null if the text is no calendar; an event without end is left out."""
    whole = F.regexp_replace(text, r"\r?\n[ \t]", "")
    events = F.regexp_extract_all(whole, F.lit(r"(?is)(?<![^\n])BEGIN:VEVENT[ \t]*\r?\n(.*?)(?<=\n)END:VEVENT"), F.lit(1))

    def event(e: Column) -> Column:
        own = F.regexp_replace(e, r"(?is)(?<![^\n])BEGIN:VALARM.*?(?<=\n)END:VALARM", "")  # an alarm has a description of its own
        plain = [_value(own, name).alias(out) for name, out in (("UID", "uid"), ("SUMMARY", "summary"), ("DESCRIPTION", "description"), ("LOCATION", "location"), ("URL", "url"), ("DTSTART", "starts"), ("DTEND", "ends"))]
        guests = F.filter(F.transform(F.regexp_extract_all(own, F.lit(_line("ATTENDEE")), F.lit(1)), _mailbox), lambda x: x.isNotNull())
        return F.struct(*plain, _mailbox(F.regexp_extract(own, _line("ORGANIZER"), 1)).alias("organizer"), F.array_distinct(guests).alias("attendees"))

    return F.when(F.rlike(whole, F.lit(r"(?i)^\s*BEGIN:VCALENDAR")), F.struct(F.upper(_value(whole, "METHOD")).alias("method"), F.transform(events, event).alias("events")))
