"""Timestamps and dates, independent of the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from revlume.functions.date_grammar import read_date
from revlume.functions.text import strip_text

# Fixed value: the look-back window, in days rather than calendar months.
WINDOW_DAYS = 365

_ZONE = r"(?:Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)"
_ISO = r"(?i)\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?%s)?)?\z" % _ZONE
_HAS_ZONE = r"(?i):\d{2}(?:\.\d+)?(?: ?[AP]M)? ?%s\z" % _ZONE
_NO_SECONDS = r"\A(\S{10}[T ]\d{2}:\d{2})(?!:)"

def utc_date(ts: Column) -> Column:
    """Calendar day of an instant in UTC."""
    days = F.floor(F.unix_seconds(ts) / F.lit(86400))
    return F.date_from_unix_date(days.cast("int"))


def _has_zone(text: Column) -> Column:
    return text.rlike(_HAS_ZONE)


def _iso_instant(text: Column) -> Column:
    full = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(
        F.regexp_replace(text, _NO_SECONDS, "$1:00")
    )
    zoned = F.when(_has_zone(text), F.upper(full)).otherwise(F.concat(full, F.lit("Z")))
    return zoned.try_cast("timestamp")


def parse_timestamp(col: Column) -> Column:
    """Instant named by a date text, null if unreadable; no offset means UTC."""
    text = strip_text(col)
    return F.when(text.rlike(_ISO), _iso_instant(text)).otherwise(read_date(text)["instant"])


def local_date(col: Column) -> Column:
    """Day in the offset the text itself carries.

    Late-evening reviews west of Greenwich keep their own day, which the UTC
    instant would move to the next.
    """
    text = strip_text(col)
    return F.when(
        text.rlike(_ISO), F.substring(text, 1, 10).try_cast("date")
    ).otherwise(read_date(text)["day"])


def cutoff(as_of: datetime, days: int = WINDOW_DAYS) -> datetime:
    """Oldest instant still inside the window; a naive ``as_of`` is UTC."""
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return as_of - timedelta(days=days)


def cutoff_literal(as_of: datetime, dtype: str = "timestamp") -> Column:
    """The cutoff as a literal of the column's own type.

    Comparing like with like keeps the predicate free of casts, so that it
    reaches the scan.
    """
    bound = cutoff(as_of)
    if dtype == "timestamp_ntz":
        naive = bound.astimezone(timezone.utc).replace(tzinfo=None)
        return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(bound)


def as_instant(col: Column, dtype: str) -> Column:
    """A time column as an instant, whether or not it was landed with a zone."""
    return naive_as_utc(col) if dtype == "timestamp_ntz" else col


def naive_as_utc(col: Column) -> Column:
    """Instant of a time without zone, read as UTC in any session zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, col))
