"""Post timestamps and search windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_DAYS = 14

# "Wed Aug 12 14:23:01 +0000 2026". The weekday must be a name but need not fit
# the date. It is dropped because Spark does not parse weekdays.
_WEEKDAYS = ("Mon ", "Tue ", "Wed ", "Thu ", "Fri ", "Sat ", "Sun ")
_POSTED = (r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)\s+([a-z]{3})\s+(\d{1,2})\s+"
           r"(\d{1,2}:\d{1,2}:\d{1,2})\s+((?-i:Z))?(?:([+-]\d\d):?(\d\d):?(\d\d)?)?\s+(\d{4})$")


def parse_created_at(text: Column) -> Column:
    """The instant a post was made; NULL for malformed or missing text."""
    usual = F.when(F.substring(text, 1, 4).isin(*_WEEKDAYS),
                   F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM d HH:mm:ss Z yyyy")))
    # Only text of another make comes here: letter case, spaces, short hours, other offsets.
    # The "@" makes text without a weekday fail the parse.
    bare = F.regexp_replace(text, _POSTED, "@$1 $2 $3 $4$5$6$7 $8")
    unusual = F.try_to_timestamp(F.initcap(bare), F.lit("'@'MMM d H:m:s XXXX yyyy"))
    return F.coalesce(usual, unusual)


def format_created_at(ts: Column) -> Column:
    """Inverse of :func:`parse_created_at`, in UTC."""
    return F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy")


def utc(moment: dt.datetime | dt.date | str) -> Column:
    """A UTC literal from a datetime, a date or ISO text."""
    if isinstance(moment, dt.datetime) and moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(str(moment)).cast("timestamp")


def window_index(ts: Column, start: Column, days: int = WINDOW_DAYS, end: Column | None = None) -> Column:
    """Number of the ``days``-long window that holds ``ts``, counted from ``start``.

    Windows are so many times 24 hours after ``start``; NULL before it and, if
    given, from ``end`` on.
    """
    inside = ts >= start if end is None else (ts >= start) & (ts < end)
    passed = F.unix_micros(ts) - F.unix_micros(start)
    return F.when(inside, F.floor(passed / F.lit(days * 86_400_000_000)).cast("long"))


def window_bounds(index: Column, start: Column, end: Column,
                  days: int = WINDOW_DAYS) -> tuple[Column, Column]:
    """Start and end of a window, NULL for none; the last one is cut at ``end``."""
    first = start + F.make_dt_interval((index * days).cast("int"))
    last = start + F.make_dt_interval(((index + 1) * days).cast("int"))
    return first, F.when(last > end, end).otherwise(last)


def collected_at() -> Column:
    """The time of the query, one value for all rows."""
    return F.current_timestamp()
