"""Timestamps, day and hour keys, date ranges and presets."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
_ISO = r"\A[+-]?\d{4,6}(-\d{2}(-\d{2}([T ].*)?)?)?\z"
_DATE_ONLY = r"\A\d{4}(-\d{2}(-\d{2})?)?\z"


def parse_ts(c: Column) -> Column:
    """Instant of an ISO-8601 text, null when it is not one.  A bare date is UTC, a zone-less time is local."""
    text = F.when(c.rlike(_DATE_ONLY), F.concat(c, F.when(F.length(c) == 4, "-01-01").when(F.length(c) == 7, "-01")
                                                .otherwise(""), F.lit("T00:00:00Z"))).otherwise(c)
    return F.when(c.rlike(_ISO), F.try_to_timestamp(text))


def iso_utc(ts: Column) -> Column:
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_key(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_ts(c), "yyyy-MM-dd"), F.lit(UNKNOWN))


def hour_key(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_ts(c), "yyyy-MM-dd HH:00"), F.lit(UNKNOWN))


def bucket_key(c: Column, grain: str) -> Column:
    return day_key(c) if grain == "day" else hour_key(c)


def range_bound(value: str | None, end: bool) -> Column | None:
    """Epoch milliseconds of a bound; a bare date means the whole local day."""
    if not value:
        return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        value += "T23:59:59.999" if end else "T00:00:00.000"
    return F.unix_millis(F.to_timestamp(F.lit(value)))


def in_range(c: Column, since: str | None = None, until: str | None = None) -> Column:
    """True inside the range; absent and unreadable timestamps always pass."""
    low, high = range_bound(since, False), range_bound(until, True)
    millis = F.unix_millis(parse_ts(c))
    keep = F.lit(True)
    if low is not None:
        keep = keep & (millis >= low)
    if high is not None:
        keep = keep & (millis <= high)
    return F.coalesce(keep, F.lit(True))


def date_preset(mode: str, anchor: date, today: date, since: date | None = None,
                until: date | None = None) -> tuple[str | None, str | None]:
    """Bounds of a calendar preset (all, day, week, month, year, custom), never later than today.

    Weeks start on Sunday.
    """
    anchor = min(anchor, today)
    if mode == "all":
        return None, None
    if mode == "custom":
        low = min(since or today, today)
        return low.isoformat(), max(low, min(until or today, today)).isoformat()
    if mode == "day":
        low = high = anchor
    elif mode == "week":
        low = anchor - timedelta(days=(anchor.weekday() + 1) % 7)
        high = low + timedelta(days=6)
    elif mode == "month":
        low = anchor.replace(day=1)
        high = anchor.replace(day=calendar.monthrange(anchor.year, anchor.month)[1])
    elif mode == "year":
        low, high = date(anchor.year, 1, 1), date(anchor.year, 12, 31)
    else:
        raise ValueError(f"unknown preset {mode}")
    high = min(high, today)
    return min(low, high).isoformat(), high.isoformat()
