"""Time expressions. The reference time is always an explicit ``as_of``."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import col, trim_space

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def moment(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def at(value: datetime | str | Column) -> Column:
    """A zone-less timestamp literal, comparable with Parquet ``timestamp_ntz`` columns."""
    if isinstance(value, Column):
        return value
    return F.lit(moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def age_us(c: Column | str, as_of: datetime | str | Column) -> Column:
    """Microseconds from ``c`` to ``as_of``; negative for later timestamps."""
    return micros(at(as_of)) - micros(c)


def age_hours(c: Column | str, as_of: datetime | str | Column) -> Column:
    return age_us(c, as_of).cast("double") / F.lit(float(HOUR_US))


def is_recent(c: Column | str, as_of: datetime | str | Column, days: int) -> Column:
    """At most ``days`` old, the limit included. Later timestamps count as recent."""
    return F.coalesce(age_us(c, as_of) <= F.lit(days * DAY_US), F.lit(False))


def since_date(as_of: datetime | str, time_range: str) -> date:
    """Lower bound of a daily, weekly or monthly range. Other names mean weekly."""
    day = moment(as_of).date()
    if time_range == "daily":
        return day - timedelta(days=1)
    if time_range == "monthly":
        # the same day of the month before; a day past its end runs over into this month
        year, month = (day.year, day.month - 1) if day.month > 1 else (day.year - 1, 12)
        return date(year, month, 1) + timedelta(days=day.day - 1)
    return day - timedelta(days=7)


# The accepted timestamp layouts, in the order in which they are tried.
# A leading weekday is removed before matching; zone names become offsets.
FEED_LAYOUTS = [
    "dd MMM yyyy HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "dd MMM yy HH:mm Z",
    "yyyy-MM-dd HH:mm:ss",
]
PAGE_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "dd MMM yyyy HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "dd MMM yyyy",
]
CONFORM_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "dd MMM yyyy HH:mm:ss Z",
    "dd MMM yy HH:mm Z",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MMM dd HH:mm:ss Z yyyy",
]


def parse_timestamp(c: Column | str, layouts: list[str]) -> Column:
    """The first layout that reads the text, as zone-less UTC; NULL when none does.

    The parser refuses weekday names, so a leading one is dropped, and an alphabetic zone
    such as GMT or EST counts as offset zero.
    """
    value = trim_space(c)
    value = F.regexp_replace(value, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    value = F.regexp_replace(value, r"(\d{2}:\d{2}(?::\d{2})?) [A-Z]{3,4}$", "$1 +0000")
    tries = [F.try_to_timestamp(value, F.lit(layout)) for layout in layouts]
    return F.coalesce(*tries).cast("timestamp_ntz")
