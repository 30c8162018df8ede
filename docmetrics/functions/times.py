"""Times without a zone; nothing here depends on the session's zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(when: dt.datetime) -> Column:
    """A constant time. Text is used because a Python datetime would be read in a zone."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def event_time(ts: Column) -> Column:
    """The instant a zoneless time names if taken as UTC, to the second, for watermarks."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return F.timestamp_seconds(days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))
