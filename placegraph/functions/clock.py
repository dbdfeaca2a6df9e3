"""Times of day, days of the week and event times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
WEEK = 10080


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minutes_of(hhmm) -> Column:
    parts = F.split(_c(hhmm), ":")
    return F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")


def hhmm(minutes) -> Column:
    m = _c(minutes)
    return F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))


def twelve_hour(text) -> Column:
    m = minutes_of(text)
    h = F.floor(m / 60)
    hour = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.concat(hour.cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(h < 12, "am").otherwise("pm"))


def weekday(ts) -> Column:
    """0 to 6, Sunday first."""
    return F.dayofweek(_c(ts)) - 1


def minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def week_slot(ts) -> Column:
    """Minute of the week, 0 to 10079."""
    return (weekday(ts) * DAY + minute_of_day(ts)).cast("int")


def micros(ts) -> Column:
    """Microseconds since 1970 of the written time, whatever the session time zone."""
    t = _c(ts)
    day = F.unix_date(F.to_date(t)).cast("bigint")
    second = (F.extract(F.lit("SECOND"), t) * 1000000).cast("bigint")
    return (day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60) * 1000000 + second


def days_of_bits(bits) -> Column:
    """Days whose bit is set, Sunday the lowest bit."""
    b = _c(bits)
    return F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: F.getbit(b, d) == 1)


def expiry(at, seconds) -> Column:
    return _c(at) + F.make_interval(secs=_c(seconds) if isinstance(seconds, (str, Column)) else F.lit(seconds))
