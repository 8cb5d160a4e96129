"""Days: the 04:00 boundary, weekends, names, and chart places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY_HOURS = 4


def local_day(ts: Column, zone: Column) -> Column:
    """The local day of an instant, days changing at 04:00. The hours go off the instant, before the zone is applied."""
    return F.from_utc_timestamp(ts - F.make_dt_interval(hours=F.lit(BOUNDARY_HOURS)), zone).cast("date")


def sleep_day(end: Column, zone: Column) -> Column:
    """A night belongs to the day it ends on."""
    return F.from_utc_timestamp(end, zone).cast("date")


def wall_clock(day: Column, hour: int, zone: Column) -> Column:
    """The instant at which the zone's clocks show ``hour`` on a day."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), zone)


def day_start(day: Column, zone: Column) -> Column:
    """The first instant whose ``local_day`` is ``day``."""
    return wall_clock(day, 0, zone) + F.make_dt_interval(hours=F.lit(BOUNDARY_HOURS))


def until_next(ts: Column, zone: Column, hour: Column | int, minute: Column | int = 0) -> Column:
    """Microseconds on the wall clock from an instant to the next time of day, a whole day at that time itself.

    Clocks that change in between are not counted, as a clock on the wall would not.
    """
    local = F.from_utc_timestamp(ts, zone)
    number = lambda v: F.lit(v) if isinstance(v, int) else v
    gone = F.unix_micros(local) - F.unix_micros(local.cast("date").cast("timestamp"))
    wait = (number(hour).cast("long") * 60 + number(minute)) * 60_000_000 - gone
    return F.when(wait > 0, wait).otherwise(wait + 86_400_000_000)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def epoch_day(day: Column) -> Column:
    return F.unix_date(day)


def day_name(day: Column) -> Column:
    """English name, whatever the machine's locale."""
    names = F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")))
    return F.get(names, F.weekday(day))


def day_header(day: Column) -> Column:
    return F.date_format(day, "EEEE d MMMM")


def chart_x(day: Column, start: Column, end: Column) -> Column:
    return F.datediff(day, start) / F.greatest(F.lit(1), F.datediff(end, start))


def chart_y(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))
