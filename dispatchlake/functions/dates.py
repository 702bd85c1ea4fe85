"""Work days that roll over at 04:00 wall-clock time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROLLOVER_HOURS = 4
STALE_MINUTES = 45


def business_date(ts: Column) -> Column:
    """The work day of a wall-clock time. Zoned timestamps are read in the session's zone."""
    return F.to_date(ts - F.expr(f"interval {ROLLOVER_HOURS} hours"))


def next_date(day: Column) -> Column:
    return F.date_add(day, 1)


def age_minutes(now: Column, then: Column) -> Column:
    """Whole minutes between two times, halves upwards."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.floor(seconds / 60_000_000 + 0.5).cast("long")


def is_stale(minutes: Column, handled: Column) -> Column:
    """A route is stale past STALE_MINUTES, or once any of its stops is delivered or failed."""
    return (minutes > STALE_MINUTES) | handled
