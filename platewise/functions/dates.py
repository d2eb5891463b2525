"""Date and weekday expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monday first, the order every schedule listing uses.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def day_literal(value: dt.date | str) -> Column:
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def days_before(as_of: dt.date, days: int) -> Column:
    """Cut-off of a trailing window, folded on the driver so that it reaches the scan."""
    return F.lit(as_of - dt.timedelta(days=days))


def sunday_zero(date: Column) -> Column:
    """Weekday numbered 0 = Sunday, as the schedule tables store it."""
    return F.dayofweek(date) - 1


def day_name(sunday_based: Column) -> Column:
    names = F.array(*[F.lit(n) for n in (DAY_NAMES[6],) + DAY_NAMES[:6]])
    return F.when(sunday_based.between(0, 6), F.element_at(names, sunday_based.cast("int") + 1))


def day_position(name: Column) -> Column:
    """1 for Monday … 7 for Sunday."""
    return F.array_position(F.array(*[F.lit(n) for n in DAY_NAMES]), name)
