"""Report dates relative to a given day. Nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run flags and the days added to the weekday (Monday = 0) when counting back.
WEEKDAY_FLAGS = {
    "lmon": 0,
    "lsun": 1,
    "lsat": 2,
    "lfri": 3,
    "lthur": 4,
    "lwed": 5,
    "ltue": 6,
}
DAYS_PER_YEAR = 364  # keeps the weekday


def run_date(day: Column, flag: str) -> Column:
    """The day a run flag stands for, seen from ``day``.

    ``lmon`` .. ``lsun`` the last such weekday; ``plusten`` ten days on; ``now`` the
    day before.
    """
    d = day.cast("date")
    if flag == "plusten":
        return F.date_add(d, 10)
    if flag == "now":
        return F.date_sub(d, 1)
    if flag not in WEEKDAY_FLAGS:
        raise ValueError(f"unknown run flag {flag!r}")
    back = F.weekday(d) + WEEKDAY_FLAGS[flag]
    return F.date_sub(d, F.when(back > 7, back - 7).otherwise(back))


def last_year(day: Column) -> Column:
    """Same weekday a year before."""
    return F.date_sub(day.cast("date"), DAYS_PER_YEAR)


def next_year(day: Column) -> Column:
    """Inverse of :func:`last_year`."""
    return F.date_add(day.cast("date"), DAYS_PER_YEAR)
