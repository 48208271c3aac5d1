"""Filters and columns over schedule tables. The moment of looking, ``as_of``, is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import Keys, as_columns

# Seconds between runs of a daily and a weekly task.
DAY_SECONDS = 86400
WEEK_SECONDS = 604800


def _moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def is_due(next_run: Column, ends: Column, as_of) -> Column:
    """next run < as_of < end; no end means never ending."""
    now = _moment(as_of)
    return (next_run < now) & (ends.isNull() | (now < ends))


def due_rows(df: DataFrame, next_run: str, ends: str, as_of) -> DataFrame:
    return df.where(is_due(F.col(next_run), F.col(ends), as_of))


def next_task(df: DataFrame, next_run: str, ends: str, priority: str, as_of, tie_break: Keys) -> DataFrame:
    """The due row with the highest priority, the first in ``tie_break`` order on ties."""
    due = due_rows(df, next_run, ends, as_of)
    return due.orderBy(F.col(priority).desc_nulls_last(), *as_columns(tie_break)).limit(1)


def due_within(df: DataFrame, next_run: str, horizon: str, as_of) -> DataFrame:
    """Rows whose next run is not beyond the horizon; rows without a next run stay.

    today: before a day from now; week: up to seven days from now; month: before the
    first of the month that lies four weeks ahead.
    """
    now, col = _moment(as_of), F.col(next_run)
    if horizon == "today":
        beyond = col >= now + F.expr("INTERVAL 1 DAY")
    elif horizon == "week":
        beyond = col > now + F.expr("INTERVAL 7 DAY")
    elif horizon == "month":
        beyond = col >= F.trunc((now + F.expr("INTERVAL 28 DAY")).cast("date"), "month").cast("timestamp_ntz")
    else:
        raise ValueError(f"horizon must be today, week or month, not {horizon!r}")
    return df.where(~F.coalesce(beyond, F.lit(False)))


def recurrence_class(delta: Column) -> Column:
    """monthly (no delta), daily, weekly or other, from the seconds between runs."""
    return (
        F.when(delta.isNull(), "monthly")
        .when(delta == DAY_SECONDS, "daily")
        .when(delta == WEEK_SECONDS, "weekly")
        .otherwise("other")
    )


def with_recurrence(df: DataFrame, delta: str, flagged: str | None, last: str | None, as_of) -> DataFrame:
    """Add ``recurrence``, ``unusual`` (has one-time runs) and ``ended`` (last run is past)."""
    unusual = F.col(flagged).isNotNull() if flagged else F.lit(False)
    ended = F.coalesce(F.col(last) < _moment(as_of), F.lit(False)) if last else F.lit(False)
    return df.select(
        "*", recurrence_class(F.col(delta)).alias("recurrence"), unusual.alias("unusual"), ended.alias("ended")
    )


def roll_forward(last_run: Column, delta: Column, as_of) -> Column:
    """First run at or after ``as_of``: whole deltas, or whole months where there is no delta.

    A month step keeps the day, or takes the last day of a shorter month. A delta
    that is not positive leaves the run where it is.
    """
    now = _moment(as_of)
    gap = F.timestamp_diff("MICROSECOND", last_run, now)
    step = delta.cast("bigint") * 1000000
    steps = F.when(gap > 0, F.call_function("div", gap + step - 1, step)).otherwise(0)
    by_delta = F.timestamp_add("MICROSECOND", steps * step, last_run)
    # whole months to the month of ``now``, one more where that lands too early
    months = (F.year(now) - F.year(last_run)) * 12 + F.month(now) - F.month(last_run)
    landed = F.timestamp_add("MONTH", months, last_run)
    months = F.greatest(F.when(landed < now, months + 1).otherwise(months), F.lit(0))
    by_month = F.timestamp_add("MONTH", months, last_run)
    rolled = F.when(delta.isNull() | (delta == 0), by_month).when(delta > 0, by_delta).otherwise(last_run)
    return F.when(last_run >= now, last_run).otherwise(rolled)


def upcoming_flags(flagged: Column, as_of) -> Column:
    """One-time runs still ahead, in order."""
    now = _moment(as_of)
    return F.array_sort(F.filter(flagged, lambda run: run > now))


def earliest_flagged(next_run: Column, flagged: Column, as_of) -> Column:
    """The next run, or the earliest one-time run ahead where that is sooner."""
    return F.least(next_run, F.array_min(upcoming_flags(flagged, as_of)))
