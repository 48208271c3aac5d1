"""Run dates of a report and comparison with last year."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import DAYS_PER_YEAR, last_year, next_year, run_date


def run_dates(
    spark: SparkSession,
    flag: str | None = None,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
    as_of: datetime.date | None = None,
) -> dict[str, datetime.date | None]:
    """``rundate_i``, ``rundate_f`` and the same days last year, ``ly_i``, ``ly_f``.

    From a flag seen from ``as_of``, or from start and end days.
    """
    if flag:
        if as_of is None:
            raise ValueError("a flag needs as_of")
        end, start = spark.range(1).select(run_date(F.lit(as_of), flag)).first()[0], None

    def back(day):
        return day - datetime.timedelta(days=DAYS_PER_YEAR) if day else None

    return {"rundate_i": start, "rundate_f": end, "ly_i": back(start), "ly_f": back(end)}


def date_range_table(
    spark: SparkSession, start: datetime.date | None, end: datetime.date | None
) -> DataFrame:
    """One row: start and end of this year's and last year's range."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return spark.range(1).select(
        a.alias("start date ty"),
        b.alias("end date ty"),
        last_year(a).alias("start date ly"),
        last_year(b).alias("end date ly"),
    )


def last_year_from_calendar(days: DataFrame, day: str, calendar: DataFrame, calendar_day: str, ly_day: str) -> DataFrame:
    """Add ``ly_day_dt`` from a calendar table; days it lacks get NULL."""
    lookup = calendar.select(F.col(calendar_day).cast("date").alias("__day"), F.col(ly_day).alias("ly_day_dt"))
    return days.join(lookup, days[day].cast("date") == F.col("__day"), "left").drop("__day")


def ty_ly_compare(
    df: DataFrame, day: str, metrics: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Metrics per day beside those of the same weekday a year before.

    ``metrics`` are aggregate columns by name; the result has ``<name>_ty`` and
    ``<name>_ly``. Days are aggregated first, so the join is over days only.
    """
    daily = df.groupBy(*by, F.col(day).cast("date").alias("day")).agg(*[c.alias(n) for n, c in metrics.items()])
    ty = daily.select(*by, "day", *[F.col(n).alias(f"{n}_ty") for n in metrics])
    ly = daily.select(*[F.col(b).alias(f"__{b}") for b in by], next_year(F.col("day")).alias("__day"),
                      *[F.col(n).alias(f"{n}_ly") for n in metrics])
    on = F.col("day") == F.col("__day")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__{b}"))
    joined = ty.join(ly, on, "left")
    return joined.select(*by, "day", last_year(F.col("day")).alias("ly_day"),
                         *[c for n in metrics for c in (f"{n}_ty", f"{n}_ly")])
