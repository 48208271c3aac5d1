"""Casts that turn bad or empty text into NULL instead of failing the job."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in a column name that announce dates, and the text date format.
DATE_WORDS = ["dt", "date", "dates", "dts", "time", "run"]
DATE_NAME_PATTERN = r"(^|[ _])(" + "|".join(DATE_WORDS) + r")($|[ _])"
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy.MM.dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MM-dd-yyyy",
    "dd MMM yyyy",
    "yyyyMMdd",
)


def is_date_name(name: str) -> bool:
    return re.search(DATE_NAME_PATTERN, name.lower()) is not None


def cast_known(col: Column, to: str) -> Column:
    """Cast to ``to``; blank text and values that do not parse become NULL."""
    return F.nullif(F.trim(col.cast("string")), F.lit("")).try_cast(to)


def cast_failed(col: Column, to: str) -> Column:
    """True where a value is present but does not parse as ``to``."""
    text = F.nullif(F.trim(col.cast("string")), F.lit(""))
    return text.isNotNull() & text.try_cast(to).isNull()


def cast_columns(df: DataFrame, types: dict[str, str], flag_bad: bool = False) -> DataFrame:
    """Cast the named columns; ``flag_bad`` adds ``<name>__bad`` columns."""
    flags = [cast_failed(df[name], to).alias(f"{name}__bad") for name, to in types.items()] if flag_bad else []
    body = [cast_known(df[n], types[n]).alias(n) if n in types else df[n] for n in df.columns]
    return df.select(*body, *flags)


def parse_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses; NULL when none does."""
    text = F.trim(col.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_date_columns(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Parse the string columns whose name announces dates."""
    strings = {n for n, t in df.dtypes if t == "string" and is_date_name(n)}
    return df.select(*[parse_date(df[n], formats).alias(n) if n in strings else df[n] for n in df.columns])


def text_to_date(col: Column, fmt: str = DATE_FORMAT) -> Column:
    """Parse text; the last ``.`` and what follows it (fractions of a second) are ignored."""
    return F.try_to_timestamp(F.regexp_replace(col, r"^(.+)\..*$", "$1"), F.lit(fmt)).cast("timestamp_ntz")


def date_to_text(col: Column, fmt: str = DATE_FORMAT) -> Column:
    return F.date_format(col, fmt)
