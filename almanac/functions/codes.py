"""Retail product codes as arithmetic on whole-number columns.

No strings or arrays are built, so the expressions stay inside generated code.
Codes are whole numbers below 10**18; a result that does not fit a long raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 13  # digits a code is padded to before its check digit is computed
MAX_DIGITS = 19


def _div(col: Column, by: int) -> Column:
    return F.call_function("div", col, F.lit(by).cast("bigint"))


def gtin_to_upc(col: Column) -> Column:
    """Drop the last digit (floor division by ten)."""
    c = col.cast("bigint")
    return _div(c - F.pmod(c, F.lit(10).cast("bigint")), 10)


def check_digit(col: Column) -> Column:
    """Check digit of a non-negative code: odd positions from the left count three times.

    A code of up to 13 digits is padded to 13, so its last digit is in an odd
    position; a longer code is not padded and the weights follow its length.
    """
    c = col.cast("bigint")
    digits = [_div(c, 10**k) % F.lit(10).cast("bigint") for k in range(MAX_DIGITS)]
    even_places = reduce(Column.__add__, digits[0::2])
    odd_places = reduce(Column.__add__, digits[1::2])
    even_length = reduce(
        Column.__or__,
        [(c >= 10 ** (n - 1)) & (c < 10**n) for n in range(WIDTH + 1, MAX_DIGITS, 2)],
    )
    total = F.when(even_length, even_places + odd_places * 3).otherwise(even_places * 3 + odd_places)
    return (F.lit(10) - total % 10) % 10


def upc_to_gtin(col: Column) -> Column:
    """Append the check digit. 0 and NULL stay; a negative code gives NULL."""
    c = col.cast("bigint")
    return F.when(c == 0, c).when(c > 0, c * 10 + check_digit(c))


def to_manufacturer(col: Column) -> Column:
    """First five digits; shorter and negative codes stay."""
    c = col.cast("bigint")
    return F.when(c >= 100000, F.substring(c.cast("string"), 1, 5).cast("bigint")).otherwise(c)


def slu_to_upc(col: Column) -> Column:
    """Five zeros appended."""
    return col.cast("bigint") * 100000


def slu_to_gtin(col: Column) -> Column:
    """Five zeros and a check digit appended."""
    return upc_to_gtin(slu_to_upc(col))
