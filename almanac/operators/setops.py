"""Bag union by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import default_name, unique_names


def _both(left: T.DataType, right: T.DataType, a: Column, b: Column, coerce: bool) -> tuple[Column, Column]:
    """Give two columns a common type. Text and a number meet as text, unless ``coerce``
    turns the right-hand text into a number."""
    if left == right or isinstance(left, T.NullType) or isinstance(right, T.NullType):
        return a, b
    l_text, r_text = isinstance(left, T.StringType), isinstance(right, T.StringType)
    if r_text and coerce and isinstance(left, T.NumericType):
        return a.cast("double"), F.trim(b).try_cast("double")
    if l_text or r_text:
        return a.cast("string"), b.cast("string")
    return a, b


def union(left: DataFrame, right: DataFrame, coerce: bool = False) -> DataFrame:
    """All rows of both tables, matched by position, duplicates kept.

    The narrower table is padded with NULL columns; names come from the left, and
    padding on the left is called ``_field_<i>``. ``coerce`` reads right-hand text
    as numbers where the left column is one, and empty right-hand text as NULL. A column
    in which some right-hand text is no number becomes text and keeps it; which columns
    that are is found by one aggregate over the right table.
    """
    width = max(len(left.columns), len(right.columns))
    names = unique_names(left.columns + [default_name(i) for i in range(len(left.columns), width)])
    inner = [f"c{i}" for i in range(width)]
    l_df, r_df = left.toDF(*inner[: len(left.columns)]), right.toDF(*inner[: len(right.columns)])
    kept_as_text = _no_numbers(left, right, r_df) if coerce else set()
    l_out, r_out = [], []
    for i, c in enumerate(inner):
        in_left, in_right = i < len(left.columns), i < len(right.columns)
        a = F.col(c) if in_left else F.lit(None)
        b = F.col(c) if in_right else F.lit(None)
        a_type = left.schema[i].dataType if in_left else T.NullType()
        b_type = right.schema[i].dataType if in_right else T.NullType()
        if coerce and isinstance(b_type, T.StringType):
            b = F.nullif(b, F.lit(""))
        a, b = _both(a_type, b_type, a, b, coerce and i not in kept_as_text)
        l_out.append(a.alias(c))
        r_out.append(b.alias(c))
    return l_df.select(*l_out).union(r_df.select(*r_out)).toDF(*names)


def _no_numbers(left: DataFrame, right: DataFrame, r_df: DataFrame) -> set[int]:
    """Positions where the left column is a number and some right-hand text is neither empty nor one."""
    at = [
        i
        for i, (a, b) in enumerate(zip(left.schema, right.schema))
        if isinstance(a.dataType, T.NumericType) and isinstance(b.dataType, T.StringType)
    ]
    if not at:
        return set()
    text = {i: F.nullif(F.trim(F.col(f"c{i}")), F.lit("")) for i in at}
    bad = r_df.agg(*[F.max(text[i].isNotNull() & text[i].try_cast("double").isNull()).alias(f"c{i}") for i in at]).first()
    return {i for i in at if bad[f"c{i}"]}
