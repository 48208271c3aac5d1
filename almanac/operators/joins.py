"""Equi-joins of two tables by one or more key pairs, and folds over many tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import unique_names
from ..functions.text import fold_case
from .columns import Key, position_of
from .setops import union

JOIN_WORDS = ("inner", "left", "right", "outer")
UNION_WORDS = ("union", "unite")
EXACT_NUMBER = "decimal(38,10)"
#: Text with a nonzero digit behind the ten that EXACT_NUMBER keeps, or written with an exponent.
TOO_FINE = r"\.\d{10}\d*[1-9]|[eE]"


def _comparable(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, nocase: bool) -> tuple[Column, Column]:
    """Key expressions of both sides: ASCII case folded for text, and text read as the
    other side's type where that is a number, a date, a time or a boolean.

    Text that cannot be read so matches nothing. Whole and decimal numbers are compared
    without rounding: text with more digits than the decimal keeps is no match.
    """
    a_text, b_text = isinstance(a_type, T.StringType), isinstance(b_type, T.StringType)
    if a_text and b_text:
        return (fold_case(a), fold_case(b)) if nocase else (a, b)
    if b_text and not a_text:
        right, left = _comparable(b, b_type, a, a_type, nocase)
        return left, right
    if not a_text:
        return a, b
    text = F.trim(a)
    if isinstance(b_type, (T.FloatType, T.DoubleType)):
        return text.try_cast("double"), b.cast("double")
    if isinstance(b_type, T.NumericType):
        return F.when(~text.rlike(TOO_FINE), text.try_cast(EXACT_NUMBER)), b.cast(EXACT_NUMBER)
    if isinstance(b_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return text.try_cast(b_type), b
    return a, b


def join(
    left: DataFrame,
    right: DataFrame,
    how: str = "union",
    on: Sequence[tuple[Key, Key]] = (),
    nocase: bool = True,
    nulls_equal: bool = False,
    drop_redundant: bool = True,
    skewed: bool = False,
) -> DataFrame:
    """Join two tables.

    ``how``: inner, left, right, outer, or union for a bag union by position.
    ``on``: pairs of (left key, right key), by name or position, all of which must
    match. Text keys ignore ASCII case unless ``nocase`` is False. NULL keys match
    only with ``nulls_equal``.

    The result has the left columns, then the right ones, with unique names. Inner
    and left joins drop the right keys, a right join drops the left keys, an outer
    join keeps both; ``drop_redundant=False`` keeps all.

    Adaptive execution splits a hot key on either side of an inner join and on the
    preserved side of an outer one. Where a key may be hot on the side that an outer join
    fills with NULL, say ``skewed=True``: the join then runs as an inner join plus the
    rows without a partner, which splits there too and reads both inputs twice. Nothing
    is counted and no job runs while a join is built.
    """
    how = how.lower().strip()
    if how in UNION_WORDS:
        return union(left, right)
    if how not in JOIN_WORDS:
        raise ValueError(f"unknown join {how!r}")
    if not on:
        raise ValueError("a join needs at least one pair of keys")

    left_keys = [position_of(left.columns, a) for a, _ in on]
    right_keys = [position_of(right.columns, b) for _, b in on]
    l_names = [f"l{i}" for i in range(len(left.columns))]
    r_names = [f"r{i}" for i in range(len(right.columns))]
    l_df, r_df = left.toDF(*l_names), right.toDF(*r_names)
    pairs = [
        _comparable(F.col(l_names[i]), left.schema[i].dataType, F.col(r_names[j]), right.schema[j].dataType, nocase)
        for i, j in zip(left_keys, right_keys)
    ]

    if how == "inner":
        joined = l_df.join(r_df, _matches(pairs, nulls_equal), "inner")
    else:
        if skewed:
            joined = _outer_by_parts(l_df, r_df, pairs, how, nulls_equal)
        else:
            joined = l_df.join(r_df, _matches(pairs, nulls_equal), {"outer": "full_outer"}.get(how, how))

    gone: set[str] = set()
    if drop_redundant and how in ("inner", "left"):
        gone = {r_names[j] for j in right_keys}
    elif drop_redundant and how == "right":
        gone = {l_names[i] for i in left_keys}
    kept = [(c, n) for c, n in zip(l_names + r_names, left.columns + right.columns) if c not in gone]
    names = unique_names([n for _, n in kept])
    return joined.select(*[F.col(c).alias(n) for (c, _), n in zip(kept, names)])


def _matches(pairs: Sequence[tuple[Column, Column]], nulls_equal: bool) -> Column:
    return reduce(Column.__and__, [a.eqNullSafe(b) if nulls_equal else a == b for a, b in pairs])


def _outer_by_parts(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[Column, Column]], how: str, nulls_equal: bool
) -> DataFrame:
    """Inner join plus, for each preserved side, its rows without a partner.

    The keys that the missing-partner check compares with are made distinct first,
    so a hot key is one row there.
    """
    names = left.columns + right.columns
    parts = [left.join(right, _matches(pairs, nulls_equal), "inner")]
    mine = [a for a, _ in pairs]
    other = [b for _, b in pairs]
    for side, keys, far, far_keys, wanted in (
        (left, mine, right, other, ("left", "outer")),
        (right, other, left, mine, ("right", "outer")),
    ):
        if how in wanted:
            aliases = [f"x{i}" for i in range(len(keys))]
            present = far.select(*[k.alias(x) for k, x in zip(far_keys, aliases)]).distinct()
            lonely = side.join(present, _matches(list(zip(keys, map(F.col, aliases))), nulls_equal), "left_anti")
            padding = [F.lit(None).cast(f.dataType).alias(f.name) for f in far.schema]
            parts.append(lonely.select("*", *padding).select(*names))
    return reduce(DataFrame.union, parts)


MergeRule = tuple[tuple[int, int], str, Sequence[tuple[Key, Key]]]


def merge_plan(
    tables: Sequence[DataFrame], rules: Sequence[MergeRule], complete: bool = False, **options
) -> list[DataFrame]:
    """Fold tables by rules ``((i, j), how, on)``: the join of i and j replaces i.

    All j are removed at the end. ``complete`` joins every table to the first one
    with the first rule. ``options`` go to :func:`join`.
    """
    if not rules:
        return list(tables)
    if complete:
        _, how, on = rules[0]
        rules = [((0, j), how, on) for j in range(1, len(tables))]
    result = list(tables)
    merged = set()
    for (i, j), how, on in rules:
        result[i] = join(result[i], result[j], how, on, **options)
        merged.add(j)
    return [t for i, t in enumerate(result) if i not in merged]
