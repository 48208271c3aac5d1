"""Row operators: filters by value, condition, pattern and position."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import SINGLE_POSITIONS, Keys, as_columns, directed, last_place, numbered, places_of, split_at, with_position

COMPARISONS = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}
# What a comparison gives for NULL when NULL is lower than every value.
NULL_RESULT = {"==": False, "!=": True, "<": True, "<=": True, ">": False, ">=": False}

Condition = tuple[str, str] | tuple[str, str, object]


def equals_all(where: Sequence[tuple[str, object]], null_words: bool = True) -> Column:
    """AND of equalities. ``None`` matches nothing; with ``null_words`` the values
    ``'null'`` and ``'not null'`` test for NULL."""
    tests = []
    for name, value in where:
        word = value.strip().lower() if null_words and isinstance(value, str) else None
        if word == "null":
            tests.append(F.col(name).isNull())
        elif word == "not null":
            tests.append(F.col(name).isNotNull())
        else:
            tests.append(F.col(name) == F.lit(value))
    return reduce(Column.__and__, tests, F.lit(True))


def filter_equals(df: DataFrame, where: Sequence[tuple[str, object]]) -> DataFrame:
    return df.where(equals_all(where)) if where else df


def _condition(df: DataFrame, condition: Condition, nulls: str) -> Column:
    if len(condition) == 2:
        name, text = condition
        found = re.match(r"\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*$", text, re.S)
        if not found:
            raise ValueError(f"cannot read condition {text!r}")
        op, value = found.group(1), ast.literal_eval(found.group(2))
    else:
        name, op, value = condition
    col = F.col(df.columns[name] if isinstance(name, int) else name)
    if value is None:
        # NULL equals itself and is below everything else
        return {
            "==": col.isNull(),
            "!=": col.isNotNull(),
            "<": F.lit(False),
            "<=": col.isNull(),
            ">": col.isNotNull(),
            ">=": F.lit(True),
        }[op]
    test = COMPARISONS[op](col, F.lit(value))
    if isinstance(df.schema[df.columns[name] if isinstance(name, int) else name].dataType, (T.FloatType, T.DoubleType)):
        test = F.when(F.isnan(col), F.lit(op == "!=")).otherwise(test)
    return F.coalesce(test, F.lit(NULL_RESULT[op] if nulls == "low" else False))


def drop_rows_where(df: DataFrame, conditions: Sequence[Condition], nulls: str = "low") -> DataFrame:
    """Drop the rows for which all conditions hold.

    A condition is ``(column, "< 13")`` or ``(column, "<", 13)``. ``nulls="low"``:
    NULL is below every value; ``nulls="sql"``: a comparison with NULL never holds.
    NaN differs from everything and is neither below nor above anything.
    """
    if nulls not in ("low", "sql"):
        raise ValueError("nulls must be 'low' or 'sql'")
    if not conditions:
        return df.where(F.lit(False))
    return df.where(~reduce(Column.__and__, [_condition(df, c, nulls) for c in conditions]))


def _split(df: DataFrame, positions: Iterable[int], order_by: Keys) -> tuple[DataFrame, DataFrame]:
    """(rows at other positions, rows at ``positions``)."""
    wanted = sorted(set(positions))
    if any(p < 0 for p in wanted):
        raise IndexError("positions start at 0")
    if directed(order_by) and len(wanted) <= SINGLE_POSITIONS:
        return split_at(df, places_of(df, wanted, order_by).values(), order_by)
    name = "__position"
    placed = with_position(df, order_by, name)
    test = F.col(name).isin(wanted)
    return placed.where(~test).drop(name), placed.where(test).drop(name)


def drop_rows(df: DataFrame, positions: Iterable[int], order_by: Keys) -> DataFrame:
    """Rows not at the given positions of the given order.

    Up to 64 positions of an order by columns (names, or name and direction) are found by selection, so only the order's
    columns are looked at and no row moves. More positions, and orders by expressions, take one sort.
    """
    return _split(df, positions, order_by)[0]


def pop_rows(df: DataFrame, positions: Iterable[int], order_by: Keys) -> tuple[DataFrame, DataFrame]:
    """(rest, taken out): both sides of :func:`drop_rows`."""
    return _split(df, positions, order_by)


def pop_last(df: DataFrame, order_by: Keys) -> tuple[DataFrame, DataFrame]:
    """(rest, last row) in the order of ``order_by``."""
    if directed(order_by):
        place = last_place(df, order_by)
        return split_at(df, [place] if place else [], order_by)
    name = "__position"
    placed = with_position(df, order_by, name)
    last = placed.agg(F.max(name)).scalar()
    test = F.col(name) == last
    return placed.where(~test).drop(name), placed.where(test).drop(name)


def row_at(df: DataFrame, position: int, order_by: Keys) -> DataFrame:
    return _split(df, [position], order_by)[1]


def append_rows(df: DataFrame, rows: DataFrame | Sequence[Sequence]) -> DataFrame:
    """Append rows, cast to the table's types; a list of tuples must have its width."""
    if not isinstance(rows, DataFrame):
        wrong = [r for r in rows if len(r) != len(df.columns)]
        if wrong:
            raise ValueError(f"row of length {len(wrong[0])} for {len(df.columns)} columns")
        if not rows:
            return df
        rows = df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema, verifySchema=True)
    elif len(rows.columns) != len(df.columns):
        raise ValueError(f"rows of length {len(rows.columns)} for {len(df.columns)} columns")
    names = [f"c{i}" for i in range(len(df.columns))]
    cast = rows.toDF(*names).select(*[F.col(n).cast(f.dataType) for n, f in zip(names, df.schema)])
    return df.union(cast)


def latest_n(df: DataFrame, n: int, by: str, tie_break: Keys = ()) -> DataFrame:
    """The newest ``n`` rows, newest first."""
    return df.orderBy(F.col(by).desc_nulls_last(), *as_columns(tie_break)).limit(n)


def sample_n(df: DataFrame, n: int = 100, order_by: Keys = ()) -> DataFrame:
    """The first ``n`` rows; any ``n`` rows where no order is given."""
    return (df.orderBy(*as_columns(order_by)) if order_by else df).limit(n)


def matches_any(rules: Sequence[tuple[str, str]]) -> Column:
    """True where any ``(regex, column)`` rule finds its pattern."""
    return reduce(Column.__or__, [F.coalesce(F.col(c).rlike(rx), F.lit(False)) for rx, c in rules], F.lit(False))


def filter_any_regex(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Keep rows that match any rule. Works on batch and streaming tables."""
    unknown = [c for _, c in rules if c not in df.columns]
    if unknown:
        raise KeyError(f"no column {unknown[0]!r}")
    return df.where(matches_any(rules))


def latest_match(
    df: DataFrame,
    pattern: str,
    name: str,
    sent: str,
    mode: str = "all",
    order_by: Keys = (),
    out: str = "saved_as",
    spread: bool = True,
) -> DataFrame:
    """Rows whose ``name`` matches ``pattern``, with the name to save each one under.

    ``mode`` recent: only the latest ``sent``, the first in ``order_by`` on ties, under
    its own name. ``mode`` all: every match; the extension is kept and the stem gets a
    running number 0, 1, ... per stem, in the order of ``order_by``; names without an
    extension are left out.
    """
    found = df.where(F.col(name).rlike(pattern))
    if mode == "recent":
        recent = found.where(F.col(sent).isNotNull()).orderBy(F.col(sent).desc(), *as_columns(order_by)).limit(1)
        return recent.withColumn(out, F.col(name))
    if mode != "all":
        raise ValueError(f"mode must be 'all' or 'recent', not {mode!r}")
    parts = r"^(.*)(\.\w+)$"
    named = (
        found.where(F.col(name).rlike(parts))
        .withColumn("__stem", F.regexp_extract(name, parts, 1))
        .withColumn("__ext", F.regexp_extract(name, parts, 2))
    )
    counted = numbered(named, ["__stem"], order_by, "__n", spread)
    label = F.concat("__stem", (F.col("__n") - 1).cast("string"), "__ext")
    return counted.withColumn(out, label).drop("__stem", "__ext", "__n")


def settings_lookup(df: DataFrame, key: Mapping[str, object], fields: Sequence[str]) -> DataFrame:
    """Fields of the rows with the given key values."""
    return filter_equals(df, list(key.items())).select(*fields)
