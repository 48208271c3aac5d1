"""Column operators. Keys are names or positions; names may repeat in the input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name, default_name, unique_names
from .ordering import with_position

Key = str | int


def position_of(names: Sequence[str], key: Key) -> int:
    """Position of a column given by name (first one wins) or by position."""
    if isinstance(key, int):
        if not -len(names) <= key < len(names):
            raise IndexError(f"no column {key} in {len(names)} columns")
        return key % len(names)
    if key in names:
        return list(names).index(key)
    raise KeyError(f"no column {key!r} in {list(names)}")


def pick(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Select by position, correct also where names repeat."""
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    return inner.select(*[F.col(f"c{i}").alias(names[i]) for i in positions])


def select_cols(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    return pick(df, [position_of(df.columns, k) for k in keys])


def reorder(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keep, reorder or repeat columns."""
    return pick(df, [position_of(df.columns, p) for p in positions])


def move_to_index(df: DataFrame, old: Key, new: Key) -> DataFrame:
    order = list(range(len(df.columns)))
    target = position_of(df.columns, new)
    order.insert(target, order.pop(position_of(df.columns, old)))
    return pick(df, order)


def add_constants(df: DataFrame, values: Mapping[str, object], front: bool = True) -> DataFrame:
    """Add columns with the same value in every row; a Column is used as it is."""
    new = [(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in values.items()]
    return df.select(*new, "*") if front else df.select("*", *new)


def drop_columns(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    gone = {position_of(df.columns, k) for k in keys}
    return pick(df, [i for i in range(len(df.columns)) if i not in gone])


def rename_header(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename from the left; fewer names leave the rest, empty names are skipped."""
    old = df.columns
    new = [n or o for n, o in zip(names, old)] + old[len(names):]
    return df.toDF(*new[: len(old)])


def default_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[default_name(i) for i in range(len(df.columns))])


def unique_header(df: DataFrame, nocase: bool = True) -> DataFrame:
    return df.toDF(*unique_names(df.columns, nocase))


def clean_header(df: DataFrame, level: int = 1, lower: bool = False, length: int | None = None) -> DataFrame:
    return df.toDF(*unique_names([clean_name(n, level, lower, length) for n in df.columns]))


def concat_columns(
    left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column]
) -> DataFrame:
    """Glue two tables by row position; the shorter side is padded with NULL."""
    names = unique_names(left.columns + right.columns)
    width = len(left.columns)
    a = with_position(left, left_order, "p").toDF(*[f"a{i}" for i in range(width)], "p")
    b = with_position(right, right_order, "p").toDF(*[f"b{i}" for i in range(len(right.columns))], "p")
    joined = a.join(b, "p", "full_outer")
    glued = [f"a{i}" for i in range(width)] + [f"b{i}" for i in range(len(right.columns))]
    return joined.select(*[F.col(c).alias(n) for c, n in zip(glued, names)])


def flatten_values(df: DataFrame) -> DataFrame:
    """One row per cell: column position, column name, value as text."""
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(n).alias("column"),
                F.col(f"c{i}").cast("string").alias("value"),
            )
            for i, n in enumerate(names)
        ]
    )
    return inner.select(F.inline(cells))


def dimensions(df: DataFrame) -> DataFrame:
    """One row: number of columns and rows."""
    return df.agg(
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.count(F.lit(1)).alias("n_rows"),
    )
