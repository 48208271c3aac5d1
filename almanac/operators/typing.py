"""Column types from values, in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casting import DATE_FORMATS, is_date_name, parse_date
from .columns import position_of

INTEGER = r"^[+-]?\d{1,18}$"
LONG_INTEGER = r"^[+-]?\d{1,38}$"
REAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEAN = r"^(?i:true|false)$"

SPARK_TYPES = {
    "NULL": "string",
    "BOOLEAN": "boolean",
    "INTEGER": "bigint",
    "LONG_INTEGER": "decimal(38,0)",
    "REAL": "double",
    "DATETIME": "timestamp_ntz",
    "TEXT": "string",
}


def _count(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def infer_types(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """One row per column: ``position``, ``column``, ``n_values``, ``n_bad``, ``simple_type``.

    The type is the narrowest of BOOLEAN, INTEGER, LONG_INTEGER (19 to 38 digits), REAL, DATETIME that every value
    that is not empty parses as, else TEXT; NULL where there is no value. Dates are
    looked for only in columns whose name announces them. ``n_bad`` counts the
    values that kept a column from being a number.
    """
    names = df.columns
    texts = df.select(*[F.nullif(F.trim(c.cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(_cells(df))])
    totals = []
    for i, name in enumerate(names):
        c = F.col(f"c{i}")
        dates = _count(parse_date(c, formats).isNotNull()) if is_date_name(name) else F.lit(-1).cast("bigint")
        totals.append(
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(name).alias("column"),
                F.count(c).alias("n_values"),
                _count(c.rlike(BOOLEAN)).alias("booleans"),
                _count(c.rlike(INTEGER)).alias("integers"),
                _count(c.rlike(LONG_INTEGER)).alias("long_integers"),
                _count(c.rlike(REAL)).alias("reals"),
                dates.alias("dates"),
            ).alias(f"t{i}")
        )
    one_row = texts.agg(*totals)
    long = one_row.select(F.inline(F.array(*[f"t{i}" for i in range(len(names))])))
    n = F.col("n_values")
    kind = (
        F.when(n == 0, "NULL")
        .when(F.col("booleans") == n, "BOOLEAN")
        .when(F.col("dates") == n, "DATETIME")
        .when(F.col("integers") == n, "INTEGER")
        .when(F.col("long_integers") == n, "LONG_INTEGER")
        .when(F.col("reals") == n, "REAL")
        .otherwise("TEXT")
    )
    return long.select("position", "column", "n_values", (n - F.col("reals")).alias("n_bad"), kind.alias("simple_type"))


def _cells(df: DataFrame) -> list[Column]:
    names = df.columns
    return [df[names[position_of(names, i)]] for i in range(len(names))]


def apply_types(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Cast every column to its inferred type; empty text becomes NULL.

    The inferred types (one small row per column) are read once; the cast itself
    stays lazy.
    """
    kinds = {r["position"]: r["simple_type"] for r in infer_types(df, formats).collect()}
    out = []
    for i, (name, cell) in enumerate(zip(df.columns, _cells(df))):
        text = F.nullif(F.trim(cell.cast("string")), F.lit(""))
        kind = kinds[i]
        if kind == "DATETIME":
            value = parse_date(text, formats)
        elif kind in ("TEXT", "NULL"):
            value = F.nullif(cell.cast("string"), F.lit(""))
        else:
            value = text.try_cast(SPARK_TYPES[kind])
        out.append(value.alias(name))
    return df.select(*out)
