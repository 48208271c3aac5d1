"""Tables from the catalog, other databases and the driver program."""

from __future__ import annotations

import datetime
import decimal
import itertools
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import default_name, unique_names
from ..operators.rows import equals_all

# Names of simple types and of database types that mean them.
TYPE_NAMES = {
    "NULL": "string",
    "BLOB": "binary",
    "BOOLEAN": "boolean",
    "TEXT": "string",
    "VARCHAR": "string",
    "CHAR": "string",
    "INTEGER": "bigint",
    "SMALLINT": "bigint",
    "BYTEINT": "bigint",
    "BIGINT": "bigint",
    "REAL": "double",
    "DECIMAL": "double",
    "DOUBLE": "double",
    "NUMBER": "double",
    "DATETIME": "timestamp_ntz",
    "DATE": "timestamp_ntz",
    "TIMESTAMP": "timestamp_ntz",
}


def from_select(
    source: DataFrame, fields: Sequence[str] | None = None, where: Sequence[tuple[str, object]] = ()
) -> DataFrame:
    """Columns of the rows for which all equalities hold; no fields means all columns."""
    rows = source.where(equals_all(where, null_words=False)) if where else source
    return rows.select(*fields) if fields else rows


def from_database(
    spark: SparkSession,
    options: Mapping[str, str],
    query: str | None = None,
    table: str | None = None,
    split: tuple[str, object, object, int] | None = None,
) -> DataFrame:
    """A query or table of another database over JDBC.

    ``options`` hold url, driver, user and the like. ``split`` is (column, lower,
    upper, parts) for a parallel read; it needs ``table``, since Spark does not split
    a query text.
    """
    reader = spark.read.format("jdbc").options(**options)
    if (query is None) == (table is None):
        raise ValueError("give either query or table")
    if query is not None:
        if split:
            raise ValueError("a split read needs table=..., for a query write table='(<query>) q'")
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table)
    if split:
        column, lower, upper, parts = split
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", str(parts))
        )
    return reader.load()


def _type_of(values: Sequence) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= set():
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        big = any(not -(2**63) <= v < 2**63 for v in values if v is not None)
        return T.DecimalType(38, 0) if big else T.LongType()
    if kinds <= {int, float, decimal.Decimal}:
        return T.DoubleType()
    if kinds == {datetime.date}:
        return T.DateType()
    if kinds <= {datetime.date, datetime.datetime}:
        return T.TimestampNTZType()
    if kinds == {bytes}:
        return T.BinaryType()
    return T.StringType()


def _cell(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        if isinstance(value, (list, tuple, dict)):
            return json.dumps(value)
        return value if isinstance(value, str) else str(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    if isinstance(kind, T.TimestampNTZType) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    return value


def from_rows(
    spark: SparkSession,
    data: Sequence[Sequence] = (),
    header: Sequence[str] = (),
    row_first: bool = True,
    known_types: Sequence[str] | None = None,
) -> DataFrame:
    """A small table from values in the driver program.

    ``data`` are rows, or columns with ``row_first=False``; short ones are padded with
    NULL. Names missing from ``header`` are ``_field_<i>``; a header alone gives an
    empty table. ``known_types`` are type names; else types come from the values.
    """
    columns = list(itertools.zip_longest(*data)) if row_first else [list(c) for c in data]
    length = max((len(c) for c in columns), default=0)
    columns = [list(c) + [None] * (length - len(c)) for c in columns]
    if not columns:
        columns = [[] for _ in header]
    names = [header[i] if i < len(header) and header[i] else default_name(i) for i in range(len(columns))]
    if known_types:
        kinds = [_type_of(c) for c in columns]
        wanted = [TYPE_NAMES[t.upper()] for t in known_types]
    else:
        kinds = [_type_of(c) for c in columns]
        wanted = [k.simpleString() for k in kinds]
    fields = [T.StructField(n, k) for n, k in zip(unique_names(names), kinds)]
    cells = [[_cell(v, k) for v in c] for c, k in zip(columns, kinds)]
    df = spark.createDataFrame(list(zip(*cells)), T.StructType(fields))
    return df.select(*[F.col(f.name).cast(w).alias(f.name) for f, w in zip(fields, wanted)])
