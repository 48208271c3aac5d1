"""What the catalog knows about tables, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_SCHEMA = "table string, position bigint, column string, type string"


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``table``, ``kind``: one row per table."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table string, kind string")


def list_columns(spark: SparkSession, table: str | None = None, database: str | None = None) -> DataFrame:
    """``table``, ``position``, ``column``, ``type`` of one table or of all tables of a database."""
    names = [table] if table else [t.name for t in spark.catalog.listTables(database)]
    rows = []
    for name in names:
        full = f"{database}.{name}" if database and "." not in name and not _temporary(spark, name) else name
        rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(spark.table(full).schema)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def _temporary(spark: SparkSession, name: str) -> bool:
    return any(t.name == name and t.isTemporary for t in spark.catalog.listTables())


def find_column(columns: DataFrame, name: str) -> DataFrame:
    """Rows of :func:`list_columns` with that column name, upper or lower case."""
    return columns.where(F.lower("column") == name.lower())


def describe(df: DataFrame) -> DataFrame:
    """``position``, ``column``, ``type`` of a DataFrame."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position bigint, column string, type string")


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)
