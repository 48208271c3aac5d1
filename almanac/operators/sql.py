"""SQL over DataFrames, always with bound parameters."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

DATE_PARAMETERS = ("rundate_f", "ly_f", "rundate_i", "ly_i")


def select(
    df: DataFrame, sql: str, values: Sequence | Mapping[str, object] | None = None, name: str | None = None
) -> DataFrame:
    """Run a SELECT over one table, known in the text as ``name`` or as ``{t}``.

    ``values`` fill ``?`` (a list) or ``:name`` (a mapping) markers.
    """
    view = name or f"t_{uuid.uuid4().hex}"
    return from_sql(df.sparkSession, sql.replace("{t}", view), values, {view: df})


def from_sql(
    spark: SparkSession,
    sql: str,
    values: Sequence | Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run any SELECT over catalog tables, and over ``tables`` under their given names.

    A temporary view that the caller has under such a name is hidden meanwhile and there again afterwards.
    """
    tables = tables or {}
    hidden = {}
    for name, df in tables.items():
        if _is_view(spark, name):
            hidden[name] = spark.table(name)
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql, args=_args(values))
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables())


def _args(values):
    if not values:
        return None
    return dict(values) if isinstance(values, Mapping) else list(values)


def report_values(dates: Mapping[str, object], variables: Mapping[str, object] | None = None) -> dict[str, object]:
    """Parameters of a report query: the run dates, and variables of which a value that
    names a run date is replaced by that date."""
    known = {k: dates.get(k) for k in DATE_PARAMETERS}
    mine = {k: known[v] if isinstance(v, str) and v in known else v for k, v in (variables or {}).items()}
    return {**mine, **known}


def report_sql(
    spark: SparkSession,
    sql: str,
    dates: Mapping[str, object],
    variables: Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """A report query with ``:rundate_f``, ``:ly_f``, ``:rundate_i``, ``:ly_i`` and own ``:variables``."""
    return from_sql(spark, sql, report_values(dates, variables), tables)
