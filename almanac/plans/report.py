"""A whole report: get tables, merge them, keep a history, write the result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unique_names
from ..operators.dml import flatten_nested, snapshot_append
from ..operators.joins import MergeRule, merge_plan
from ..operators.sql import report_sql
from .dates import date_range_table

Source = Mapping[str, DataFrame] | Callable[[str, Mapping], DataFrame] | DataFrame


@dataclass
class ReportTable:
    """A result with its name and where it came from."""

    data: DataFrame
    name: str
    note: str = ""


@dataclass
class Report:
    """What a report is made of.

    ``data``: (source, SQL text, variables) entries. A source is a set of named
    tables that the SQL may use, a function of SQL and parameters (such as a read
    from another database), or a finished DataFrame, which ignores the SQL.
    ``merge``: rules of :func:`almanac.operators.joins.merge_plan`.
    """

    name: str
    data: Sequence[tuple[Source, str, Mapping]]
    merge: Sequence[MergeRule] = ()
    complete: bool = False
    dates: Mapping[str, object] = field(default_factory=dict)
    merge_options: Mapping[str, object] = field(default_factory=dict)


def get_data(spark: SparkSession, report: Report) -> list[ReportTable]:
    tables = []
    for i, (source, sql, variables) in enumerate(report.data):
        if isinstance(source, DataFrame):
            df = source
        elif callable(source):
            df = source(sql, {**variables, **report.dates})
        else:
            df = report_sql(spark, sql, report.dates, variables, source)
        tables.append(ReportTable(df, f"Data{i}", sql))
    return tables


def merge_data(tables: Sequence[ReportTable], report: Report) -> list[ReportTable]:
    """Merged tables; the note of a merged table has the notes of its parts."""
    merged = merge_plan([t.data for t in tables], report.merge, report.complete, **report.merge_options)
    rules = [((0, j), h, o) for j in range(1, len(tables)) for _, h, o in report.merge[:1]] if report.complete else report.merge
    notes = [t.note for t in tables]
    for (i, j), how, on in rules:
        notes[i] = f"{notes[i]}\n{how.upper()} {list(on)}\n{notes[j]}"
    gone = {j for (_, j), _, _ in rules}
    left = [n for k, n in enumerate(notes) if k not in gone]
    return [ReportTable(df, f"Data{k}", note) for k, (df, note) in enumerate(zip(merged, left))]


def run_report(
    spark: SparkSession,
    report: Report,
    run_datetime=None,
    sub_task: str = "",
    history: str | None = None,
    date_table: bool = False,
    folder: str | None = None,
) -> list[ReportTable]:
    """Get, merge and, where asked for, keep and write.

    ``history``: a database in which each result is appended to its history table with ``run_datetime`` and ``sub_task``.
    ``date_table`` adds a table with the report's date range and that of last year. ``folder``: where the results and
    their provenance are written. Getting and merging is lazy; only the last two run jobs, and the tables they wrote are
    the ones returned.
    """
    tables = merge_data(get_data(spark, report), report)
    if history:
        names = backup_report(tables, report.name, run_datetime, sub_task, history)
        now = F.col("run_datetime") == F.lit(run_datetime).cast("timestamp_ntz")
        for table, name in zip(tables, names):
            own = spark.table(name).where(now & (F.col("sub_task") == sub_task))
            table.data = own.select(*table.data.columns)
    if date_table:
        dates = date_range_table(spark, report.dates.get("rundate_i"), report.dates.get("rundate_f"))
        tables.append(ReportTable(dates, "Dates", "date range of the run"))
    if folder:
        written = write_report(spark, tables, folder)
        for table, name in zip(tables, written):
            table.data = spark.read.parquet(f"{folder}/{name}")
    return tables


def backup_report(tables: Sequence[ReportTable], task: str, run_datetime, sub_task: str = "", database: str | None = None) -> list[str]:
    """Append each table to its history table ``<task>_<i>``."""
    names = [f"{database}.{task}_{i}" if database else f"{task}_{i}" for i in range(len(tables))]
    for table, name in zip(tables, names):
        snapshot_append(table.data, name, run_datetime, sub_task)
    return names


def write_report(spark: SparkSession, tables: Sequence[ReportTable], folder: str) -> list[str]:
    """One folder per table, with unique names, and ``_provenance`` with each table's note.

    Returns the names used.
    """
    names = unique_names([t.name or f"Data{i}" for i, t in enumerate(tables)])
    for name, table in zip(names, tables):
        flatten_nested(table.data).write.parquet(f"{folder}/{name}")
    notes = spark.createDataFrame([(n, t.note) for n, t in zip(names, tables)], "table string, note string")
    notes.coalesce(1).write.parquet(f"{folder}/_provenance")
    return names


def read_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_provenance").select("table", "note")


def sheet_summary(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """``table``, ``n_columns``, ``n_rows`` of a written report."""
    parts = [
        df.agg(F.lit(n).alias("table"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.count(F.lit(1)).alias("n_rows"))
        for n, df in ((n, spark.read.parquet(f"{folder}/{n}")) for n in names)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
