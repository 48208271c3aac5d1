"""Row and column changes.

The first half are functions from the old rows to the new rows. The second half
keeps catalog tables current: a Parquet table cannot change in place, so the new
rows are written to a new folder and the table is pointed there; the old folder
stays, so readers that have started can finish, until :func:`remove_old_versions`.
Tables live below the location of their database, never in the scratch folder.

A change of rows writes again only the partitions that have such rows, of one table or of
several together (:func:`change_tables`): first all new folders are written, then one record of
where every partition goes, then the catalog is told. :func:`recover` finishes a change that broke off after its record.
Nothing is locked: two changes of one table must not run at the same time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import Keys, as_columns
from .rows import equals_all

Where = Sequence[tuple[str, object]]


def delete_where(df: DataFrame, where: Where) -> DataFrame:
    """Delete the rows for which all equalities hold. No equalities: an error, not everything."""
    if not where:
        raise ValueError("delete_where needs a condition")
    return df.where(~F.coalesce(equals_all(where, null_words=False), F.lit(False)))


def update_where(df: DataFrame, where: Where, sets: Mapping[str, object]) -> DataFrame:
    """Set columns where all equalities hold; types stay."""
    hit = equals_all(where, null_words=False)

    def new(field: T.StructField) -> Column:
        value = sets[field.name]
        value = value if isinstance(value, Column) else F.lit(value)
        return F.when(hit, value.cast(field.dataType)).otherwise(F.col(field.name)).alias(field.name)

    unknown = set(sets) - set(df.columns)
    if unknown:
        raise KeyError(f"no column {sorted(unknown)[0]!r}")
    return df.select(*[new(f) if f.name in sets else F.col(f.name) for f in df.schema])


def insert_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """Append by position, cast to the table's types; nested values become JSON text."""
    return df.union(to_schema(new, df.schema))


def to_schema(new: DataFrame, schema: T.StructType) -> DataFrame:
    if len(new.columns) != len(schema):
        raise ValueError(f"{len(new.columns)} columns for a table with {len(schema)}")
    inner = [f"c{i}" for i in range(len(schema))]
    flat = flatten_nested(new.toDF(*inner))
    return flat.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(inner, schema)])


def flatten_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, void columns as text."""

    def flat(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(F.col(field.name)).alias(field.name)
        if isinstance(field.dataType, T.NullType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[flat(f) for f in df.schema])


def absent_rows(df: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Keys = ()) -> DataFrame:
    """Rows of ``new`` whose key is not in ``df``; of several with the same key the first
    in ``order_by``. A key with NULL is equal to nothing, so such rows are always new."""
    names = new.columns
    no_null = ~_any_null(keys)
    columns = F.struct(*[F.col(n) for n in names])
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(as_columns(order_by) or [F.col(n) for n in names])])
    first = (
        new.where(no_null)
        .groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        .agg(F.min_by(columns, order).alias("row"))
        .select("row.*")
    )
    # only old keys that also occur in ``new`` matter: a small ``new`` never shuffles the old table
    held = df.select(*keys).join(new.select(*keys), list(keys), "left_semi").distinct()
    fresh = first.join(held, list(keys), "left_anti").select(*names)
    return fresh.union(new.where(_any_null(keys)).select(*names))


def _any_null(keys: Sequence[str]) -> Column:
    test = F.lit(False)
    for k in keys:
        test = test | F.col(k).isNull()
    return test


def insert_if_absent(df: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Keys = ()) -> DataFrame:
    return df.union(absent_rows(df, new, keys, order_by).select(*df.columns))


def delete_before(df: DataFrame, field: str, moment) -> DataFrame:
    """Retention: delete rows older than ``moment``; rows without a date stay."""
    return df.where(~F.coalesce(F.col(field) < F.lit(moment), F.lit(False)))


def add_column(df: DataFrame, name: str, data_type: str, default=None) -> DataFrame:
    return df.withColumn(name, F.lit(default).cast(data_type))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise KeyError(f"no column {name!r}")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise KeyError(f"no column {old!r}")
    return df.withColumnRenamed(old, new)


def snapshot_rows(df: DataFrame, run_datetime, sub_task: str) -> DataFrame:
    """Rows with the run they belong to in front."""
    moment = F.lit(run_datetime).cast("timestamp_ntz")
    return df.select(moment.alias("run_datetime"), F.lit(sub_task).alias("sub_task"), "*")


# --- catalog tables -----------------------------------------------------------------------


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def create_table(df: DataFrame, table: str, if_not: bool = True, partition_by: Sequence[str] = ()) -> None:
    """An empty table with the columns of ``df``."""
    spark = df.sparkSession
    if table_exists(spark, table):
        if if_not:
            return
        raise ValueError(f"table {table} exists")
    _write_new(flatten_nested(df).limit(0), table, partition_by)


COLUMN_ORDER = "almanac.columns"  # table property: the columns in the order they were given


def _names(spark: SparkSession, table: str) -> tuple[str, str]:
    database, _, name = table.rpartition(".")
    return database or spark.catalog.currentDatabase(), name


def _home(spark: SparkSession, table: str) -> str:
    """The folder of all versions of a table, in its database's location."""
    database, name = _names(spark, table)
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{name}.versions"


def _new_version(spark: SparkSession, table: str) -> str:
    return f"{_home(spark, table)}/{uuid.uuid4().hex}"


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _column_order(spark: SparkSession, table: str) -> list[str]:
    """The columns in the order they were given; Spark itself moves partition columns to the end."""
    known = spark.table(table).columns
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == COLUMN_ORDER).collect()
    first = json.loads(found[0]["value"]) if found else []
    return [c for c in first if c in known] + [c for c in known if c not in first]


def _keep_order(spark: SparkSession, table: str, columns: Sequence[str]) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({_literal(COLUMN_ORDER)} = {_literal(json.dumps(list(columns)))})")


def _write_new(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    spark = df.sparkSession
    writer = df.write.format("parquet").option("path", _new_version(spark, table))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    _keep_order(spark, table, df.columns)


def _aligned(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of the table in its own order, matched by name where all names
    agree and otherwise by position in the order in which the table's columns were given."""
    spark = df.sparkSession
    target = spark.table(table).schema
    if sorted(c.lower() for c in df.columns) == sorted(f.name.lower() for f in target):
        df = df.select(*[f.name for f in target])
        return to_schema(df, target)
    given = T.StructType([target[c] for c in _column_order(spark, table)])
    return to_schema(df, given).select(*target.names)


def write_table(df: DataFrame, table: str, if_not: bool = True, partition_by: Sequence[str] = ()) -> None:
    """Create the table unless it exists (an error with ``if_not=False``) and append all rows.

    Columns meet an existing table by name if the names are the same, else by position.
    """
    spark = df.sparkSession
    if not table_exists(spark, table):
        _write_new(flatten_nested(df), table, partition_by)
    elif not if_not:
        raise ValueError(f"table {table} exists")
    else:
        _aligned(df, table).write.insertInto(table)


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows whose partition column is NULL

Spec = dict[str, str | None]  # partition column -> value as text


def _spec_sql(spec: Spec) -> str:
    return ", ".join(f"`{c}` = {'NULL' if v is None else _literal(v)}" for c, v in spec.items())


def _spec_of(folder: str) -> Spec:
    """The partition of a folder or catalog entry such as ``day=2024-01-01/kind=a``."""
    pairs = (part.split("=", 1) for part in folder.strip("/").split("/"))
    return {unquote(c): None if v == NO_VALUE else unquote(v) for c, v in pairs}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _location(spark: SparkSession, table: str, spec: Spec | None = None) -> str | None:
    """Where a table or one of its partitions is; None for a partition it does not have."""
    of = f" PARTITION ({_spec_sql(spec)})" if spec else ""
    rows = spark.sql(f"DESCRIBE FORMATTED {table}{of}").where(F.col("col_name") == "Location").collect()
    return rows[0]["data_type"].rstrip("/") if rows else None


def partitions(spark: SparkSession, table: str) -> list[Spec]:
    """The partitions that the catalog knows; none for a table without partition columns."""
    if not partition_columns(spark, table):
        return []
    return [_spec_of(r["partition"]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def _written_partitions(spark: SparkSession, path: str, levels: int) -> dict[str, str]:
    """Partition folders below ``path``: relative name -> folder."""
    system, _ = _file_system(spark, path)
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path, *["*=*"] * levels]))
    found = [str(s.getPath()) for s in system.globStatus(glob) or []]
    return {"/".join(f.split("/")[-levels:]): f for f in found}


def _is_in(columns: Sequence[T.StructField], specs: Sequence[Spec]) -> Column:
    """Rows of the given partitions, as a condition that prunes the others."""
    if len(columns) == 1:
        name, kind = columns[0].name, columns[0].dataType
        known = [F.lit(s[name]).cast(kind) for s in specs if s[name] is not None]
        test = F.col(name).isin(known) if known else F.lit(False)
        return test | F.col(name).isNull() if any(s[name] is None for s in specs) else test
    tests = [reduce(Column.__and__, [F.col(f.name).eqNullSafe(F.lit(s[f.name]).cast(f.dataType)) for f in columns]) for s in specs]
    while len(tests) > 1:  # a flat tree, as there may be many partitions
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _touched(spark: SparkSession, table: str, hit: Column) -> list[Spec]:
    """The partitions that have a row for which ``hit`` is true: one row for each of them."""
    columns = partition_columns(spark, table)
    found = spark.table(table).where(hit).select(*[F.col(c).cast("string").alias(c) for c in columns]).distinct()
    return [r.asDict() for r in found.collect()]


def _stage(spark: SparkSession, table: str, hit: Column | None, change: Callable[[DataFrame], DataFrame], moves: Column | None = None) -> dict | None:
    """Write what a change of a table makes of it, and return where its parts then are; None if nothing changes.

    ``hit`` says which rows change (None: any row may). Only partitions with such rows are read and written again. ``moves`` is
    given where rows may change their partition: partitions they go to are touched too.
    """
    columns = partition_columns(spark, table)
    old = spark.table(table)
    path = _new_version(spark, table)
    if not columns:
        if hit is not None and old.where(hit).isEmpty():
            return None
        change(old).select(*old.columns).write.parquet(path)
        return {"table": table, "location": path, "partitions": []}
    fields = [old.schema[c] for c in columns]
    touched = partitions(spark, table) if hit is None else _touched(spark, table, hit)
    if not touched:
        return None
    if moves is not None:
        goes = change(old.where(_is_in(fields, touched))).where(moves).select(*[F.col(c).cast("string").alias(c) for c in columns]).distinct()
        known = {tuple(s.items()) for s in touched}
        touched += [s for s in (r.asDict() for r in goes.collect()) if tuple(s.items()) not in known]
    change(old.where(_is_in(fields, touched))).select(*old.columns).write.partitionBy(*columns).parquet(path)
    return {"table": table, "location": None, "partitions": _moves_to(spark, table, path, touched)}


def _moves_to(spark: SparkSession, table: str, path: str, old: Sequence[Spec]) -> list[dict]:
    """For each partition written below ``path`` its new place, and those of ``old`` that are empty now."""
    columns = partition_columns(spark, table)
    new = [(_spec_of(name), folder) for name, folder in _written_partitions(spark, path, len(columns)).items()]
    left = {tuple(s[c] for c in columns) for s, _ in new}
    gone = [s for s in old if tuple(s[c] for c in columns) not in left]
    return [{"spec": s, "to": folder} for s, folder in new] + [{"spec": s, "to": None, "was": _location(spark, table, s)} for s in gone]


def _switch(spark: SparkSession, switch: dict) -> None:
    """Tell the catalog where a table and its partitions are now. May be done again."""
    table = switch["table"]
    if switch["location"]:
        spark.sql(f"ALTER TABLE {table} SET LOCATION {_literal(switch['location'])}")
    for part in switch["partitions"]:
        spec = _spec_sql(part["spec"])
        if part["to"]:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION {_literal(part['to'])}")
            spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION {_literal(part['to'])}")
        else:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
            # The files must go too: rows that come later for this partition would be put beside them.
            if part["was"] and f"/{_names(spark, table)[1]}.versions/" in part["was"]:
                system, folder = _file_system(spark, part["was"])
                system.delete(folder, True)
    spark.catalog.refreshTable(table)


def _records(spark: SparkSession, database: str) -> str:
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/_changes"


def _commit(spark: SparkSession, switches: Sequence[dict]) -> None:
    """One record of all switches, which counts from its renaming on; then the switches."""
    if not switches:
        return
    folder, name = _records(spark, _names(spark, switches[0]["table"])[0]), uuid.uuid4().hex
    system, open_record = _file_system(spark, f"{folder}/{name}.open")
    out = system.create(open_record)
    out.write(json.dumps(list(switches)).encode())
    out.close()
    record = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
    if not system.rename(open_record, record):
        raise OSError(f"cannot write {record}")
    for switch in switches:
        _switch(spark, switch)
    system.delete(record, False)


def recover(spark: SparkSession, database: str) -> int:
    """Finish the changes that broke off after their record was written; returns how many. Those without a record have changed nothing."""
    system, folder = _file_system(spark, _records(spark, database))
    if not system.exists(folder):
        return 0
    done = 0
    for status in system.listStatus(folder):
        path = status.getPath()
        if path.getName().endswith(".json"):
            text = "".join(r["value"] for r in spark.read.text(str(path), wholetext=True).collect())
            for switch in json.loads(text):
                _switch(spark, switch)
            done += 1
        system.delete(path, False)
    return done


def change_tables(spark: SparkSession, changes: Sequence[tuple[str, Column | None, Callable[[DataFrame], DataFrame]]]) -> None:
    """Change rows of several stored tables of one database together.

    Each entry is a table, the condition for the rows that change (None: any), and a function from old to new rows with the same columns that
    leaves other rows as they are and in their partitions. All new rows are written before the first table is switched.
    """
    staged = [_stage(spark, table, hit, change) for table, hit, change in changes]
    _commit(spark, [s for s in staged if s])


def delete_stored(spark: SparkSession, table: str, where: Where) -> None:
    """:func:`delete_where` in a stored table; partitions without such rows are left as they are."""
    if not where:
        raise ValueError("delete_stored needs a condition")
    change_tables(spark, [(table, equals_all(where, null_words=False), lambda df: delete_where(df, where))])


def update_stored(spark: SparkSession, tables: str | Sequence[str], where: Where, sets: Mapping[str, object]) -> None:
    """:func:`update_where` in a stored table, or in several together; partitions without such rows are left as they are."""
    names = [tables] if isinstance(tables, str) else list(tables)
    hit = equals_all(where, null_words=False)
    staged = []
    for table in names:
        moved = [c for c in partition_columns(spark, table) if c in sets]
        staged.append(_stage(spark, table, hit, lambda df: update_where(df, where, sets), F.lit(True) if moved else None))
    _commit(spark, [s for s in staged if s])


def replace_table(df: DataFrame, table: str, partition_by: Sequence[str] | None = None) -> None:
    """The table with other rows, and with other columns if ``df`` has them.

    ``df`` may read the table itself: the new rows are complete in a folder of their own before the
    switch. With the same columns and partition columns the table and its partitions are pointed to the new folders, and defaults
    and properties stay. A table with other columns is exchanged for a new entry: the old one is kept under
    another name until the new one is in place. ``partition_by`` None keeps the partitioning.
    """
    spark = df.sparkSession
    flat = flatten_nested(df)
    if not table_exists(spark, table):
        _write_new(flat, table, partition_by or ())
        return
    old = partition_columns(spark, table)
    wanted = [c for c in old if c in flat.columns] if partition_by is None else list(partition_by)
    target = spark.table(table).schema
    if wanted == old and {(f.name, f.dataType) for f in flat.schema} == {(f.name, f.dataType) for f in target}:
        path = _new_version(spark, table)
        writer = flat.select(*target.names).write
        (writer.partitionBy(*old) if old else writer).parquet(path)
        _commit(spark, [{"table": table, "location": path, "partitions": _moves_to(spark, table, path, partitions(spark, table)) if old else []}])
        return
    mark = uuid.uuid4().hex[:12]
    _write_new(flat, f"{table}__new_{mark}", wanted)
    rename_table(spark, table, f"{table}__old_{mark}")
    rename_table(spark, f"{table}__new_{mark}", table)
    spark.sql(f"DROP TABLE {table}__old_{mark}")


def rewrite_table(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Copy on write: ``change`` maps the old rows to the new ones. The partitioning stays."""
    replace_table(change(spark.table(table)), table)


def expire(spark: SparkSession, table: str, field: str, moment) -> None:
    """Retention in a stored table: delete rows older than ``moment``; rows without a date stay.

    Where ``field`` is a partition column, old partitions leave the catalog and their files are deleted, without
    reading any data. Otherwise partitions with old rows are written again; a table without partitions is rewritten.
    """
    columns = partition_columns(spark, table)
    old = F.col(field) < F.lit(moment)
    if field not in columns:
        change_tables(spark, [(table, old, lambda df: delete_before(df, field, moment))])
        return
    kind = spark.table(table).schema[field].dataType
    listed = partitions(spark, table)
    if not listed:
        return
    values = spark.createDataFrame([(i, s[field]) for i, s in enumerate(listed)], f"i int, {field} string")
    gone = [listed[r["i"]] for r in values.select("i", F.col(field).cast(kind).alias(field)).where(old).collect()]
    parts = [{"spec": s, "to": None, "was": _location(spark, table, s)} for s in gone]
    _commit(spark, [{"table": table, "location": None, "partitions": parts}] if parts else [])


def remove_old_versions(spark: SparkSession, table: str) -> int:
    """Delete the folders of files that earlier versions of a table have left; returns their number.

    Call it when no reader of an earlier version is left, and no change is under way.
    """
    system, home = _file_system(spark, _home(spark, table))
    if not system.exists(home):
        return 0
    current = {unquote(urlsplit(f).path).rsplit("/", 1)[0] for f in spark.table(table).inputFiles()}
    old = {}
    files = system.listFiles(home, True)
    while files.hasNext():
        path = files.next().getPath()
        if not path.getName().startswith(("_", ".")) and path.getParent().toUri().getPath() not in current:
            old[str(path.getParent())] = path.getParent()
    for folder in old.values():
        system.delete(folder, True)
    # versions of which nothing is left
    table_at = urlsplit(_location(spark, table)).path
    for version in system.listStatus(home):
        at = version.getPath().toUri().getPath()
        if at != table_at and not any(c == at or c.startswith(at + "/") for c in current):
            system.delete(version.getPath(), True)
    return len(old)


def append_absent(new: DataFrame, table: str, keys: Sequence[str], order_by: Keys = ()) -> None:
    """Insert into a stored table the rows whose key it does not hold yet."""
    spark = new.sparkSession
    old = spark.table(table)
    absent_rows(old, new.select(*old.columns), keys, order_by).write.insertInto(table)


def add_table_column(spark: SparkSession, table: str, name: str, data_type: str, default=None) -> None:
    """Add a column with a default; only the catalog entry changes."""
    value = "NULL" if default is None else _literal(default)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (`{name}` {data_type} DEFAULT {value})")


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def drop_tables(
    spark: SparkSession, database: str, protected: Iterable[str] = (), only: Callable[[str], bool] | None = None
) -> list[str]:
    """Drop the tables of one database, except the protected ones; returns the dropped names."""
    keep = {p.lower() for p in protected}
    dropped = []
    for entry in spark.catalog.listTables(database):
        if not entry.isTemporary and entry.name.lower() not in keep and (only is None or only(entry.name)):
            spark.sql(f"DROP TABLE {database}.{entry.name}")
            dropped.append(entry.name)
    return sorted(dropped)


def drop_temp_tables(spark: SparkSession, database: str) -> list[str]:
    """Drop the tables with ``_temp`` in their name."""
    return drop_tables(spark, database, only=lambda name: "_temp" in name)


def snapshot_append(df: DataFrame, table: str, run_datetime, sub_task: str, overwrite: bool = False) -> None:
    """Append the rows of one run to a history table, which has a partition for each run."""
    rows = snapshot_rows(df, run_datetime, sub_task)
    if overwrite:
        replace_table(rows, table, ["run_datetime"])
    else:
        write_table(rows, table, partition_by=["run_datetime"])


def put_partition(df: DataFrame, table: str, values: Mapping[str, object]) -> dict[str, int]:
    """Make ``df`` the rows of one partition of a stored table, whatever it held; no other partition is touched.

    Write, audit, publish: the rows go to a folder of their own, what was written is read back and must have the count and the digest
    that were taken while writing, and only then the catalog is pointed there. So it may be done again, and a broken write leaves the
    table as it was. ``values`` are those of all partition columns, which ``df`` has too. A table that does not exist is created. No rows: the partition goes.
    Returns the audited ``rows`` and ``digest``.
    """
    spark = df.sparkSession
    rows, keys = flatten_nested(df), list(values)
    create_table(rows, table, partition_by=keys)
    if partition_columns(spark, table) != keys:
        raise ValueError(f"table {table} is not partitioned by {keys}")
    aligned = _aligned(rows, table)
    path = _new_version(spark, table)
    digest = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in aligned.columns if c not in keys]))
    marks = [F.count(F.lit(1)).alias("rows"), F.coalesce(digest, F.lit(0)).alias("digest")]
    seen = Observation()
    aligned.observe(seen, *marks).write.partitionBy(*keys).parquet(path)
    texts = spark.range(1).select(*[F.lit(v).cast(aligned.schema[c].dataType).cast("string").alias(c) for c, v in values.items()])
    spec = texts.first().asDict()
    published = _moves_to(spark, table, path, [s for s in partitions(spark, table) if s == spec])
    if any(p["spec"] != spec for p in published):
        raise ValueError(f"rows of {table} are not all in partition {spec}")
    folders = [p["to"] for p in published if p["to"]]
    written = spark.read.schema(aligned.drop(*keys).schema).parquet(*folders).agg(*marks).first().asDict() if folders else {"rows": 0, "digest": 0}
    if written != seen.get:
        raise OSError(f"{table} {spec}: wrote {seen.get}, found {written}; nothing is published")
    _commit(spark, [{"table": table, "location": None, "partitions": published}] if published else [])
    return written


def snapshot_run(df: DataFrame, table: str, run_datetime, sub_task: str) -> dict[str, int]:
    """:func:`put_partition` of one run into a history table, which has a partition for each ``run_datetime`` and ``sub_task``.

    A run that is repeated replaces its own rows and no others.
    """
    values = {"run_datetime": run_datetime, "sub_task": sub_task}
    rows = snapshot_rows(df, run_datetime, sub_task)
    return put_partition(rows, table, values)


def archive_database(
    spark: SparkSession, database: str, folder: str, day: str, protected: Iterable[str] = ()
) -> list[str]:
    """Copy every table that is not protected to ``folder/<day>/<table>``, then drop it."""
    keep = {p.lower() for p in protected}
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.name.lower() not in keep]
    for name in names:
        spark.table(f"{database}.{name}").write.mode("error").parquet(f"{folder}/{day}/{name}")
    drop_tables(spark, database, protected)
    return sorted(names)
