import datetime
from urllib.parse import unquote

import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from almanac.operators import dml
from almanac.operators.sql import from_sql, report_values, select
from almanac.plans.report import Report, ReportTable, backup_report, read_provenance, run_report, sheet_summary, write_report
from almanac.session import scratch_path
from almanac.streaming.inbox import watch


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (None, "c", 7.0)], "k int, s string, v double")


@pytest.fixture(scope="module")
def database(spark):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS store LOCATION '{scratch_path(spark, 'store')}'")
    return "store"


def test_rows_deleted_and_updated(keyed):
    assert rows(dml.delete_where(keyed, [("k", 1), ("s", "a")])) == rows(keyed.where("s <> 'a'"))
    assert dml.delete_where(keyed, [("v", None)]).count() == 3
    with pytest.raises(ValueError):
        dml.delete_where(keyed, [])
    got = dml.update_where(keyed, [("k", 1)], {"v": None, "s": "z"})
    assert rows(got) == sorted([(1, "z", None), (2, "b", None), (None, "c", 7.0)], key=repr)
    assert got.schema["v"].dataType == keyed.schema["v"].dataType
    with pytest.raises(KeyError):
        dml.update_where(keyed, [("k", 1)], {"w": 1})


def test_insert_if_absent(spark, keyed):
    new = spark.createDataFrame([(1, "n1", 0.0), (4, "n5", 0.0), (4, "n4", 0.0), (None, "n6", 0.0), (None, "n7", 0.0)], keyed.schema)
    got = dml.insert_if_absent(keyed, new, ["k"], ["s"])
    assert sorted(values(got, 1)) == ["a", "b", "c", "n4", "n6", "n7"]
    again = dml.insert_if_absent(got, new.where("k is not null"), ["k"], ["s"])
    assert rows(again) == rows(got)


def test_columns_and_dates(spark, keyed):
    assert dml.add_column(keyed, "n", "int", 3).where("n = 3").count() == 3
    assert dml.drop_column(keyed, "v").columns == ["k", "s"]
    assert dml.rename_column(keyed, "v", "w").columns == ["k", "s", "w"]
    for change in (lambda: dml.drop_column(keyed, "x"), lambda: dml.rename_column(keyed, "x", "y")):
        with pytest.raises(KeyError):
            change()
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d),) for d in (1, 2, 3)] + [(None,)], "d timestamp_ntz")
    assert dml.delete_before(df, "d", datetime.date(2024, 1, 2)).count() == 3


def test_stored_table(spark, database, keyed):
    name = f"{database}.keyed"
    dml.create_table(keyed, name)
    dml.create_table(keyed, name)
    with pytest.raises(ValueError):
        dml.create_table(keyed, name, if_not=False)
    assert spark.table(name).count() == 0
    dml.write_table(keyed, name)
    dml.write_table(keyed.toDF("x", "y", "z"), name)
    assert spark.table(name).count() == 6
    with pytest.raises(ValueError):
        dml.write_table(keyed, name, if_not=False)
    dml.rewrite_table(spark, name, lambda df: dml.delete_where(df, [("k", 1)]))
    assert rows(spark.table(name)) == rows(keyed.where("k is null or k <> 1").union(keyed.where("k is null or k <> 1")))
    dml.rewrite_table(spark, name, lambda df: dml.rename_column(df, "s", "t"))
    dml.add_table_column(spark, name, "grade", "string", "it's")
    dml.add_table_column(spark, name, "n", "int")
    assert spark.table(name).columns == ["k", "t", "v", "grade", "n"]
    assert set(values(spark.table(name).select("grade"))) == {"it's"}
    dml.append_absent(spark.createDataFrame([(2, "p", 1.0, "g", 1), (9, "q", 1.0, "g", 1)], spark.table(name).schema), name, ["k"])
    assert spark.table(name).where("k = 9").count() == 1 and spark.table(name).where("k = 2").count() == 2
    dml.rename_table(spark, name, f"{database}.other")
    assert not dml.table_exists(spark, name) and dml.table_exists(spark, f"{database}.other")
    spark.sql(f"DROP TABLE {database}.other")


def test_partitioned_replace(spark, database):
    name = f"{database}.parts"
    df = spark.range(10).select((F.col("id") % 2).alias("p"), "id").select("id", "p")
    dml.write_table(df, name, partition_by=["p"])
    dml.replace_table(spark.table(name).where("id > 4"), name, partition_by=["p"])
    assert sorted(values(spark.table(name).select("id"))) == [5, 6, 7, 8, 9]
    spark.sql(f"DROP TABLE {name}")


def test_nested_values_become_text(spark, database):
    name = f"{database}.nested"
    df = spark.createDataFrame([(1, [1, 2], {"a": 1})], "k int, xs array<int>, m map<string,int>").withColumn("v", F.lit(None))
    dml.write_table(df, name)
    assert rows(spark.table(name)) == [(1, "[1,2]", '{"a":1}', None)]
    spark.sql(f"DROP TABLE {name}")


def test_drop_and_archive(spark):
    spark.sql(f"CREATE DATABASE shard LOCATION '{scratch_path(spark, 'shard')}'")
    for t in ("a", "b_temp", "settings"):
        dml.write_table(spark.range(3), f"shard.{t}")
    assert dml.drop_temp_tables(spark, "shard") == ["b_temp"]
    folder = scratch_path(spark, "archive")
    assert dml.archive_database(spark, "shard", folder, "2024-01-01", ["SETTINGS"]) == ["a"]
    assert spark.read.parquet(f"{folder}/2024-01-01/a").count() == 3
    assert [t.name for t in spark.catalog.listTables("shard")] == ["settings"]


def test_snapshots(spark, database):
    for day in (1, 2):
        dml.snapshot_append(spark.range(day), f"{database}.history", datetime.datetime(2024, 1, day), "t")
    got = spark.table(f"{database}.history")
    assert got.columns == ["sub_task", "id", "run_datetime"] and got.count() == 3  # the partition column is last
    dml.snapshot_append(spark.range(1), f"{database}.history", datetime.datetime(2024, 1, 3), "t", overwrite=True)
    assert spark.table(f"{database}.history").count() == 1
    spark.sql(f"DROP TABLE {database}.history")


def test_sql(spark, keyed):
    assert rows(select(keyed, "SELECT s FROM {t} WHERE k > ?", [1])) == [("b",)]
    assert rows(select(keyed, "SELECT s FROM mine WHERE k = :k", {"k": 1}, name="mine")) == [("a",)]
    assert not spark.catalog.tableExists("mine")
    assert rows(select(keyed, "SELECT s FROM {t} WHERE s = ?", ["'; DROP TABLE x"])) == []
    values_ = report_values({"rundate_f": 5, "ly_f": 4}, {"until": "rundate_f", "other": "x"})
    assert values_ == {"until": 5, "other": "x", "rundate_f": 5, "ly_f": 4, "rundate_i": None, "ly_i": None}


def test_report(spark, database, keyed):
    other = spark.createDataFrame([(1, "one"), (3, "three")], "k int, word string")
    report = Report(
        name="demo",
        data=[({"t": keyed}, "SELECT k, s FROM t WHERE k <= :rundate_f", {}), (lambda sql, p: other, "far", {}), (keyed, "own", {})],
        merge=[((0, 1), "outer", [("k", "k")])],
        dates={"rundate_f": 2},
    )
    result = run_report(spark, report)
    assert [t.name for t in result] == ["Data0", "Data1"]
    assert result[0].data.columns == ["k", "s", "kb", "word"] and result[0].data.count() == 3
    assert result[0].note.startswith("SELECT") and "OUTER" in result[0].note and result[0].note.endswith("far")
    names = backup_report(result, "demo", datetime.datetime(2024, 1, 1), "x", database)
    assert [spark.table(n).count() for n in names] == [3, 3]
    folder = scratch_path(spark, "report")
    result.append(ReportTable(keyed.withColumn("xs", F.array(F.lit(1))), "DATA0", "again"))
    written = write_report(spark, result, folder)
    assert written == ["Data0", "Data1", "DATA0b"]
    assert [r.table for r in read_provenance(spark, folder).orderBy("table").collect()] == ["DATA0b", "Data0", "Data1"]
    assert rows(sheet_summary(spark, folder, written)) == [("DATA0b", 4, 3), ("Data0", 4, 3), ("Data1", 3, 3)]


def test_inbox_goes_on_where_it_stopped(spark):
    source, target, state = (scratch_path(spark, n) for n in ("messages", "kept", "state"))
    schema = "subject string, sender string"

    def batch(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        watch(stream, [("(?i)sales", "subject"), ("^boss", "sender")], target, state, available_now=True).awaitTermination()
        return sorted(values(spark.read.schema(schema).parquet(target)))

    assert batch([("Sales Q1", "x"), ("lunch", "y")]) == ["Sales Q1"]
    assert batch([("hello", "boss@a"), (None, None)]) == ["Sales Q1", "hello"]


def test_append_to_a_partitioned_table_keeps_columns_apart(spark, database):
    name = f"{database}.swapped"
    df = spark.createDataFrame([(100, 1), (200, 2)], "k long, id long")
    dml.write_table(df, name, partition_by=["k"])
    dml.write_table(df, name)
    dml.write_table(df.select("id", "k"), name)
    dml.write_table(df.toDF("x", "y"), name)
    assert sorted(tuple(r) for r in spark.table(name).select("k", "id").collect()) == sorted([(100, 1), (200, 2)] * 4)


def test_rewrite_keeps_partitions_and_defaults(spark, database):
    name = f"{database}.kept_parts"
    dml.write_table(spark.range(10).select((F.col("id") % 2).alias("p"), "id"), name, partition_by=["p"])
    dml.rewrite_table(spark, name, lambda df: dml.delete_where(df, [("id", 3)]))
    assert dml.partition_columns(spark, name) == ["p"] and spark.table(name).count() == 9
    plain = f"{database}.kept_default"
    dml.write_table(spark.range(3), plain)
    dml.add_table_column(spark, plain, "note", "string", "new")
    dml.rewrite_table(spark, plain, lambda df: dml.delete_where(df, [("id", 1)]))
    spark.sql(f"INSERT INTO {plain} (id) VALUES (7)")
    assert sorted(tuple(r) for r in spark.table(plain).collect()) == [(0, "new"), (2, "new"), (7, "new")]


def test_failed_replace_leaves_the_old_rows(spark, database, monkeypatch):
    for name, kind in ((f"{database}.safe", {}), (f"{database}.safe_parts", {"partition_by": ["id"]})):
        dml.write_table(spark.range(4).withColumn("v", F.lit(1)), name, **kind)
        broken = spark.range(8).select("id", F.raise_error(F.lit("no")).cast("int").alias("v"))
        with pytest.raises(Exception):
            dml.replace_table(broken, name)
        assert spark.table(name).count() == 4
    monkeypatch.setattr(dml, "rename_table", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        dml.replace_table(spark.range(2).toDF("other"), f"{database}.safe")
    assert spark.table(f"{database}.safe").count() == 4


def test_old_versions_can_be_removed(spark, database):
    name = f"{database}.versions"
    dml.write_table(spark.range(5), name)
    for n in (4, 3):
        dml.replace_table(spark.range(n), name)
    assert dml.remove_old_versions(spark, name) == 2 and dml.remove_old_versions(spark, name) == 0
    assert spark.table(name).count() == 3


def test_expired_runs_leave_the_history(spark, database):
    name = f"{database}.runs"
    for day in (1, 2, 3):
        dml.snapshot_append(spark.range(day), name, datetime.datetime(2024, 1, day, 6), "t")
    assert dml.partition_columns(spark, name) == ["run_datetime"]
    dml.expire(spark, name, "run_datetime", datetime.datetime(2024, 1, 2))
    assert spark.table(name).count() == 5
    plain = f"{database}.dated"
    dml.write_table(spark.sql("SELECT DATE'2024-01-01' AS d UNION ALL SELECT DATE'2024-02-01' UNION ALL SELECT NULL"), plain)
    dml.expire(spark, plain, "d", datetime.date(2024, 1, 15))
    assert spark.table(plain).count() == 2


def test_views_of_the_caller_stay(spark, keyed):
    spark.range(3).createOrReplaceTempView("mine")
    assert rows(select(keyed, "SELECT s FROM mine WHERE k = :k", {"k": 1}, name="mine")) == [("a",)]
    assert from_sql(spark, "SELECT count(*) AS n FROM MINE", tables={"MINE": keyed}).first().n == keyed.count()
    assert spark.table("mine").count() == 3
    spark.catalog.dropTempView("mine")


def files_of(spark, name):
    """Partition folder -> its files."""
    found = {}
    for f in spark.table(name).inputFiles():
        folder, file = f.rsplit("/", 2)[-2:]
        found.setdefault(folder, set()).add(file)
    return found


def test_a_change_writes_only_the_partitions_it_hits(spark, database):
    name = f"{database}.hundred"
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("kind"), (F.col("id") % 100).cast("int").alias("p"))
    dml.write_table(df.repartition(4), name, partition_by=["p"])
    before = files_of(spark, name)
    dml.delete_stored(spark, name, [("id", 342)])
    after = files_of(spark, name)
    assert len(before) == len(after) == 100 and [p for p in before if before[p] != after[p]] == ["p=42"]
    assert rows(spark.table(name)) == rows(df.where("id <> 342"))
    dml.delete_stored(spark, name, [("id", 5000)])
    dml.update_stored(spark, name, [("id", 17)], {"kind": "it's"})
    again = files_of(spark, name)
    assert [p for p in after if after[p] != again[p]] == ["p=17"] and spark.table(name).where("kind = 'it\\'s'").count() == 1
    # rows that move to another partition, to a new one, and all rows of one
    dml.update_stored(spark, name, [("id", 3)], {"p": 5})
    dml.update_stored(spark, name, [("p", 9)], {"p": 109})
    dml.delete_stored(spark, name, [("p", 11)])
    want = df.where("id <> 342 AND p <> 11").withColumn("kind", F.when(F.col("id") == 17, "it's").otherwise(F.col("kind")))
    want = want.withColumn("p", F.when(F.col("id") == 3, 5).when(F.col("p") == 9, 109).otherwise(F.col("p")))
    assert rows(spark.table(name)) == rows(want)
    assert {s["p"] for s in dml.partitions(spark, name)} == {str(i) for i in [*range(100), 109]} - {"9", "11"}
    assert dml.remove_old_versions(spark, name) > 3 and dml.remove_old_versions(spark, name) == 0
    assert rows(spark.table(name)) == rows(want)
    spark.sql(f"DROP TABLE {name}")


def test_odd_partition_values(spark, database):
    name = f"{database}.odd_parts"
    values_ = ["a b", "x/y", "50%", "c=d", "it's", "back\\slash", "é:ü", None]
    df = spark.createDataFrame([(i, v, datetime.datetime(2024, 1, 1 + i % 2, 6, 30)) for i, v in enumerate(values_ * 3)], "id int, v string, t timestamp_ntz")
    dml.write_table(df, name, partition_by=["v", "t"])
    for i, v in enumerate(values_):
        dml.update_stored(spark, name, [("id", i)], {"id": 100 + i})
        dml.delete_stored(spark, name, [("id", 8 + i)])
    want = df.where("id < 8 OR id >= 16").withColumn("id", F.when(F.col("id") < 8, F.col("id") + 100).otherwise(F.col("id")))
    assert rows(spark.table(name)) == rows(want)
    dml.expire(spark, name, "t", datetime.datetime(2024, 1, 2))
    assert rows(spark.table(name)) == rows(want.where("t >= TIMESTAMP_NTZ '2024-01-02'"))
    dml.replace_table(spark.table(name).where("v IS NULL OR v = '50%'"), name)
    assert rows(spark.table(name)) == rows(want.where("t >= TIMESTAMP_NTZ '2024-01-02' AND (v IS NULL OR v = '50%')"))
    dml.write_table(df.where("id = 2"), name)
    assert spark.table(name).where("v = '50%' AND id = 2").count() == 1
    spark.sql(f"DROP TABLE {name}")


def test_rows_that_come_after_expiry_are_alone(spark, database):
    name = f"{database}.late"
    df = spark.createDataFrame([(1, datetime.date(2024, 1, 1)), (2, datetime.date(2024, 1, 1)), (3, datetime.date(2024, 1, 5)), (4, None)], "id int, d date")
    dml.write_table(df, name, partition_by=["d"])
    old = [f for f in spark.table(name).inputFiles() if "2024-01-01" in f]
    dml.expire(spark, name, "d", datetime.date(2024, 1, 3))
    assert sorted(values(spark.table(name))) == [3, 4]
    system, path = dml._file_system(spark, old[0])
    assert not system.exists(path)
    dml.write_table(spark.createDataFrame([(9, datetime.date(2024, 1, 1))], df.schema), name)
    assert sorted(values(spark.table(name))) == [3, 4, 9]
    dml.expire(spark, name, "d", datetime.date(2020, 1, 1))
    assert sorted(values(spark.table(name))) == [3, 4, 9]
    spark.sql(f"DROP TABLE {name}")


def test_a_replaced_table_never_loses_its_name(spark, database, monkeypatch):
    name = f"{database}.named"
    df = spark.range(20).select("id", (F.col("id") % 4).alias("p"))
    dml.write_table(df, name, partition_by=["p"])

    def renamed(*args):
        raise AssertionError("the table was renamed")

    monkeypatch.setattr(dml, "rename_table", renamed)
    dml.replace_table(spark.table(name).where("p <> 1"), name)
    assert rows(spark.table(name)) == rows(df.where("p <> 1"))
    dml.write_table(df.where("id = 1"), name)
    assert spark.table(name).where("p = 1").count() == 1
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("breaks_at", [0, 1, 2])
def test_a_change_of_three_tables_that_breaks_off_is_finished(spark, database, monkeypatch, breaks_at):
    names = [f"{database}.three_{i}_{breaks_at}" for i in range(3)]
    df = spark.range(12).select("id", (F.col("id") % 3).alias("key"))
    for i, name in enumerate(names):
        dml.write_table(df, name, partition_by=["key"] if i else [])
    real, calls = dml._switch, []

    def breaking(spark_, switch):
        if len(calls) == breaks_at:
            raise OSError("lost")
        calls.append(switch["table"])
        real(spark_, switch)

    monkeypatch.setattr(dml, "_switch", breaking)
    with pytest.raises(OSError):
        dml.update_stored(spark, names, [("key", 2)], {"key": 50})
    assert [spark.table(n).where("key = 50").count() > 0 for n in names] == [i < breaks_at for i in range(3)]
    monkeypatch.setattr(dml, "_switch", real)
    assert dml.recover(spark, database) == 1 and dml.recover(spark, database) == 0
    want = rows(df.withColumn("key", F.when(F.col("key") == 2, 50).otherwise(F.col("key"))))
    for name in names:
        assert rows(spark.table(name).select("id", "key")) == want
        spark.sql(f"DROP TABLE {name}")


def test_a_change_that_breaks_off_before_its_record_changes_nothing(spark, database, monkeypatch):
    name = f"{database}.unrecorded"
    df = spark.range(6).select("id", (F.col("id") % 2).alias("p"))
    dml.write_table(df, name, partition_by=["p"])

    def lost(*args):
        raise OSError("lost")

    monkeypatch.setattr(dml, "_commit", lost)
    with pytest.raises(OSError):
        dml.delete_stored(spark, name, [("p", 1)])
    assert rows(spark.table(name)) == rows(df) and dml.recover(spark, database) == 0
    spark.sql(f"DROP TABLE {name}")


def test_a_repeated_run_replaces_its_own_rows(spark, database, monkeypatch):
    name = f"{database}.runs"
    df = spark.range(10)
    one, two = datetime.datetime(2024, 1, 1, 6), datetime.datetime(2024, 1, 2)
    first = dml.snapshot_run(df, name, one, "a/b")
    assert first["rows"] == 10 and dml.snapshot_run(df, name, one, "a/b") == first
    dml.snapshot_run(df.where("id < 3"), name, one, "c")
    dml.snapshot_run(df.where("id < 2"), name, two, "a/b")
    counts = lambda: {(r.sub_task, r.run_datetime.day): r["count"] for r in spark.table(name).groupBy("sub_task", "run_datetime").count().collect()}
    assert counts() == {("a/b", 1): 10, ("c", 1): 3, ("a/b", 2): 2}
    # files that are not what was written are not published
    real, other = dml._moves_to, unquote(spark.table(name).inputFiles()[0].rsplit("/", 1)[0])
    monkeypatch.setattr(dml, "_moves_to", lambda *args: [{**p, "to": other} for p in real(*args)])
    with pytest.raises(OSError):
        dml.snapshot_run(df.where("id = 7"), name, one, "a/b")
    monkeypatch.setattr(dml, "_moves_to", real)
    assert counts() == {("a/b", 1): 10, ("c", 1): 3, ("a/b", 2): 2}
    dml.snapshot_run(df.where("id > 100"), name, one, "a/b")
    assert counts() == {("c", 1): 3, ("a/b", 2): 2}
    spark.sql(f"DROP TABLE {name}")
