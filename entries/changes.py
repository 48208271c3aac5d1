"""Table maintenance, plain and on stored tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from almanac.operators import dml
from almanac.session import scratch_path

from .tables import fresh_table, read


def _customer(spark, sf):
    return read(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("FURNITURE")))


def delete_where(spark, sf):
    return dml.delete_where(_customer(spark, sf), [("c_mktsegment", "MACHINERY"), ("c_nationkey", 3)])


def update_where(spark, sf):
    return dml.update_where(
        _customer(spark, sf), [("c_mktsegment", "BUILDING")], {"c_mktsegment": "HOUSES", "c_acctbal": None, "c_nationkey": 99}
    )


def _fresh_rows(spark, sf):
    """Supplier keys as customers: some keys exist, some repeat, some are NULL."""
    s = read(spark, sf, "supplier")
    key = F.when(F.col("s_suppkey") % 10 == 0, None).otherwise(F.col("s_suppkey") * 40)
    one = s.select(key.alias("c_custkey"), F.col("s_name").alias("c_name"))
    return one.union(one.select("c_custkey", F.concat(F.lit("~"), "c_name")))


def insert_if_absent(spark, sf):
    old = read(spark, sf, "customer").select("c_custkey", "c_name")
    return dml.insert_if_absent(old, _fresh_rows(spark, sf), ["c_custkey"], ["c_name"])


def insert_rows(spark, sf):
    old = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return dml.insert_rows(old, read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


def delete_before(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    return dml.delete_before(e, "ts", datetime.date(2024, 1, 20))


def add_column(spark, sf):
    """On a stored table: old files get the default, later rows bring their own value."""
    name = fresh_table(spark, "supplier")
    s = read(spark, sf, "supplier")
    dml.write_table(s, name)
    dml.add_table_column(spark, name, "grade", "string", "it's new")
    dml.write_table(s.where("s_nationkey = 1").withColumn("grade", F.lit("B")), name)
    return spark.table(name)


def drop_column(spark, sf):
    name = fresh_table(spark, "part")
    dml.write_table(read(spark, sf, "part"), name)
    dml.rewrite_table(spark, name, lambda df: dml.drop_column(df, "p_brand"))
    return spark.table(name)


def rename_column(spark, sf):
    name = fresh_table(spark, "part")
    dml.write_table(read(spark, sf, "part"), name)
    dml.rewrite_table(spark, name, lambda df: dml.rename_column(df, "p_brand", "brand"))
    return spark.table(name)


def rename_table(spark, sf):
    name = fresh_table(spark, "supplier")
    dml.write_table(read(spark, sf, "supplier"), name)
    other = fresh_table(spark, "supplier")
    dml.rename_table(spark, name, other)
    assert not dml.table_exists(spark, name)
    return spark.table(other)


def drop_tables(spark, sf):
    """Temporary tables go, protected ones stay; which are left."""
    database = fresh_table(spark, "drops").replace(".", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'database')}'")
    customer = read(spark, sf, "customer")
    for label in ("orders", "orders_temp", "settings", "part_temp_"):
        dml.write_table(customer, f"{database}.{label}")
    temp = dml.drop_temp_tables(spark, database)
    rest = dml.drop_tables(spark, database, protected=["SETTINGS"])
    kept = spark.table(f"{database}.settings").agg(F.lit("settings").alias("table"), F.count(F.lit(1)).alias("n_rows"))
    gone = customer.where(F.lit(False)).agg(F.lit(",".join(temp + rest)).alias("table"), F.count(F.lit(1)).alias("n_rows"))
    return kept.union(gone)


def snapshot_append(spark, sf):
    name = fresh_table(spark, "history")
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for day, task in ((1, "north"), (2, "north"), (2, "south")):
        rows = o.where(F.col("o_orderkey") % 3 != day)
        dml.snapshot_append(rows, name, datetime.datetime(2024, 3, day, 6), task)
    return spark.table(name)


def snapshot_repeated(spark, sf):
    """Two tasks of two runs; one run is repeated with other rows and keeps only those."""
    name = fresh_table(spark, "history")
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for day, task, rest in ((1, "north", 0), (1, "south", 1), (2, "north", 2), (1, "north", 3), (1, "north", 3)):
        dml.snapshot_run(o.where(F.col("o_orderkey") % 5 != rest), name, datetime.datetime(2024, 3, day, 6), task)
    return spark.table(name)


def archive(spark, sf):
    """Every table that is not protected goes to the archive folder; rows per archived table."""
    database = fresh_table(spark, "shard").replace(".", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'database')}'")
    for label in ("orders", "customer", "settings"):
        dml.write_table(read(spark, sf, {"settings": "nation"}.get(label, label)), f"{database}.{label}")
    folder = scratch_path(spark, "archive")
    names = dml.archive_database(spark, database, folder, "2024-03-01", protected=["settings"])
    out = None
    for n in names:
        df = spark.read.parquet(f"{folder}/2024-03-01/{n}").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        out = df if out is None else out.union(df)
    return out


def stored_delete(spark, sf):
    """On a table with partitions: the first two changes touch one of them each."""
    name = fresh_table(spark, "orders")
    orders = read(spark, sf, "orders")
    dml.write_table(orders, name, partition_by=["o_orderstatus", "o_orderpriority"])
    dml.delete_stored(spark, name, [("o_orderstatus", "P")])
    dml.update_stored(spark, name, [("o_orderpriority", "5-LOW")], {"o_totalprice": 0.0})
    dml.expire(spark, name, "o_orderdate", datetime.date(1997, 1, 1))
    return spark.table(name).select(*orders.columns)


def _days(spark, sf):
    day = F.when(F.col("event_id") % 1000 != 0, F.to_date("ts"))
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", day.alias("day"))


def stored_expire(spark, sf):
    """Old days go; what arrives late for one of them is all there is of it."""
    name = fresh_table(spark, "events")
    events = _days(spark, sf)
    dml.write_table(events, name, partition_by=["day"])
    dml.expire(spark, name, "day", datetime.date(2024, 1, 20))
    dml.write_table(events.where("day < DATE '2024-01-20' AND event_id % 100 = 7"), name)
    dml.remove_old_versions(spark, name)
    return spark.table(name)


def stored_update_tables(spark, sf):
    """One key is renamed in three tables together; two of them have a partition for each key."""
    names = [fresh_table(spark, t) for t in ("nation", "supplier", "customer")]
    for name, table, key in zip(names, ("nation", "supplier", "customer"), ("n_nationkey", "s_nationkey", "c_nationkey")):
        rows = read(spark, sf, table).withColumnRenamed(key, "nation")
        dml.write_table(rows, name, partition_by=["nation"] if table != "supplier" else [])
    dml.update_stored(spark, names, [("nation", 7)], {"nation": 107})
    dml.update_stored(spark, names, [("nation", 8)], {"nation": 9})
    counted = [spark.table(n).groupBy("nation").agg(F.count(F.lit(1)).alias("n_rows")) for n in names]
    labelled = [c.select(F.lit(t).alias("table"), "nation", "n_rows") for c, t in zip(counted, ("nation", "supplier", "customer"))]
    return labelled[0].union(labelled[1]).union(labelled[2])


def stored_insert_if_absent(spark, sf):
    """Twice the same insert: the second one adds only the rows whose key is NULL."""
    name = fresh_table(spark, "customer")
    dml.write_table(read(spark, sf, "customer").select("c_custkey", "c_name"), name)
    for _ in range(2):
        dml.append_absent(_fresh_rows(spark, sf), name, ["c_custkey"], ["c_name"])
    return spark.table(name)


QUERIES = {
    "delete_where": delete_where,
    "update_where": update_where,
    "insert_if_absent": insert_if_absent,
    "insert_rows": insert_rows,
    "delete_before": delete_before,
    "add_table_column": add_column,
    "drop_table_column": drop_column,
    "rename_table_column": rename_column,
    "rename_table": rename_table,
    "drop_tables": drop_tables,
    "snapshot_append": snapshot_append,
    "snapshot_repeated": snapshot_repeated,
    "archive_shard": archive,
    "stored_delete_update": stored_delete,
    "stored_expire": stored_expire,
    "stored_update_tables": stored_update_tables,
    "stored_insert_if_absent": stored_insert_if_absent,
}

_CUSTOMER = """
    (SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment FROM customer)"""
_FRESH = """
    SELECT CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey * 40 END AS k, s_name AS n FROM supplier"""

SQL = {
    "delete_where": f"""
        SELECT * FROM {_CUSTOMER} WHERE c_mktsegment IS NULL OR c_mktsegment <> 'MACHINERY' OR c_nationkey <> 3""",
    "update_where": f"""
        SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_nationkey END AS c_nationkey,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment
        FROM {_CUSTOMER}""",
    "insert_if_absent": f"""
        SELECT c_custkey, c_name FROM customer
        UNION ALL SELECT k, n FROM ({_FRESH}) WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT k, '~' || n FROM ({_FRESH}) WHERE k IS NULL""",
    "insert_rows": """
        SELECT c_custkey, c_name, c_acctbal FROM customer
        UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) FROM supplier""",
    "delete_before": """
        SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts, user_id, event_type, value, props FROM events
        WHERE event_id % 50 = 0 OR ts >= TIMESTAMP '2024-01-20'""",
    "add_table_column": """
        SELECT *, 'it''s new' AS grade FROM supplier
        UNION ALL SELECT *, 'B' FROM supplier WHERE s_nationkey = 1""",
    "drop_table_column": "SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part",
    "rename_table_column": "SELECT p_partkey, p_name, p_brand AS brand, p_type, p_size, p_retailprice FROM part",
    "rename_table": "SELECT * FROM supplier",
    "drop_tables": """
        SELECT 'settings' AS "table", count(*) AS n_rows FROM customer
        UNION ALL SELECT 'orders_temp,part_temp_,orders', 0""",
    "snapshot_append": """
        SELECT TIMESTAMP '2024-03-01 06:00:00' AS run_datetime, 'north' AS sub_task, o_orderkey, o_totalprice
        FROM orders WHERE o_orderkey % 3 <> 1
        UNION ALL SELECT TIMESTAMP '2024-03-02 06:00:00', t, o_orderkey, o_totalprice
        FROM orders, (VALUES ('north'), ('south')) v(t) WHERE o_orderkey % 3 <> 2""",
    "snapshot_repeated": """
        SELECT TIMESTAMP '2024-03-01 06:00:00' + to_days(d) AS run_datetime, t AS sub_task, o_orderkey, o_totalprice
        FROM orders, (VALUES (0, 'north', 3), (0, 'south', 1), (1, 'north', 2)) v(d, t, k) WHERE o_orderkey % 5 <> k""",
    "archive_shard": """
        SELECT 'customer' AS "table", count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders""",
    "stored_delete_update": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1997-01-01'""",
    "stored_expire": """
        SELECT * FROM (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 1000 <> 0 THEN CAST(ts AS DATE) END AS day FROM events)
        WHERE day IS NULL OR day >= DATE '2024-01-20' OR event_id % 100 = 7""",
    "stored_update_tables": """
        SELECT "table", CASE k WHEN 7 THEN 107 WHEN 8 THEN 9 ELSE k END AS nation, count(*) AS n_rows FROM (
            SELECT 'nation' AS "table", n_nationkey AS k FROM nation UNION ALL SELECT 'supplier', s_nationkey FROM supplier
            UNION ALL SELECT 'customer', c_nationkey FROM customer) GROUP BY ALL""",
    "stored_insert_if_absent": f"""
        SELECT c_custkey, c_name FROM customer
        UNION ALL SELECT k, n FROM ({_FRESH}) WHERE k NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT k, p || n FROM ({_FRESH}), (VALUES (''), (''), ('~'), ('~')) v(p) WHERE k IS NULL""",
}
