"""Column operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from almanac.functions.text import clean_text
from almanac.operators import columns as C

from .tables import read


def select_cols(spark, sf):
    return C.select_cols(read(spark, sf, "part"), ["p_name", 0, -1])


def reorder(spark, sf):
    return C.reorder(read(spark, sf, "orders"), [3, 0, 5])


def move_to_index(spark, sf):
    return C.move_to_index(read(spark, sf, "orders"), "o_orderpriority", 0)


def add_constant(spark, sf):
    moment = F.lit(datetime.datetime(2001, 8, 2, 6, 30)).cast("timestamp_ntz")
    return C.add_constants(read(spark, sf, "customer"), {"run_datetime": moment, "sub_task": "weekly"})


def drop_column(spark, sf):
    return C.drop_columns(read(spark, sf, "lineitem"), ["l_tax", 0, -1])


def rename_header(spark, sf):
    return C.rename_header(read(spark, sf, "supplier"), ["key", "", "nation"])


def unique_header(spark, sf):
    c = read(spark, sf, "customer")
    same = c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("Name"), F.col("c_nationkey").alias("name"))
    return C.unique_header(same)


def clean_header(spark, sf):
    c = read(spark, sf, "customer")
    odd = c.select(
        F.col("c_custkey").alias("Kéy (no.)"),
        F.col("c_name").alias("Name & Title"),
        F.col("c_acctbal").alias("acct-bal: \"usd\""),
        F.col("c_mktsegment").alias("the order by"),
    )
    return C.clean_header(odd, level=2, lower=True)


def clean_text_values(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", clean_text(F.col("text"), level=1, lower=True).alias("cleaned"))


def concat_columns(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    events = read(spark, sf, "events").select("event_id", "event_type")
    return C.concat_columns(orders, events, ["o_orderkey"], ["event_id"])


def flatten_values(spark, sf):
    return C.flatten_values(read(spark, sf, "customer").drop("c_acctbal"))


def dimensions(spark, sf):
    return C.dimensions(read(spark, sf, "lineitem"))


QUERIES = {
    "select_cols": select_cols,
    "reorder": reorder,
    "move_to_index": move_to_index,
    "add_constant": add_constant,
    "drop_column": drop_column,
    "rename_header": rename_header,
    "unique_header": unique_header,
    "clean_header": clean_header,
    "clean_text": clean_text_values,
    "concat_columns": concat_columns,
    "flatten_values": flatten_values,
    "dimensions": dimensions,
}

SQL = {
    "select_cols": "SELECT p_name, p_partkey, p_retailprice FROM part",
    "reorder": "SELECT o_totalprice, o_orderkey, o_orderpriority FROM orders",
    "move_to_index": """
        SELECT o_orderpriority, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders""",
    "add_constant": """
        SELECT TIMESTAMP '2001-08-02 06:30:00' AS run_datetime, 'weekly' AS sub_task, * FROM customer""",
    "drop_column": """
        SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
               l_returnflag, l_linestatus
        FROM lineitem""",
    "rename_header": 'SELECT s_suppkey AS "key", s_name, s_nationkey AS nation, s_acctbal FROM supplier',
    "unique_header": 'SELECT c_name AS name, c_custkey AS "Nameb", c_nationkey AS namec FROM customer',
    "clean_header": """
        SELECT c_custkey AS "key_no.", c_name AS name_and_title, c_acctbal AS acct_bal_usd,
               c_mktsegment AS the_orderby
        FROM customer""",
    "clean_text": r"""
        SELECT doc_id,
               lower(replace(regexp_replace(replace(regexp_replace(
                   regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'),
                   '[()":;]', '', 'g'), '''', ''''''), '[- ]', '_', 'g'), '&', 'and')) AS cleaned
        FROM documents""",
    "concat_columns": """
        WITH a AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders),
             b AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS p FROM events)
        SELECT o_orderkey, o_orderpriority, event_id, event_type FROM a FULL OUTER JOIN b USING (p)""",
    "flatten_values": """
        SELECT CAST(0 AS BIGINT) AS position, 'c_custkey' AS "column", CAST(c_custkey AS VARCHAR) AS value FROM customer
        UNION ALL SELECT 1, 'c_name', c_name FROM customer
        UNION ALL SELECT 2, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
        UNION ALL SELECT 3, 'c_mktsegment', c_mktsegment FROM customer""",
    "dimensions": "SELECT CAST(11 AS BIGINT) AS n_columns, count(*) AS n_rows FROM lineitem",
}
