"""Row operators, sorting and ranking."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from almanac.operators import ordering as O
from almanac.operators import rows as R

from .tables import read


def filter_equals(spark, sf):
    return R.filter_equals(read(spark, sf, "orders"), [("o_orderstatus", "F"), ("o_orderpriority", "5-LOW")])


def filter_null_words(spark, sf):
    c = read(spark, sf, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    kept = R.filter_equals(c, [("segment", "null"), ("c_acctbal", "not null")])
    return kept.select("c_custkey", "segment", "c_acctbal")


def _events_with_gaps(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", "value")
    return e.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def drop_rows_where(spark, sf):
    return R.drop_rows_where(_events_with_gaps(spark, sf), [("value", "< 13.5"), ("event_type", "== 'click'")])


def drop_rows_where_sql_nulls(spark, sf):
    return R.drop_rows_where(_events_with_gaps(spark, sf), [("value", "<", 13.5)], nulls="sql")


POSITIONS = [0, 3, 10, 10, 555, 1400]


def drop_rows_at(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.drop_rows(orders, POSITIONS, [("o_totalprice", "desc"), "o_orderkey"])


def pop_rows_at(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.pop_rows(orders, POSITIONS, [("o_totalprice", "desc"), "o_orderkey"])[1]


def pop_last_row(spark, sf):
    return R.pop_last(read(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])[0]


def row_at(spark, sf):
    return R.row_at(read(spark, sf, "events"), 777, ["ts", "event_id"])


def append_rows(spark, sf):
    customer = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return R.append_rows(R.append_rows(customer, supplier), [(-1, "nobody", None), (-2, None, 7)])


def latest_n(spark, sf):
    return R.latest_n(read(spark, sf, "events"), 100, "ts", ["event_id"])


def sample_n(spark, sf):
    return R.sample_n(read(spark, sf, "orders"), 100, ["o_orderkey"])


def filter_any_regex(spark, sf):
    return R.filter_any_regex(read(spark, sf, "conversations"), [(r"(?i)(^|[ .,])que($|[ .,])", "text"), ("^assist", "role")])


def _attachments(spark, sf):
    e = read(spark, sf, "events")
    ending = F.when(F.col("value") > 40, ".xlsx").when(F.col("value") > 10, ".txt").otherwise("")
    return e.select("event_id", "ts", F.concat("event_type", ending).alias("file_name"))


def latest_match_all(spark, sf):
    return R.latest_match(_attachments(spark, sf), r"(?i)\.xls", "file_name", "ts", "all", ["event_id"])


def latest_match_recent(spark, sf):
    return R.latest_match(_attachments(spark, sf), r"^s.*\.xls", "file_name", "ts", "recent", ["event_id"])


def settings_lookup(spark, sf):
    found = R.settings_lookup(read(spark, sf, "part"), {"p_brand": "Brand#2", "p_size": 28}, ["p_partkey", "p_name"])
    return found


def rank(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    return O.rank(li, ["l_returnflag", "l_linestatus"], ["l_quantity"])


def rank_desc(spark, sf):
    orders = read(spark, sf, "orders")
    gaps = orders.withColumn("price", F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 1000)))
    kept = gaps.select("o_orderkey", "o_orderstatus", "o_orderpriority", "price")
    return O.rank(kept, ["o_orderstatus", "o_orderpriority"], ["price", "o_orderkey"], desc=True)


def rank_large_groups(spark, sf):
    """Three groups that hold all orders."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return O.rank(orders, ["o_orderstatus"], ["o_orderdate"])


def rank_small_groups(spark, sf):
    """The window for groups that the caller knows to be small: the lines of an order."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return O.rank(li, ["l_orderkey"], ["l_quantity"], spread=False)


def rank_whole_table(spark, sf):
    """No partition key: the whole table is one group."""
    return O.rank(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), [], ["o_orderdate"])


def rank_one(spark, sf):
    customer = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return O.rank_one(customer, "c_nationkey", "c_acctbal")


def sort_by(spark, sf):
    return O.sort_by(read(spark, sf, "orders"), [("o_orderpriority", "asc"), ("o_totalprice", "desc")], ["o_orderkey"])


def sort_positions(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return O.with_position(orders, ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"])


def latest_between(spark, sf):
    e = read(spark, sf, "events").where(F.col("ts") < F.lit(datetime.datetime(2024, 1, 15)).cast("timestamp_ntz"))
    return R.latest_n(e, 10, "ts", ["event_id"])


QUERIES = {
    "filter_equals": filter_equals,
    "filter_null_words": filter_null_words,
    "drop_rows_where": drop_rows_where,
    "drop_rows_where_sql_nulls": drop_rows_where_sql_nulls,
    "drop_rows_at": drop_rows_at,
    "pop_rows_at": pop_rows_at,
    "pop_last_row": pop_last_row,
    "row_at": row_at,
    "append_rows": append_rows,
    "latest_n": latest_n,
    "latest_n_before": latest_between,
    "sample_n": sample_n,
    "filter_any_regex": filter_any_regex,
    "latest_match_all": latest_match_all,
    "latest_match_recent": latest_match_recent,
    "settings_lookup": settings_lookup,
    "rank": rank,
    "rank_desc": rank_desc,
    "rank_large_groups": rank_large_groups,
    "rank_small_groups": rank_small_groups,
    "rank_whole_table": rank_whole_table,
    "rank_one": rank_one,
    "sort_by": sort_by,
    "sort_positions": sort_positions,
}

_PLACED = """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS p FROM orders"""
_ATTACHED = """
    SELECT event_id, ts, event_type || CASE WHEN value > 40 THEN '.xlsx' WHEN value > 10 THEN '.txt' ELSE '' END AS file_name
    FROM events"""

SQL = {
    "filter_equals": "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
    "filter_null_words": """
        SELECT c_custkey, CAST(NULL AS VARCHAR) AS segment, c_acctbal FROM customer WHERE c_mktsegment = 'FURNITURE'""",
    "drop_rows_where": """
        SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events
        WHERE NOT ((event_id % 7 = 0 OR value < 13.5) AND event_type = 'click')""",
    "drop_rows_where_sql_nulls": """
        SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events
        WHERE event_id % 7 = 0 OR value >= 13.5""",
    "drop_rows_at": f"SELECT o_orderkey, o_totalprice FROM ({_PLACED}) WHERE p NOT IN (0, 3, 10, 555, 1400)",
    "pop_rows_at": f"SELECT o_orderkey, o_totalprice FROM ({_PLACED}) WHERE p IN (0, 3, 10, 555, 1400)",
    "pop_last_row": """
        SELECT * FROM orders WHERE o_orderkey <>
            (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)""",
    "row_at": "SELECT * FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 777",
    "append_rows": """
        SELECT c_custkey, c_name, c_nationkey FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier
        UNION ALL SELECT -1, 'nobody', NULL UNION ALL SELECT -2, NULL, 7""",
    "latest_n": "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 100",
    "latest_n_before": "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id LIMIT 10",
    "sample_n": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
    "filter_any_regex": r"""
        SELECT * FROM conversations WHERE regexp_matches(text, '(?i)(^|[ .,])que($|[ .,])') OR role LIKE 'assist%'""",
    "latest_match_all": f"""
        SELECT event_id, ts, file_name,
               stem || CAST(row_number() OVER (PARTITION BY stem ORDER BY event_id) - 1 AS VARCHAR) || '.xlsx' AS saved_as
        FROM (SELECT *, replace(file_name, '.xlsx', '') AS stem FROM ({_ATTACHED}) WHERE file_name LIKE '%.xlsx')""",
    "latest_match_recent": f"""
        SELECT event_id, ts, file_name, file_name AS saved_as FROM ({_ATTACHED})
        WHERE file_name LIKE 's%.xls%' ORDER BY ts DESC, event_id LIMIT 1""",
    "settings_lookup": "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND p_size = 28",
    "rank": """
        SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity,
               rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) AS rank_many_by_l_quantity
        FROM lineitem""",
    "rank_desc": """
        SELECT *, rank() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY price DESC NULLS LAST)
                  AS rank_many_by_price_desc
        FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority,
                     CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS price
              FROM orders)""",
    "rank_small_groups": """
SELECT l_orderkey, l_linenumber, l_quantity,
       rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity NULLS FIRST) AS rank_many_by_l_quantity
FROM lineitem""",
    "rank_whole_table": """
SELECT o_orderkey, o_totalprice, o_orderdate, rank() OVER (ORDER BY o_orderdate NULLS FIRST) AS rank_many_by_o_orderdate
FROM orders""",
    "rank_large_groups": """
        SELECT o_orderkey, o_orderstatus, o_orderdate,
               rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS rank_many_by_o_orderdate
        FROM orders""",
    "rank_one": """
        SELECT c_custkey, c_nationkey, c_acctbal,
               rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS rank_c_nationkey_by_c_acctbal
        FROM customer""",
    "sort_by": "SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
    "sort_positions": """
        SELECT o_orderkey, o_orderpriority, o_totalprice,
               row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS position
        FROM orders""",
}
