"""Joins, merges and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.joins import join, merge_plan
from almanac.operators.setops import union

from .tables import read


def _orders(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customer(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")


KEY = [("o_custkey", "c_custkey")]


def join_inner(spark, sf):
    return join(_orders(spark, sf), _customer(spark, sf), "inner", KEY)


def join_left(spark, sf):
    return join(_customer(spark, sf), _orders(spark, sf), "left", [("c_custkey", "o_custkey")])


def join_right(spark, sf):
    return join(_orders(spark, sf), _customer(spark, sf), "right", [(1, 0)])


def _shifted(spark, sf):
    return _orders(spark, sf).withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") + 100))


def join_outer(spark, sf):
    return join(_shifted(spark, sf), _customer(spark, sf), "outer", KEY)


def join_outer_hot_keys(spark, sf):
    """The plan for hot keys on a side that an outer join cannot split."""
    return join(_shifted(spark, sf), _customer(spark, sf), "outer", KEY, skewed=True)


def join_left_hot_keys(spark, sf):
    return join(_customer(spark, sf), _shifted(spark, sf), "left", [("c_custkey", "o_custkey")], skewed=True)


def join_multi_key(spark, sf):
    li = read(spark, sf, "lineitem")
    returned = (
        li.where(F.col("l_returnflag") == "R").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n_returned"))
    )
    sold = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return join(sold, returned, "left", [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")])


def _segments(spark, sf):
    c = read(spark, sf, "customer")
    return c.withColumn("segment", F.nullif("c_mktsegment", F.lit("FURNITURE")))


def join_nulls_equal(spark, sf):
    c = _segments(spark, sf)
    sizes = c.groupBy("segment").agg(F.count(F.lit(1)).alias("n_customers"))
    return join(c.select("c_custkey", "segment"), sizes, "left", [("segment", "segment")], nulls_equal=True)


def join_nulls_differ(spark, sf):
    c = _segments(spark, sf)
    sizes = c.groupBy("segment").agg(F.count(F.lit(1)).alias("n_customers"))
    return join(c.select("c_custkey", "segment"), sizes, "outer", [("segment", "segment")])


def join_nocase(spark, sf):
    p = read(spark, sf, "part")
    types = p.groupBy(F.lower("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n_parts"))
    return join(p.select("p_partkey", "p_type"), types, "inner", [("p_type", "kind")])


def join_case_matters(spark, sf):
    p = read(spark, sf, "part")
    types = p.groupBy(F.lower("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n_parts"))
    return join(p.select("p_partkey", "p_type"), types, "left", [("p_type", "kind")], nocase=False)


def join_keep_keys(spark, sf):
    return join(_orders(spark, sf), _customer(spark, sf), "inner", KEY, drop_redundant=False)


def join_mixed_types(spark, sf):
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    orders = _orders(spark, sf).withColumn("o_custkey", text)
    return join(orders, _customer(spark, sf), "left", KEY)


def join_same_names(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return join(c, n, "inner", [("c_nationkey", "id")], drop_redundant=False)


def merge_tables(spark, sf):
    tables = [
        _orders(spark, sf),
        read(spark, sf, "customer").select("c_custkey", "c_nationkey"),
        read(spark, sf, "nation"),
        read(spark, sf, "region"),
        read(spark, sf, "supplier"),
    ]
    rules = [
        ((0, 1), "inner", [("o_custkey", "c_custkey")]),
        ((0, 2), "left", [("c_nationkey", "n_nationkey")]),
        ((0, 3), "left", [("n_regionkey", "r_regionkey")]),
    ]
    return merge_plan(tables, rules)[0]


def merge_complete(spark, sf):
    """Three tables with one rule: orders by customer, in three price classes."""
    o = read(spark, sf, "orders")
    per = [
        o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(f"n_{s.lower()}"))
        for s in ("F", "O", "P")
    ]
    return merge_plan(per, [((0, 1), "left", [("k", "k")])], complete=True)[0]


def union_bag(spark, sf):
    customer = read(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    supplier = read(spark, sf, "supplier").select("s_nationkey", "s_name")
    return union(customer, supplier)


def union_wider_right(spark, sf):
    supplier = read(spark, sf, "supplier").select("s_nationkey")
    customer = read(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    return union(supplier, customer)


def union_coerce(spark, sf):
    left = read(spark, sf, "part").select("p_partkey", "p_retailprice")
    right = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise((F.col("o_orderkey") % 1000).cast("string")).alias("text"),
    )
    return union(left, right, coerce=True)


QUERIES = {
    "join_inner": join_inner,
    "join_left": join_left,
    "join_right": join_right,
    "join_outer": join_outer,
    "join_outer_hot_keys": join_outer_hot_keys,
    "join_left_hot_keys": join_left_hot_keys,
    "join_multi_key": join_multi_key,
    "join_nulls_equal": join_nulls_equal,
    "join_nulls_differ": join_nulls_differ,
    "join_nocase": join_nocase,
    "join_case_matters": join_case_matters,
    "join_keep_keys": join_keep_keys,
    "join_mixed_types": join_mixed_types,
    "join_same_names": join_same_names,
    "merge_plan": merge_tables,
    "merge_complete": merge_complete,
    "union": union_bag,
    "union_wider_right": union_wider_right,
    "union_coerce": union_coerce,
}

_SHIFTED = """
    (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey + 100 END AS o_custkey, o_totalprice FROM orders)"""
_OUTER = f"""
    SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment
    FROM {_SHIFTED} o FULL OUTER JOIN customer ON o_custkey = c_custkey"""
_SIZES = "(SELECT nullif(c_mktsegment, 'FURNITURE') AS s, count(*) AS n_customers FROM customer GROUP BY 1)"
_KINDS = "(SELECT lower(p_type) AS kind, count(*) AS n_parts FROM part GROUP BY 1)"

SQL = {
    "join_inner": """
        SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "join_left": """
        SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_totalprice
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
    "join_right": """
        SELECT o_orderkey, o_totalprice, c_custkey, c_name, c_mktsegment
        FROM orders RIGHT JOIN customer ON o_custkey = c_custkey""",
    "join_outer": _OUTER,
    "join_outer_hot_keys": _OUTER,
    "join_left_hot_keys": f"""
        SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_totalprice
        FROM customer LEFT JOIN {_SHIFTED} o ON o_custkey = c_custkey""",
    "join_multi_key": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, r.n_returned
        FROM lineitem l LEFT JOIN
             (SELECT l_partkey, l_suppkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r
             ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey""",
    "join_nulls_equal": f"""
        SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS segment, n_customers
        FROM customer LEFT JOIN {_SIZES} x ON nullif(c_mktsegment, 'FURNITURE') IS NOT DISTINCT FROM s""",
    "join_nulls_differ": f"""
        SELECT c_custkey, segment, s AS segmentb, n_customers
        FROM (SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS segment FROM customer) c
             FULL OUTER JOIN {_SIZES} x ON segment = s""",
    "join_nocase": f"SELECT p_partkey, p_type, n_parts FROM part JOIN {_KINDS} k ON lower(p_type) = kind",
    "join_case_matters": f"SELECT p_partkey, p_type, n_parts FROM part LEFT JOIN {_KINDS} k ON p_type = kind",
    "join_keep_keys": """
        SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "join_mixed_types": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey,
               o_totalprice, c_name, c_mktsegment
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 9 <> 0""",
    "join_same_names": """
        SELECT c_custkey AS id, c_name AS name, c_nationkey, n_nationkey AS idb, n_name AS nameb
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "merge_plan": """
        SELECT o_orderkey, o_custkey, o_totalprice, c_nationkey, n_name, n_regionkey, r_name
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "merge_complete": """
        SELECT f.k, n_f, n_o, n_p
        FROM (SELECT o_custkey AS k, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f
        LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON f.k = o.k
        LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON f.k = p.k""",
    "union": """
        SELECT c_nationkey, c_mktsegment, c_custkey FROM customer
        UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier""",
    "union_wider_right": """
        SELECT s_nationkey, NULL AS _field_1 FROM supplier UNION ALL SELECT c_nationkey, c_mktsegment FROM customer""",
    "union_coerce": """
        SELECT p_partkey, p_retailprice FROM part
        UNION ALL
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END FROM orders""",
}
