"""Types, product codes, dates and word sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import casting, codes, dates
from almanac.functions.text import number_text, number_value, word_set
from almanac.operators.typing import infer_types
from almanac.plans.dates import date_range_table, last_year_from_calendar, ty_ly_compare

from .tables import read


def _order_texts(spark, sf):
    """Orders as text, with some values that spoil their column."""
    o = read(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("o_orderkey"),
        F.when(key % 10 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(key % 100 == 3, "unknown").otherwise((F.col("o_custkey") % 90).cast("string")).alias("store"),
        (F.col("o_custkey") / 4).cast("string").alias("quarter"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"),
        (key % 2 == 0).cast("string").alias("even"),
        F.lit(None).cast("string").alias("nothing"),
    )


def types_of_columns(spark, sf):
    return infer_types(_order_texts(spark, sf))


def cast_known(spark, sf):
    t = _order_texts(spark, sf).select("o_orderkey", "o_custkey", "store", "quarter")
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "store": "int", "quarter": "double"}
    return casting.cast_columns(t, types, flag_bad=True)


def date_columns(spark, sf):
    t = _order_texts(spark, sf).select("o_orderkey", "order_date", "placed")
    parsed = casting.parse_date_columns(t)
    return parsed.select("o_orderkey", F.col("order_date").cast("date").alias("order_date"), "placed")


def date_text(spark, sf):
    e = read(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(
        "event_id",
        casting.text_to_date(text).alias("second"),
        casting.date_to_text(F.col("ts")).alias("text"),
    )


def number_texts(spark, sf):
    o = read(spark, sf, "orders")
    priced = o.select(
        "o_orderkey",
        F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" ")).alias("price"),
        F.format_string("%,012d", F.col("o_custkey") * 1000).alias("whole"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("words"),
    )
    return priced.select(
        "o_orderkey",
        number_value(F.col("price")).alias("price"),
        number_text(F.col("whole")).alias("whole"),
        number_text(F.col("words")).alias("words"),
        number_value(F.col("words")).alias("no_number"),
    )


def _codes(spark, sf):
    """Part keys as codes of many lengths, with zeros and NULL."""
    li = read(spark, sf, "lineitem").select("l_partkey").distinct()
    factor = F.when(F.col("l_partkey") % 6 == 0, 1).when(F.col("l_partkey") % 6 == 1, 1003).when(
        F.col("l_partkey") % 6 == 2, 7000009).when(F.col("l_partkey") % 6 == 3, 61414121).when(
        F.col("l_partkey") % 6 == 4, 36000291457)
    return li.select("l_partkey", (F.col("l_partkey") * factor).cast("bigint").alias("code"))


def gtin_to_upc(spark, sf):
    return _codes(spark, sf).select("l_partkey", codes.gtin_to_upc(F.col("code")).alias("upc"))


def upc_to_gtin(spark, sf):
    return _codes(spark, sf).select("l_partkey", "code", codes.upc_to_gtin(F.col("code")).alias("gtin"))


def to_manufacturer(spark, sf):
    return _codes(spark, sf).select("l_partkey", codes.to_manufacturer(F.col("code")).alias("mfc"))


def slu_to_upc(spark, sf):
    return read(spark, sf, "part").select("p_partkey", codes.slu_to_upc(F.col("p_partkey")).alias("upc"))


def slu_to_gtin(spark, sf):
    return read(spark, sf, "part").select("p_partkey", codes.slu_to_gtin(F.col("p_partkey")).alias("gtin"))


FLAGS = ["lmon", "lsun", "lsat", "lfri", "lthur", "lwed", "ltue", "plusten", "now"]


def last_weekday(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", *[dates.run_date(F.col("o_orderdate"), f).alias(f) for f in FLAGS])


def last_year(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("ship_day")).distinct()
    return li.select("ship_day", dates.last_year(F.col("ship_day")).alias("ly_day"))


def last_year_calendar(spark, sf):
    """A calendar made of the order days; some days are not in it."""
    days = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day_dt")).distinct()
    calendar = days.where(F.dayofmonth("day_dt") != 29).select(
        F.col("day_dt").alias("cal_day"), F.date_sub("day_dt", 364).alias("cal_ly")
    )
    li = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship_day"))
    return last_year_from_calendar(li, "ship_day", calendar, "cal_day", "cal_ly")


def date_range(spark, sf):
    first, last = read(spark, sf, "orders").agg(
        F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")
    ).first()
    return date_range_table(spark, first, last)


def ty_ly(spark, sf):
    o = read(spark, sf, "orders")
    metrics = {
        "n_orders": F.count(F.lit(1)),
        "revenue": F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"),
    }
    return ty_ly_compare(o, "o_orderdate", metrics, ["o_orderpriority"])


def str_prep(spark, sf):
    d = read(spark, sf, "documents")
    words = word_set(F.col("text"))
    return d.select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, " ").alias("words"))


QUERIES = {
    "infer_types": types_of_columns,
    "cast_known": cast_known,
    "date_columns": date_columns,
    "date_text": date_text,
    "number_text": number_texts,
    "gtin_to_upc": gtin_to_upc,
    "upc_to_gtin": upc_to_gtin,
    "to_mfc_code": to_manufacturer,
    "slu_to_upc": slu_to_upc,
    "slu_to_gtin": slu_to_gtin,
    "last_weekday": last_weekday,
    "last_year": last_year,
    "last_year_calendar": last_year_calendar,
    "date_range_table": date_range,
    "ty_ly_compare": ty_ly,
    "str_prep": str_prep,
}

_CODES = """
    (SELECT l_partkey, CAST(l_partkey AS BIGINT) * CASE l_partkey % 6 WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN 1003
            WHEN 2 THEN 7000009 WHEN 3 THEN 61414121 WHEN 4 THEN 36000291457 END AS code
     FROM (SELECT DISTINCT l_partkey FROM lineitem))"""


def _gtin(table: str, key: str, code: str) -> str:
    """Check digit from the digits of the padded text, one row per digit."""
    return f"""
        WITH c AS (SELECT {key} AS k, {code} AS code FROM {table}),
             d AS (SELECT k, code, CASE WHEN length(CAST(code AS VARCHAR)) < 13
                                        THEN lpad(CAST(code AS VARCHAR), 13, '0') ELSE CAST(code AS VARCHAR) END AS s
                   FROM c WHERE code > 0),
             e AS (SELECT k, code, unnest(range(1, length(s) + 1)) AS i, s FROM d),
             w AS (SELECT k, code, (10 - sum(CAST(substr(s, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) % 10) % 10 AS digit
                   FROM e GROUP BY k, code)
        SELECT c.k, c.code, CASE WHEN c.code > 0 THEN CAST(c.code * 10 + w.digit AS BIGINT) ELSE c.code END AS gtin
        FROM c LEFT JOIN w ON c.k = w.k"""


def _back(flag: str, offset: int) -> str:
    off = f"({offset} + isodow(o_orderdate) - 1)"
    return f"CAST(o_orderdate AS DATE) - CAST(CASE WHEN {off} > 7 THEN {off} - 7 ELSE {off} END AS INT) AS {flag}"


SQL = {
    "infer_types": """
        SELECT position, "column", n_values, n_bad, simple_type FROM (
            SELECT CAST(0 AS BIGINT) AS position, 'o_orderkey' AS "column", count(*) AS n_values, CAST(0 AS BIGINT) AS n_bad, 'INTEGER' AS simple_type FROM orders
            UNION ALL SELECT 1, 'o_custkey', count(*), 0, 'INTEGER' FROM orders WHERE o_orderkey % 10 <> 0
            UNION ALL SELECT 2, 'store', count(*), count(*) FILTER (WHERE o_orderkey % 100 = 3), 'TEXT' FROM orders
            UNION ALL SELECT 3, 'quarter', count(*), 0, 'REAL' FROM orders
            UNION ALL SELECT 4, 'order_date', count(*), count(*), 'DATETIME' FROM orders
            UNION ALL SELECT 5, 'placed', count(*), count(*), 'TEXT' FROM orders
            UNION ALL SELECT 6, 'even', count(*), count(*), 'BOOLEAN' FROM orders
            UNION ALL SELECT 7, 'nothing', 0, 0, 'NULL')""",
    "cast_known": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 100 <> 3 THEN CAST(o_custkey % 90 AS INT) END AS store, o_custkey / 4.0::DOUBLE AS quarter,
               false AS o_orderkey__bad, false AS o_custkey__bad, o_orderkey % 100 = 3 AS store__bad, false AS quarter__bad
        FROM orders""",
    "date_columns": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
               strftime(o_orderdate, '%Y-%m-%d') AS placed
        FROM orders""",
    "date_text": """
        SELECT event_id, date_trunc('second', ts) AS second, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events""",
    "number_text": """
        SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey * 1000 AS VARCHAR) AS whole,
               o_orderpriority AS words, CAST(NULL AS DOUBLE) AS no_number
        FROM orders""",
    "gtin_to_upc": f"SELECT l_partkey, CAST(floor(code / 10.0::DECIMAL(20,1)) AS BIGINT) AS upc FROM {_CODES}",
    "upc_to_gtin": f"SELECT k AS l_partkey, code, gtin FROM ({_gtin(_CODES, 'l_partkey', 'code')})",
    "to_mfc_code": f"""
        SELECT l_partkey, CASE WHEN code >= 100000 THEN CAST(substr(CAST(code AS VARCHAR), 1, 5) AS BIGINT) ELSE code END AS mfc
        FROM {_CODES}""",
    "slu_to_upc": "SELECT p_partkey, p_partkey * 100000 AS upc FROM part",
    "slu_to_gtin": f"SELECT k AS p_partkey, gtin FROM ({_gtin('part', 'p_partkey', 'p_partkey * 100000')})",
    "last_weekday": f"""
        SELECT o_orderkey, {_back('lmon', 0)}, {_back('lsun', 1)}, {_back('lsat', 2)}, {_back('lfri', 3)},
               {_back('lthur', 4)}, {_back('lwed', 5)}, {_back('ltue', 6)},
               CAST(o_orderdate AS DATE) + 10 AS plusten, CAST(o_orderdate AS DATE) - 1 AS now
        FROM orders""",
    "last_year": """
        SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship_day, CAST(l_shipdate AS DATE) - 364 AS ly_day FROM lineitem""",
    "last_year_calendar": """
        SELECT l_orderkey, CAST(l_shipdate AS DATE) AS ship_day, CAST(d.day - 364 AS DATE) AS ly_day_dt
        FROM lineitem LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) <> 29) d
             ON CAST(l_shipdate AS DATE) = d.day""",
    "date_range_table": """
        SELECT a AS "start date ty", b AS "end date ty", a - 364 AS "start date ly", b - 364 AS "end date ly"
        FROM (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders)""",
    "ty_ly_compare": """
        WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
                          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
                   FROM orders GROUP BY 1, 2)
        SELECT t.o_orderpriority, t.day, t.day - 364 AS ly_day, t.n AS n_orders_ty, l.n AS n_orders_ly,
               t.revenue AS revenue_ty, l.revenue AS revenue_ly
        FROM d t LEFT JOIN d l ON t.o_orderpriority = l.o_orderpriority AND t.day = l.day + 364""",
    "str_prep": r"""
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS words FROM (
            SELECT doc_id, list_sort(list_distinct([x FOR x IN
                string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+') IF x <> ''])) AS w
            FROM documents)""",
}
