"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import dml
from almanac.operators.columns import dimensions
from almanac.plans.report import ReportTable, read_provenance, sheet_summary, write_report
from almanac.session import scratch_path
from almanac.sources.catalog import describe, find_column, list_columns, list_tables
from almanac.sources.csv import read_csv, write_csv
from almanac.sources.encoding import from_unicode, read_lines_any_encoding, to_ascii
from almanac.sources.folders import read_lines
from almanac.sources.tables import from_select
from almanac.sources.textreport import LineRule, parse_lines, read_report
from almanac.streaming.reports import follow_reports, forget_last_commit
from almanac.operators.sql import from_sql

from .tables import DATABASE, fresh_table, read


def csv_round_trip(spark, sf):
    """Part as text files with names, read back with inferred types."""
    path = scratch_path(spark, "csv")
    part = read(spark, sf, "part")
    write_csv(part, path, delimiter=";")
    return read_csv(spark, path, delimiter=";")


def csv_quoted(spark, sf):
    """Texts with line breaks, quotes and commas survive a round trip without header."""
    path = scratch_path(spark, "csv")
    write_csv(read(spark, sf, "documents").select("doc_id", "text", "lang"), path, header=False)
    back = read_csv(spark, path, header=["id", "body"], infer=False, multiline=True)
    return back.select(F.col("id").cast("bigint").alias("id"), "body", "_field_2")


def select_table(spark, sf):
    return from_select(
        read(spark, sf, "lineitem"),
        ["l_orderkey", "l_partkey", "l_quantity"],
        [("l_returnflag", "R"), ("l_linestatus", "O"), ("l_linenumber", 3)],
    )


def sql_with_values(spark, sf):
    tables = {"li": read(spark, sf, "lineitem")}
    text = "SELECT l_orderkey, l_linenumber, l_shipdate FROM li WHERE l_returnflag = ? AND l_quantity > ?"
    return from_sql(spark, text, ["A", 45.0], tables)


# A report as printed: a run line, one line per store, one line per order, and totals.
HEADER = [
    ("run_date", True),
    ("store", True),
    ("store_name", True),
    ("order_no", False),
    ("amount", False),
    ("note", False),
]
RULES = [
    LineRule(r"^RUN .+ ENDING (\d+-\d+-\d+)", 1),
    LineRule(r"^STORE\s+(\d+)\s+(\w*)", 2),
    LineRule(r"^\s+(\d+)\s+([\d,.]+)\s+(\S+)\s*$", 3),
]


def _report_lines(spark, sf):
    """``file``, ``at``, ``text``: a report per order status, printed from the orders."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    store = F.col("o_custkey") % 20
    run = o.select("o_orderstatus").distinct().select(
        F.col("o_orderstatus").alias("file"),
        F.lit(-1).cast("bigint").alias("store"),
        F.lit(-1).cast("bigint").alias("n"),
        F.concat(F.lit("RUN WEEKLY ENDING 2001-08-0"), F.ascii("o_orderstatus") % 7 + 1).alias("text"),
    )
    heads = o.select("o_orderstatus", store.alias("store")).distinct().select(
        F.col("o_orderstatus").alias("file"),
        "store",
        F.lit(-1).cast("bigint").alias("n"),
        F.concat(F.lit("STORE  "), "store", F.lit("  "), F.when(F.col("store") % 3 != 0, F.concat(F.lit("s"), "store")).otherwise("")).alias("text"),
    )
    lines = o.select(
        F.col("o_orderstatus").alias("file"),
        store.alias("store"),
        F.col("o_orderkey").alias("n"),
        F.concat(
            F.lit("   "), "o_orderkey", F.lit("   "),
            F.when(F.col("o_orderkey") % 8 == 0, "0.00").otherwise(F.format_number("o_totalprice", 2)),
            F.lit("   "), F.substring("o_orderpriority", 1, 1),
        ).alias("text"),
    )
    totals = heads.select("file", "store", F.lit(2**40).alias("n"), F.lit("--- end of store ---").alias("text"))
    return run.union(heads).union(lines).union(totals)


def _typed(parsed):
    return parsed.select(
        "run_date",
        F.col("store").cast("bigint").alias("store"),
        "store_name",
        F.col("order_no").cast("bigint").alias("order_no"),
        F.col("amount").cast("double").alias("amount"),
        "note",
    )


def parse_text_files(spark, sf):
    """Reports written as text files, one per status and store, in dated folders; the latest is parsed."""
    folder = scratch_path(spark, "reports")
    lines = _store_reports(spark, sf)
    for day, part in (("2001.07.01", lines.where(F.col("store") < 3)), ("2001.08.01", lines)):
        _print_reports(part, f"{folder}/{day}")
    return _typed(read_report(spark, folder, HEADER, RULES, "amount", mode="latest", file_rule=REPORT_FILES))


REPORT_FILES = r"(?i)part-.*\.txt"


def _store_reports(spark, sf):
    """The report lines with the run's first line in the report of every store."""
    lines = _report_lines(spark, sf)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("store")
    runs = lines.where(F.col("store") < 0).select("file", every, F.lit(-2).cast("bigint").alias("n"), "text")
    return lines.where(F.col("store") >= 0).union(runs)


def _print_reports(lines, folder):
    """A text file for each status and store, written by as many tasks."""
    # sorted by the folder columns first, so the writer does not sort again
    (
        lines.withColumn("status", F.concat("file", F.lit("_report")))
        .repartition("status", "store")
        .sortWithinPartitions("status", "store", "n")
        .select("status", "store", "text")
        .write.partitionBy("status", "store")
        .text(folder)
    )


def reports_as_they_arrive(spark, sf):
    """Two days of reports, each taken up after it has come; then the last batch is repeated, as after a failure."""
    folder, checkpoint, name = scratch_path(spark, "arriving"), scratch_path(spark, "arriving-checkpoint"), fresh_table(spark, "arrived")
    lines = _store_reports(spark, sf)

    def take_up():
        query = follow_reports(spark, folder, name, checkpoint, HEADER, RULES, "amount", REPORT_FILES)
        query.awaitTermination()
        return query

    for day, part in (("2001.07.01", lines.where(F.col("store") < 3)), ("2001.08.01", lines)):
        _print_reports(part, f"{folder}/{day}")
        take_up()
    forget_last_commit(spark, checkpoint)
    take_up()
    return _typed(spark.table(name))


def parse_text_lines(spark, sf):
    """The same report as rows of a table; the orders of a store whose numbers share their thousands are a block."""
    lines = _report_lines(spark, sf)
    size = F.lit(1000).cast("bigint")
    number = F.when(F.abs("n") < 2**40, F.call_function("div", F.col("n"), size)).otherwise(F.col("n"))
    ordered = lines.withColumn("block", F.struct("store", number.alias("part"))).withColumn("line", F.struct("store", "n"))
    return _typed(parse_lines(ordered, HEADER, RULES, "amount"))


def parse_documents(spark, sf):
    """Every document as a report: a long capitalised word that opens a line holds for the addresses below it."""
    d = read(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    blocks = lines.withColumn("block", F.call_function("div", F.col("line"), F.lit(50)))
    rules = [LineRule(r"^([A-Z][a-z]{5,})[ ,.][^@]*$", 1), LineRule(r"([A-Za-z0-9]+)@([a-z0-9]+)\.example\.", 2)]
    header = [("opening", True), ("user", False), ("host", False)]
    return parse_lines(blocks, header, rules, "host", keep=["file"])


def dated_folders(spark, sf):
    """Orders as text in dated folders, one per status; the lines of the latest one."""
    folder = scratch_path(spark, "folders")
    o = read(spark, sf, "orders")
    for day, status in (("2024.01.15", "F"), ("2023.12.31", "O"), ("2024.01.02", "P")):
        o.where(F.col("o_orderstatus") == status).select("o_orderpriority").write.text(f"{folder}/{day}")
    o.select("o_orderkey").write.json(f"{folder}/notes")
    return read_lines(spark, folder, "latest").groupBy(F.col("text").alias("line")).agg(F.count(F.lit(1)).alias("n_lines"))


def report_sheets(spark, sf):
    folder = scratch_path(spark, "report")
    tables = [
        ReportTable(read(spark, sf, "customer"), "Data", "SELECT * FROM customer"),
        ReportTable(read(spark, sf, "orders"), "data", "SELECT * FROM orders"),
        ReportTable(read(spark, sf, "nation"), "Data", "SELECT * FROM nation"),
    ]
    names = write_report(spark, tables, folder)
    summary = sheet_summary(spark, folder, names)
    return summary.join(read_provenance(spark, folder), "table")


def db_write(spark, sf):
    """Create, then append, with nested values as text."""
    name = fresh_table(spark, "events")
    e = read(spark, sf, "events").select("event_id", F.array("user_id", "event_id").alias("ids"), "event_type")
    dml.write_table(e.where("event_type = 'click'"), name)
    dml.write_table(e.where("event_type <> 'click'"), name)
    return spark.table(name)


def db_replace(spark, sf):
    """A stored table replaced by a change of itself."""
    name = fresh_table(spark, "customer")
    dml.write_table(read(spark, sf, "customer"), name)
    dml.replace_table(spark.table(name).where("c_acctbal > 0").drop("c_acctbal"), name)
    return spark.table(name)


def catalog_info(spark, sf):
    name = fresh_table(spark, "orders")
    dml.write_table(read(spark, sf, "orders"), name)
    short = name.split(".")[1]
    found = list_columns(spark, short, DATABASE)
    known = list_tables(spark, DATABASE).where(F.col("table") == short)
    joined = found.join(known, "table").select("position", "column", "type")
    both = joined.union(find_column(found, "O_ORDERKEY").select(F.lit(-1).cast("bigint"), "column", "type"))
    return both.withColumn("n_rows", dimensions(spark.table(name)).select("n_rows").scalar())


def describe_table(spark, sf):
    li = read(spark, sf, "lineitem")
    return describe(li).withColumn("n_rows", dimensions(li).select("n_rows").scalar())


def text_any_encoding(spark, sf):
    """Documents as bytes in two encodings, back to plain text."""
    d = read(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return d.select("doc_id", to_ascii(content).alias("text"))


def text_files_any_encoding(spark, sf):
    """The lines of all documents in files of four encodings, and back.

    The first byte of a file tells its charset, so every line starts with a sign that has that byte.
    """
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    folder = scratch_path(spark, "encodings")
    for k, (charset, sign) in enumerate((("utf8", "é"), ("latin1", "é"), ("iso8859_15", "€"), ("cp1252", "“"))):
        line = F.concat(F.lit(sign), F.concat_ws("\t", F.col("doc_id"), F.col("at"), F.col("line")))
        some = lines.where(F.col("doc_id") % 4 == k)
        some.select(from_unicode(line, charset).cast("string").alias("value")).write.text(f"{folder}/{charset}")
    part = F.split("text", "\t", 3)
    back = read_lines_any_encoding(spark, folder, "part-*").select(part.alias("p"))
    number = F.regexp_extract(F.col("p")[0], r"\d+$", 0).cast("bigint")
    return back.select(number.alias("doc_id"), F.col("p")[1].cast("bigint").alias("at"), F.col("p")[2].alias("text"))


QUERIES = {
    "read_csv": csv_round_trip,
    "write_csv": csv_quoted,
    "from_select": select_table,
    "from_sql": sql_with_values,
    "parse_text_files": parse_text_files,
    "reports_as_they_arrive": reports_as_they_arrive,
    "parse_text_lines": parse_text_lines,
    "parse_text_documents": parse_documents,
    "dated_folders": dated_folders,
    "write_report": report_sheets,
    "db_write": db_write,
    "db_replace": db_replace,
    "catalog_info": catalog_info,
    "describe_table": describe_table,
    "read_text_any_encoding": text_any_encoding,
    "read_lines_any_encoding": text_files_any_encoding,
}

# The same report without parsing: what each order line says, and the last named store line.
_REPORT = """
    SELECT '2001-08-0' || CAST(ascii(o_orderstatus) % 7 + 1 AS VARCHAR) AS run_date, o_custkey % 20 AS store,
           CASE WHEN o_custkey % 20 % 3 <> 0 THEN 's' || CAST(o_custkey % 20 AS VARCHAR) END AS store_name,
           o_orderkey AS order_no, o_totalprice AS amount, substr(o_orderpriority, 1, 1) AS note
    FROM orders WHERE o_orderkey % 8 <> 0"""

SQL = {
    "read_csv": "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part",
    "write_csv": "SELECT doc_id AS id, text AS body, lang AS _field_2 FROM documents",
    "from_select": """
        SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
        WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 3""",
    "from_sql": """
        SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45""",
    "parse_text_files": _REPORT,
    "reports_as_they_arrive": f"SELECT * FROM ({_REPORT}) UNION ALL SELECT * FROM ({_REPORT}) WHERE store < 3",
    "parse_text_lines": _REPORT,
    "parse_text_documents": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
                          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
             m AS (SELECT doc_id, i, t, regexp_matches(t, '^[A-Z][a-z]{5,}[ ,.][^@]*$') AS opens,
                          regexp_matches(t, '[A-Za-z0-9]+@[a-z0-9]+\.example\.') AS address FROM l),
             h AS (SELECT *, last_value(CASE WHEN opens THEN regexp_extract(t, '^([A-Z][a-z]{5,})', 1) END IGNORE NULLS)
                             OVER (PARTITION BY doc_id ORDER BY i) AS opening FROM m)
        SELECT doc_id AS file, opening,
               CASE WHEN regexp_matches(u, '^\d{1,18}$') THEN CAST(CAST(u AS BIGINT) AS VARCHAR) ELSE u END AS "user", host
        FROM (SELECT doc_id, opening, regexp_extract(t, '([A-Za-z0-9]+)@([a-z0-9]+)\.example\.', 1) AS u,
                     regexp_extract(t, '([A-Za-z0-9]+)@([a-z0-9]+)\.example\.', 2) AS host
              FROM h WHERE address AND NOT opens)""",
    "dated_folders": """
        SELECT o_orderpriority AS line, count(*) AS n_lines
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
    "write_report": """
        SELECT 'Data' AS "table", CAST(5 AS BIGINT) AS n_columns, count(*) AS n_rows, 'SELECT * FROM customer' AS note FROM customer
        UNION ALL SELECT 'datab', 6, count(*), 'SELECT * FROM orders' FROM orders
        UNION ALL SELECT 'Datac', 3, count(*), 'SELECT * FROM nation' FROM nation""",
    "db_write": """
        SELECT event_id, '[' || CAST(user_id AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) || ']' AS ids, event_type FROM events""",
    "db_replace": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0",
    "catalog_info": """
        SELECT *, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES (CAST(0 AS BIGINT), 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
            (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'),
            (-1, 'o_orderkey', 'bigint')) v(position, "column", type)""",
    "describe_table": """
        SELECT *, (SELECT count(*) FROM lineitem) AS n_rows FROM (VALUES (CAST(0 AS BIGINT), 'l_orderkey', 'bigint'), (1, 'l_partkey', 'bigint'), (2, 'l_suppkey', 'bigint'),
            (3, 'l_linenumber', 'int'), (4, 'l_quantity', 'double'), (5, 'l_extendedprice', 'double'),
            (6, 'l_discount', 'double'), (7, 'l_tax', 'double'), (8, 'l_returnflag', 'string'),
            (9, 'l_linestatus', 'string'), (10, 'l_shipdate', 'timestamp_ntz')) v(position, "column", type)""",
    "read_text_any_encoding": r"""
        SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text FROM documents""",
    "read_lines_any_encoding": r"""
        SELECT doc_id, k - 1 AS "at", regexp_replace(strip_accents(line), '[^\x00-\x7F]', '', 'g') AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)""",
}
