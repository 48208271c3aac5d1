import datetime
import json
import re
from types import SimpleNamespace

import pytest
from helpers import rows
from pyspark.sql import functions as F

from almanac.session import materialize, scratch_path, shared_dir
from almanac.sources import catalog, folders, tables
from almanac.sources.csv import read_csv, write_csv
from almanac.streaming.reports import follow_reports, forget_last_commit
from almanac.sources.encoding import from_unicode, read_lines_any_encoding, read_text_any_encoding, to_ascii, to_unicode
from almanac.sources.textreport import LineRule, parse_lines, read_report, total_level, total_name


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and scratch_path(spark, "x").startswith(named)
    df = materialize(spark.range(5))
    assert df.count() == 5 and df.inputFiles()[0].replace("file:", "").startswith("/")


def test_shared_folder_where_the_session_names_none():
    def session(master):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(ValueError):
        shared_dir(session("yarn"))


def test_csv_cells(spark, tmp_path):
    data = [(1, 'say "hi", you', "x"), (2, "two\nlines", ""), (3, None, "a;b"), (4, "back\\slash", "'q'")]
    df = spark.createDataFrame(data, "id int, body string, tail string")
    for sep, quote in ((",", '"'), (";", "'")):
        path = str(tmp_path / f"c{ord(sep)}")
        write_csv(df, path, sep, quote)
        back = read_csv(spark, path, True, sep, quote, multiline=True)
        assert dict(back.dtypes)["id"] == "bigint"
        assert rows(back) == sorted([(i, b, t or None) for i, b, t in data], key=repr)


def test_csv_headers(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("1,a,2.5\n2,b,\n")
    assert read_csv(spark, str(path), header=False).columns == ["_field_0", "_field_1", "_field_2"]
    assert read_csv(spark, str(path), header=["x"]).columns == ["x", "_field_1", "_field_2"]
    assert rows(read_csv(spark, str(path), header=["x", "y", "z"])) == [(1, "a", 2.5), (2, "b", None)]
    path = tmp_path / "repeated.csv"
    path.write_text("k,K,\n1,2,\n")
    again = read_csv(spark, str(path))
    assert again.columns == ["k", "Kb", "_field_2"] and rows(again) == [(1, 2, None)]


def test_from_rows(spark):
    t = tables.from_rows(spark, [(1, 2, 3), (4, 5, 6)])
    assert t.columns == ["_field_0", "_field_1", "_field_2"] and rows(t) == [(1, 2, 3), (4, 5, 6)]
    t = tables.from_rows(spark, [(1, 2.5), (3,)], header=["a", "b"])
    assert rows(t) == [(1, 2.5), (3, None)] and dict(t.dtypes) == {"a": "bigint", "b": "double"}
    t = tables.from_rows(spark, [[1, 2], ["x"]], header=["a"], row_first=False)
    assert t.columns == ["a", "_field_1"] and rows(t) == [(1, "x"), (2, None)]
    assert tables.from_rows(spark, header=["a", "b"]).columns == ["a", "b"]
    t = tables.from_rows(spark, [("1", [1, 2], datetime.date(2024, 1, 1))], ["a", "b", "c"], known_types=["INTEGER", "TEXT", "DATETIME"])
    assert rows(t) == [(1, "[1, 2]", datetime.datetime(2024, 1, 1))]
    assert rows(tables.from_rows(spark, [(2**70,)], ["n"]))[0][0] == 2**70


def test_from_select(spark):
    df = spark.createDataFrame([(1, "null"), (2, None)], "a int, s string")
    assert rows(tables.from_select(df, ["a"], [("s", "null")])) == [(1,)]
    assert tables.from_select(df, None, [("s", None)]).count() == 0
    assert tables.from_select(df).count() == 2
    with pytest.raises(ValueError):
        tables.from_database(spark, {}, query="select 1", table="t")
    with pytest.raises(ValueError):
        tables.from_database(spark, {}, query="select 1", split=("a", 0, 1, 2))


@pytest.fixture()
def reports(tmp_path):
    text = {
        "2024.01.05/a.txt": "noise\nRUN ENDING 2024-01-05\nSTORE 7 main\n 1 10.50 x\n 2 0.00 y\nSTORE 8\n 3 1,200 z\n",
        "2024.01.05/deep/b.TXT": " 4 5 early\nSTORE 9 last\nRUN ENDING 2024-01-06\n 007 6 w\nRUN 5 STORE\n",
        "2024.01.05/skip.log": " 9 9 q\n",
        "2023.12.31/a.txt": "STORE 1 old\n 8 8 o\n",
    }
    for name, body in text.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(tmp_path)


HEADER = [("run", True), ("store", True), ("label", True), ("no", False), ("amount", False), ("note", False)]
RULES = [
    LineRule(r"RUN ENDING (\d+-\d+-\d+)", 1),
    LineRule(r"^STORE (\d+) ?(\w*)", 2),
    LineRule(r"^ (\d+) ([\d,.]+) (\w+)", 3),
]


def loop(lines, header, rules, trigger):
    """The report rules, one line after the other."""
    out, current = [], [None] * len(header)
    for line in lines:
        at = 0
        for rule in rules:
            found = re.search(rule.pattern, line)
            if found:
                for j, g in enumerate(found.groups()):
                    g = (g or "").replace(",", "").strip()
                    current[at + j] = str(int(g)) if re.fullmatch(r"[+-]?\d+", g) else (g or None)
                value = current[trigger]
                if value is not None and not re.fullmatch(r"[+-]?0*\.?0*", value):
                    out.append(tuple(current))
                current = [c if hold else None for c, (_, hold) in zip(current, header)]
                break
            at += rule.width
    return out


def test_report_files(spark, reports):
    got = read_report(spark, reports, HEADER, RULES, "amount")
    want = [
        ("2024-01-05", "7", "main", "1", "10.50", "x"),
        ("2024-01-05", "8", None, "3", "1200", "z"),
        (None, None, None, "4", "5", "early"),
        ("2024-01-06", "9", "last", "7", "6", "w"),
    ]
    assert rows(got) == sorted(want, key=repr)
    assert read_report(spark, reports, HEADER, RULES, "amount", mode="all").count() == 5
    assert rows(read_report(spark, reports, HEADER, RULES, 4, mode="date: 2023.12.31")) == [(None, "1", "old", "8", "8", "o")]
    # a held trigger gives a row on every matching line below it
    assert read_report(spark, reports, HEADER, RULES, "store", mode="all").count() == 10


def test_folders(spark, reports):
    assert folders.choose_folder(spark, reports, "latest").endswith("2024.01.05")
    assert folders.choose_folder(spark, reports, "all") == reports
    names = folders.list_files(spark, reports)
    assert sorted((r.folder, r.name) for r in names.collect()) == [
        ("2023.12.31", "a.txt"), ("2024.01.05", "a.txt"), ("2024.01.05", "b.TXT")
    ]
    with pytest.raises(ValueError):
        folders.choose_folder(spark, reports, "newest")


@pytest.mark.parametrize("trigger", ["amount", "store", "note"])
def test_parser_equals_line_loop(spark, trigger):
    import random

    rng = random.Random(11)
    choices = ["RUN ENDING 2024-01-0{}", "STORE {} s{}", "STORE {}", " {} {},5{}.0 n", " {} 0 n", "nothing {}", "RUN ENDING x STORE {}"]
    files = {f"f{k}": [rng.choice(choices).format(*[rng.randint(0, 9) for _ in range(4)]) for _ in range(200)] for k in range(3)}
    data = [(f, i // 7, i, t) for f, lines in files.items() for i, t in enumerate(lines)]
    df = spark.createDataFrame(data, "file string, block long, line long, text string").repartition(5)
    at = [n for n, _ in HEADER].index(trigger)
    want = [r for lines in files.values() for r in loop(lines, HEADER, RULES, at)]
    got = parse_lines(df, HEADER, RULES, trigger)
    assert rows(got) == sorted(want, key=repr)


def test_rule_without_groups_only_ends_the_line(spark):
    header, rules = [("head", True), ("n", False)], [LineRule("^#", 0), LineRule(r"^H (\w+)", 1), LineRule(r"(\d+)", 1)]
    text = ["H one", "5", "# 6", "7", "0", "H", "8"]
    df = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(text)], "file string, block int, line int, text string")
    for trigger in ("n", "head"):
        at = [h for h, _ in header].index(trigger)
        assert rows(parse_lines(df, header, rules, trigger)) == sorted(loop(text, header, rules, at), key=repr)


def test_one_large_file_is_read_in_blocks(spark, tmp_path):
    # long stretches without a store line: whole blocks that only carry
    lines = [f"STORE {i} s{i}" if i % 7000 == 0 else f" {i} {i % 3} n" for i in range(20000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        source = folders.read_lines(spark, str(tmp_path), "all")
        assert source.select("block").distinct().count() > 5
        got = read_report(spark, str(tmp_path), HEADER, RULES, "amount", mode="all")
        assert rows(got) == sorted(loop(lines, HEADER, RULES, 4), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_extra_columns(spark):
    rule = LineRule(r"^(\d+) (.*)$", 2, extra=(total_level, total_name))
    header = [("n", False), ("words", False), ("level", False), ("name", False)]
    text = ["1 Category total for fresh bread", "2 ZONE TOTAL", "3 bread", "4 department total for All"]
    df = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(text)], "file string, block int, line int, text string")
    got = [r[2:] for r in rows(parse_lines(df, header, [rule], "n"))]
    assert got == [("2", "fresh bread"), ("3", None), (None, None), ("1", "All")]
    with pytest.raises(ValueError):
        parse_lines(df, header[:2], [rule], "n")


def test_encodings(spark, tmp_path):
    data = {
        "utf8": ("é ñ ü".encode(), "é ñ ü", "e n u"),
        "latin15": ("¤".encode("latin-1") + b"uro \xe9", "€uro é", "uro e"),
        "cp1252": (b"\x93quoted\x94 \xe9", "“quoted” é", "quoted e"),
        "latin1": (b"caf\xe9 \xa4", "café ¤", "cafe "),
        "control": (b"a\x00\xc3\xa9", "a\x00Ã©", "a\x00A"),
        "plain": (b"abc", "abc", "abc"),
        "empty": (b"", "", ""),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in data.items()], "k string, b binary")
    for k, u, a in df.select("k", to_unicode(F.col("b")), to_ascii(F.col("b"))).collect():
        assert (u, a) == data[k][1:], k
    for k, v in data.items():
        (tmp_path / f"{k}.txt").write_bytes(v[0])
    got = {r.path.rsplit("/", 1)[1][:-4]: r.text for r in read_text_any_encoding(spark, str(tmp_path)).collect()}
    assert got == {k: v[2] for k, v in data.items() if v[0]}  # an empty file has no row


def test_reports_that_arrive_are_taken_up_once(spark, tmp_path):
    """Files added between runs, several batches in a run, and repeated batches, against one read of all files."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS arriving LOCATION '{tmp_path / 'db'}'")
    rules, header = [LineRule(r"^S (\w+)", 1), LineRule(r"^(\d+) (\d+)$", 2)], [("store", True), ("no", False), ("amount", False)]
    folder, checkpoint, name = tmp_path / "in", str(tmp_path / "cp"), "arriving.rows"

    def add(day, file, text):
        (folder / day).mkdir(parents=True, exist_ok=True)
        (folder / day / file).write_text(text)

    def take_up():
        follow_reports(spark, str(folder), name, checkpoint, header, rules, "amount", files_per_batch=2).awaitTermination()
        got = spark.table(name)
        assert got.groupBy("batch").count().count() == len(got.select("batch").distinct().collect())
        return rows(got.select("store", "no", "amount"))

    def once():
        return rows(read_report(spark, str(folder), header, rules, "amount", mode="all"))

    for i in range(5):
        add("2024.01.01", f"a{i}.txt", f"S s{i}\n1 {i + 1}\n2 0\n3 4\n")
    add("2024.01.01", "held.txt", "7 7\nS late\n8 8\n")
    add("2024.01.01", "notes.md", "S no\n1 1\n")
    assert take_up() == once() and len(once()) == 12
    assert take_up() == once()
    add("2024.01.02", "b.txt", "5 5\n")  # nothing is held from another file
    assert take_up() == once() and (None, "5", "5") in once()
    forget_last_commit(spark, checkpoint)
    assert take_up() == once()
    spark.sql(f"DROP TABLE {name}")


def test_lines_of_files_in_any_encoding(spark, tmp_path):
    """Files are split over tasks, and what decides is at other ends of them."""
    body = [f"line {i} with é and ü" for i in range(4000)]
    data = {
        "utf8": "\n".join(body).encode(),
        "late": "\n".join(body[:10]).encode() + b"\n" + b"plain\n" * 20_000 + b"\xe9 is not utf-8",
        "latin15": "\n".join(["€ first", *body]).encode("iso8859_15"),
        "cp1252": "\n".join(["“first” …", *body]).encode("cp1252"),
        "latin1": "\n".join(["¿", *body, ""]).encode("latin-1") + b"\xa4\r\n\r\n",
        "blank": b"\n\n\x80",
        "control": "é\n".encode() + b"a\x00",
        "empty": b"",
    }
    want = {}
    for name, content in data.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
        try:
            text = content.decode()
            if "\x00" in text:
                raise ValueError
        except ValueError:
            charset = {0xA4: "iso8859_15"}.get(content[0], "cp1252" if 0x80 <= content[0] <= 0xBF else "latin-1")
            text = content.decode(charset)
        lines = text.split("\n")
        want[name] = lines[:-1] if lines[-1] == "" else lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_lines_any_encoding(spark, str(tmp_path), ascii_only=False)
        got = {}
        for r in df.orderBy("path", "place").collect():
            got.setdefault(r.path.rsplit("/", 1)[1][:-4], []).append(r.text)
        assert df.where("path like '%late.txt'").select("place.block").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: v for k, v in want.items() if v}
    folded = read_lines_any_encoding(spark, str(tmp_path), "latin15.txt").orderBy("place").first().text
    assert folded == " first"


@pytest.mark.parametrize("charset", ["utf8", "latin1", "iso8859_15", "cp1252"])
def test_bytes_of_a_text_in_a_charset(spark, charset):
    text = {"utf8": "日本 é", "latin1": "¤ é ÿ", "iso8859_15": "€ Š é", "cp1252": "“€” … é"}[charset]
    python = {"utf8": "utf-8", "latin1": "latin-1"}.get(charset, charset)
    got = spark.createDataFrame([(text,)], "t string").select(from_unicode(F.col("t"), charset)).first()[0]
    assert bytes(got) == text.encode(python)


def test_catalog(spark):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS cat LOCATION '{scratch_path(spark, 'cat')}'")
    spark.range(1).select("id", F.lit("x").alias("Name")).write.mode("overwrite").saveAsTable("cat.one")
    assert [r.table for r in catalog.list_tables(spark, "cat").collect()] == ["one"]
    cols = catalog.list_columns(spark, database="cat")
    assert rows(cols) == [("one", 0, "id", "bigint"), ("one", 1, "Name", "string")]
    assert catalog.find_column(cols, "NAME").count() == 1
    assert catalog.table_exists(spark, "cat.one") and not catalog.table_exists(spark, "cat.two")
    assert json.loads(catalog.describe(spark.range(1)).toJSON().first())["column"] == "id"


def test_an_empty_latest_folder_counts(spark, tmp_path):
    for day in ("2024.01.01", "2024.02.01", "notes"):
        (tmp_path / day).mkdir()
    (tmp_path / "2024.01.01" / "a.txt").write_text("x")
    assert folders.choose_folder(spark, str(tmp_path)).endswith("2024.02.01")


def test_long_whole_numbers_keep_their_digits(spark):
    from almanac.operators.typing import apply_types

    df = spark.createDataFrame([("9007199254740993123",), ("1",)], "n string")
    got = apply_types(df)
    assert got.dtypes == [("n", "decimal(38,0)")] and sorted(int(r.n) for r in got.collect()) == [1, 9007199254740993123]
