import datetime
from datetime import date

import pytest
from helpers import rows, values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.functions import casting, codes, dates
from almanac.operators.typing import apply_types, infer_types
from almanac.plans.dates import date_range_table, last_year_from_calendar, run_dates, ty_ly_compare


def digit(code):
    text = str(code).rjust(13, "0")
    total = sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(text))
    return (10 - total % 10) % 10


def test_known_codes(spark):
    df = spark.createDataFrame([(3600029145,), (61414121022,), (0,), (None,), (-5,)], "c long")
    got = [r[0] for r in df.select(codes.upc_to_gtin(F.col("c"))).collect()]
    assert got == [36000291452, 614141210220, 0, None, None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 18).flatmap(lambda n: st.integers(10 ** (n - 1), min(10**n - 1, 9 * 10**17))), min_size=1, max_size=60))
def test_check_digit_of_any_length(spark, data):
    df = spark.createDataFrame([(c,) for c in data], "c long")
    got = df.select("c", codes.upc_to_gtin(F.col("c")).alias("g")).withColumn("back", codes.gtin_to_upc(F.col("g")))
    for r in got.collect():
        assert r.g == r.c * 10 + digit(r.c) and r.back == r.c


def test_other_codes(spark):
    df = spark.createDataFrame([(0,), (None,), (12345,), (123456,), (12345678,), (12345678901,), (123456789012345678,), (-15,)], "c long")
    out = df.select(
        codes.gtin_to_upc(F.col("c")), codes.to_manufacturer(F.col("c")), codes.slu_to_upc(F.col("c") % 1000000)
    ).collect()
    assert [r[0] for r in out] == [0, None, 1234, 12345, 1234567, 1234567890, 12345678901234567, -2]
    assert [r[1] for r in out] == [0, None, 12345, 12345, 12345, 12345, 12345, -15]
    assert out[2][2] == 1234500000
    slu = spark.createDataFrame([(77,), (0,), (None,)], "c long").select(codes.slu_to_gtin(F.col("c")))
    assert values(slu) == [7700000 * 10 + digit(7700000), 0, None]


def test_weekdays(spark):
    monday = date(2024, 1, 1)
    days = [monday + datetime.timedelta(days=i) for i in range(7)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for flag, weekday in (("lmon", 0), ("lsun", 6), ("lsat", 5), ("lfri", 4), ("lthur", 3), ("lwed", 2), ("ltue", 1)):
        for d, got in df.select("d", dates.run_date(F.col("d"), flag)).collect():
            back = (d - got).days
            assert got.weekday() == weekday
            # a Monday is its own last Monday, any other weekday lies one to seven days back
            assert back == ((d.weekday() - weekday) % 7 or (0 if flag == "lmon" else 7))
    assert values(df.select(dates.run_date(F.col("d"), "plusten")))[0] == date(2024, 1, 11)
    assert values(df.select(dates.run_date(F.col("d"), "now")))[0] == date(2023, 12, 31)
    with pytest.raises(ValueError):
        dates.run_date(F.col("d"), "lmo")


def test_last_year_and_leap_days(spark):
    df = spark.createDataFrame([(date(2024, 2, 29),), (date(2025, 3, 1),)], "d date")
    assert values(df.select(dates.last_year(F.col("d")))) == [date(2023, 3, 2), date(2024, 3, 2)]
    assert values(df.select(dates.next_year(dates.last_year(F.col("d"))))) == [date(2024, 2, 29), date(2025, 3, 1)]


def test_run_dates(spark):
    got = run_dates(spark, flag="ltue", as_of=date(2024, 1, 4))
    assert got == {"rundate_i": None, "rundate_f": date(2024, 1, 2), "ly_i": None, "ly_f": date(2023, 1, 3)}
    got = run_dates(spark, start=date(2024, 1, 1), end=date(2024, 1, 7))
    assert got["ly_i"] == date(2023, 1, 2) and got["ly_f"] == date(2023, 1, 8)
    one = date_range_table(spark, date(2024, 1, 1), None)
    assert one.columns == ["start date ty", "end date ty", "start date ly", "end date ly"]
    assert rows(one) == [(date(2024, 1, 1), None, date(2023, 1, 2), None)]


def test_ty_ly(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), "a", 5), (date(2024, 1, 1), "a", 6), (date(2023, 1, 2), "a", 3), (date(2023, 1, 2), None, 9), (date(2024, 1, 1), None, 1)],
        "d date, g string, v int",
    )
    got = ty_ly_compare(df, "d", {"v": F.sum("v")}, ["g"]).where("day = '2024-01-01'")
    assert rows(got.select("g", "ly_day", "v_ty", "v_ly")) == [("a", date(2023, 1, 2), 11, 3), (None, date(2023, 1, 2), 1, 9)]


def test_calendar(spark):
    days = spark.createDataFrame([(date(2024, 5, 5),), (date(2024, 5, 6),)], "d date")
    calendar = spark.createDataFrame([(date(2024, 5, 5), date(2023, 5, 7))], "day_dt date, ly_day_dt date")
    got = last_year_from_calendar(days, "d", calendar, "day_dt", "ly_day_dt")
    assert rows(got) == [(date(2024, 5, 5), date(2023, 5, 7)), (date(2024, 5, 6), None)]


@pytest.mark.parametrize(
    "name, yes",
    [("date", 1), ("run date", 1), ("LOAD_DT", 1), ("dt_loaded", 1), ("update", 0), ("runtime", 0), ("time", 1), ("dates x", 1), ("mandate_x", 0)],
)
def test_date_names(name, yes):
    assert casting.is_date_name(name) == bool(yes)


def test_casts(spark):
    df = spark.createDataFrame([(" 12 ", "x"), ("", "1.5"), (None, "2"), ("1x", "")], "a string, b string")
    got = casting.cast_columns(df, {"a": "bigint", "b": "double"}, flag_bad=True)
    assert got.columns == ["a", "b", "a__bad", "b__bad"]
    assert [tuple(r) for r in got.collect()] == [
        (12, None, False, True), (None, 1.5, False, False), (None, 2.0, False, False), (None, None, True, False)
    ]


def test_dates_from_text(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "2024-01-05 10:11:12.345"), ("01/05/2024", "2024-01-05 10:11:12"), ("never", "x.y")], "run_date string, stamp string"
    )
    got = casting.parse_date_columns(df)
    assert [r.run_date for r in got.collect()] == [datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 5), None]
    assert dict(got.dtypes) == {"run_date": "timestamp_ntz", "stamp": "string"}
    stamps = values(df.select(casting.text_to_date(F.col("stamp"))))
    assert stamps == [datetime.datetime(2024, 1, 5, 10, 11, 12)] * 2 + [None]
    assert values(df.select(casting.date_to_text(casting.text_to_date(F.col("stamp")))))[0] == "2024-01-05 10:11:12"


def test_inference(spark):
    data = [
        ("1", "1", "a", "1.5", "2024-01-01", "2024-01-01", None, "true", "007"),
        ("22", "", "2", "2", "2024-02-01", "2024-02-01", "", "False", "8"),
        (" 3 ", "x1", "3", ".5e2", None, "", " ", None, "+9"),
    ]
    df = spark.createDataFrame(data, "i string, t string, mixed string, r string, load_dt string, plain string, nothing string, b string, z string")
    kinds = {r.column: (r.simple_type, r.n_values) for r in infer_types(df).collect()}
    assert kinds == {
        "i": ("INTEGER", 3), "t": ("TEXT", 2), "mixed": ("TEXT", 3), "r": ("REAL", 3), "load_dt": ("DATETIME", 2),
        "plain": ("TEXT", 2), "nothing": ("NULL", 0), "b": ("BOOLEAN", 2), "z": ("INTEGER", 3),
    }
    typed = apply_types(df)
    assert dict(typed.dtypes)["load_dt"] == "timestamp_ntz" and dict(typed.dtypes)["r"] == "double"
    assert [tuple(r)[:4] for r in typed.collect()] == [(1, "1", "a", 1.5), (22, None, "2", 2.0), (3, "x1", "3", 50.0)]


def test_inference_reads_once(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    plan = infer_types(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
