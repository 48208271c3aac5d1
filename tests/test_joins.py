import itertools

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.operators.joins import join, merge_plan
from almanac.operators.setops import union


@pytest.fixture(scope="module")
def nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r")], "k long, y string")
    return left, right


@pytest.mark.parametrize("skewed", [True, False])
@pytest.mark.parametrize("how, n", [("inner", 2), ("left", 5), ("right", 4), ("outer", 7)])
def test_null_keys_do_not_match(nulls, how, n, skewed):
    assert join(*nulls, how, [("k", "k")], skewed=skewed).count() == n


@pytest.mark.parametrize("skewed", [True, False])
@pytest.mark.parametrize("how, n", [("inner", 4), ("left", 5), ("right", 5), ("outer", 6)])
def test_nulls_equal(nulls, how, n, skewed):
    assert join(*nulls, how, [("k", "k")], nulls_equal=True, skewed=skewed).count() == n


def test_which_keys_stay(nulls):
    on = [("k", "k")]
    assert join(*nulls, "inner", on).columns == ["k", "x", "y"]
    assert join(*nulls, "left", on).columns == ["k", "x", "y"]
    assert join(*nulls, "right", on).columns == ["x", "k", "y"]
    assert join(*nulls, "outer", on).columns == ["k", "x", "kb", "y"]
    assert join(*nulls, "inner", on, drop_redundant=False).columns == ["k", "x", "kb", "y"]


def test_right_join_values(nulls):
    got = rows(join(*nulls, "right", [(0, 0)]))
    assert got == sorted([("a", 1, "p"), ("b", 1, "p"), (None, 3, "q"), (None, None, "r")], key=repr)


def test_case_is_folded_for_ascii_only(spark):
    left = spark.createDataFrame([("abc",), ("ABC",), ("Äb",)], "k string")
    right = spark.createDataFrame([("Abc", 1), ("äB", 2)], "k string, n int")
    assert rows(join(left, right, "inner", [("k", "k")])) == [("ABC", 1), ("abc", 1)]
    assert rows(join(left, right, "inner", [("k", "k")], nocase=False)) == []


def test_number_and_text_keys(spark):
    numbers = spark.createDataFrame([(12, "n"), (9007199254740993, "big"), (0, "zero")], "k long, x string")
    texts = spark.createDataFrame([("12", 1), (" 12 ", 2), ("x", 3), ("", 4), ("9007199254740992", 5)], "k string, y int")
    assert rows(join(numbers, texts, "inner", [("k", "k")])) == [(12, "n", 1), (12, "n", 2)]
    assert rows(join(texts, numbers, "inner", [("k", "k")])) == [(" 12 ", 2, "n"), ("12", 1, "n")]


def test_same_names_and_two_keys(spark):
    left = spark.createDataFrame([(1, 1, "l"), (1, 2, "m")], "k int, j int, v string")
    right = spark.createDataFrame([(1, 2, "r")], "k int, j int, V string")
    got = join(left, right, "left", [("k", "k"), ("j", "j")])
    assert got.columns == ["k", "j", "v", "Vb"]
    assert rows(got) == [(1, 1, "l", None), (1, 2, "m", "r")]


def test_unknown_kind(nulls):
    with pytest.raises(ValueError):
        join(*nulls, "cross", [("k", "k")])
    with pytest.raises(ValueError):
        join(*nulls, "inner", [])


def test_no_job_runs_while_a_merge_is_built(spark):
    tables = [spark.range(50).select((F.col("id") % (n + 2)).alias("k"), F.col("id").alias(f"v{n}")) for n in range(5)]
    context = spark.sparkContext
    context.setJobGroup("building", "merge_plan")
    merge_plan(tables, [((0, n), "outer", [("k", "k")]) for n in range(1, 5)])
    ran = context.statusTracker().getJobIdsForGroup("building")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert list(ran) == []


def test_mixed_types_never_fail(spark):
    text = spark.createDataFrame([("2024-01-02",), ("no date",), ("true",), (" 5 ",), ("5.00000000001",), ("5.0",), ("1e3",), (None,), ("9007199254740993",)], "t string")
    other = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP_NTZ'2024-01-02' AS s, TRUE AS b, 5L AS n, CAST(5 AS DOUBLE) AS r, 9007199254740993L AS w")
    for key, want in (("d", ["2024-01-02"]), ("s", ["2024-01-02"]), ("b", ["true"]), ("n", [" 5 ", "5.0"]), ("r", [" 5 ", "5.0"]), ("w", ["9007199254740993"])):
        for how in ("inner", "right"):
            got = join(other.select(key), text, how, [(key, "t")], drop_redundant=False)
            assert sorted(r.t for r in got.collect() if r[key] is not None) == sorted(want), key


keys = st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=7)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys, keys, st.booleans())
def test_counts_follow_multiplicities(spark, a, b, nulls_equal):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(a)], "k int, i int")
    right = spark.createDataFrame([(k, i) for i, k in enumerate(b)], "k int, j int")

    def same(x, y):
        return (x is None and y is None and nulls_equal) or (x is not None and x == y)

    inner = sum(same(x, y) for x, y in itertools.product(a, b))
    alone_l = sum(not any(same(x, y) for y in b) for x in a)
    alone_r = sum(not any(same(x, y) for x in a) for y in b)
    for how, n in (("inner", inner), ("left", inner + alone_l), ("right", inner + alone_r), ("outer", inner + alone_l + alone_r)):
        for skewed in (False, True):
            assert join(left, right, how, [("k", "k")], nulls_equal=nulls_equal, skewed=skewed).count() == n


def test_merge_plan(spark):
    t = [spark.createDataFrame([(i, f"t{n}-{i}") for i in range(n, 4)], f"k int, v{n} string") for n in range(3)]
    on = [("k", "k")]
    merged = merge_plan(t, [((0, 1), "left", on), ((0, 2), "inner", on)])
    assert len(merged) == 1 and merged[0].columns == ["k", "v0", "v1", "v2"] and merged[0].count() == 2
    folded = merge_plan(t, [((0, 1), "left", on)], complete=True)
    assert len(folded) == 1 and folded[0].count() == 4
    assert len(merge_plan(t, [((1, 2), "inner", on)])) == 2


def test_union_ragged(spark):
    left = spark.createDataFrame([(1, 2.5, "a"), (1, 2.5, "a")], "a int, b double, c string")
    right = spark.createDataFrame([("12", ""), (None, "7"), ("12", "")], "x string, y string")
    plain = union(left, right)
    assert plain.columns == ["a", "b", "c"] and plain.count() == 5
    assert rows(plain)[0][0] in ("1", "12")
    coerced = union(left, right, coerce=True)
    assert rows(coerced) == sorted(
        [(1.0, 2.5, "a"), (1.0, 2.5, "a"), (12.0, None, None), (12.0, None, None), (None, 7.0, None)], key=repr
    )
    narrow = union(right, left)
    assert narrow.columns == ["x", "y", "_field_2"] and narrow.count() == 5


def test_union_keeps_text_that_is_no_number(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([("x", "3"), ("", " 4 ")], "a string, b string")
    got = union(left, right, coerce=True)
    assert got.dtypes == [("a", "string"), ("b", "double")]
    assert rows(got) == sorted([("1", 2.0), ("x", 3.0), (None, 4.0)], key=repr)
