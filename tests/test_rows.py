import datetime

import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from almanac.operators import ordering as O
from almanac.operators import rows as R


@pytest.fixture(scope="module")
def ties(spark):
    data = [("a", "x", 10, 1), ("a", "x", 20, 2), ("a", "x", 20, 3), ("a", "x", None, 4), ("a", None, 5, 5), ("a", None, 5, 6), (None, "x", 7, 7)]
    return spark.createDataFrame(data, "p string, q string, v int, id int")


@pytest.mark.parametrize("spread", [False, True])
def test_rank_ties_and_nulls(ties, spread):
    up = O.rank(ties, ["p", "q"], ["v"], spread=spread)
    assert up.columns[-1] == "rank_many_by_v"
    assert [(r.id, r.rank_many_by_v) for r in up.orderBy("id").collect()] == [(1, 2), (2, 3), (3, 3), (4, 1), (5, 1), (6, 1), (7, 1)]
    down = O.rank(ties, ["p", "q"], ["v", "id"], desc=True, spread=spread)
    assert [r.rank_many_by_v_desc for r in down.orderBy("id").collect()] == [3, 1, 1, 4, 1, 1, 1]


def test_rank_one(ties):
    got = O.rank_one(ties, "q", 2)
    assert got.columns[-1] == "rank_q_by_v"
    assert [r[-1] for r in got.orderBy("id").collect()] == [3, 4, 4, 1, 1, 1, 2]


def test_rank_spread_equals_window_on_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 997).alias("v"),
        "id",
    )
    for desc in (False, True):
        a = O.rank_one(df, "g", "v", desc, spread=False)
        b = O.rank_one(df, "g", "v", desc)
        assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_numbered_both_ways(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), "id")
    a = O.numbered(df, ["g"], ["h"], spread=False)
    b = O.numbered(df, ["g"], ["h"], spread=True)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_whole_table_is_one_group(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"), (F.col("id") % 7).alias("v"), "id")
    numbers = O.numbered(df, [], ["h"]).orderBy("h").collect()
    assert [r.number for r in numbers] == list(range(1, 501))
    for desc in (False, True):
        a, b = O.rank(df, [], ["v"], desc, spread=False), O.rank(df, [], ["v"], desc)
        assert a.exceptAll(b).isEmpty() and b.count() == 500


def test_positions(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id")
    got = O.with_position(df, [F.col("h").desc()], "p").orderBy("p").collect()
    assert [r.p for r in got] == list(range(1000))
    assert [r.h for r in got] == sorted((r.h for r in got), reverse=True)


def test_sort_is_stable_with_tie_break(spark):
    df = spark.createDataFrame([(1, "b"), (None, "c"), (1, "a"), (2, "d"), (None, "a")], "k int, v string")
    assert values(O.sort_by(df, [("k", "asc")], ["v"]), 1) == ["a", "c", "a", "b", "d"]
    assert values(O.sort_by(df, [("k", "desc"), (1, "ASC")]), 1) == ["d", "a", "b", "a", "c"]
    with pytest.raises(ValueError):
        O.sort_by(df, [("k", "up")])


def test_drop_rows_where(spark):
    df = spark.createDataFrame([(5, "hawaii"), (20, "hawaii"), (None, "hawaii"), (5, "ohio"), (None, None)], "n int, s string")
    kept = R.drop_rows_where(df, [(0, "< 13"), ("s", "=='hawaii'")])
    assert rows(kept) == sorted([(20, "hawaii"), (5, "ohio"), (None, None)], key=repr)
    kept = R.drop_rows_where(df, [(0, "< 13"), ("s", "==", "hawaii")], nulls="sql")
    assert kept.count() == 4
    assert R.drop_rows_where(df, [("n", "!=", 5)]).count() == 2
    assert R.drop_rows_where(df, [("n", "== None")]).count() == 3
    assert R.drop_rows_where(df, [("n", "!=", None)]).count() == 2
    assert R.drop_rows_where(df, [("n", ">", None)]).count() == 2
    assert R.drop_rows_where(df, []).count() == 0
    with pytest.raises(ValueError):
        R.drop_rows_where(df, [("n", "; import os")])


def test_positions_dropped_and_popped(spark):
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(6)], "i int, c string")
    assert values(R.drop_rows(df, [0, 2, 2, 5], ["i"]).orderBy("i")) == [1, 3, 4]
    rest, out = R.pop_rows(df, [4, 1], [F.col("i").desc()])
    assert values(rest.orderBy("i")) == [0, 2, 3, 5] and values(out.orderBy("i")) == [1, 4]
    rest, out = R.pop_last(df, ["i"])
    assert values(out) == [5] and rest.count() == 5
    assert rows(R.row_at(df, 3, ["c"])) == [(3, "d")]
    with pytest.raises(IndexError):
        R.row_at(df, -1, ["c"])


def test_positions_by_selection_equal_those_of_a_sort(spark, monkeypatch):
    """Ties, NULLs, a key with most of the rows, both directions; ranges so small that several rounds are needed."""
    import random

    monkeypatch.setattr(O, "SMALL_RANGE", 40)
    monkeypatch.setattr(O, "SPLITTERS", 4)
    rng = random.Random(3)
    data = [(rng.choice([None, 1.5, 7.0, *map(float, range(40))]), rng.choice([None, "a", "b"]), i) for i in range(500)] + [(7.0, "a", -1)] * 400
    df = spark.createDataFrame(data, "v double, s string, i int").repartition(5)

    def ordered(desc):
        by_content = sorted(data, key=repr)
        by_s = sorted(by_content, key=lambda r: r[1] or "")  # NULL is lowest
        if desc:
            return sorted(by_s, key=lambda r: (1, 0) if r[0] is None else (0, -r[0]))
        return sorted(by_s, key=lambda r: (0, 0) if r[0] is None else (1, r[0]))

    for desc in (True, False):
        order = [("v", "desc" if desc else "asc"), "s"]
        model = ordered(desc)
        positions = [0, 57, 300, 650, 899]
        places = O.places_of(df, [*positions, 900, 5000], order)
        assert {p: places[p].key for p in places} == {p: model[p][:2] for p in positions}
        rest, out = R.pop_rows(df, positions, order)
        assert sorted(((r.v, r.s) for r in out.collect()), key=repr) == sorted((model[p][:2] for p in positions), key=repr)
        assert rows(rest.union(out)) == rows(df)
        assert R.drop_rows(df, positions, order).count() == 900 - len(positions)
        last = R.pop_last(df, order)[1].collect()
        assert [tuple(r)[:2] for r in last] == [model[-1][:2]]
    assert R.row_at(df, 900, ["v", "s"]).count() == 0 and R.pop_last(df.limit(0), ["v"])[1].count() == 0
    unique = [("i", "desc"), "v", "s"]
    assert [tuple(r) for r in R.row_at(df.where("i >= 0"), 0, unique).collect()] == [data[499]]


def test_a_position_is_fetched_by_its_key(spark, tmp_path):
    """Nothing is written, and the scan gets the key."""
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id", "repeat('x', 100) AS wide").write.parquet(path)
    df = spark.read.parquet(path)
    got = R.row_at(df, 777, ["id"])
    plan = got._jdf.queryExecution().toString()
    assert values(got) == [777] and "PushedFilters: [EqualNullSafe(id,777)]" in plan and "Exchange" not in plan


def test_append_rows(spark):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    assert rows(R.append_rows(df, [(2, None)])) == [(1, 2.0), (2, None)]
    more = spark.createDataFrame([(3, 4)], "x int, y int")
    assert rows(R.append_rows(df, more)) == [(1, 2.0), (3, 4.0)]
    with pytest.raises(ValueError):
        R.append_rows(df, [(1,)])


def test_equalities(spark):
    df = spark.createDataFrame([(1, "null"), (2, None), (3, "x")], "a int, s string")
    assert values(R.filter_equals(df, [("s", "null")])) == [2]
    assert sorted(values(R.filter_equals(df, [("s", "NOT NULL")]))) == [1, 3]
    assert R.filter_equals(df, [("s", None)]).count() == 0
    assert R.filter_equals(df, []).count() == 3


def test_regex_and_attachments(spark):
    day = [datetime.datetime(2024, 1, d) for d in (1, 3, 3, 2)]
    data = [(1, "a.xls", day[0]), (2, "b.xlsx", day[1]), (3, "a.xls", day[2]), (4, "c.txt", day[3]), (5, "noext", day[3]), (6, None, None)]
    df = spark.createDataFrame(data, "id int, name string, sent timestamp_ntz")
    assert sorted(values(R.filter_any_regex(df, [(r"^b", "name"), ("txt$", "name")]))) == [2, 4]
    with pytest.raises(KeyError):
        R.filter_any_regex(df, [("x", "nope")])
    recent = R.latest_match(df, r"\.xls", "name", "sent", "recent", ["id"])
    assert [(r.id, r.saved_as) for r in recent.collect()] == [(2, "b.xlsx")]
    for spread in (False, True):
        every = R.latest_match(df, r".", "name", "sent", "all", ["id"], spread=spread)
        assert sorted((r.id, r.saved_as) for r in every.collect()) == [(1, "a0.xls"), (2, "b0.xlsx"), (3, "a1.xls"), (4, "c0.txt")]


def test_nan_is_not_above_anything(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, 20.0), (4, None)], "id int, v double")
    for condition, left in (("> 13", [1, 2, 4]), ("< 13", [2, 3]), ("!= 5.0", [1]), ("== 5.0", [2, 3, 4]), (">= 5.0", [2, 4])):
        assert sorted(r.id for r in R.drop_rows_where(df, [("v", condition)]).collect()) == left, condition
