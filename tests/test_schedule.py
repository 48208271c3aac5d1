import datetime

import pytest
from helpers import values
from pyspark.sql import functions as F

from almanac.operators import schedule as S

T = datetime.datetime
NOW = T(2024, 3, 15, 12)


@pytest.fixture(scope="module")
def tasks(spark):
    data = [
        (1, T(2024, 3, 15, 11), None, 2.0, 86400),
        (2, T(2024, 3, 1), T(2024, 3, 16), 5.0, 604800),
        (3, T(2024, 3, 2), T(2024, 3, 15, 12), 9.0, None),
        (4, T(2024, 3, 16, 11), None, 1.0, 7200),
        (5, T(2024, 3, 22, 12), None, 1.0, 86400),
        (6, T(2024, 4, 1), None, None, 86400),
        (7, None, None, 9.0, None),
        (8, T(2024, 2, 1), None, 5.0, None),
    ]
    return spark.createDataFrame(data, "id int, next timestamp_ntz, ends timestamp_ntz, priority double, delta long")


def test_due(tasks):
    assert sorted(values(S.due_rows(tasks, "next", "ends", NOW))) == [1, 2, 8]
    assert values(S.next_task(tasks, "next", "ends", "priority", NOW, ["id"])) == [2]


def test_horizons(tasks):
    found = {h: sorted(values(S.due_within(tasks, "next", h, NOW))) for h in ("today", "week", "month")}
    assert found["today"] == [1, 2, 3, 4, 7, 8]
    assert found["week"] == [1, 2, 3, 4, 5, 7, 8]
    assert found["month"] == [1, 2, 3, 4, 5, 7, 8]
    with pytest.raises(ValueError):
        S.due_within(tasks, "next", "year", NOW)


def test_classes(tasks):
    got = S.with_recurrence(tasks, "delta", None, "ends", NOW)
    assert [r.recurrence for r in got.orderBy("id").collect()] == ["daily", "weekly", "monthly", "other", "daily", "daily", "monthly", "monthly"]
    assert [r.id for r in got.where("ended").collect()] == []
    late = S.with_recurrence(tasks, "delta", "ends", "ends", T(2024, 3, 15, 13))
    assert [r.id for r in late.where("ended").collect()] == [3]
    assert sorted(r.id for r in late.where("unusual").collect()) == [2, 3]


def step(last, delta, now):
    while last < now:
        last += datetime.timedelta(seconds=delta)
    return last


def test_roll_forward_by_delta(spark):
    data = [(i, T(2024, 3, 15, 12) - datetime.timedelta(seconds=i * 1800 + i % 3), d) for i in range(-3, 60) for d in (5400, 86400)]
    df = spark.createDataFrame(data, "i int, last timestamp_ntz, delta long")
    for r in df.withColumn("n", S.roll_forward(F.col("last"), F.col("delta"), NOW)).collect():
        assert r.n == step(r.last, r.delta, NOW)


def test_roll_forward_by_month(spark):
    data = [(T(2024, 1, 31, 8),), (T(2024, 3, 15, 12),), (T(2024, 3, 15, 11),), (T(2022, 12, 20),), (T(2024, 6, 1),), (None,), (T(2024, 2, 29),)]
    df = spark.createDataFrame(data, "last timestamp_ntz").withColumn("delta", F.lit(None).cast("long"))
    got = values(df.select(S.roll_forward(F.col("last"), F.col("delta"), NOW)))
    assert got == [T(2024, 3, 31, 8), T(2024, 3, 15, 12), T(2024, 4, 15, 11), T(2024, 3, 20), T(2024, 6, 1), None, T(2024, 3, 29)]


def test_flagged(spark):
    data = [
        (T(2024, 4, 1), [T(2024, 3, 1), T(2024, 3, 20), T(2024, 3, 18)]),
        (T(2024, 3, 16), [T(2024, 3, 20)]),
        (T(2024, 3, 16), [T(2024, 3, 1)]),
        (T(2024, 3, 16), None),
    ]
    df = spark.createDataFrame(data, "next timestamp_ntz, flags array<timestamp_ntz>")
    got = df.select(S.earliest_flagged(F.col("next"), F.col("flags"), NOW), S.upcoming_flags(F.col("flags"), NOW)).collect()
    assert [r[0] for r in got] == [T(2024, 3, 18), T(2024, 3, 16), T(2024, 3, 16), T(2024, 3, 16)]
    assert got[0][1] == [T(2024, 3, 18), T(2024, 3, 20)]
