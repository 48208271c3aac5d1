"""Row positions, numbering, ranking and sorting.

Spark rows have no order, so every operator names the columns that order them.
Nothing here puts a whole table, or a group of unknown size, into one task:

* positions come from a parallel sort, a counter per task and one count per task;
* single positions are found by selection: only the order's columns are read and nothing is written;
* ranks and numbers are a running count over sorted values, whatever the groups'
  sizes; a plain window is used only where the caller says that groups are small.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

COUNTER_BITS = 33  # monotonically_increasing_id: task number above, row counter below

Keys = Sequence[str | Column | tuple[str, str]]  # a name, an expression, or (name, "asc" | "desc")


def as_columns(keys: Keys) -> list[Column]:
    def one(key: str | Column | tuple[str, str]) -> Column:
        if isinstance(key, tuple):
            return _sort_key(F.col(key[0]), key[1] == "desc")
        return F.col(key) if isinstance(key, str) else key

    return [one(k) for k in keys]


def _task_of(counter: str) -> Column:
    return F.shiftright(counter, COUNTER_BITS)


def _before_task(df: DataFrame, counter: str, rows: Column) -> DataFrame:
    """For each sort task the number of rows in the tasks before it.

    One row per task, so its size is bounded by the number of shuffle partitions;
    that also bounds the window without partitions.
    """
    totals = df.groupBy(_task_of(counter).alias("task")).agg(rows.alias("rows"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("task", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))


def with_position(df: DataFrame, order_by: Keys, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``.

    ``order_by`` should end in a unique key, otherwise tied rows get any order.
    The sorted rows are written once, so that counts and rows come from one and
    the same partitioning.
    """
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]
    ordered = df.orderBy(*as_columns(order_by)).toDF(*inner)
    stored = materialize(ordered.select("*", F.monotonically_increasing_id().alias("n")), "positions")
    before = _before_task(stored, "n", F.count(F.lit(1)))
    placed = stored.withColumn("task", _task_of("n")).join(F.broadcast(before), "task")
    counter = F.col("n").bitwiseAND(F.lit((1 << COUNTER_BITS) - 1))
    return placed.select(
        *[F.col(c).alias(n) for c, n in zip(inner, names)],
        (F.col("before") + counter).alias(name),
    )


def _all_equal(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _with_first(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the smallest ``value`` of each group of ``keys``; no keys: of all rows."""
    if not keys:
        return df.withColumn(name, df.agg(F.min(value)).scalar())
    firsts = [f"first_{k}" for k in keys]
    first = df.groupBy(*[F.col(k).alias(f) for k, f in zip(keys, firsts)]).agg(F.min(value).alias(name))
    return df.join(first, _all_equal(keys, firsts)).drop(*firsts)


def numbered(df: DataFrame, partition_by: Keys, order_by: Keys, name: str = "number", spread: bool = True) -> DataFrame:
    """Number the rows of each group from 1. ``order_by`` should end in a unique key.

    Rows are numbered through one parallel sort, so a group may be the whole table, and
    no partition keys number the table. ``spread=False`` uses a window, which puts each
    group into one task.
    """
    groups = as_columns(partition_by)
    if not spread:
        window = Window.partitionBy(*groups).orderBy(*as_columns(order_by))
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    keys = [f"g{i}" for i in range(len(groups))]
    keyed = df.select("*", *[g.alias(k) for g, k in zip(groups, keys)])
    placed = _with_first(with_position(keyed, [*keys, *order_by], "p"), keys, "p", "p0")
    return placed.select(*df.columns, (F.col("p") - F.col("p0") + 1).alias(name))


def _sort_key(col: Column, desc: bool) -> Column:
    return col.desc_nulls_last() if desc else col.asc_nulls_first()


def _rank_spread(df: DataFrame, groups: list[Column], key: Column, desc: bool, name: str) -> DataFrame:
    """Rank = 1 + number of rows of the group with an earlier key, counted over distinct values.

    Rows with the same value are one row in the running count, however many they are.
    """
    cols = [f"g{i}" for i in range(len(groups))] + ["k"]
    values = df.select(*[c.alias(n) for c, n in zip([*groups, key], cols)]).groupBy(*cols).agg(F.count(F.lit(1)).alias("m"))
    ordered = values.orderBy(*cols[:-1], _sort_key(F.col("k"), desc))
    stored = materialize(ordered.select("*", F.monotonically_increasing_id().alias("n")), "ranks")
    in_task = Window.partitionBy("task").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        stored.withColumn("task", _task_of("n"))
        .withColumn("earlier", F.coalesce(F.sum("m").over(in_task), F.lit(0)))
        .join(F.broadcast(_before_task(stored, "n", F.sum("m"))), "task")
        .withColumn("at", F.col("before") + F.col("earlier"))
    )
    value_names = [f"v{i}" for i in range(len(cols))]
    ranks = _with_first(counted, cols[:-1], "at", "at0").select(
        *[F.col(c).alias(v) for c, v in zip(cols, value_names)],
        (F.col("at") - F.col("at0") + 1).alias(name),
    )
    keyed = df.select("*", *[c.alias(n) for c, n in zip([*groups, key], cols)])
    joined = keyed.join(ranks, _all_equal(cols, value_names))
    return joined.select(*[keyed[c] for c in df.columns], name)


def _rank(df: DataFrame, groups: list[Column], key: Column, desc: bool, name: str, spread: bool) -> DataFrame:
    if spread:
        return _rank_spread(df, groups, key, desc, name)
    window = Window.partitionBy(*groups).orderBy(_sort_key(key, desc))
    return df.withColumn(name, F.rank().over(window).cast("bigint"))


def rank(
    df: DataFrame,
    partition_by: Sequence[str | int],
    order_by: Sequence[str | int],
    desc: bool = False,
    spread: bool = True,
) -> DataFrame:
    """SQL RANK within the groups of ``partition_by``, by the first key of ``order_by``.

    NULL is lowest. The new column is ``rank_many_by_<key>[_desc]``. For ``spread``
    see :func:`numbered`.
    """
    key = _name(df, order_by[0])
    groups = [F.col(_name(df, k)) for k in partition_by]
    name = f"rank_many_by_{key}" + ("_desc" if desc else "")
    return _rank(df, groups, F.col(key), desc, name, spread)


def rank_one(
    df: DataFrame,
    partition_by: str | int,
    order_by: str | int,
    desc: bool = False,
    spread: bool = True,
) -> DataFrame:
    """:func:`rank` with one partition key; the column is ``rank_<partition>_by_<key>[_desc]``."""
    part, key = _name(df, partition_by), _name(df, order_by)
    name = f"rank_{part}_by_{key}" + ("_desc" if desc else "")
    return _rank(df, [F.col(part)], F.col(key), desc, name, spread)


def _name(df: DataFrame, key: str | int) -> str:
    return df.columns[key] if isinstance(key, int) else key


def sort_by(df: DataFrame, keys: Sequence[tuple[str | int, str]], tie_break: Keys = ()) -> DataFrame:
    """Sort by ``(key, 'asc' | 'desc')`` pairs, NULL lowest.

    ``tie_break`` makes the order of equal rows fixed, and lets the sort split a
    value that many rows share.
    """
    orders = []
    for key, order in keys:
        if order.lower() not in ("asc", "desc"):
            raise ValueError(f"order must be 'asc' or 'desc', not {order!r}")
        orders.append(_sort_key(F.col(_name(df, key)), order.lower() == "desc"))
    return df.orderBy(*orders, *as_columns(tie_break))


# --- single positions, without sorting the table

SPLITTERS = 128  # keys that cut a range into smaller ones
SMALL_RANGE = 100_000  # rows of a range that are sorted to find a position in it
SINGLE_POSITIONS = 64  # more positions than this are found by one sort of the whole table


class Place(NamedTuple):
    """Where a position is: its key, and its number among the rows with that key."""

    key: tuple
    offset: int
    ties: int


def directed(keys: Keys) -> list[tuple[str, bool]] | None:
    """(name, descending) of each key; None if one of them is an expression, which cannot be compared with a value."""
    if not keys or any(isinstance(k, Column) for k in keys):
        return None
    return [(k, False) if isinstance(k, str) else (k[0], k[1] == "desc") for k in keys]


def key_is(df: DataFrame, order: list[tuple[str, bool]], key: tuple) -> Column:
    """Rows with that key; the scan can skip the others."""
    tests = []
    for (name, _), value in zip(order, key):
        column = F.col(name)
        tests.append(column.isNull() if value is None else column.eqNullSafe(F.lit(value).cast(df.schema[name].dataType)))
    return reduce(Column.__and__, tests)


def _after(df: DataFrame, order: list[tuple[str, bool]], key: tuple) -> Column:
    """Rows that come after a key in the order; NULL is lowest."""
    (name, desc), value = order[0], key[0]
    column, kind = F.col(name), df.schema[name].dataType
    if value is None:
        later, same = F.lit(False) if desc else column.isNotNull(), column.isNull()
    else:
        bound = F.lit(value).cast(kind)
        later = (column < bound) | column.isNull() if desc else column > bound
        later, same = F.coalesce(later, F.lit(False)), F.coalesce(column == bound, F.lit(False))
    return later | (same & _after(df, order[1:], key[1:])) if len(order) > 1 else later


def _range_of(df: DataFrame, order: list[tuple[str, bool]], splitters: list[tuple]) -> Column:
    """2 i for the rows between two splitters, 2 i + 1 for those with the key of splitter i; a binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        here = F.when(_after(df, order, splitters[middle]), search(middle + 1, high))
        return here.when(key_is(df, order, splitters[middle]), F.lit(2 * middle + 1)).otherwise(search(low, middle))

    return search(0, len(splitters))


def _splitters(rows: DataFrame, order: list[tuple[str, bool]], count: int) -> list[tuple]:
    """A bounded number of keys from everywhere in ``rows``, in order."""
    names = [n for n, _ in order]
    parts, want = 1 << 30, 16 * SPLITTERS
    share = F.pmod(F.xxhash64(*names), F.lit(parts)) < max(1, int(parts * want / count))
    keys = [tuple(r) for r in rows.where(share).distinct().limit(4 * want).orderBy(*as_columns(_keys(order))).collect()]
    if not keys:  # few keys, each with many rows
        keys = [tuple(r) for r in rows.limit(1).collect()]
    step = max(1, len(keys) // SPLITTERS)
    return keys[step // 2 :: step]


def _keys(order: list[tuple[str, bool]]) -> Keys:
    return [(name, "desc" if desc else "asc") for name, desc in order]


def places_of(df: DataFrame, positions: Iterable[int], order_by: Keys) -> dict[int, Place]:
    """The key at each of a few positions of an order, found by selection: positions past the end have none.

    Only the order's columns are read. Sampled keys cut the rows into ranges, one pass counts the rows of each range, and only
    ranges that hold a position are looked into; one of at most ``SMALL_RANGE`` rows is sorted. Rows of one key are counted
    and never sorted, however many they are. Nothing is written.
    """
    order = directed(order_by)
    rows = df.select(*[n for n, _ in order])
    found: dict[int, Place] = {}
    todo = [(F.lit(True), 0, rows.count(), sorted(set(positions)))]
    while todo:
        inside, before, count, wanted = todo.pop()
        wanted = [p for p in wanted if p < before + count]
        if not wanted:
            continue
        part = rows.where(inside)
        if count <= SMALL_RANGE:
            # at most SMALL_RANGE rows: the window without partitions is bounded
            keys = part.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("ties#"))
            upto = F.sum("ties#").over(Window.orderBy(*as_columns(_keys(order))).rowsBetween(Window.unboundedPreceding, 0))
            spans = keys.withColumn("end#", upto)
            offsets = [p - before for p in wanted]
            hit = reduce(Column.__or__, [(F.col("end#") > o) & (F.col("end#") - F.col("ties#") <= o) for o in offsets])
            for r in spans.where(hit).collect():
                start = before + r["end#"] - r["ties#"]
                for p in wanted:
                    if start <= p < before + r["end#"]:
                        found[p] = Place(tuple(r[: len(order)]), p - start, r["ties#"])
            continue
        splitters = _splitters(part, order, count)
        range_ = _range_of(rows, order, splitters)
        sizes = {r["r"]: r["n"] for r in part.groupBy(range_.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for r in range(2 * len(splitters) + 1):
            n = sizes.get(r, 0)
            here = [p for p in wanted if before <= p < before + n]
            if here and r % 2:
                found.update({p: Place(splitters[r // 2], p - before, n) for p in here})
            elif here:
                low = _after(rows, order, splitters[r // 2 - 1]) if r else F.lit(True)
                high = ~_after(rows, order, splitters[r // 2]) & ~key_is(rows, order, splitters[r // 2]) if r // 2 < len(splitters) else F.lit(True)
                todo.append((inside & low & high, before, n, here))
            before += n
    return found


def last_place(df: DataFrame, order_by: Keys) -> Place | None:
    """The key of the last row of an order: one pass, no sort."""
    order = directed(order_by)
    back = [F.col(n).asc_nulls_first() if desc else F.col(n).desc_nulls_last() for n, desc in order]
    key = df.select(*[n for n, _ in order]).orderBy(*back).limit(1).collect()
    if not key:
        return None
    ties = df.where(key_is(df, order, tuple(key[0]))).count()
    return Place(tuple(key[0]), ties - 1, ties)


def split_at(df: DataFrame, places: Iterable[Place], order_by: Keys) -> tuple[DataFrame, DataFrame]:
    """(other rows, the rows at ``places``). Of rows with the same key, the numbers go by their content."""
    order, places = directed(order_by), list(places)
    if not places:
        return df, df.where(F.lit(False))
    among = reduce(Column.__or__, [key_is(df, order, key) for key in {p.key for p in places}])
    if all(p.ties == 1 for p in places):
        return df.where(~among), df.where(among)
    number = "number#"
    tied = numbered(df.where(among), [n for n, _ in order], [F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))], number)
    wanted = reduce(Column.__or__, [key_is(df, order, p.key) & (F.col(number) == p.offset + 1) for p in places])
    return df.where(~among).union(tied.where(~wanted).drop(number)), tied.where(wanted).drop(number)
