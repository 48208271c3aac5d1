"""Exact dedup by radix partitioning from the first byte on: equality is decided by the bytes themselves."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import id_type, python_tasks
from almanac.session import materialize

#: Bytes of the first digit; each later one has four times as many, up to the largest.
FIRST_DIGIT = 64
LARGEST_DIGIT = 1 << 20
#: Bytes of a node's texts up to which one task splits it alone.
TASK_BYTES = 32 << 20


def next_digit(at: int, width: int) -> tuple[int, int]:
    """Where the digit after ``at, width`` starts and how wide it is."""
    return at + width, min(4 * width, LARGEST_DIGIT)


def first_equal(texts: Sequence[bytes]) -> list[int]:
    """For each text the place of the first one equal to it.

    Texts are dealt into buckets by length, then buckets are split by successive digits until they hold one text or its end is reached.
    """
    first = list(range(len(texts)))
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, text in enumerate(texts):
        by_length[len(text)].append(i)
    todo = [(0, FIRST_DIGIT, bucket) for bucket in by_length.values() if len(bucket) > 1]
    while todo:
        at, width, bucket = todo.pop()
        if len(texts[bucket[0]]) <= at:
            for i in bucket:
                first[i] = bucket[0]
            continue
        parts: dict[bytes, list[int]] = defaultdict(list)
        for i in bucket:
            parts[texts[i][at : at + width]].append(i)
        todo += [(*next_digit(at, width), part) for part in parts.values() if len(part) > 1]
    return first


def numbered_rows(docs: DataFrame, text_column: str, carry: Sequence[str]) -> DataFrame:
    """``rid`` (a number for each row), ``rep`` (that of an equal text read with it), ``copies`` (how many of those), ``size`` in bytes, ``body``, ``row``.

    ``row`` holds the columns ``carry``; where the text is among them, it stands for ``body``. The numbers hold for what one run
    of these tasks writes, so the rows are written.
    """
    python_tasks(docs.sparkSession)
    body = F.coalesce(text_column, F.lit("")).cast("binary")
    rows = docs.select(F.struct(*carry).alias("row"), *([] if text_column in carry else [body.alias("body")]))
    column = list(carry).index(text_column) if text_column in carry else None
    names = ["rid", "rep", "copies", "size", *rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            bodies = batch.column(1) if column is None else batch.column(0).field(column).cast(pa.binary())
            texts = [t or b"" for t in bodies.to_pylist()]
            first = first_equal(texts)
            copies = [0] * len(texts)
            for i in first:
                copies[i] += 1
            columns = [[base + i for i in range(len(texts))], [base + i for i in first], [copies[i] for i in first], [len(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *batch.columns], names=names)
            base += len(texts)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    done = materialize(rows.mapInArrow(run, f"rid long, rep long, copies long, size long, {kinds}"), "numbered")
    return done if column is None else done.withColumn("body", F.coalesce(F.col("row").getField(text_column), F.lit("")).cast("binary"))


def _digit(body: Column, at: int, width: int) -> Column:
    return F.substring(body, at + 1, width).alias("digit")


def _next_nodes(now: DataFrame) -> DataFrame:
    """``rid, size, node, n`` of the rows of ``now`` (``rid, size, node, digit``) whose next node holds ``n > 1`` of them.

    Digits are counted per node, which combines before the shuffle.
    """
    keys = ["size", "node", "digit"]
    nodes = now.groupBy(*keys).agg(F.min("rid").alias("next"), F.count("*").alias("n")).where("n > 1")
    # Nodes grow with the data and carry digits, so they are never sent to all tasks: one plan at every size.
    return materialize(now.join(nodes.hint("merge"), keys).select("rid", "size", F.col("next").alias("node"), "n"), "nodes")


def _split_in_tasks(rows: DataFrame, task_bytes: int) -> DataFrame:
    """``rid, size, node, rep, copies, body``: rows (``rid, size, node, n, body``) compared with those of their node that share a task.

    A node goes to one task as long as its texts have at most ``task_bytes``, or else to several. ``rep`` is an equal row of the task and
    ``copies`` how many the task has. Where a task did not see all ``n`` rows of a node, ``body`` stays on one row of each text; elsewhere it is null
    and the node is done. This is decided by counting what came, not by how it was dealt.
    """
    python_tasks(rows.sparkSession)
    parts = F.ceil(F.col("n") / F.greatest(F.lit(2.0), F.lit(float(task_bytes)) / F.col("size")))
    keys = ["size", "node", "part"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rid"), parts)).repartition(*keys).sortWithinPartitions(*keys)

    def split(key: tuple[int, int, int], n: int, rids: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        first = first_equal(bodies)
        copies = [0] * len(rids)
        for i in first:
            copies[i] += 1
        todo = [None if len(rids) == n or i != at else bodies[i] for at, i in enumerate(first)]
        numbers = [rids, [key[0]] * len(rids), [key[1]] * len(rids), [rids[i] for i in first], [copies[i] for i in first]]
        columns = [*(pa.array(c, pa.int64()) for c in numbers), pa.array(todo, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["rid", "size", "node", "rep", "copies", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, rids, bodies, done = None, 0, [], [], []
        for batch in batches:
            size, node, part, rid, n = (batch.column(i).to_pylist() for i in range(5))
            for i, body in enumerate(batch.column(5)):
                if (size[i], node[i], part[i]) != key:
                    if rids:
                        done.append(split(key, total, rids, bodies))
                    key, total, rids, bodies = (size[i], node[i], part[i]), n[i], [], []
                rids.append(rid[i])
                bodies.append(body.as_py())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if rids:
            yield split(key, total, rids, bodies)

    kinds = "rid long, size long, node long, rep long, copies long, body binary"
    return materialize(dealt.select(*keys, "rid", "n", "body").mapInArrow(run, kinds), "split")


def _equal_over_tasks(texts: DataFrame) -> DataFrame:
    """``rid, node`` of the rows of ``texts`` (``rid, size, node, body``, alike up to the first digit) that equal another one, by rounds over all tasks.

    Each round splits all open nodes by the next digit. Nodes of one text are closed, those at the end of their texts are the groups.
    """
    at, width = next_digit(0, FIRST_DIGIT)
    now = texts.select("rid", "size", "node", _digit(F.col("body"), at, width))
    groups: list[DataFrame] = []
    while True:
        placed = _next_nodes(now)
        at, width = next_digit(at, width)
        groups.append(placed.where(F.col("size") <= at).select("rid", "node"))
        open_rows = placed.where(F.col("size") > at).select("rid", "size", "node")
        if open_rows.isEmpty():
            return reduce(DataFrame.union, groups)
        now = open_rows.join(texts.select("rid", _digit(F.col("body"), at, width)), "rid")


def equal_texts(texts: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rid, node``: rows of ``texts`` (``rid, size, body``) that equal another one; equal rows have the same ``node``.

    A node is a bucket of texts with the same length and the same bytes so far, named by one of its ``rid``. All texts are split by length and first
    digit. Texts are shuffled once by ``rid`` to find those of nodes that hold several and go on, and these once more by node: a node of at most ``task_bytes`` is split to its end in
    one task. A larger one is dealt to several tasks, and one row of each text per task goes on to rounds over all tasks.
    """
    placed = _next_nodes(texts.select("rid", "size", F.lit(0).cast("long").alias("node"), _digit(F.col("body"), 0, FIRST_DIGIT)))
    ended = placed.where(F.col("size") <= FIRST_DIGIT).select("rid", "node")
    # Open rows grow with the data too, so here as well the plan is the one that large tables need: texts are shuffled once by their number.
    open_rows = placed.where(F.col("size") > FIRST_DIGIT).hint("merge")
    split = _split_in_tasks(texts.select("rid", "body").join(open_rows, "rid"), task_bytes)
    wide = split.where("body IS NOT NULL").select("rid", "size", "node", "body")
    if wide.isEmpty():
        return ended.union(split.where("copies > 1").select("rid", "rep"))
    met = _equal_over_tasks(wide).select(F.col("rid").alias("rep"), F.col("node").alias("group"))
    joined = split.select("rid", "rep", "copies").join(met, "rep", "left").where("copies > 1 OR group IS NOT NULL")
    return ended.union(joined.select("rid", F.coalesce("group", "rep")))


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``row`` (the id and the columns ``carry`` of the row, by default all of ``docs``), ``keep_id``, ``group_size``, ``kept`` for every row.

    Rows with the same text, byte for byte, are a group; null counts as an empty text. The row with the largest id stays, null ids
    being lowest; of several such rows one. ``keep_id`` is its id and ``group_size`` the number of rows. Rows, their order of columns
    and other columns are kept as they are; an empty table gives no rows.

    Texts that are read together are compared first, so of a very common text one row per batch takes part in the rounds over all
    data. Buckets of at most ``task_bytes`` are split by one task, larger ones by rounds over all. Groups are then summed before they are shuffled. What is marked moves at the end with the columns that are carried: leave
    the text out where it is not needed.
    """
    names = docs.columns if carry is None else list(dict.fromkeys([id_column, *carry]))
    rows = numbered_rows(docs, text_column, names)
    found = equal_texts(rows.where("rid = rep").select("rid", "size", "body"), task_bytes)
    linked = found.select(F.col("rid").alias("rep"), "node")
    ids = rows.select("rid", "rep", "copies", F.col("row").getField(id_column).alias("id"))
    members = ids.join(linked, "rep", "left").where("copies > 1 OR node IS NOT NULL")
    members = materialize(members.select("rid", "rep", "id", F.coalesce("node", "rep").alias("group")), "members")
    tops = members.groupBy("group").agg(F.max(F.struct("id", "rid")).alias("top"), F.count("*").alias("group_size"))
    marks = members.where("rid = rep").select("rep", "group").join(tops, "group").select("rep", "top", "group_size")
    joined = rows.select("rid", "rep", "row").join(materialize(marks, "marks"), "rep", "left")
    alone = F.col("top").isNull()
    keep = F.when(alone, F.col("row").getField(id_column)).otherwise(F.col("top.id")).cast(id_type(docs, id_column))
    return joined.select(
        "row", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("top.rid") == F.col("rid"))).alias("kept")
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, one of each text."""
    kept = mark_copies(docs, id_column, text_column).where("kept")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
