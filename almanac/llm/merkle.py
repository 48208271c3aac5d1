"""A Merkle manifest of a table, with a proof for every row, made by octopus multiproofs.

Rows are the leaves of a tree per group, and the roots of these are the leaves of one more tree. Every eight nodes in a row
have a parent. A leaf partition is the leaves below one node of level ``PART_LEVELS``. It works out which nodes all of its proofs need that it cannot derive from
its own leaves, fetches each of them once, derives the nodes that its leaves share, and writes out the proof of each leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import id_type, python_tasks
from almanac.operators.ordering import with_position
from almanac.session import materialize

ARITY = 8
PART_LEVELS = 4
#: A node is copied for every so many leaf partitions that may ask for it, so that no node is a hot key.
ASKERS = 512

Coordinate = tuple[int, int]  # level, place in it


def parent_hash(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def depth(leaves: int) -> int:
    """Levels above the leaves; a lone leaf is its own root."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def level_size(leaves: int, level: int) -> int:
    return -(-leaves // ARITY**level)


def missing_nodes(places: Sequence[int], leaves: int) -> list[Coordinate]:
    """The fewest nodes from which, with the leaves at ``places``, the proofs of all of these follow: an octopus.

    At each level the known nodes are those with a leaf of ours below; of the other members of their runs each is missing once.
    """
    wanted: list[Coordinate] = []
    known = np.unique(np.asarray(places, np.int64))
    for level in range(depth(leaves)):
        runs = np.unique(known // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        members = members[members < level_size(leaves, level)]
        wanted += [(level, int(i)) for i in np.setdiff1d(members, known)]
        known = runs
    return wanted


class PartTree:
    """The nodes above a leaf partition, from its leaves and the nodes it has fetched."""

    def __init__(self, first: int, hashes: list[str], leaves: int, levels: int, fetched: dict[Coordinate, str]):
        self.leaves, self.fetched = leaves, fetched
        self.levels, self.starts = [hashes], [first]
        for level in range(min(depth(leaves), levels)):
            known = dict(enumerate(self.levels[-1], self.starts[-1]))
            size = level_size(leaves, level)
            parents = []
            for run in range(min(known) // ARITY, max(known) // ARITY + 1):
                members = range(run * ARITY, min(size, run * ARITY + ARITY))
                parents.append(parent_hash(known[i] if i in known else fetched[level, i] for i in members))
            self.levels.append(parents)
            self.starts.append(self.starts[-1] // ARITY)

    def run(self, level: int, place: int) -> list[str]:
        """The hashes of the run that a node is in."""
        start = place // ARITY * ARITY
        members = range(start, min(level_size(self.leaves, level), start + ARITY))
        own, low = self.levels[level], self.starts[level]
        return [own[i - low] if 0 <= i - low < len(own) else self.fetched[level, i] for i in members]


def _value(column: str | Column) -> Column:
    """A value as the manifest has it: its length in bytes, a colon and the value; a minus for null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[str | Column]) -> Column:
    return F.sha2(F.concat(*map(_value, columns)), 256)


def _part(part_levels: int) -> Column:
    return F.expr(f"at div {ARITY**part_levels}").alias("part")


def _asked(leaves: DataFrame, part_levels: int) -> DataFrame:
    """Of each leaf partition of ``leaves`` (``tree, n, at, hash``): the nodes it asks for (``hash`` null), and the node above it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, part = (k.as_py() for k in key)
        table = table.sort_by("at")
        places, n = table["at"].to_pylist(), table["n"][0].as_py()
        own = PartTree(places[0], table["hash"].to_pylist(), n, part_levels, {})
        rows = [(level, i, None) for level, i in missing_nodes(places, n)]
        rows.append((len(own.levels) - 1, own.starts[-1], own.levels[-1][0]))
        level, at, node = zip(*rows, strict=True)
        columns = [pa.array([v] * len(rows), pa.int64()) for v in (tree, n, part)]
        return pa.table([*columns, pa.array(level, pa.int64()), pa.array(at, pa.int64()), pa.array(node, pa.string())], names=["tree", "n", "part", "level", "at", "hash"])

    placed = leaves.select("tree", "n", "at", "hash", _part(part_levels))
    return placed.groupBy("tree", "part").applyInArrow(run, "tree long, n long, part long, level long, at long, hash string")


def _fetched(leaves: DataFrame, part_levels: int, askers: int) -> tuple[DataFrame, DataFrame]:
    """(the nodes that each leaf partition has fetched, the root of each tree)."""
    asked = materialize(_asked(leaves, part_levels), "asked")
    now = asked.where("hash IS NOT NULL").select("tree", "n", "level", "at", "hash")
    nodes = [now]
    most = asked.agg(F.max("n")).first()[0] or 0
    for level in range(part_levels, depth(most)):
        several = now.where((F.col("level") == level) & (F.col("n") > ARITY**level))
        children = F.array_sort(F.collect_list(F.struct("at", "hash")))
        up = several.groupBy("tree", "n", F.expr(f"at div {ARITY}").alias("up")).agg(children.alias("c"))
        joined = F.array_join(F.transform("c", lambda x: x["hash"]), "")
        now = materialize(up.select("tree", "n", F.lit(level + 1).cast("long").alias("level"), F.col("up").alias("at"), F.sha2(joined, 256).alias("hash")), "level")
        nodes.append(now)
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    top = F.col("n") <= F.pow(F.lit(ARITY), F.col("level"))  # the level with one node
    roots = every.where(top).select("tree", "hash")
    # The partitions that ask for a node are those below its parent.
    below = F.pow(F.lit(ARITY), F.col("level") + 1 - part_levels).cast("long")
    first = F.call_function("div", F.col("at"), F.lit(ARITY)) * below
    last = F.least(first + below - 1, F.call_function("div", F.col("n") - 1, F.lit(ARITY**part_levels)))
    group = F.sequence(F.call_function("div", first, F.lit(askers)), F.call_function("div", last, F.lit(askers)))
    offered = every.where(~top & (F.col("level") >= part_levels)).select("tree", "level", "at", "hash", F.explode(group).alias("askers"))
    wanted = asked.where("hash IS NULL").select("tree", "part", "level", "at", F.expr(f"part div {askers}").alias("askers"))
    return wanted.join(offered, ["tree", "level", "at", "askers"]).select("tree", "part", "level", "at", "hash"), roots


_FETCHED = "tree long, part long, level long, at long, hash string"


def _placed(rows: DataFrame, tree: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the number of their tree, its number of leaves ``n`` and their place ``at``; the trees). Nulls come first."""
    ordered = materialize(with_position(rows, [tree, *order], "place"), "placed")
    spans = ordered.groupBy(tree).agg(F.min("place").alias("start"), F.count("*").alias("n"))
    trees = materialize(with_position(spans, [tree], "tree"), "trees").withColumnRenamed(tree, "of")
    joined = ordered.join(trees, F.col(tree).eqNullSafe(F.col("of")))
    return joined.withColumn("at", F.col("place") - F.col("start")).drop("of", "place", "start"), trees


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    order: str = "doc_id",
    presented: dict[str, Column] | None = None,
    part_levels: int = PART_LEVELS,
    askers: int = ASKERS,
) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded_root, verified`` for every row.

    A leaf is the hash of the ``columns`` of a row. Leaves with the same value of ``tree`` form a tree, by ``order``, and their roots form the
    tree above, by value; nulls come first. ``proof`` has the hashes of the other members of each run on the way to ``root``, from left to right and
    bottom to top. ``presented`` gives columns as they are when they are checked: ``folded_root`` is what such a
    row and the proof lead to, and ``verified`` whether that is the root. By default rows are checked as they are.

    Leaves with the same id go by their hash; equal rows are leaves of their own and take any of their places. Null ids come first.
    An empty table gives no rows; other columns are not looked at. The numbers of groups, and rows in one, are not bounded: no tree is in one task. The driver
    sees the largest number of leaves of a tree, and the root.
    """
    spark = python_tasks(docs.sparkSession)
    shown = [(presented or {}).get(c, c) for c in columns]
    rows = docs.select(F.col(tree).cast("string").alias("name"), F.col(order).alias("id"), leaf_hash(columns).alias("leaf"), leaf_hash(shown).alias("shown"))
    # Written before the sort, which reads its input twice; the number keeps equal rows apart.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves, trees = _placed(rows, "name", ["id", "leaf", "row"])
    leaves = leaves.select("tree", "n", "at", "id", "leaf", "shown")
    below, roots = _fetched(leaves.withColumnRenamed("leaf", "hash"), part_levels, askers)
    roots = materialize(roots, "subroots")
    count = trees.count()
    kinds = f"id {id_type(docs, order)}, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    if not count:
        return spark.createDataFrame([], kinds)
    # The tree of subroots: what each of them has fetched, as nodes above its own tree.
    tops = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("at"), "hash")
    above, top = _fetched(tops, part_levels, askers)
    root = top.first()["hash"]

    def expand(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        places = left["at"].to_pylist()
        fetched = {(a, b): h for a, b, h in zip(*(right[c].to_pylist() for c in ("level", "at", "hash")), strict=True)}
        own = PartTree(places[0], left["hash"].to_pylist(), count, depth(count), fetched)
        rows = []
        for i in places:
            for level in range(depth(count)):
                place = i // ARITY**level
                start = place // ARITY * ARITY
                rows += [(i, level, start + k, h) for k, h in enumerate(own.run(level, place)) if start + k != place]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["tree", "level", "at", "hash"])

    tops_by_part = tops.withColumn("part", _part(part_levels)).groupBy("tree", "part")
    paths = tops_by_part.cogroup(above.groupBy("tree", "part")).applyInArrow(expand, "tree long, level long, at long, hash string")
    paths = materialize(paths, "paths")
    # Every leaf partition takes the path above its subroot once.
    size = ARITY**part_levels
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {size} div {askers}"))).alias("askers")
    offered = paths.join(trees.select("tree", "n", chunk), "tree")
    parts = F.expr(f"explode(sequence(askers * {askers}, least(askers * {askers} + {askers - 1}, (n - 1) div {size})))").alias("part")
    offered = offered.select("tree", parts, (-1 - F.col("level")).alias("level"), "at", "hash")
    given = below.unionByName(offered)
    given = given.select(*(F.col(c).cast(t) for c, t in (x.split() for x in _FETCHED.split(", "))))

    def prove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        tree_number = key[0].as_py()
        left = left.sort_by("at")
        n, places = left["n"][0].as_py(), np.array(left["at"].to_pylist())
        found = list(zip(*(right[c].to_pylist() for c in ("level", "at", "hash")), strict=True))
        own = PartTree(int(places[0]), left["leaf"].to_pylist(), n, depth(n), {(a, b): h for a, b, h in found if a >= 0})
        upper = {(-1 - a, b): h for a, b, h in found if a < 0}
        subroot = own.levels[-1][0]
        # Above the partition all its proofs go on alike: (members before, members behind) of each run.
        low = min(depth(n), part_levels)
        shared: list[tuple[list[str], list[str]]] = []
        for level in range(low, depth(n)):
            place = int(places[0]) // ARITY**level
            run, k = own.run(level, place), place % ARITY
            shared.append((run[:k], run[k + 1 :]))
        for level in range(depth(count)):
            place = tree_number // ARITY**level
            start = place // ARITY * ARITY
            members = range(start, min(level_size(count, level), start + ARITY))
            shared.append(([upper[level, i] for i in members if i < place], [upper[level, i] for i in members if i > place]))
        ends = [("".join(a), "".join(b)) for a, b in shared]
        proofs, folded = [], []
        tail = [h for a, b in shared for h in (*a, *b)]
        for place, shown in zip(places.tolist(), left["shown"].to_pylist(), strict=True):
            proof, node = [], shown
            for level in range(low):
                run, k = own.run(level, place), place % ARITY
                proof += run[:k] + run[k + 1 :]
                run[k] = node
                node = parent_hash(run)
                place //= ARITY
            for before, behind in ends:
                node = hashlib.sha256(f"{before}{node}{behind}".encode()).hexdigest()
            proofs.append(proof + tail)
            folded.append(node)
        m = len(left)
        return pa.table(
            [left["id"], left["leaf"], pa.array([subroot] * m), pa.array([root] * m), pa.array(proofs, pa.list_(pa.string())), pa.array(folded), pa.array([f == root for f in folded])],
            names=["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"],
        )

    by_part = leaves.withColumn("part", _part(part_levels)).groupBy("tree", "part")
    return by_part.cogroup(given.groupBy("tree", "part")).applyInArrow(prove, kinds)
