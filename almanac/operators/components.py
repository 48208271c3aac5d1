"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: list[int] | None = None) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` can reach.

    Only nodes with an edge to another node are listed, the smallest of each component included. Nulls and loops are dropped.
    Each round hangs every larger neighbour of a node, then every smaller one, onto the smallest of them. Edges
    per component shrink to a star in about log n rounds whatever its shape, each round is a few jobs over a
    written table, and no node's neighbours are gathered in one task. ``rounds`` gets the number of edges after each round.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct()
    pairs = materialize(pairs, "edges")
    mark = _mark(pairs)
    while True:
        ways = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(below, "hi")
        small = hung.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        small = small.unionByName(hung.select("hi", F.col("m").alias("lo"))).distinct()
        pairs = materialize(small, "edges")
        before, mark = mark, _mark(pairs)
        if rounds is not None:
            rounds.append(mark[0])
        if mark == before:
            break
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _mark(pairs: DataFrame) -> tuple[int, int | None]:
    """Count and digest of a table of edges."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
