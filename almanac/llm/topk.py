"""Exact search for the highest inner products: a KD-tree per shard, which queries then stream past."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import python_tasks
from almanac.session import materialize

SHARD_ROWS = 20_000
BLOCK_QUERIES = 20_000
LEAF_ROWS = 256
SCALE = 1024


class KDTree:
    """Median splits along the widest side of tight boxes; a box of equal points is not split."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.ids, self.rows = points, ids, rows
        self.order = np.arange(len(points))
        self.low, self.high, self.kids, self.span = [], [], [], []
        if len(points):
            todo = [(0, len(points), None, 0)]
            while todo:
                a, b, up, side = todo.pop()
                part = points[self.order[a:b]]
                node = len(self.span)
                self.low.append(part.min(axis=0))
                self.high.append(part.max(axis=0))
                self.kids.append([-1, -1])
                self.span.append((a, b))
                if up is not None:
                    self.kids[up][side] = node
                width = self.high[node].astype(float) - self.low[node]
                axis = int(width.argmax()) if width.size else 0
                if b - a > leaf_rows and width.size and width[axis] > 0:
                    middle = (b - a) // 2
                    self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], middle)]
                    todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
            self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """Best ``k`` (score, id) but for the row ``own``, best first, ties to smaller ids; nothing below ``floor`` is looked for.

        ``floor`` is a score that k candidates are known to reach.
        """
        if not self.span:
            return []
        bounds = np.maximum(self.low * query, self.high * query).sum(axis=1)
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst on top
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -bound < least:
                break
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            a, b = self.span[node]
            rows = self.order[a:b]
            rows = rows[self.rows[rows] != own]
            scores = self.points[rows] @ query
            if least is not None:
                rows, scores = rows[scores >= least], scores[scores >= least]
            if len(rows) > k:
                keep = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[keep], scores[keep]
            for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                entry = (s, -i)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def matrix(column: pa.ListArray) -> np.ndarray:
    """Integer vectors as rows; doubles where every inner product stays exact in them."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(n, len(flat) // n if n else 0)
    most = float(np.abs(rows).max()) if rows.size else 0.0
    return rows.astype(np.float64) if most * most * max(1, rows.shape[1]) < 2**52 else rows


FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"


def _meet(points: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` points of its group for each query of the same group (``keys``).

    Points (``row, id, v``) come before the queries (``row, id, v, floor``) of their group in a sorted partition, so a group's tree is built once
    and its queries stream past it; a task holds the points of one group and one batch of queries.
    """
    floor = F.lit(None).cast("long").alias("floor")
    both = points.select(*keys, F.lit(0).alias("asks"), "row", "id", "v", floor).unionByName(queries.select(*keys, F.lit(1).alias("asks"), "row", "id", "v", "floor"))
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "asks")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, tree = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = list(zip(*(table.column(i).to_pylist() for i in range(width + 1)), strict=True))
            cuts = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]]
            found: list[tuple[int, int, int, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if b == a:
                    continue
                *key, asks = marks[a]
                if key != group:
                    group, parts, tree = key, [], None
                part = table.slice(a, b - a)
                if not asks:
                    parts.append(part)
                    continue
                if tree is None and parts:
                    held = pa.concat_tables(parts).combine_chunks()
                    tree, parts = KDTree(matrix(held["v"].combine_chunks()), held["id"].to_numpy(), held["row"].to_numpy()), []
                if tree is None:
                    continue
                asked = matrix(part["v"].combine_chunks())
                points = tree.points
                if asked.dtype != points.dtype:
                    asked = asked.astype(np.int64)
                    points = tree.points = points.astype(np.int64)
                    tree.low, tree.high = tree.low.astype(np.int64), tree.high.astype(np.int64)
                for query, row, own, least in zip(asked, *(part[c].to_pylist() for c in ("row", "id", "floor")), strict=True):
                    found += [(row, own, i, int(s)) for s, i in tree.search(query, row, k, least)]
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def search(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 100,
    k: int = 10,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest integer inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. Rows that repeat
    an id are rows of their own: each asks, and each can be found. Components become ``floor(1024 * x)``; scores must fit a long. Rows with a
    null id, a null vector, or a null or non-finite component take no part. A vector is compared with those of its own length only. An empty table gives no rows.

    Rows are dealt into shards of bounded size. First all queries meet one of the shards, which is copied for each block of queries and gives each
    of them a kth score to start from. Then they meet the other shards with it, so most boxes are never opened. The rows of
    a shard are shuffled once, and its tree is built once, however many queries there are.
    """
    python_tasks(vectors.sparkSession)
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
        .select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"), F.monotonically_increasing_id().alias("row"))
    )
    rows = materialize(rows.withColumn("width", F.size("v")), "vectors")
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q"))
    n, q = sizes.agg(F.max("n"), F.max("q")).first()
    shards, blocks = -(-(n or 1) // shard_rows), -(-(q or 1) // block_queries)
    points = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    copied = points.where("shard = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = _meet(copied, queries.withColumn("floor", F.lit(None).cast("long")), ["width", "block"], k)
    if shards == 1:
        return best(first)
    first = materialize(first, "nearest")
    floors = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("m"))
    floors = floors.select(F.col("query").alias("row"), F.when(F.col("m") >= k, F.col("least")).alias("floor"))
    later = queries.join(floors, "row", "left").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
    return best(first.unionByName(_meet(points.where("shard > 0"), later, ["width", "shard"], k)))
