"""Mixing sources to target weights by blocks of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import python_tasks, words
from almanac.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK_WORDS = 512
SHARD_BLOCKS = 4096
WEIGHTS = (3, 1, 2)
BUCKET_DOCS = 10_000


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Split ``share`` of all sizes by weight; none above ``most`` times its size, the excess shared again."""
    left, goal, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                goal[i] = left * weights[i] / total
            break
        for i in over:
            goal[i] = float(most * sizes[i])
        left -= sum(goal[i] for i in over)
        free -= set(over)
    return goal


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network, walked until inside.

    ``index``, ``size`` and ``key`` are arrays of the same length.
    """
    half = np.array([max(1, (int(s - 1).bit_length() + 1) // 2) for s in np.unique(size)], dtype=np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = out[todo] >> h, out[todo] & m
            for turn in range(4):
                z = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(29)
                left, right = right, left ^ (z & m)
            out[todo] = (left << h) | right
            todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the pieces of the mix.

    Documents: ``key, doc_id, source, size, source_size, target``, one row per row of ``docs``. ``key`` tells rows apart
    (id, text digest and a number among equal rows). Pieces: ``key, shard, slot, lo, hi``, the words [lo, hi) of a
    document that a slot of an output shard takes.
    """
    spark = python_tasks(docs.sparkSession)
    rows = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("digest"))
    rows = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    rows = materialize(rows, "sizes")
    by_source = sorted(
        ((r.source, r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()),
        key=lambda x: (x[0] is None, x[0] or ""),
    )
    goal = targets([n for _, n in by_source], [weights[i % len(weights)] for i in range(len(by_source))], share, most)
    table = [(s, i, n, g) for i, ((s, n), g) in enumerate(zip(by_source, goal, strict=True))]
    known = spark.createDataFrame(table, "source string, s int, source_size long, target double")
    rows = rows.join(known.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")

    # Each source's words in a row: documents in the order of a hash, sums first over buckets and then within them.
    spot = F.xxhash64("doc_id", "digest", "copy", F.lit(seed))
    buckets = max(1, rows.count() // BUCKET_DOCS)
    rows = rows.withColumn("spot", spot).withColumn("bucket", F.pmod(F.col("spot"), F.lit(buckets)))
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("s", "bucket").orderBy("spot", "doc_id", "digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    laid = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["s", "bucket"])
    laid = laid.withColumn("at", F.col("base") + F.col("within"))
    key = F.struct("doc_id", "digest", "copy").alias("key")
    laid = materialize(laid.select(key, "doc_id", "source", "s", "size", "source_size", "target", "at"), "laid")

    # Blocks of a source and the documents in them.
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    parts = laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.select("key", "s", "block", "at", "size")

    slots = _slots(spark, table, block_words, shard_blocks, seed)
    start = F.col("block") * block_words
    lo, hi = F.greatest(F.col("at"), start), F.least(F.col("at") + F.col("size"), start + F.col("room"))
    pieces = parts.join(slots, ["s", "block"]).where(hi > lo).select("key", "shard", "slot", (lo - F.col("at")).alias("lo"), (hi - F.col("at")).alias("hi"))
    return laid, pieces


def _slots(spark, table: list[tuple], block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """``shard, slot, s, block, room``: which block of which source each slot takes, and how many of its words.

    Every output shard draws how many of its slots each source gets. A source's slots are numbered over all
    shards and go through its blocks pass by pass in a permuted order, the short last block at the end of each
    pass. Draws beyond a source's quota are left out, and what the draws leave short fills shards of its own.
    """
    n = len(table)
    size = np.array([t[2] for t in table], dtype=np.int64)
    want = np.floor(np.array([t[3] for t in table]) + 1e-6).astype(np.int64)
    full = size // block_words
    per_pass = full + (size % block_words > 0)
    passes = np.where(size > 0, want // np.maximum(size, 1), 0)
    rest = want - passes * size
    quota = passes * per_pass + -(-rest // block_words)
    total = int(quota.sum())
    shards = -(-total // shard_blocks)
    odds = quota / max(1, total)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng([seed, shard]).multinomial(shard_blocks, odds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(counts, pa.int64())], names=["shard", "s", "n"]
                )

    drawn = spark.range(shards).mapInArrow(draw, "shard long, s int, n long")
    # The number of a source's first slot in each shard: sums over groups of shards, then within a group.
    drawn = drawn.withColumn("g", F.floor(F.col("shard") / 1024))
    before = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("s", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = drawn.groupBy("s", "g").agg(F.sum("n").alias("m")).select("s", "g", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    numbered = drawn.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(bases, ["s", "g"])
    main = numbered.select("shard", "s", (F.col("base") + F.col("ahead")).alias("a"), (F.col("base") + F.col("ahead") + F.col("n")).alias("b"))
    quotas = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota)], "s int, quota long")
    missing = (
        quotas.join(drawn.groupBy("s").agg(F.sum("n").alias("m")), "s", "left")
        .withColumn("m", F.coalesce("m", F.lit(0)))
        .where("m < quota")
        .withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("m") - 1) / shard_blocks))))
        .select(
            (F.lit(shards) + F.col("c")).alias("shard"),
            "s",
            (F.col("m") + F.col("c") * shard_blocks).alias("a"),
            F.least(F.col("m") + (F.col("c") + 1) * shard_blocks, "quota").alias("b"),
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, s, a, b = (batch.column(i).to_numpy() for i in range(4))
            b = np.maximum(a, np.minimum(b, quota[s]))
            count = b - a
            own = np.repeat(np.arange(len(a)), count)
            src = s[own]
            turn = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            number = a[own] + turn
            spin, index = number // per_pass[src], number % per_pass[src]
            inner = index < full[src]
            block = index.copy()
            if inner.any():
                block[inner] = permuted(index[inner], full[src[inner]], src[inner] * 1_000_003 + spin[inner] + seed)
            room = np.where(spin < passes[src], block_words, np.minimum(block_words, rest[src] - index * block_words))
            columns = (shard[own], turn, src.astype("int32"), block, room)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "slot", "s", "block", "room"])

    return main.unionByName(missing).mapInArrow(place, "shard long, slot long, s int, block long, room long")


def mix(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``.

    Sizes are words; a null text has none. Sources are ordered by code point, null last, and weigh ``weights`` in turn;
    targets are shares of ``share`` times all words, at most ``most`` times a source's own. A source's taken words are its
    target without the fraction, and no document is taken more than ``most`` times its size, rounded up to whole passes.
    Equal rows are told apart by a number. Reruns agree. Null ids are kept; an empty table gives no rows; other columns are not
    looked at. One row per source goes through the driver.
    """
    laid, pieces = plan(docs, **how)
    taken = pieces.groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return _joined(laid, taken).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.key.digest").eqNullSafe(F.col(f"{b}.key.digest")) & F.col(f"{a}.key.doc_id").eqNullSafe(F.col(f"{b}.key.doc_id")) & (
        F.col(f"{a}.key.copy") == F.col(f"{b}.key.copy")
    )


def _joined(laid: DataFrame, taken: DataFrame) -> DataFrame:
    return laid.alias("a").join(taken.alias("b"), _same_key("a", "b"), "left").drop(F.col("b.key"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words [lo, hi) of each span as they stand in the text; spans that repeat come after all the others, on new lines."""
    found = [m.span() for m in WORD.finditer(text)]
    times: dict[int, list[int]] = {}
    for lo, hi in sorted(spans, key=lambda s: (s[0], -s[1])):
        times.setdefault(lo, []).append(hi)
    parts = []
    for turn in range(max(map(len, times.values()), default=0)):
        runs: list[list[int]] = []
        for lo in sorted(times):
            if len(times[lo]) > turn:
                hi = times[lo][turn]
                if runs and runs[-1][1] == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        parts += [text[found[a][0] : found[b - 1][1]] for a, b in runs]
    return "\n".join(parts)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of ``docs`` that the mix takes words of, with ``text`` holding the words taken.

    Words taken twice stand in the text twice. Rows that are equal in id and text are numbered in one task.
    """
    laid, pieces = plan(docs, **how)
    spans = pieces.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = spans.groupBy(*_row_keys("key.doc_id", F.col("key.digest"))).agg(F.collect_list(F.struct(F.col("key.copy").alias("copy"), "spans")).alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), *_row_keys("doc_id", F.xxhash64("text")))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")).cast("long"))
    joined = rows.join(spans, ["k1", "k2"])
    joined = joined.select("row", F.filter("copies", lambda c: c["copy"] == F.col("copy")).alias("own")).where(F.size("own") > 0)
    joined = joined.select("row.*", F.col("own")[0]["spans"].alias("_spans"))
    text, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                _cut(t.as_py(), [(x["lo"], x["hi"]) for x in s.as_py()])
                for t, s in zip(batch.column(text), batch.column(len(columns)), strict=True)
            ]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(run, docs.schema)


def _row_keys(doc_id: str, digest: Column) -> list[Column]:
    return [F.xxhash64(F.col(doc_id), digest).alias("k1"), F.xxhash64(digest, F.col(doc_id)).alias("k2")]
