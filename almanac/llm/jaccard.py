"""N-gram Jaccard join: parity sketches, a pigeonhole join of their blocks, and exact checks."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import python_tasks
from almanac.operators.components import components
from almanac.session import materialize

SHINGLE = 5
#: Links need 100 * shared >= PERCENT * all.
PERCENT = 80
#: Blocks of a sketch that are joined; sketches with more blocks leave the others out, unless all are asked for.
BLOCKS, ALL_BLOCKS = 128, 1 << 62
#: The chance that a link shares too few of those blocks, for sketches with more.
MISS = 1e-12
#: Words that a task remembers, and the bytes of the longest ones of these.
MEMO_WORDS, MEMO_BYTES = 1 << 18, 64

#: Taken from the band in the second row of a document.
SECOND = 1 << 20
#: Bits of the parity sketches that pairs are compared by inside a join, and of the same sketches folded for the first look.
PARITY_BITS, FOLDED_BITS = 2048, 512
#: In buckets of more sets than this, elements that only one set has are counted before sets are compared.
CROWDED = 64

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX
        x = (x ^ (x >> np.uint64(27))) * _STEP
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles of a whole text.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Fewer words: the whole
    sequence as one. No words: none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) + len(words) > MEMO_WORDS:
        memo.clear()
    ids = []
    for word in words:
        h = memo.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
            if len(word) <= MEMO_BYTES:
                memo[word] = h
        ids.append(h)
    h = np.array(ids, dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    mixed = np.full(n, min(len(h), SHINGLE), dtype=np.uint64)
    for k in range(min(len(h), SHINGLE)):
        mixed = _mixed(mixed ^ h[k : k + n]) + np.uint64(k)
    return np.unique(_mixed(mixed))


def allowed(n: int) -> int:
    """Largest symmetric difference of a linked pair one of whose sets has ``n`` elements.

    With d the difference and s the sum of both sizes, similarity p means d <= s (1 - p) / (1 + p), and
    the larger set has at most n / p elements if n is the smaller one.
    """
    return n * (100 - PERCENT) // PERCENT


def blocks_of(band: int) -> int:
    """Blocks of the sketches of sets with 2**band to 2**(band+1)-1 elements: over twice the largest difference."""
    return 1 << band


@functools.lru_cache(maxsize=4096)
def sure_blocks(n: int, blocks: int, most: int = BLOCKS) -> int:
    """How many of the joined blocks a linked pair shares at least.

    Each element of the difference changes one block, so all but ``allowed(n)`` blocks are equal. Where only ``most``
    of them are joined, those are a random choice, and the number is one that is missed with a chance under MISS.
    """
    d = allowed(n)
    if blocks <= most:
        return blocks - d
    p = (1 - 1 / blocks) ** d
    tail, k = 0.0, 0
    while True:
        tail += math.comb(most, k) * p**k * (1 - p) ** (most - k)
        if tail > MISS:
            return max(1, k)
        k += 1


def sketch(hashes: np.ndarray, band: int, most: int = BLOCKS) -> tuple[np.ndarray, int]:
    """Join keys of a set in a band, and how many of the rarest ones have to be kept.

    The top bits of a hash choose its block, and a block is the XOR of its elements: a wide parity sketch. The number of blocks in
    which two sketches differ is at most the symmetric difference. A key is the band, the block and its value. Pairs share ``sure_blocks``
    keys, so any two of them share one among the rarest ``joined - sure_blocks + 1`` of each, in any order that both use. Empty
    blocks are last in that order and are only emitted if the others do not suffice; their keys are odd, the others even.
    """
    n, blocks = len(hashes), blocks_of(band)
    joined = min(blocks, most)
    quota = joined - sure_blocks(n, blocks, most) + 1
    block = (hashes >> np.uint64(64 - band)).astype(np.int64) if band else np.zeros(n, np.int64)
    inside = block < joined
    block, own = block[inside], _mixed(hashes[inside] ^ _STEP)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    value = np.bitwise_xor.reduceat(own, starts) if len(block) else own
    full = block[starts]
    salt = (np.uint64(band) << np.uint64(32)) + full.astype(np.uint64)
    keys = _mixed(_mixed(value) ^ _mixed(salt)) & ~np.uint64(1)
    short = quota - len(keys)
    if short > 0:
        empty = np.setdiff1d(np.arange(joined), full)[:short].astype(np.uint64)
        keys = np.r_[keys, _mixed(_mixed((np.uint64(band) << np.uint64(32)) + empty)) | np.uint64(1)]
    return keys.view(np.int64), quota


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as longs: each element flips one, so two sketches differ in at most the symmetric difference.

    The longs of the folded sketch, for which the same holds, come first.
    """
    bits = np.bincount((hashes >> np.uint64(3)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    folded = bits.reshape(-1, FOLDED_BITS).sum(axis=0) & 1
    return np.packbits(np.concatenate([folded, bits]).astype(np.uint8)).view(np.int64)


def bands(n: int) -> list[int]:
    """The band of a set with ``n`` elements, and the one below if a linked set can be in it."""
    band = n.bit_length() - 1
    return [band] + ([band - 1] if band and n * PERCENT <= 100 * ((1 << band) - 1) else [])


def _sketched(docs: DataFrame, most: int) -> DataFrame:
    """One row per row of ``docs`` and band: ``spot, n, fp, band, quota, keys``; ``keys`` is null for copies met before in the task.

    ``fp`` digests the set; sets with equal ``n`` and ``fp`` count as equal.
    """
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        met: set[int] = set()
        for batch in batches:
            row, n, fp, band, quota, keys = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                hashes = shingles(text.as_py(), memo)
                digest = xxhash.xxh3_64_intdigest(hashes.tobytes())
                copy = digest in met
                met.add(digest)
                for at, b in enumerate([-1] if copy or not len(hashes) else bands(len(hashes))):
                    found, rarest = sketch(hashes, b, most) if b >= 0 else (None, 0)
                    row.append(i)
                    n.append(len(hashes))
                    fp.append(digest - (1 << 63))
                    band.append(b - SECOND if at else b)
                    quota.append(rarest)
                    keys.append(found)
            where = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array(n, pa.int64()), pa.array(fp, pa.int64())]
                + [pa.array(band, pa.int32()), pa.array(quota, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n", "fp", "band", "quota", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, mark long, n long, fp long, band int, quota int, keys array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, kinds)


def _sized(n: Column, m: Column) -> Column:
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * PERCENT)


def _near(bits: str, others: str, n: Column, m: Column) -> Column:
    """Whether the parity sketches of sets of ``n`` and ``m`` elements differ in no more bits than a linked pair may.

    The folded sketches are compared first, in few enough instructions for the join's loop to be compiled to machine code; most pairs
    end there. The whole ones are compared by a loop of their own.
    """
    most = (n + m) * (100 - PERCENT)
    few = F.lit(0)
    for i in range(FOLDED_BITS // 64):
        few = few + F.bit_count(F.get(F.col(bits), F.lit(i)).bitwiseXOR(F.get(F.col(others), F.lit(i))))
    each = F.zip_with(bits, others, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    whole = F.aggregate(F.slice(each, FOLDED_BITS // 64 + 1, PARITY_BITS // 64), F.lit(0), lambda total, x: total + x)
    return (few * (100 + PERCENT) <= most) & (whole * (100 + PERCENT) <= most)


def _buckets(sketched: DataFrame) -> DataFrame:
    """``key, fp, n, lone``: what is left of the join keys when each set keeps its rarest ones and lone keys are gone.

    ``lone`` is the number of the set's keys that no other set has.
    """
    keys = sketched.where(F.col("keys").isNotNull()).select("fp", "n", "band", "quota", F.size("keys").alias("made"), F.explode("keys").alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = keys.join(common, "key").groupBy("key", "fp", "n", "band", "quota", "made").agg(F.count("*").alias("c"))
    shared = materialize(shared.drop("c"), "keys")
    counts = shared.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    rare = shared.join(counts, "key")
    one = Window.partitionBy("fp", "n", "band")
    order = one.orderBy(F.col("key").bitwiseAND(F.lit(1)), "f", "key")
    rare = rare.withColumn("lone", F.col("made") - F.count("*").over(one)).withColumn("place", F.row_number().over(order))
    return rare.where(F.col("place") <= F.col("quota") - F.col("lone")).select("key", "fp", "n", "lone")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp, n, hashes, bits``: the shingles of one text of each wanted set, as bytes, and their parity sketch.

    ``wanted`` has ``doc_id, mark, fp, n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingles(t.as_py(), memo) for t in batch.column(2)]
            data = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([parity(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *data], names=["fp", "n", "hashes", "bits"])

    right = wanted.select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "fp", "n")
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    joined = texts.join(right, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))).select("fp", "n", "text")
    return joined.mapInArrow(run, "fp long, n long, hashes binary, bits array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``a, b`` are structs of ``n, fp``) whose sets are similar enough, by their elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= PERCENT * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], names=["an", "afp", "bn", "bfp"]).filter(pa.array(keep, pa.bool_()))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("n").alias(f"{name}n"), F.col("fp").alias(f"{name}fp"), F.col("hashes").alias(f"{name}_set"))

    flat = pairs.select(F.col("a.n").alias("an"), F.col("a.fp").alias("afp"), F.col("b.n").alias("bn"), F.col("b.fp").alias("bfp"))
    joined = flat.join(side("a"), ["an", "afp"]).join(side("b"), ["bn", "bfp"]).select("an", "afp", "bn", "bfp", "a_set", "b_set")
    checked = joined.mapInArrow(run, "an long, afp long, bn long, bfp long")
    return checked.select(F.struct(F.col("an").alias("n"), F.col("afp").alias("fp")).alias("a"), F.struct(F.col("bn").alias("n"), F.col("bfp").alias("fp")).alias("b"))


def _labelled(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, x, label, bits`` of the buckets that hold sets with different labels; a set without one is its own."""
    rows = members.join(labels, "x", "left").withColumn("label", F.coalesce("label", "x"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    bits = sets.select(F.struct("n", "fp").alias("x"), "bits")
    return materialize(rows.join(mixed, "key").join(bits, "x"), "labels")


def _with_own(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with ``own``, less those of crowded buckets that cannot be linked with another of their bucket.

    ``own`` is, in a bucket of over CROWDED sets, the number of a set's elements that no other set of such buckets has: all of them
    are in the difference to any partner there, as are the partner's. Where that of the set and the least of the bucket are
    more than a linked pair may differ, the set has no partner in it. In other buckets ``own`` is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                fps = batch.column(0)[at : at + 64].to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)[at : at + 64]]
                owner = pa.array(np.repeat(fps, [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([owner, pa.array(np.concatenate(sets))], names=["fp", "element"])

    many = rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CROWDED).select("key", F.lit(True).alias("crowded"))
    crowded = rows.join(many, "key").select("x.n", "x.fp").distinct()
    elements = sets.join(crowded, ["n", "fp"]).select("fp", "hashes").mapInArrow(run, "fp long, element long")
    single = elements.groupBy("element").agg(F.count("*").alias("c"), F.min("fp").alias("fp")).where("c = 1")
    own = single.groupBy("fp").agg(F.count("*").alias("own"))
    counted = rows.join(many, "key", "left").join(own.withColumnRenamed("fp", "own_fp"), F.col("x.fp") == F.col("own_fp"), "left")
    counted = counted.withColumn("own", F.when(F.col("crowded"), F.coalesce("own", F.lit(0))).otherwise(0)).drop("own_fp", "crowded")
    counted = materialize(counted, "labels")
    least = counted.groupBy("key").agg(F.min("own").alias("least"))
    fits = (F.col("own") + F.col("least")) * PERCENT <= F.col("x.n") * (100 - PERCENT)
    return counted.join(least, "key").where(fits).drop("least")


def _grouped(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, component`` of all sets that are linked, found without pairing all of a bucket's sets.

    First each set is compared with the one in its buckets that has the fewest keys of its own: of a text and its near copies, the text.
    Then each bucket has another set as its hub, and those not yet connected with it are compared with it. Groups of near copies
    come together this way. Last, all pairs of a bucket that are still not connected are compared, so no link between different
    components is missed. In both steps pairs whose parity sketches differ too much to be linked never leave the join.
    """
    members = buckets.select("key", F.struct("n", "fp").alias("x"))
    spot = F.struct("lone", "n", "fp")
    ranked = buckets.select("key", spot.alias("x"))
    hubs = ranked.groupBy("key").agg(F.min("x").alias("y"))
    near = ranked.join(hubs, "key").where((F.col("x.fp") != F.col("y.fp")) & _sized(F.col("x.n"), F.col("y.n")))
    near = near.groupBy(F.struct("x.n", "x.fp").alias("x")).agg(F.min("y").alias("y")).select("x", F.struct("y.n", "y.fp").alias("y"))
    first = materialize(near, "pairs")
    both = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    tested = first.select(*both).distinct()
    links = materialize(_linked(tested, sets), "links")
    # What hangs on one set, and on the set that this one hangs on.
    hung = first.select(*both, "x", F.col("y").alias("label")).join(links, ["a", "b"]).select("x", "label")
    above = hung.select(F.col("x").alias("label"), F.col("label").alias("top"))
    labels = hung.join(above, "label", "left").select("x", F.coalesce("top", "label").alias("label"))
    rows = _labelled(members, labels, sets)

    def compared(left: DataFrame, right: DataFrame, more: Column | None = None) -> DataFrame:
        """New pairs of a bucket that may be linked and are not yet connected."""
        apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.label") != F.col("r.label")) & _sized(F.col("l.x.n"), F.col("r.x.n"))
        apart = apart if more is None else apart & more
        apart = apart & _near("l.bits", "r.bits", F.col("l.x.n"), F.col("r.x.n"))
        met = left.alias("l").join(right.alias("r"), apart)
        new = met.select(F.least("l.x", "r.x").alias("a"), F.greatest("l.x", "r.x").alias("b")).distinct()
        return materialize(new.join(tested, ["a", "b"], "left_anti"), "pairs")

    hub = F.min(F.struct(F.xxhash64("x").alias("r"), "x", "label", "bits")).alias("hub")
    pairs = compared(rows, rows.groupBy("key").agg(hub).select("key", "hub.x", "hub.label", "hub.bits"))
    tested = tested.unionByName(pairs)
    links = links.unionByName(materialize(_linked(pairs, sets), "links"))
    found = materialize(components(links), "components")
    rows = _labelled(members, found.select(F.col("node").alias("x"), F.col("component").alias("label")), sets)
    # Of two sets with different labels one does not have the bucket's most frequent label: only those meet all others.
    often = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"))
    rows = _with_own(rows.join(often, "key").withColumn("main", F.col("label") == F.col("most.label")).drop("most"), sets)
    apart = (F.col("l.own") + F.col("r.own")) * (100 + PERCENT) <= (F.col("l.x.n") + F.col("r.x.n")) * (100 - PERCENT)
    pairs = compared(rows.where(~F.col("main")), rows, apart & (F.col("r.main") | (F.col("l.x") < F.col("r.x"))))
    last = materialize(_linked(pairs, sets), "links")
    return found if last.isEmpty() else components(links.unionByName(last))


def _components(docs: DataFrame, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, mark, n, fp`` of ``docs``, and for each set with words ``n, fp, s``, the first row of its component."""
    sketched = materialize(_sketched(docs, ALL_BLOCKS if exact else BLOCKS), "sketches")
    rows = sketched.where(F.col("band") >= -1).select("doc_id", "mark", "n", "fp")
    sketched = sketched.withColumn("band", F.when(F.col("band") < -1, F.col("band") + SECOND).otherwise(F.col("band")))
    buckets = materialize(_buckets(sketched), "buckets")
    few = buckets.select("fp", "n").distinct()
    spot = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark")).alias("s")
    classes = materialize(rows.where("n > 0").groupBy("fp", "n").agg(spot), "classes")
    wanted = classes.join(few, ["fp", "n"]).select("s.doc_id", "s.mark", "fp", "n")
    sets = _sets(docs, wanted).groupBy("fp", "n").agg(F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))
    found = _grouped(buckets, materialize(sets, "sets")).select("node.n", "node.fp", "component")
    named = classes.join(found, ["n", "fp"], "left").withColumn("component", F.coalesce("component", F.struct("n", "fp")))
    least = named.groupBy("component").agg(F.min("s").alias("s"))
    return rows, named.select("n", "fp", "component").join(least, "component").select("n", "fp", "s")


def join_similar(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A set is the distinct 5-word shingles of a whole text. Rows link when 100 * shared >= 80 * all; ``component_id`` is the smallest id
    that links lead to, the row's own included. Texts that are null, empty or blank have an empty set and link with nothing. Equal sets
    link, and are one set throughout: copies are never paired. Repeated rows get a row each. Null ids are kept and are larger than all
    others; a component of null ids only has a null id. An empty table gives no rows; other columns are not looked at.

    ``exact`` joins all blocks of sets with 256 and more shingles too: up to a key per shingle, where else 128 keys miss a link with a chance under ``MISS``.
    """
    rows, named = _components(docs, exact)
    lone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    joined = rows.where("n > 0").join(named, ["n", "fp"])
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("s.doc_id").alias("component_id")).unionByName(lone)


def one_per_group(docs: DataFrame, exact: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` with one row of each component, the one with the smallest id.

    Texts without words are groups of their own. Rows that are equal in id and text count as one. ``exact`` is that of ``join_similar``.
    """
    rows, named = _components(docs, exact)
    keep = named.select("s.doc_id", "s.mark").distinct().unionByName(rows.where("n = 0").select("doc_id", "mark").distinct())
    keep = keep.select(F.xxhash64("doc_id", "mark").alias("k1"), F.xxhash64("mark", "doc_id").alias("k2"))
    mark = F.xxhash64("text")
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", mark).alias("k1"), F.xxhash64(mark, "doc_id").alias("k2"))
    return whole.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
