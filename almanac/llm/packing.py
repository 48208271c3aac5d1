"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import id_type, python_tasks
from almanac.session import materialize

SEQUENCE = 2048
GROUP_PIECES = 20_000
#: The fast encoder's pattern search gives up in very long runs of white space.
LONG_TEXT, LONG_SPACE = 50_000, re.compile(r"\s{5000}")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str, pattern: str):
    """A function from text to token ids, made once in each Python worker.

    ``ranks`` holds the same vocabulary as ``vocabulary``; encoding by ranks gives the same ids
    several times faster. Only texts that spell a special token, to which the other library gives its
    own id, and texts with a very long run of white space go through that library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as file:
        by_rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=by_rank, special_tokens={})
    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) > LONG_TEXT and LONG_SPACE.search(text)):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, longest first; each goes to the first bin with room.

    A tournament tree over the bins holds the largest room below each node, so the first bin
    with room is found by one walk from the root. Ties keep their order.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = [(0, 0)] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[item], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        placed[item] = (node - leaves, capacity - room[node])
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return placed


def cut(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, length: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """Token pieces of at most ``length`` ids: as many full ones as there are, then the rest."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        for batch in batches:
            row, start, size, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    row.append(i)
                    start.append(at)
                    size.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kinds = f"doc_id {id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    length: int = SEQUENCE,
    end_id: int = 1,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Where each piece of every document goes: ``sequence_id`` and ``offset``.

    A document is the ids of its whole text and ``end_id``; a null text counts as empty and is
    one id. Documents are cut into full sequences and one rest. Pieces are dealt at random (by a
    hash, so reruns agree; equal pieces by their row) into groups of about ``group_pieces``, and each group is packed by
    itself. Only piece records are shuffled, never ids. Repeated rows are packed as often as they
    occur; null ids are kept; an empty table gives no rows; other columns are not looked at.
    """
    pieces = materialize(cut(docs, vocabulary, ranks, pattern, length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    out = pieces.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        at = first_fit_decreasing(table["length"].to_pylist(), length)
        group = table["group"][0].as_py() << 32
        return (
            table.select(out)
            .append_column("sequence_id", pa.array([group | b for b, _ in at], pa.int64()))
            .append_column("offset", pa.array([o for _, o in at], pa.int64()))
        )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    piece = ["doc_id", "start", "ids_crc32"]
    repeated = pieces.groupBy(*piece).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"same_{c}") for c in piece))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"same_{c}")) for c in piece])
    # Equal pieces are dealt one by one, others by what they are.
    number = F.when(F.col("same_start").isNotNull(), F.col("row"))
    dealt = numbered.join(repeated, same, "left").withColumn("group", F.pmod(F.xxhash64(*piece, F.lit(7), number), F.lit(groups)).cast("long"))
    dealt = dealt.select(*out, "group")
    return dealt.groupBy("group").applyInArrow(run, kinds)
