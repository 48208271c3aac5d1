"""Word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.common import id_type, python_tasks

#: Words that a worker remembers, and the bytes of the longest ones of these.
MEMO_WORDS, MEMO_BYTES = 1 << 18, 64


class LongestMatch:
    """Number of pieces that greedy longest match cuts a word into, in time linear in the word.

    ``first`` are the pieces a word can begin with, ``inner`` those that can follow. Both sit in
    one trie with two roots. Where no child fits, the failure link leads to the node reached after the
    pieces that are certain by then have been cut off, and ``popped`` says how many these are, so
    pieces are counted and never built.
    """

    ROOT, INNER = 0, 1

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((self.ROOT, first), (self.INNER, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.child:
                        self.child[key] = len(ends)
                        ends.append(False)
                    node = self.child[key]
                ends[node] = node > self.INNER
        self.fail: list[int | None] = [None] * len(ends)
        self.popped = [0] * len(ends)
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in self.child.items():
            below[key >> 8].append((key & 255, node))
        queue = deque([self.ROOT, self.INNER])
        while queue:
            up = queue.popleft()
            for byte, node in below[up]:
                if ends[node]:
                    self.fail[node], self.popped[node] = self.INNER, 1
                else:
                    to, cut = self.fail[up], self.popped[up]
                    while to is not None and (to << 8 | byte) not in self.child:
                        cut += self.popped[to]
                        to = self.fail[to]
                    if to is not None:
                        self.fail[node], self.popped[node] = self.child[to << 8 | byte], cut
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; a word that cannot be cut counts as one unknown piece."""
        child, fail, popped = self.child, self.fail, self.popped
        node, total = self.ROOT, 0
        for byte in word:
            while True:
                to = child.get(node << 8 | byte)
                if to is not None:
                    node = to
                    break
                total += popped[node]
                node = fail[node]
                if node is None:
                    return 1
        while node > self.INNER:
            total += popped[node]
            node = fail[node]
            if node is None:
                return 1
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by their public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return {chr(shifted.get(b, b)): b for b in range(256)}


@functools.lru_cache(maxsize=2)
def automaton(vocabulary: str) -> LongestMatch:
    """The automaton of a byte-level vocabulary file, made once in each Python worker.

    Pieces with a leading space begin a word, those without one go on with it. All single bytes are
    pieces, so every word can be cut.
    """
    alphabet = byte_alphabet()
    with open(vocabulary, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    pieces = [bytes(alphabet[c] for c in t) for t in tokens if all(c in alphabet for c in t)]
    return LongestMatch([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row's whole text, repeated rows included.

    Words are runs of anything but ASCII white space. Null, empty and blank texts have 0 words and 0
    tokens. Null ids are kept. An empty table gives an empty result. Columns other than ``doc_id``
    and ``text`` are not looked at. Each worker keeps the counts of at most ``MEMO_WORDS`` words of at most ``MEMO_BYTES`` bytes.
    """
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = automaton(vocabulary).count, {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().split()
                total = 0
                for word in found:
                    n = memo.get(word)
                    if n is None:
                        n = count(b" " + word)
                        if len(word) <= MEMO_BYTES:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            memo[word] = n
                    total += n
                n_words.append(len(found))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_words long, n_tokens long")
