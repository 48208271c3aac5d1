"""Runs of words that repeat with a period, by string synchronising sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.common import id_type, python_tasks

LEAST_WORDS = 24
LEAST_REPEATS = 3
#: Periods up to this one are looked for directly; the first scale finds longer ones.
SMALL_PERIOD = 11
FIRST_SCALE = 8
#: Texts are worked on together, up to about so many bytes.
TOGETHER_BYTES = 1 << 20

NONE = np.uint64(2**64 - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


class Windows:
    """Hashes of all windows of 1, 2, 4, ... words, made when they are asked for."""

    def __init__(self, x: np.ndarray):
        self.levels = [_mix(x.astype(np.uint64), np.zeros(len(x), np.uint64))]

    def __getitem__(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mix(last[:-width], last[width:]) if len(last) > width else last[:0])
        return self.levels[level]


def _stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edge = np.flatnonzero(np.diff(true.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2] - edge[::2]


def _extend(x: np.ndarray, windows: Windows, level: int, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """Move each ``at`` on (``step`` 1) or back (-1) while the words there and a period later are equal."""
    at, n = at.copy(), len(x)
    for k in range(level, -1, -1):
        hashes, width = windows[k], 1 << k
        left = np.arange(len(at))
        while len(left):
            from_ = at[left] if step > 0 else at[left] - width
            fits = (from_ >= 0) & (from_ + period[left] + width <= n)
            left, from_ = left[fits], from_[fits]
            same = hashes[from_] == hashes[from_ + period[left]]
            left = left[same]
            at[left] += step * width
    return at


def synchronising_set(windows: Windows, level: int, periodic: np.ndarray) -> np.ndarray:
    """Places chosen by the 2 * t words from there on alone, t being ``2 ** level``.

    A place is chosen if the smallest hash of the windows of t words that start in the t + 1 places from there on is that of the first or
    the last of them. ``periodic`` windows do not count. Any t places in a row have a chosen one, unless all windows from there on are periodic.
    """
    t = 1 << level
    value = np.where(periodic, NONE, windows[level])
    places = len(value) - t
    if places <= 0:
        return np.zeros(0, np.int64)
    least, width = value, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    return np.flatnonzero((least != NONE) & ((value[:places] == least) | (value[t:] == least)))


def find_runs(x: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: stretches that repeat their smallest period at least three times, as long as they can be.

    Those with a period up to 11 have 8 words at least. ``longest`` bounds the length of a run.

    Small periods are found by comparing each word with the one a period before. A scale t = 8, 16, 32, ... finds the periods from 1.5 t to 3 t: a run with such a
    period q has a place of the synchronising set with another one q places later, both with the same 2 t words behind them. Places with the same
    words are more than t / 3 apart, so each is compared with at most eight following ones. Windows that repeat a period of at most t / 3
    are left out of the set; they lie in runs that smaller scales have found. A pair of places only proposes a period; the run is
    extended to both sides by hashes and then checked word by word.
    """
    n = len(x)
    longest = n if longest is None else longest
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()

    def add(starts, lengths, period):
        for a, m, q in zip(starts.tolist(), lengths.tolist(), period.tolist(), strict=True):
            if (a, m) not in seen:  # else it has a smaller period
                seen.add((a, m))
                runs.append((a, m, q))

    def direct(period: int, least: int) -> None:
        starts, lengths = _stretches(x[period:] == x[:-period])
        long = lengths + period >= least
        add(starts[long], lengths[long] + period, np.full(long.sum(), period))

    for period in range(1, min(SMALL_PERIOD, longest // LEAST_REPEATS) + 1):
        direct(period, max(FIRST_SCALE, LEAST_REPEATS * period))
    windows = Windows(x)
    level = FIRST_SCALE.bit_length() - 1
    while 9 << level <= 2 * longest:
        t = 1 << level
        edges = np.zeros(n + 1, np.int64)
        some = np.array([(a, m) for a, m, q in runs if 3 * q <= t and m >= t], np.int64).reshape(-1, 2)
        np.add.at(edges, some[:, 0], 1)
        np.add.at(edges, some[:, 0] + some[:, 1] - t + 1, -1)
        places = synchronising_set(windows, level, np.cumsum(edges)[: len(windows[level])] > 0)
        context = windows[level + 1][places]
        order = np.argsort(context, kind="stable")
        context, places = context[order], places[order]
        starts, periods = [], []
        for j in range(1, 9):
            same = context[j:] == context[:-j]
            if not same.any():
                break
            apart = places[j:] - places[:-j]
            near = same & (2 * apart >= 3 * t) & (apart < 3 * t)
            starts.append(places[:-j][near])
            periods.append(apart[near])
        if starts and sum(map(len, starts)):
            at, period = np.concatenate(starts), np.concatenate(periods)
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            # places whose contexts touch and propose the same period are in the same run
            new = np.r_[True, (np.diff(period) != 0) | (np.diff(at) > 2 * t)]
            first, last, period = at[new], at[np.r_[new[1:], True]] + 2 * t, period[new]
            first = _extend(x, windows, level + 1, first, period, -1)
            last = _extend(x, windows, level + 1, last, period, 1)
            length = last + period - first
            long = length >= LEAST_REPEATS * period
            for a, m, q in zip(first[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True):
                b = a + m - q
                exact = np.array_equal(x[a:b], x[a + q : b + q]) and (a == 0 or x[a - 1] != x[a - 1 + q]) and (b + q == n or x[b] != x[b + q])
                if not exact:  # two different windows with one hash
                    direct(q, LEAST_REPEATS * q)
                elif (a, m) not in seen:
                    seen.add((a, m))
                    runs.append((a, m, q))
        level += 1
    return runs


def runs_of_texts(texts: Sequence[np.ndarray], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """Runs of at least ``least`` words of each text, by start and period.

    Texts are laid end to end with a word of its own behind each. Only texts in which eight words in a row occur twice can have a run.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longer = [i for i, t in enumerate(texts) if len(t) >= least]
    if not longer:
        return found

    def together(some: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ends = [np.array([-1 - i]) for i in range(len(some))]
        return np.concatenate([p for i, e in zip(some, ends, strict=True) for p in (texts[i], e)]), np.cumsum([0] + [len(texts[i]) + 1 for i in some])

    x, starts = together(longer)
    level = FIRST_SCALE.bit_length() - 1
    hashes = Windows(x)[level]
    text = np.repeat(np.arange(len(longer)), np.diff(starts))[: len(hashes)]
    key = _mix(hashes, text.astype(np.uint64))
    order = np.argsort(key)
    repeated = text[order[1:]][key[order[1:]] == key[order[:-1]]]
    by_size: dict[int, list[int]] = {}
    for i in np.unique(repeated).tolist():
        by_size.setdefault(len(texts[longer[i]]).bit_length() // 3, []).append(longer[i])
    for some in by_size.values():
        x, starts = together(some)
        for a, m, q in find_runs(x, max(len(texts[i]) for i in some)):
            if m >= least:
                k = int(np.searchsorted(starts, a, "right")) - 1
                found[some[k]].append((a - int(starts[k]), m, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: where its words repeat, and its words without the repeats.

    ``runs`` has ``start, length, period`` in words, by start and period: stretches of at least 24 words that repeat their smallest period three times
    or more and cannot be made longer. ``collapsed`` has the words that no run holds behind its first period, with one space
    between them. Null, empty and blank texts have no runs and collapse to an empty text. Repeated rows get the same
    result each; null ids are kept; an empty table gives no rows; other columns are not looked at. Each text is worked on by
    itself, whole, in the task that reads it; nothing is shuffled.
    """
    python_tasks(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def some(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
        numbers: dict[bytes, int] = {}
        number = count()

        def numbered(word: bytes) -> int:
            k = numbers.get(word)
            if k is None:
                k = numbers[word] = next(number)
            return k

        split = [t.split() for t in texts]
        runs = runs_of_texts([np.fromiter(map(numbered, w), np.int64, len(w)) for w in split])
        return runs, [_collapsed(w, r) if r else b" ".join(w) for w, r in zip(split, runs, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            all_runs, all_collapsed = [], []
            part: list[bytes] = []
            size = 0
            for i in range(len(texts)):
                text = texts[i].as_py() or b""
                part.append(text)
                size += len(text)
                if size >= TOGETHER_BYTES or i == len(texts) - 1:
                    runs, collapsed = some(part)
                    all_runs += runs
                    all_collapsed += collapsed
                    part, size = [], 0
            flat = [r for runs in all_runs for r in runs]
            offsets = np.cumsum([0] + [len(r) for r in all_runs])
            columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists.cast(run_type), pa.array(all_collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"]
            )

    kinds = f"doc_id {id_type(docs, id_column)}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(id_column, text_column).mapInArrow(run, kinds)
