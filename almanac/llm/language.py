"""Language identification by a small byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import held_out, id_type, may_learn, python_tasks

WINDOW = 256
TRAIN_DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 4
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
BATCH_WINDOWS = 24
#: Texts whose best language scores less are in none of the learned ones, or in several at once.
ACCEPT = 0.4
#: Letter sequences count as known if so many windows of the sample have them. A text may have this many times as many unknown ones as the
#: hundredth part of the known windows with the most has.
SEEN, SLACK = 2, 8


class Network(NamedTuple):
    """Byte embedding, filters of all widths side by side (narrow ones padded with zeros), dense layer."""

    langs: list[str]
    emb: np.ndarray  # 256 x EMBEDDING; byte 0 pads and is always zero
    conv: np.ndarray  # (max width * EMBEDDING) x all filters
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray


class Familiar(NamedTuple):
    """Three letters in a row (as bytes) that known languages have, and the share of those of a text that must be among them."""

    known: np.ndarray
    least: float


def windows_of(text: str) -> np.ndarray:
    """The whole lower-cased text as rows of WINDOW bytes, the last one padded."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    rows = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(rows * WINDOW, dtype=np.uint8)
    padded[: len(data)] = data
    return padded.reshape(rows, WINDOW)


def unfolded(emb: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row and position the embedded bytes under the widest filter."""
    x = np.ascontiguousarray(emb[rows]).reshape(len(rows), -1)
    wide = max(WIDTHS)
    view = np.lib.stride_tricks.sliding_window_view(x, wide * EMBEDDING, axis=1)[:, ::EMBEDDING]
    return np.ascontiguousarray(view)


def probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    x = unfolded(net.emb, rows)
    hidden = (x.reshape(-1, x.shape[2]) @ net.conv).reshape(len(rows), x.shape[1], -1).max(axis=1)
    hidden = np.maximum(hidden + net.bias, 0)
    z = hidden @ net.dense + net.out
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Softmax cross entropy, max pooling, Adam; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], dtype=np.int64)
    wide, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide * EMBEDDING, n_filters), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
    p = {
        "emb": rng.normal(0, 0.5, (256, EMBEDDING)),
        "conv": rng.normal(0, 0.3, mask.shape) * mask,
        "bias": np.zeros(n_filters),
        "dense": rng.normal(0, 0.3, (n_filters, len(langs))),
        "out": np.zeros(len(langs)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["emb"][0] = 0
    share = np.bincount(y, minlength=len(langs)) / max(1, len(y))
    weight = (1 / np.maximum(share, 1e-9) / len(langs)).astype(np.float32)
    first, second, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = unfolded(p["emb"], rows[pick])
            pooled = (x.reshape(-1, x.shape[2]) @ p["conv"]).reshape(len(pick), x.shape[1], -1)
            where = pooled.argmax(axis=1)
            top = np.take_along_axis(pooled, where[:, None, :], axis=1)[:, 0] + p["bias"]
            hidden = np.maximum(top, 0)
            z = hidden @ p["dense"] + p["out"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(pick)), y[pick]] -= 1
            z *= weight[y[pick], None] / len(pick)
            back = (z @ p["dense"].T) * (top > 0)
            under = x[np.arange(len(pick))[:, None], where]  # row x filter x width*embedding
            g = {
                "dense": hidden.T @ z,
                "out": z.sum(axis=0),
                "bias": back.sum(axis=0),
                "conv": np.einsum("bf,bfk->kf", back, under) * mask,
                "emb": np.zeros_like(p["emb"]),
            }
            spread = np.einsum("bf,kf->bfk", back, p["conv"]).reshape(len(pick), n_filters, wide, EMBEDDING)
            byte = rows[pick][np.arange(len(pick))[:, None, None], where[:, :, None] + np.arange(wide)]
            np.add.at(g["emb"], byte.reshape(-1), spread.reshape(-1, EMBEDDING))
            g["emb"][0] = 0
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = (p[k] - rate * move).astype(np.float32)
    return Network(langs, p["emb"], p["conv"], p["bias"], p["dense"], p["out"])


def letter_triples(text: str) -> np.ndarray:
    """All three successive bytes of letters of the lower-cased text, as numbers; each byte above 127 counts as a letter."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    letter = ((data >= 97) & (data <= 122)) | (data > 127)
    wide = data.astype(np.int32)
    return ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:])[letter[:-2] & letter[1:-1] & letter[2:]]


def learn_familiar(texts: list[str]) -> Familiar:
    """Known triples from ``texts``; the least share from how many triples of one half of them the other half does not have."""

    def known(some: list[str]) -> np.ndarray:
        counts = np.zeros(1 << 24, np.int32)
        for t in some:
            counts[np.unique(letter_triples(t))] += 1
        return counts >= SEEN

    half, triples = known(texts[::2]), [letter_triples(t) for t in texts[1::2]]
    shares = [half[x].mean() for x in triples if len(x)]
    least = 1 - SLACK * (1 - float(np.quantile(shares, 0.01))) if shares else 0.0
    return Familiar(np.flatnonzero(known(texts)), max(0.0, least))


def is_familiar(known: np.ndarray, least: float, text: str) -> bool:
    """Whether a whole text has few enough unknown triples, with room for chance in short ones; ``known`` has a flag for each triple."""
    triples = letter_triples(text)
    n = len(triples)
    return bool(n - np.count_nonzero(known[triples]) <= (1 - least) * n + 2 * np.sqrt(n * least * (1 - least)))


def fit(docs: DataFrame, docs_per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> Network | None:
    """Train on a bounded sample: about ``docs_per_language`` rows of each language, chosen by a hash.

    Of each sampled row, WINDOWS_PER_DOC stretches of WINDOW characters from anywhere in the text are
    used. Rows that are held out, have a null language or no text are never learned from. No such row
    at all: None.
    """
    return fit_with_familiar(docs, docs_per_language)[0]


def fit_with_familiar(docs: DataFrame, docs_per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> tuple[Network | None, Familiar | None]:
    """:func:`fit`, and from the same sample what texts in the learned languages look like, to tell those in others."""
    rows = docs.select("doc_id", "text", "lang").where(may_learn() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None, None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_language / n)).otherwise(share)
    few = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    starts = [F.pmod(F.xxhash64("text", "doc_id", F.lit(k)), room).cast("int") + 1 for k in range(WINDOWS_PER_DOC)]
    cut = few.select("lang", F.explode(F.array_distinct(F.array(*(F.substr("text", s, F.lit(WINDOW)) for s in starts)))).alias("t"))
    sample = sorted((r.lang, r.t) for r in cut.collect())
    if not sample:
        return None, None
    net = train(np.concatenate([windows_of(t)[:1] for _, t in sample]), [lang for lang, _ in sample])
    return net, learn_familiar([t for _, t in sample])


def classify(net: Network | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: probabilities of their windows, weighted by the bytes in them, averaged."""
    best, score = ["und"] * len(texts), [0.0] * len(texts)
    usable = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
    sums = np.zeros((len(texts), len(net.langs) if net else 1))
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        owner = np.repeat([i for i, _ in held], [len(w) for _, w in held])
        rows = np.concatenate([w for _, w in held])
        for at in range(0, len(rows), BATCH_WINDOWS):
            part = rows[at : at + BATCH_WINDOWS]
            filled = np.count_nonzero(part, axis=1)[:, None]
            np.add.at(sums, owner[at : at + BATCH_WINDOWS], probabilities(net, part) * filled)
        held.clear()

    waiting = 0
    for i in usable:
        held.append((i, windows_of(texts[i])))
        waiting += len(held[-1][1])
        if waiting >= 16 * BATCH_WINDOWS:
            flush()
            waiting = 0
    if held:
        flush()
    for i in usable:
        k = int(sums[i].argmax())
        best[i], score[i] = net.langs[k], float(min(1.0, sums[i][k] / sums[i].sum()))
    return best, score


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, repeated rows included.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. Null ids are
    kept and count as not held out; equal texts get equal results; an empty table gives no rows; other columns are
    not looked at.
    """
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = classify(net, [t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, net: Network | None, familiar: Familiar | None = None, least: float = ACCEPT) -> DataFrame:
    """The rows and columns of ``docs`` whose text is in a learned language with a score of at least ``least``.

    The network only tells learned languages from each other, so it gives one of them to any text. Texts in others are told by ``familiar``: more of
    their letter sequences are unknown than learned languages account for. Texts without letters go.
    """
    python_tasks(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << 24, bool)
        if familiar:
            known[familiar.known] = True
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text)]
            ours = [familiar is None or is_familiar(known, familiar.least, t) for t in texts]
            best, score = classify(net, [t if o else "" for t, o in zip(texts, ours, strict=True)])
            yield batch.filter(pa.array([b != "und" and s >= least for b, s in zip(best, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
