"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Five transducers, for insults, threats, negation, reported speech and targets, are composed into one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import hashed_share, held_out, id_type, may_learn, python_tasks
from almanac.llm.transducers import Transducer, compose, copying, numbered, weigh

TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
#: Words that a task remembers, and the longest ones of these.
MEMO_WORDS, MEMO_LENGTH = 1 << 18, 64
THRESHOLD = 0.3

CLAUSE = re.compile(r"[.!?;\n]+")
EDGE = "\"'`´’‘“”„«»()[]{}<>,.:;!?-–—_*#$%&|~/\\"

#: Symbols of words, and two of the grammar: a hit that is weighed, and one that is passed over while another one is.
INSULT, THREAT, SECOND, OTHER, DENIAL, REPORT, WILL, HIT, PASSED = SYMBOLS = range(1, 10)

#: General words of the grammar; insults and threats beyond these are learned with their weights.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú usted ti tus".split())
OTHER_TARGETS = frozenset("he she they him her them these those people er sie ihnen il elle ils eux él ella ellos".split())
DENIALS = frozenset("not no never without isn't aren't wasn't weren't don't doesn't didn't nicht kein keine nie ne pas jamais sin nunca".split())
REPORTS = frozenset("said says say told wrote called calls claimed claims quote quoted reported sagte sagt schrieb dit écrit dijo dice".split())
WILLS = frozenset("will shall gonna going i'll we'll werde werden vais va voy vamos".split())
THREATS = frozenset("kill hurt destroy burn shoot stab beat murder töten schlagen tuer frapper matar golpear".split())


class Grammar(NamedTuple):
    """Weights of learned words and word beginnings, and of the logistic layer over clause sums."""

    whole: dict[str, float]
    begin: dict[str, float]
    lengths: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray


def symbol(grammar: Grammar, token: str) -> tuple[int, float] | None:
    """The word transducer, which has one state: at most one symbol with its weight. Learned words win over general ones."""
    word = token.strip(EDGE)
    weight = grammar.whole.get(word, 0.0)
    if not weight:
        for n in grammar.lengths:  # longest beginning first
            if len(word) >= n and (weight := grammar.begin.get(word[:n], 0.0)):
                break
    if word in THREATS:
        return THREAT, max(weight, 1.0)
    if weight:
        return INSULT, weight
    for kind, words in ((SECOND, SECOND_PERSON), (DENIAL, DENIALS), (REPORT, REPORTS), (WILL, WILLS), (OTHER, OTHER_TARGETS)):
        if word in words:
            return kind, 0.0
    return None


def insult() -> Transducer:
    """A learned insult is a hit."""
    return copying(0, SYMBOLS, [0], {(0, INSULT): (HIT, 1.0, 0)})


def threat() -> Transducer:
    """A threatening act is a hit: whole if announced, less if somebody was named before it, else little."""
    none, named, announced = range(3)
    arcs = {(s, WILL): (WILL, 1.0, announced) for s in range(3)}
    arcs |= {(none, who): (who, 1.0, named) for who in (SECOND, OTHER)}
    arcs |= {(s, THREAT): (HIT, share, s) for s, share in ((none, 0.1), (named, 0.4), (announced, 1.0))}
    return copying(none, SYMBOLS, range(3), arcs)


def negation() -> Transducer:
    """A denial takes from the next hit; a second one before it takes the first back."""
    plain, denied = range(2)
    arcs = {(plain, DENIAL): (DENIAL, 1.0, denied), (denied, DENIAL): (DENIAL, 1.0, plain)}
    return copying(plain, SYMBOLS, range(2), arcs | {(denied, HIT): (HIT, 0.4, plain), (denied, PASSED): (PASSED, 1.0, plain)})


def reported_speech() -> Transducer:
    """What is said to have been said counts half."""
    own, quoted = range(2)
    return copying(own, SYMBOLS, range(2), {(own, REPORT): (REPORT, 1.0, quoted), (quoted, HIT): (HIT, 0.5, quoted)})


def target() -> Transducer:
    """Accepts clauses with one hit, which counts more for the strongest target before it and for the next one after it.

    States are the strongest target so far, whether the hit was read, and what the target after it gave.
    """
    aims = {SECOND: 0.5, OTHER: 0.2}
    levels = (0.0, *sorted(aims.values()))
    arcs: dict = {}
    final: dict = {}
    for best in levels:
        arcs[best, False, 0.0] = {x: [(x, 1.0, (max(best, aims.get(x, 0.0)), False, 0.0))] for x in SYMBOLS}
        arcs[best, False, 0.0][HIT] = [(HIT, 1.0, (best, True, 0.0))]
        for after in levels:
            there = best, True, after
            arcs[there] = {x: [(x, 1.0, there)] for x in SYMBOLS if x != HIT}
            if not after:
                arcs[there] |= {x: [(x, 1.0, (best, True, max(best, aim)))] for x, aim in aims.items()}
            final[there] = 1.0 + best + after
    return Transducer((0.0, False, 0.0), arcs, final)


@functools.cache
def clauses() -> Transducer:
    """The grammar of a clause: insults and threats become hits, which denials and reports lessen and targets raise."""
    return numbered(functools.reduce(compose, [insult(), threat(), negation(), reported_speech(), target()]))


def readings(found: tuple[int, float]) -> tuple[tuple[int, float], ...]:
    """How the grammar may read a word: an insult or threat is the hit, with the word's weight, or another one is."""
    kind, weight = found
    return ((PASSED, 1.0), (kind, weight)) if kind <= THREAT else ((kind, 1.0),)


def clause_score(symbols: list[tuple[tuple[int, float], ...]]) -> float:
    """The weight of a clause given by the readings of its words: the sum over its hits."""
    return weigh(clauses(), symbols)


def features(grammar: Grammar, text: str, memo: dict) -> tuple[float, float, float, float]:
    """Strongest clause, sum over matched clauses, share of matched clauses, sum per hundred words."""
    best = total = 0.0
    n_words = n_clauses = n_matched = 0
    for clause in CLAUSE.split(text.lower()):
        symbols, hit = [], False
        tokens = clause.split()
        if not tokens:
            continue
        n_words += len(tokens)
        n_clauses += 1
        for token in tokens:
            try:
                s = memo[token]
            except KeyError:
                found = symbol(grammar, token)
                s = readings(found) if found else None
                if len(token) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[token] = s
            if s:
                symbols.append(s)
                hit = hit or len(s) > 1
        if hit:
            score = clause_score(symbols)
            best, total, n_matched = max(best, score), total + score, n_matched + 1
    return (
        math.log1p(best),
        math.log1p(total),
        n_matched / max(1, n_clauses),
        math.log1p(100 * total / max(20, n_words)),
    )


def learn_words(texts: list[str], toxic: list[int]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and word beginnings: smoothed log odds of toxic rows having them.

    A word or beginning is kept only where this is clear from the counts. A beginning must also stand for
    several such words, and no shorter kept beginning may say as much.
    """
    seen = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        found = set()
        for token in set(text.lower().split()):
            word = token.strip(EDGE)
            found.add("=" + word)
            found.update(word[:n] for n in range(5, min(10, len(word) + 1)))
        seen[1 if y else 0].update(found)
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    forms = Counter(k[1 : n + 1] for k, c in seen[1].items() if k[0] == "=" and c > 1 for n in range(5, min(10, len(k))))

    def odds(key: str) -> float:
        """Log odds, or 0 where they may be chance."""
        a, b = seen[1][key] + 0.5, seen[0][key] + 0.5
        value = math.log(a / (n1 + 1)) - math.log(b / (n0 + 1))
        return value if value - math.sqrt(1 / a + 1 / b) > 1 else 0.0

    kept = {k: w for k, n in seen[1].items() if n >= 5 and k != "=" and (w := odds(k)) > 2}
    whole = {k[1:]: w for k, w in kept.items() if k[0] == "="}
    begin: dict[str, float] = {}
    for key in sorted((k for k in kept if k[0] != "=" and forms[k] >= 3), key=lambda k: (len(k), k)):
        if not any(begin.get(key[:n], 0) >= kept[key] - 0.5 for n in range(5, len(key))):
            begin[key] = kept[key]
    return whole, begin


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps over weighted rows; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    coef = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        coef += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * coef)
    return coef


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Grammar | None:
    """Learn weights from a bounded sample: about ``toxic_rows`` and ``clean_rows`` labelled rows, chosen by a hash.

    One half of the sample gives the words, the other half the logistic layer. There a row counts as many times as
    rows of its class stand behind each sampled one, so the layer sees the class mix of all rows that may be learned
    from, whatever the caps. Held-out rows, null labels and null texts are not used. Nothing to learn from: None.
    """
    marks = labels.where(F.col("toxic").isNotNull() & may_learn()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    caps = {1: toxic_rows, 0: clean_rows}
    picked = [hashed_share(marks.where(F.col("toxic") == k), counts.get(k, 0), most, "doc_id") for k, most in caps.items()]
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = sorted((r.text, r.toxic) for r in texts.join(picked[0].unionByName(picked[1]), "doc_id").select("text", "toxic").collect())
    y = [t for _, t in rows]
    if not rows or len(set(y)) < 2:
        return None
    blank = Grammar({}, {}, (), np.zeros(4), np.ones(4), np.zeros(5))
    whole, begin = learn_words([t for t, _ in rows[::2]], y[::2])
    draft = blank._replace(whole=whole, begin=begin, lengths=tuple(sorted({len(k) for k in begin}, reverse=True)))
    memo: dict = {}
    x = np.array([features(draft, t, memo) for t, _ in rows[1::2]])
    target = np.array(y[1::2], dtype=float)
    stands_for = {k: max(1.0, counts.get(k, 0) / most) for k, most in caps.items()}
    weight = np.array([stands_for[t] for t in y[1::2]])
    weight /= weight.mean()  # the ridge keeps its strength
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-9
    return draft._replace(mean=mean, scale=scale, coef=logistic((x - mean) / scale, target, weight))


def score(docs: DataFrame, grammar: Grammar | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row's whole text, repeated rows included.

    Null, empty and blank texts have no matched clause and get the score of such texts. Without
    anything learned all scores are 0. Null ids are kept and count as not held out. An empty
    table gives no rows; other columns are not looked at.
    """
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            if grammar is None:
                p = np.zeros(len(batch))
            else:
                x = np.array([features(grammar, t.as_py() or "", memo) for t in batch.column(1)]).reshape(-1, 4)
                z = np.c_[(x - grammar.mean) / grammar.scale, np.ones(len(x))] @ grammar.coef
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, score double, predicted int")
