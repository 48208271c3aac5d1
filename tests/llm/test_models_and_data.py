"""Language, toxicity, mixing, packing, exact search and the pipeline against plain Python."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from almanac.llm import language, mixing, packing, topk, toxicity, transducers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"
LONG = "long text of words. " * 20_000
ODD = [(1, None, "en", "b"), (2, "", None, None), (3, "12 34 !!", "en", "a"), (None, "words of a null id", "en", "a"), (5, LONG, "en", "a"), (6, "one", "xx", None), (6, "one", "xx", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 3, 0.5) for r in ODD], "doc_id long, text string, lang string, source string, size int, score double")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def network(docs):
    return language.fit(docs)


def test_language_of_held_out_documents(docs, network):
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs, network).collect()
    assert len(got) == len(true)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 150 and sum(r.lang_pred == true[r.doc_id] for r in out) > 0.97 * len(out)


def test_language_learns_from_no_held_out_row(docs, network):
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    again = language.fit(other)
    assert again.langs == network.langs and all(np.array_equal(a, b) for a, b in zip(network[1:], again[1:], strict=True))


def test_language_odd_rows(odd, network):
    got = sorted((str(r.doc_id), r.lang_pred == "und", r.held_out) for r in language.identify(odd, network).collect())
    assert got == sorted((str(i), not any(c.isalpha() for c in t or ""), held_out(i)) for i, t, _, _ in ODD)
    assert language.identify(odd.limit(0), network).collect() == []
    assert language.fit(odd.limit(0)) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    kept = language.in_known_language(odd, network)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {None, 5, 6}


def test_language_stage_takes_out_other_languages(spark, docs):
    texts = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια.",
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق.",
    ]
    learned = language.fit_with_familiar(docs)
    df = spark.createDataFrame([(i, t * k) for i, t in enumerate(texts) for k in (1, 8)], "doc_id long, text string")
    assert language.in_known_language(df, *learned).collect() == []
    kept = language.in_known_language(docs, *learned)
    letters = docs.where(F.col("text").rlike("[A-Za-z]"))
    assert kept.columns == docs.columns and kept.count() >= 0.99 * letters.count()
    held = letters.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert language.in_known_language(held, *learned).count() >= 0.99 * held.count()


def test_convolution_is_a_maximum_over_positions(network):
    row = language.windows_of("ein kurzer text")[0]
    x = network.emb[row]
    wide = max(language.WIDTHS)
    filters = network.conv.reshape(wide, language.EMBEDDING, -1)
    slow = np.max([np.einsum("we,wef->f", x[i : i + wide], filters) for i in range(len(row) - wide + 1)], axis=0)
    z = np.maximum(slow + network.bias, 0) @ network.dense + network.out
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(p, language.probabilities(network, row[None])[0], atol=1e-4)
    assert (network.emb[0] == 0).all()


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(docs, labels)
    true = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, grammar).collect() if held_out(r.doc_id) and r.doc_id in true]
    hit = sum(r.predicted and true[r.doc_id] for r in got)
    assert hit > 0.9 * sum(r.predicted for r in got) and hit > 0.8 * sum(true[r.doc_id] for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out for r in got)


def test_toxicity_scores_do_not_follow_the_caps(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi").cache()

    def mean_score(**caps):
        return toxicity.score(labelled, toxicity.fit(docs, labels, **caps)).agg(F.avg("score")).first()[0]

    share = labels.agg(F.avg("toxic")).first()[0]
    whole, few = mean_score(), mean_score(toxic_rows=250, clean_rows=500)
    assert abs(whole - share) < 0.2 * share and abs(few - whole) < 0.2 * whole, (share, whole, few)


def test_toxicity_grammar():
    grammar = toxicity.Grammar({"fool": 2.0}, {"stupi": 1.5}, (5,), np.zeros(4), np.ones(4), np.zeros(5))

    def score(text):
        return toxicity.features(grammar, text, {})[0]

    assert score("a quiet day") == 0
    assert score("you are a fool") > score("what a fool") > score("not a fool") > 0
    assert score("he said what a fool") < score("what a fool")
    assert score("I will hurt you") > score("it can hurt") > 0
    assert score("stupidly done") > 0 and score("stupendous") == 0
    assert score("you. a fool") == score("a fool")


def clause_model(symbols):
    """The sum over hits, by one pass with explicit flags."""
    total, target, denied, reported, announced, pending = 0.0, 0.0, False, False, False, 0.0
    for kind, weight in symbols:
        if kind in (toxicity.SECOND, toxicity.OTHER):
            target = max(target, 0.5 if kind == toxicity.SECOND else 0.2)
            total, pending = total + pending * target, 0.0
        elif kind == toxicity.DENIAL:
            denied = not denied
        elif kind == toxicity.REPORT:
            reported = True
        elif kind == toxicity.WILL:
            announced = True
        else:
            if kind == toxicity.THREAT:
                weight *= 1.0 if announced else 0.4 if target else 0.1
            weight *= (0.4 if denied else 1.0) * (0.5 if reported else 1.0)
            total, pending, denied = total + weight * (1 + target), pending + weight, False
    return total


def outputs(machine, symbols):
    """All ``(output, weight, end)`` of an input, path by path."""
    paths = [((), 1.0, machine.start)]
    for x in symbols:
        paths = [((*o, y), w * v, t) for o, w, s in paths for y, v, t in machine.arcs[s].get(x, ())]
    return [(o, w, s) for o, w, s in paths if s in machine.final]


def test_composition_is_one_machine_after_the_other():
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported_speech(), toxicity.target()]
    for a, b in [*zip(parts, parts[1:], strict=False), (parts[1], transducers.compose(parts[2], parts[4]))]:
        both = transducers.compose(a, b)
        for symbols in itertools.product(toxicity.SYMBOLS, repeat=3):
            want = [(o2, w1 * w2 * a.final[s] * b.final[t]) for o, w1, s in outputs(a, symbols) for o2, w2, t in outputs(b, o)]
            got = [(o, w * both.final[s]) for o, w, s in outputs(both, symbols)]
            assert sorted((o, round(w, 12)) for o, w in got) == sorted((o, round(w, 12)) for o, w in want)


def test_clause_weights_are_sums_over_paths():
    rng = random.Random(8)
    for _ in range(2000):
        words = [(rng.choice(list(toxicity.SYMBOLS)[:7]), rng.choice([0.5, 2.0, 3.25])) for _ in range(rng.choice([0, 1, 2, 5, 9]))]
        assert toxicity.clause_score([toxicity.readings(w) for w in words]) == pytest.approx(clause_model(words), abs=1e-12)
    grammar = toxicity.clauses()
    words = [toxicity.readings(w) for w in [(toxicity.DENIAL, 0.0), (toxicity.INSULT, 2.0), (toxicity.SECOND, 0.0), (toxicity.THREAT, 3.0)]]
    one_by_one = sum(
        math.prod(w for _, w in choice) * sum(v * grammar.final[s] for _, v, s in outputs(grammar, [x for x, _ in choice]))
        for choice in itertools.product(*words)
    )
    assert toxicity.clause_score(words) == pytest.approx(one_by_one)


def test_toxicity_scores_against_a_slow_model(docs, labels):
    grammar = toxicity.fit(docs, labels)
    assert grammar.whole or grammar.begin
    got = {r.doc_id: r.score for r in toxicity.score(docs, grammar).collect()}
    some = 0
    for r in docs.select("doc_id", "text").collect():
        parts = [c.split() for c in toxicity.CLAUSE.split((r.text or "").lower())]
        parts = [c for c in parts if c]
        found = [[s for t in c if (s := toxicity.symbol(grammar, t))] for c in parts]
        scores = [clause_model(c) for c in found if any(k <= toxicity.THREAT for k, _ in c)]
        some += bool(scores)
        total, n = sum(scores), sum(map(len, parts))
        x = np.log1p([max(scores, default=0), total, 0, 100 * total / max(20, n)])
        x[2] = len(scores) / max(1, len(parts))
        z = ((x - grammar.mean) / grammar.scale) @ grammar.coef[:-1] + grammar.coef[-1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
    assert some > 5


def test_toxicity_odd_rows(odd, docs, labels, spark):
    grammar = toxicity.fit(docs, labels)
    got = toxicity.score(odd, grammar).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), grammar).collect() == []
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, None, 1), (1, 1, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, nulls) is None


def targets_model(sizes):
    """Raise all free targets together until the whole share is spent."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 1e18
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, 2 * s) for w, s in zip(weights, sizes, strict=True)) < 1.5 * sum(sizes) else (low, mid)
    return [min(high * w, 2 * s) for w, s in zip(weights, sizes, strict=True)]


def check_mix(df, **how):
    rows = Counter((r.doc_id, len((r.text or "").encode().split())) for r in df.collect())
    by_source = defaultdict(int)
    for r in df.collect():
        by_source[r.source] += len((r.text or "").encode().split())
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets_model([by_source[s] for s in names]), strict=True))
    got = mixing.mix(df, **how).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == rows
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    sums = defaultdict(int)
    for r in got:
        sums[(r.source_size, round(r.target, 3))] += r.taken
    expect = defaultdict(int)
    for s in names:
        expect[(by_source[s], round(want[s], 3))] += int(want[s] + 1e-6)
    assert {k: v for k, v in sums.items()} == pytest.approx(dict(expect), abs=len(names))
    return sorted(got, key=repr)


def test_mixing(docs):
    for how in ({}, {"block_words": 16, "shard_blocks": 64}):
        assert check_mix(docs, **how) == check_mix(docs.repartition(5), **how)


def test_mixing_odd_rows(odd):
    check_mix(odd, block_words=7, shard_blocks=4)
    check_mix(odd)
    assert mixing.mix(odd.limit(0)).collect() == []


def test_mixed_texts_hold_the_words_taken(odd, docs):
    for df in (odd, docs):
        want = Counter((r.doc_id, r.taken) for r in mixing.mix(df, block_words=64).collect() if r.taken)
        got = mixing.mixed(df, block_words=64)
        assert got.columns == df.columns
        assert Counter((r.doc_id, len(r.text.encode().split())) for r in got.collect()) == want


def test_mixing_stage_meets_the_targets(spark, docs):
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len((r.text or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    got = defaultdict(int)
    for r in corpus_pipeline.mixture(spark, docs, SF).collect():
        got[r.source] += len(r.text.encode().split())
    want = dict(zip(names, targets_model([size[s] for s in names]), strict=True))
    assert set(got) <= set(names) and {s: got[s] for s in names} == pytest.approx(want, abs=1.001)


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        index = np.arange(n)
        for key in (0, 5):
            assert sorted(mixing.permuted(index, np.full(n, n), np.full(n, key)).tolist()) == index.tolist()
    assert mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 1)).tolist() != list(range(100))


def check_packing(df, limit=0.05):
    exact = Tokenizer.from_file(VOCABULARY)
    ids = {}
    for r in df.select("doc_id", "text").collect():
        ids.setdefault(r.doc_id, []).append([*exact.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(df, VOCABULARY, RANKS, public_tokenizers.PATTERN).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = {}
    for doc_id, copies in ids.items():
        want[doc_id] = sorted(
            (at, len(c[at : at + 2048]), zlib.crc32(np.array(c[at : at + 2048], "<u4").tobytes()), len(c)) for c in copies for at in range(0, len(c), 2048)
        )
    assert {k: sorted(v) for k, v in pieces.items()} == want
    used = [sum(n for _, n in parts) for parts in sequences.values()]
    if limit:
        assert sum(2048 - u for u in used if u & (u - 1)) < limit * sum(used)
    return len(rows)


def test_packing(docs):
    assert check_packing(docs.where("doc_id < 300")) > 300


def test_packing_odd_rows(odd, spark):
    assert check_packing(odd, limit=None) >= len(ODD)
    texts = ["<|endoftext|> a", "a <|endoftext|>", "\x85a \x85 b", "It's  we'll x\x1c\x1dy", "日本語 テスト", "é ñ́", "   \n\n  x", "١٢٣ Ⅷ ²", "🙂🙂"]
    check_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=None)
    assert packing.pack(odd.limit(0), VOCABULARY, RANKS, public_tokenizers.PATTERN).collect() == []


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 200):
        lengths = rng.integers(1, 101, n).tolist()
        got = packing.first_fit_decreasing(lengths, 100)
        room, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
            if b is None:
                b = len(room)
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= lengths[i]
        assert got == want


def topk_model(rows, every, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for to, (i, w) in enumerate(usable) if to != at and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block_queries", [(20_000, 2_000), (150, 2), (7, 1)])
def test_topk(spark, shard_rows, block_queries):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(300)] + [(7, [9.0] * 6), (None, [1.0] * 6), (2000, None), (2100, []), (2200, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(2300, [float("nan")] * 6), (2400, [float("inf")] + [0.0] * 5), (2500, [1.0, 2.0]), (2501, [3.0, 2.0]), (2600, [2e5] * 6), (0, rows[0][1])]
    rows += [(1, [8.0] * 6), (1, [8.0] * 6), (1100, [7.0] * 6), (2700, []), (2701, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, shard int, block int")
    got = sorted(tuple(r) for r in topk.search(df, shard_rows=shard_rows, block_queries=block_queries).collect())
    assert got == topk_model(rows, 100, 10)
    assert topk.search(df.limit(0)).collect() == []


def test_pipeline(spark):
    """Every stage keeps the columns, and what is packed are the words that the stages before have kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near copies", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before) and len(after) == docs.count()
        if name == "line dedup":
            seen = set()
            for i in sorted(after):
                kept = [tuple(x.lower().split()) for x in after[i].text.split("\n") if x.split()]
                assert not seen & set(kept) and len(kept) == len(set(kept))
                seen |= set(kept)
        if name == "language":
            assert len(after) > 0.95 * len(before)
    want = {r.doc_id: len(Tokenizer.from_file(VOCABULARY).encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    packed = {r.doc_id: r.n for r in corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == want


def test_pipeline_of_an_empty_table(spark, docs):
    left = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
    assert left.collect() == []
