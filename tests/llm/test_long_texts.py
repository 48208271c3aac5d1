"""Texts of a megabyte that repeat one thing, through every operator and every stage."""

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from almanac.llm import exact, jaccard, language, licenses, lines, merkle, mixing, packing, periods, quality, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
UNITS = [" ", " \n", "(c) ", "©", "copyright ", "a", "日本", "x", "A1. ", "\r\n", "\u3000", "('"]
TEXTS = [u * (1_000_000 // len(u)) for u in UNITS] + ["word " + " " * 999_990 + "word"]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return language.fit(docs), toxicity.fit(docs, labels)


OPERATORS = {
    "quality": lambda d, m: quality.judge(d),
    "token counts": lambda d, m: token_counts.count_tokens(d, VOCABULARY),
    "jaccard": lambda d, m: jaccard.join_similar(d),
    "toxicity": lambda d, m: toxicity.score(d, m[1]),
    "language": lambda d, m: language.identify(d, m[0]),
    "mixing": lambda d, m: mixing.mix(d),
    "licenses": lambda d, m: licenses.scan(d),
    "lines": lambda d, m: lines.dedup_lines(d),
    "exact": lambda d, m: exact.mark_copies(d),
    "periods": lambda d, m: periods.periodic_runs(d),
    "merkle": lambda d, m: merkle.manifest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(long, models, name):
    assert len(OPERATORS[name](long, models).collect()) == len(TEXTS)


def test_packing_gives_the_ids_of_the_contract(long):
    exact_encoder = Tokenizer.from_file(VOCABULARY)
    want = {i: len(exact_encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
    got = packing.pack(long, VOCABULARY, RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert all(sum(r.length for r in got if r.doc_id == i) == n for i, n in want.items())


def test_equal_pieces_are_dealt_to_many_groups(spark):
    df = spark.createDataFrame([(7, "the same text in every row")] * 3_000, "doc_id long, text string")
    got = packing.pack(df, VOCABULARY, RANKS, public_tokenizers.PATTERN, group_pieces=100).collect()
    groups = [r.sequence_id >> 32 for r in got]
    assert len(got) == 3_000 and len(set(groups)) == 30 and max(groups.count(g) for g in set(groups)) < 200


def test_stages(spark, long):
    docs = long
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.01")
        assert len(docs.collect()) > 0


# --- licenses against a slow model

MARK = regex.compile(r"copyright|\(c\)|©")


def copyright_model(low):
    """Marks one by one: the last of several is a sign, or a year or \"by\" follows."""
    at = regex.match(r"[^\p{L}\p{N}©(]*", low).end()
    n = 0
    while True:
        if n and regex.match(r"\(c\)|©|\d{4}|by ", low[at:]):
            return True
        m = MARK.match(low, at)
        if not m and n and at < len(low) and not regex.match(r"[\p{L}\p{N}]", low[at]):
            at += 1
            continue
        if not m:
            return False
        n, at = n + 1, m.end()


def canonical_model(text):
    lines_ = []
    for line in text.split("\n"):
        low = line.lower()
        plain = regex.sub(r"[^\p{L}\p{N}]+", " ", low).strip(" ")
        for old, new in licenses.SPELLINGS.items():
            plain = regex.sub(rf"\b{old}\b", new, plain)
        if plain and not copyright_model(low):
            lines_.append(plain)
    whole = " ".join(lines_)
    for old, new in licenses.SPELLINGS.items():
        if " " in old:
            whole = regex.sub(rf"\b{old}\b", new, whole)
    return lines_, whole


def test_license_scan_of_documents_equals_a_slow_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {}
    for name, text in [*licenses.KNOWN, *licenses.license_texts()]:
        whole = canonical_model(text)[1]
        known[whole] = min(name, known.get(whole, name))
    marked = ["Copyright (c) 2020 a", "copyright copyright b", "(c) (c) c", "© d", "copyright © e", "( (c) 2020 f", "copyright by g", "-- copyright 1999 h", "copyright of i", "see copyright 2020", "(c)", "copyright 日 2020", "MIT"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000 + i, f"{m}\nReleased under the MIT License.") for i, m in enumerate(marked)]
    want = []
    for doc_id, text in rows:
        lines_, whole = canonical_model(text)
        hits = [known[x] for x in lines_ if x in known]
        want.append((doc_id, known.get(whole), ",".join(sorted(set(hits))), len(hits)))
    got = [(r.doc_id, r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()]
    assert sum(w[3] > 0 for w in want) > 20
    assert sorted(got, key=repr) == sorted(want, key=repr)
