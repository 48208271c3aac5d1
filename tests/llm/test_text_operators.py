"""Quality rules, token counts, licenses, lines and the Jaccard join against plain Python."""

import json
import re
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest

from almanac.llm import jaccard, licenses, lines, quality, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\n\r ", None),
    (4, "one", "b"),
    (5, "a b a b a b a b", "b"),
    (6, "a b c d e f g h", "b"),
    (6, "a b c d e f g h", "b"),
    (7, LONG, "c"),
    (8, LONG + " end", "c"),
    (None, "null id text with a few words in it", None),
    (9, "é ü # $ % x\n\nx\nx\n \nX", "a"),
    (10, "a b c d e f g i", "a"),
    (11, "日本語 テスト 🙂 emoji", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names operators use inside."""
    extra = [(*r, 1, "k", 2.5) for r in ODD]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, n int, key string, h1 double").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def quality_model(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    with_word = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(with_word) - len(set(with_word)), len(covered), failed


QUALITY = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules(docs, texts):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in QUALITY) == quality_model(texts[r.doc_id])
        assert r.kept == (not r.base_failed and not r.host_refused)


def test_quality_odd_rows(odd, empty):
    got = sorted((tuple(r[c] for c in QUALITY) for r in quality.judge(odd).collect()), key=repr)
    assert got == sorted((quality_model(t) for _, t, _ in ODD), key=repr)
    assert quality.judge(empty).collect() == []


def test_quality_refuses_a_bad_host(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "too short"
    rows = [(i, good, f"good{i % 5}") for i in range(200)] + [(1000 + i, bad, "bad") for i in range(60)] + [(2000, good, "bad")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[2000].base_failed and got[2000].host_refused and not got[2000].kept
    assert got[0].kept and got[0].host_rate < 0.1


def longest_match(first, inner, word):
    pieces, at, use = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in use), None)
        if end is None:
            return 1
        at, use, pieces = end, inner, pieces + 1
    return pieces


def test_token_counts(docs, texts):
    alphabet = token_counts.byte_alphabet()
    import json

    with open(VOCABULARY, encoding="utf-8") as file:
        tokens = [bytes(alphabet[c] for c in t) for t in json.load(file)["model"]["vocab"] if all(c in alphabet for c in t)]
    first, inner = {t for t in tokens if t[:1] == b" "}, {t for t in tokens if t[:1] != b" "}
    memo = {}
    for r in token_counts.count_tokens(docs, VOCABULARY).collect():
        words = texts[r.doc_id].encode().split()
        for w in words:
            if w not in memo:
                memo[w] = longest_match(first, inner, b" " + w)
        assert (r.n_words, r.n_tokens) == (len(words), sum(memo[w] for w in words))


def test_automaton_backs_off_and_meets_unknown_words():
    first, inner = {b"a", b"abcdx", b"ab"}, {b"b", b"c", b"cd", b"bcdy", b"d", b"dz"}
    machine = token_counts.LongestMatch(first, inner)
    for word in (b"abcdx", b"abcdy", b"abcd", b"abcdz", b"a", b"ab", b"abcdcdcd", b"q", b"aq", b"abcdq", b"b", b""):
        assert machine.count(word) == longest_match(first, inner, word), word


def test_token_counts_odd_rows(odd, empty):
    got = token_counts.count_tokens(odd, VOCABULARY).collect()
    assert sorted((r.n_words for r in got)) == sorted(len((t or "").encode().split()) for _, t, _ in ODD)
    assert {r.n_tokens for r in got if r.n_words == 0} == {0}
    assert token_counts.count_tokens(empty, VOCABULARY).collect() == []


def test_licenses(spark):
    mit = licenses.KNOWN[-2][1]
    rows = [
        (1, "© 2020 Somebody\nCopyright (c) 2021 by others\n" + mit.upper().replace(",", " ;")),
        (2, "some prose\nReleased under the MIT LICENCE!\nmore\n  all rights reserved"),
        (3, mit + " and more"),
        (4, None),
        (5, ""),
        (5, ""),
        (6, "Copyright 1999 nobody"),
        (None, "Licensed under CC BY-NC 4.0"),
        (7, "a word\n" * 20_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, copies int")
    got = sorted(((r.doc_id, r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.scan(df).collect()), key=repr)
    want = [
        (1, "MIT", "", 0),
        (2, None, "MIT,all-rights-reserved", 2),
        (3, None, "", 0),
        (4, None, "", 0),
        (5, None, "", 0),
        (5, None, "", 0),
        (6, None, "", 0),
        (7, None, "", 0),
        (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
    ]
    assert got == sorted(want, key=repr)
    assert licenses.scan(df.limit(0)).collect() == []


def test_licenses_whole_texts_with_and_without_titles(spark):
    common = Path("/usr/share/common-licenses")
    files = {f: (common / f).read_text() for f in ("Apache-2.0", "Artistic", "BSD", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0")}
    names = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause"} | {f: re.sub(r"^(\w+-\d)$", r"\1.0", f) + "-only" for f in files if f.startswith("G") or f.startswith("L")}
    cases = [(names.get(f, f), t) for f, t in files.items()]
    cases.append(("Apache-2.0", files["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Somebody")))
    cases.append(("Apache-2.0", files["Apache-2.0"].split("APPENDIX")[0]))
    cases.append(("MIT", Path(public_tokenizers.__file__).with_name("LICENSES.txt").read_text().partition(":\n")[2].partition("\n\nword_bpe")[0]))
    for row in json.loads(Path(licenses.__file__).with_name("licenses.json").read_text()):
        for title in ("", *row["titles"]):
            cases.append((row["license"], f"{title}\n\nCopyright (c) 2020 Somebody\n\n{row['text']}"))
        if len(row["text"]) < 2_000:  # no copyright lines in it; line ends elsewhere, also inside of words of two parts
            cases.append((row["license"], "\n".join(row["text"].split())))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in licenses.scan(df).collect()}
    assert len(got) == len(cases) and [(name, got[i], t[:90]) for i, (name, t) in enumerate(cases) if got[i] != name] == []


def within_one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def dedup_model(rows, digests, least=8):
    """Every line against every distinct earlier line of like length."""
    first, order = {}, []
    for (doc_id, text), digest in zip(rows, digests, strict=True):
        for at, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(line.lower()))
            if words:
                spot = (doc_id is not None, doc_id or 0, digest, at)
                order.append((spot, words))
                first[words] = min(first.get(words, spot), spot)
    by_length = defaultdict(list)
    for words in first:
        by_length[len(words)].append(words)
    keep = dict(first)
    for words in first:
        if len(words) >= least:
            for n in (len(words) - 1, len(words), len(words) + 1):
                for other in by_length[n] if n >= least else ():
                    if first[other] < keep[words] and within_one_edit(list(words), list(other)):
                        keep[words] = first[other]
    return {spot for spot, words in order if spot > keep[words]}


def check_lines(df, least=8):
    rows = [(r.doc_id, r.text, r.d) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS d").collect()]
    gone = dedup_model([r[:2] for r in rows], [r[2] for r in rows], least)
    want = []
    for doc_id, text, digest in rows:
        split = (text or "").split("\n")
        spot = (doc_id is not None, doc_id or 0, digest)
        left = [x for at, x in enumerate(split) if (*spot, at) not in gone]
        want.append((doc_id, None if text is None else "\n".join(left), 0 if text is None else len(split), len(split) - len(left)))
    got = [(r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df, least).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return len(gone)


def test_line_dedup(docs):
    assert check_lines(docs.where("doc_id < 400")) > 50


def test_line_dedup_edits(spark):
    base = [f"w{i}" for i in range(10)]
    made = [base, base[:4] + base[5:], base[:3] + ["new"] + base[4:], base + ["more"], ["front"] + base, base[:8] + ["u", "v"], base[::-1]]
    made += [["page"] * 8 + [str(i)] for i in range(30)] + [["short", "line"], ["short", "lines"], ["same"] * 8, ["same"] * 9, ["same"] * 11]
    rows = [(i % 7, "\n".join([" ".join(made[i]), "", "  ", " ".join(made[-i - 1]).upper()])) for i in range(len(made))]
    rows += [(None, "Short  line"), (50, None), (51, ""), (52, "\n\n"), (53, LONG), (54, LONG + " x"), (53, LONG)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, removed int")
    assert check_lines(df) > 30
    assert lines.without_repeats(df).columns == df.columns
    assert lines.dedup_lines(df.limit(0)).collect() == []


def jaccard_model(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        counts = Counter(j for x in s for j in having[x])
        for j, k in counts.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[top(i)] = top(j)
        for x in s:
            having[x].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min((doc_id is None, doc_id or 0), least.get(top(i), (True, 0)))
    return sorted(((rows[i][0], len(s), None if least[top(i)][0] else least[top(i)][1]) for i, s in enumerate(sets)), key=repr)


def check_jaccard(df, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_similar(df, **how).collect()]
    assert sorted(got, key=repr) == jaccard_model(rows)
    return got


def test_jaccard_join(docs):
    got = check_jaccard(docs)
    assert sum(a != c for a, _, c in got) > 20


def test_one_per_group_keeps_the_smallest_id_of_each_component(docs):
    model = jaccard_model([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    want = sorted(i for i, n, c in model if n == 0 or i == c)
    assert len(want) == len({c for _, n, c in model if n}) + sum(n == 0 for _, n, _ in model) < len(model) - 20
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_jaccard_odd_rows(odd, empty):
    check_jaccard(odd)
    assert jaccard.join_similar(empty).collect() == []


def test_jaccard_templates_just_below_the_threshold(spark):
    """Texts that share 60 of 70 words do not link and fill the same buckets; a few among them have near copies that do."""
    import random

    rng = random.Random(6)
    base = [f"c{i}" for i in range(60)]
    rows = [base + [f"w{i}x{k}" for k in range(10)] for i in range(700)]
    for i in range(0, 700, 50):
        rows += [rows[i][:-2] + [f"v{i}", f"y{i}"], rows[i][:63] + [f"z{i}x{k}" for k in range(7)]]
    rows += [base + [f"s{rng.randrange(12)}" for _ in range(10)] for _ in range(90)]  # own words that others have too
    rng.shuffle(rows)
    got = check_jaccard(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4))
    assert 600 < len({c for _, _, c in got}) < len(rows) - 20


@pytest.mark.parametrize("crowded", [64, 1])
def test_jaccard_near_the_threshold(spark, monkeypatch, crowded):
    """Chains of small edits, one group of many near copies, and a passage shared by unlinked texts."""
    import random

    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    rng = random.Random(3)
    rows = []

    def text(n):
        return [f"t{rng.randrange(10**9)}" for _ in range(n)]

    for n in (5, 6, 7, 8, 9, 10, 12, 17, 33, 64, 100, 129, 300, 700):
        words = text(n)
        for _ in range(12):
            words = list(words)
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
            if rng.random() < 0.3:
                words.append("tail")
            rows.append(" ".join(words))
    crowd = text(90)
    for _ in range(150):
        words = list(crowd)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"c{rng.randrange(10**9)}"
        rows.append(" ".join(words))
    passage = text(60)
    rows += [" ".join(text(20) + passage + text(rng.randrange(5, 60))) for _ in range(150)]
    rng.shuffle(rows)
    check_jaccard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))


def test_jaccard_join_of_large_sets_by_all_blocks(spark):
    """Sets of over 256 shingles, a little above and below the threshold; no block is left to chance."""
    import random

    rng = random.Random(4)
    rows = []
    for n in (260, 300, 520, 1100):
        words = [f"b{n}x{i}" for i in range(n)]
        rows.append(" ".join(words))
        for edits in (0.017, 0.02, 0.022, 0.024, 0.03):
            new = list(words)
            for k in rng.sample(range(0, n, 6), int(edits * n)):
                new[k] = f"e{rng.randrange(10**9)}"
            rows.append(" ".join(new))
    got = check_jaccard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), exact=True)
    assert 4 < len({c for _, _, c in got}) < len(got)
    words = [f"a{i}" for i in range(3000)]
    one, other = (jaccard.shingles(" ".join(w), {}) for w in (words, words[:2700]))
    keys = [set(jaccard.sketch(x, 11, jaccard.ALL_BLOCKS)[0].tolist()) for x in (one, other)]
    assert len(keys[0]) > 1024 and len(keys[0] & keys[1]) >= jaccard.sure_blocks(len(other), 2048, jaccard.ALL_BLOCKS) - 2048 + len(keys[0])


def test_sketches_bound_the_difference():
    """The number of blocks that differ is at most the symmetric difference."""
    memo = {}
    a = jaccard.shingles(" ".join(f"a{i}" for i in range(200)), memo)
    b = jaccard.shingles(" ".join(f"a{i}" for i in range(190)), memo)
    keys = [set(jaccard.sketch(x, 7)[0].tolist()) for x in (a, b)]
    assert len(keys[0] ^ keys[1]) <= 2 * len(set(a.tolist()) ^ set(b.tolist()))
    assert all(jaccard.sure_blocks(n, 1 << (n.bit_length() - 1)) >= 1 for n in range(1, 100_000, 37))
