"""Exact dedup, periodic runs and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from almanac.llm import entries, exact, merkle, periods
from check import TABLES, rows_of

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BODY = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
MEGABYTE = {"spaces": " " * 1_000_000, "lines": " \n" * 500_000, "letter": "a" * 1_000_000, "word": "日本" * 170_000, "mark": "(c) " * 250_000}
ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (2, "", None, "a"),
    (3, " \t\n\r ", "", None),
    (4, "One word", "en", "b"),
    (None, "One word", "en", "b"),
    (None, None, None, None),
    (7, BODY + " a", "fr", "c"),
    (8, BODY + " b", "fr", "c"),
    (9, BODY + " b", "fr", "c"),
    (9, BODY + " b", "fr", "c"),
    (10, "Ünïcode 日本語 🙂 EMOJI", "de", "c"),
    (11, "x y " * 40, "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(*r, 12, 3, 4, "k", 2.5) for r in ODD]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, rid int, n int, row string, hash double"
    return spark.createDataFrame(extra, kinds).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


# --- exact dedup


def copies_model(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    want = []
    for ids in groups.values():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        rest = list(ids)
        rest.remove(keep)
        want += [(keep, keep, len(ids), True)] + [(i, keep, len(ids), False) for i in rest]
    return sorted(want, key=repr)


def check_copies(df, task_bytes=exact.TASK_BYTES):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [(r.row.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.mark_copies(df, task_bytes=task_bytes).collect()]
    assert sorted(got, key=repr) == copies_model(rows)


def test_exact_dedup_odd_rows(odd):
    check_copies(odd)
    kept = exact.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t, _, _ in ODD})
    assert exact.mark_copies(odd.limit(0)).collect() == []


@pytest.mark.parametrize("task_bytes", [exact.TASK_BYTES, 300_000, 1])
def test_exact_dedup_of_long_and_nearly_equal_texts(spark, task_bytes):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdef ") for _ in range(50_000))
    rows = []
    for i in range(240):
        at = rng.choice([0, 1, 63, 64, 65, 319, 320, 321, 1343, 1344, 5440, 49_999])
        rows.append((i, base[:at] + rng.choice("xy") + base[at + 1 :] if i % 3 else base))
    rows += [(1000 + i, t) for i, t in enumerate(MEGABYTE.values())] * 2 + [(2000 + i, base[: 64 * i]) for i in range(6)]
    check_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), task_bytes)


def test_radix_buckets_in_a_batch():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 64, 65, 400]))) for _ in range(300)]
    texts += [t[:-1] + b"c" for t in texts if t] + texts
    first = {}
    assert exact.first_equal(texts) == [first.setdefault(t, i) for i, t in enumerate(texts)]


# --- periodic runs


def runs_model(x, least=24):
    """All runs by comparing every word with the one a period before, for every period."""
    n, found = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_model(doc_id, text):
    words = WORD.findall(text or "")
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def row_model(doc_id, words):
    runs = runs_model(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digests = ["".join(f"{a},{m},{q}\n" for a, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)]
    digests = [hashlib.sha256(d.encode()).hexdigest() for d in digests]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_periodic_runs_of_all_documents_with_repeats(spark, docs):
    short = {r.doc_id: r.text for r in docs.where("length(text) < 9000").select("doc_id", "text").collect()}
    got = [tuple(r) for r in entries.op12_periodic_runs(spark, SF).collect()]
    assert len(got) == docs.count()
    want = {i: row_model(i, planted_model(i, t)) for i, t in short.items()}
    assert len(want) > 900 and sum(r[1] > 0 for r in want.values()) > 60
    assert [g for g in got if g[0] in want and g != want[g[0]]] == []


def test_runs_of_made_up_words():
    rng = random.Random(7)
    texts = []
    for _ in range(150):
        n, letters = rng.randrange(700), rng.choice([1, 2, 2, 3, 50, 10_000])
        x = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(6)):
            if n > 30:
                a = rng.randrange(n)
                p = rng.randrange(1, (n - a) // 3 + 2)
                for i in range(a + p, min(n, a + int(p * rng.uniform(2, 9)))):
                    x[i] = x[i - p]
        texts.append(x)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    texts += [fib[-1], fib[-2] * 4, [0, 1] * 300 + [2] + [0, 1, 1] * 200]

    got = periods.runs_of_texts([np.array(x, np.int64) for x in texts])
    assert sum(map(len, got)) > 500
    for x, g in zip(texts, got, strict=True):
        assert g == runs_model(x)


def test_a_scale_whose_hashes_clash_is_still_exact(monkeypatch):
    """With hashes of a few bits pairs of places propose wrong periods; the words decide."""

    mix = periods._mix
    monkeypatch.setattr(periods, "_mix", lambda a, b: mix(a, b) % np.uint64(5))
    rng = random.Random(8)
    for _ in range(10):
        x = [rng.randrange(3) for _ in range(60)] * 5 + [rng.randrange(3) for _ in range(100)]
        got = [r for r in periods.find_runs(np.array(x, np.int64)) if r[1] >= 24]
        want = runs_model(x)
        assert set(got) <= set(want)  # nothing wrong is reported


def test_synchronising_set_is_consistent_and_dense():

    rng = random.Random(9)
    x = np.array([rng.randrange(40) for _ in range(2000)])
    for level in (3, 4, 5):
        t = 1 << level
        windows = periods.Windows(x)
        none = np.zeros(len(windows[level]), bool)
        chosen = periods.synchronising_set(windows, level, none)
        assert np.diff(chosen).max() <= t and len(chosen) < 5 * len(x) / t
        moved = periods.synchronising_set(periods.Windows(x[100:]), level, none[100:])
        assert set(moved + 100) == {int(p) for p in chosen if p >= 100}


def test_periodic_runs_odd_rows(spark, odd):
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(odd).collect()]
    want = []
    for doc_id, text, _, _ in ODD:
        words = WORD.findall(text or "")
        runs = [(0, 80, 2)] if text and text.startswith("x y") else runs_model(words) if len(words) < 100 else None
        want.append((doc_id, runs, len(words)))
    assert len(got) == len(want)
    by_words = {i: (r, n) for i, r, n in want if r is not None and i is not None}
    for doc_id, runs, text in got:
        if doc_id in by_words and by_words[doc_id][0] is not None:
            assert runs == by_words[doc_id][0]
    assert next(g for g in got if g[0] == 11)[2] == "x y"
    assert periods.periodic_runs(odd.limit(0)).collect() == []
    long = spark.createDataFrame(list(enumerate(MEGABYTE.values())), "doc_id long, text string")
    found = {r.doc_id: (r.runs, r.collapsed) for r in periods.periodic_runs(long).collect()}
    assert found[0] == ([], "") and found[1] == ([], "") and found[4][1] == "(c)" and tuple(found[4][0][0]) == (0, 250_000, 1)


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_model(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_model(leaves):
    """(root, proof of each leaf)."""
    proofs = [[] for _ in leaves]
    level, above = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        nodes, parents = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for k in range(len(run)):
                for i in above[a + k]:
                    proofs[i] += run[:k] + run[k + 1 :]
            nodes.append(sha("".join(run)))
            parents.append([i for x in above[a : a + 8] for i in x])
        level, above = nodes, parents
    return level[0], proofs


def manifest_model(rows):
    """``rows``: (tree, id, leaf); sorted rows with their subroot, the root and the proof."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    trees = defaultdict(list)
    for r in rows:
        trees[r[0]].append(r)
    subs = {name: tree_model([r[2] for r in part]) for name, part in trees.items()}
    root, tops = tree_model([s[0] for s in subs.values()])
    return root, [(r, subs[name][0], subs[name][1][i] + top) for (name, part), top in zip(trees.items(), tops, strict=True) for i, r in enumerate(part)]


def check_manifest(df, presented=None, shown=lambda doc_id, text: text, **options):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    root, model = manifest_model([(r[2], r[0], leaf_model(*r)) for r in rows])
    want = sorted(((r[1], r[2], sub, root, proof) for r, sub, proof in model), key=repr)
    got = merkle.manifest(df, presented=presented, **options).collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == want
    changed = {leaf_model(*r) for r in rows if leaf_model(*r[:4], shown(r[0], r[4])) != leaf_model(*r)}
    assert all(r.verified == (r.folded_root == root) == (r.leaf not in changed) for r in got)
    return len(changed)


def test_manifest_of_documents_with_changed_texts(docs):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.when(third, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    n = check_manifest(docs, {"text": lower}, lambda i, t: t.translate(ASCII_LOWER) if zlib.crc32(str(i).encode()) % 3 == 0 else t, part_levels=2, askers=2)
    assert n > 250


def test_manifest_odd_rows(odd):
    assert check_manifest(odd) == 0
    assert check_manifest(odd, part_levels=1) == 0
    assert merkle.manifest(odd.limit(0)).collect() == []
    assert check_manifest(odd.where("doc_id = 4")) == 0


@pytest.mark.parametrize("n,trees", [(8, 1), (9, 1), (64, 1), (65, 1), (600, 1), (700, 90)])
def test_manifest_of_trees_of_any_size(spark, n, trees):
    rows = [(i, f"text {i}", f"t{min(i * i % trees, i % trees):03}", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    check_manifest(df, part_levels=1, askers=3)


def test_an_octopus_asks_for_each_node_once_and_for_none_that_it_can_derive():
    rng = random.Random(10)
    for n in (1, 7, 8, 9, 64, 65, 500, 4097):
        for size in (1, 2, 5, n // 2, n):
            places = sorted(rng.sample(range(n), min(max(size, 1), n)))
            wanted = merkle.missing_nodes(places, n)
            need = set()
            for p in places:
                for level in range(merkle.depth(n)):
                    node = p // 8**level
                    need |= {(level, i) for i in range(node // 8 * 8, min(node // 8 * 8 + 8, merkle.level_size(n, level))) if i != node}
            derived = {(level, p // 8**level) for p in places for level in range(merkle.depth(n) + 1)}
            assert sorted(wanted) == sorted(need - derived)
