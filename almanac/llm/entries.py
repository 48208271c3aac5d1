"""One query per operator over its whole table, and the SQL of those that SQL can express.

Each query takes its rows from its operator and only derives the columns of the contract.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import exact, jaccard, language, licenses, lines, merkle, mixing, packing, periods, quality, token_counts, topk, toxicity
from almanac.llm.common import id_number, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules for every document; its source is its host."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(_documents(spark, folder)).select(*columns)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, folder), VOCABULARY)


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_similar(_documents(spark, folder))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return language.identify(docs, language.fit(docs))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder), VOCABULARY, RANKS, public_tokenizers.PATTERN)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder))


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its remaining text and the number of its lines and of those taken out."""
    done = lines.dedup_lines(_documents(spark, folder))
    return done.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    done = exact.mark_copies(_documents(spark, folder).select("doc_id", "text", digest), carry=["text_sha256"])
    return done.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one of ten texts the words from some place on repeat the first of them.

    Its words are then those of the contract, with one space between them.
    """
    h = id_number()
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    n, g = F.size("w"), F.expr("h div 10")
    start = F.when(n > 0, g % n).cast("int")
    sized = split.select("doc_id", "text", "w", n.alias("n"), g.alias("g"), start.alias("a"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    placed = sized.select("doc_id", "text", "w", "n", "a", period.alias("p"))
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.array_join(F.transform(at, lambda i: F.get("w", i)), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(_with_repeats(_documents(spark, folder)))
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a),
    )
    lines_of_runs = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    hashes = [F.sha2(F.array_join(lines_of_runs, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *hashes)
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the documents; a third of them is checked with a changed text."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    presented = {"text": F.when(id_number() % 3 == 0, lower).otherwise(F.col("text"))}
    rows = merkle.manifest(_documents(spark, folder), presented=presented)
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_exact_topk": op9_exact_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {}

SQL["op9_exact_topk"] = """
WITH v AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Sources are hosts; the prior over their failure rates is fitted by moments.
SQL["op1_quality_rules"] = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
n AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM n WHERE n > 1) GROUP BY k),
m AS (SELECT k, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 3 * n_dup_lines > n_lines AS failed FROM b),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS bad FROM f GROUP BY source),
q AS (SELECT sum(bad) / sum(n) AS m, coalesce(var_samp(bad / n), 0) AS spread, avg(1 / n) AS inverse FROM h),
s AS (SELECT m, greatest(m * (1 - m) / greatest(spread - m * (1 - m) * inverse, 1e-6) - 1, 1) AS s FROM q),
v AS (SELECT source, (bad + m * s) / (n + s) > 0.5 AS refused FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

#: Ids are unique here, so a place is an id and a line number.
SQL["op10_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT doc_id, line, pos, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
d AS (SELECT w, min((doc_id, pos)) AS first FROM n WHERE len(w) > 0 GROUP BY w),
e AS (SELECT row_number() OVER () AS k, w, first FROM d WHERE len(w) >= 8),
x AS (SELECT k, first, i, array_to_string(list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM e)),
y AS (SELECT k, first, array_to_string(w, ' ') AS v FROM e),
z AS (SELECT k, min(first) OVER (PARTITION BY v, i) AS near FROM x
      UNION ALL SELECT x.k, y.first FROM x JOIN y USING (v) UNION ALL SELECT y.k, x.first FROM x JOIN y USING (v)),
o AS (SELECT e.w, least(any_value(e.first), min(near)) AS keep FROM e JOIN z USING (k) GROUP BY e.w),
g AS (SELECT n.*, len(n.w) > 0 AND (doc_id, pos) > coalesce(o.keep, d.first) AS gone FROM n LEFT JOIN d USING (w) LEFT JOIN o USING (w))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed
FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

SQL["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: crc32, bit by bit, of the decimal digits of an id.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, v: xor(xor(s, v) >> 1, (xor(s, v) & 1) * 3988292384)))"""


def _manifest_sql(tree_levels: int = 8, top_levels: int = 4) -> str:
    """SQL for trees of at most 8 ** 8 leaves, and 8 ** 4 of them: each level and each step of a proof is written out."""

    def hashed(text: str) -> str:
        parts = [*(f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")), text]
        return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"

    changed = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""WITH d AS (SELECT doc_id, coalesce('+' || lang, '-') AS g, lang, {hashed('text')} AS leaf, CASE WHEN {_CRC32} % 3 = 0 THEN {hashed(changed)} ELSE {hashed('text')} END AS shown FROM documents)""",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT g, any_value(lang) OVER (PARTITION BY g) AS lang, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p0)",
        "f0 AS (SELECT g, lang, doc_id, leaf, i, shown AS h, '' AS proof FROM p0)",
    ]

    def level(k: int) -> None:
        run = "n.g = o.g AND n.i // 8 = o.i // 8 AND n.i <> o.i"
        steps.append(
            f"""s{k} AS (SELECT n.g, n.i, n.n, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i < n.i), '') AS b,
            coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i > n.i), '') AS e FROM n{k} n LEFT JOIN n{k} o ON {run} GROUP BY n.g, n.i, n.n)"""
        )
        steps.append(
            f"""f{k + 1} AS (SELECT f.g, lang, doc_id, leaf, CASE WHEN n > 1 THEN f.i // 8 ELSE f.i END AS i, CASE WHEN n > 1 THEN sha256(b || f.h || e) ELSE f.h END AS h, proof || b || e AS proof
            FROM f{k} f JOIN s{k} s ON f.g = s.g AND f.i = s.i)"""
        )
        steps.append(
            f"""n{k + 1} AS (SELECT g, any_value(lang) AS lang, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY n{k}.i)) ELSE any_value(h) END AS h,
            (any_value(n) + 7) // 8 AS n FROM n{k} GROUP BY g, n, CASE WHEN n > 1 THEN i // 8 ELSE i END)"""
        )

    for k in range(tree_levels):
        level(k)
    t = tree_levels
    steps += [
        f"r AS (SELECT g, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{t})",
        f"n{t + 1} AS (SELECT 0 AS g, NULL AS lang, i, h, n FROM r)",
        f"f{t + 1} AS (SELECT 0 AS g, lang, doc_id, leaf, r.i, f.h, proof, r.h AS subroot FROM f{t} f JOIN r ON f.g = r.g)",
    ]
    for k in range(t + 1, t + 1 + top_levels):
        level(k)
        steps[-2] = steps[-2].replace("doc_id, leaf,", "doc_id, leaf, subroot,")
    t += 1 + top_levels
    return ", ".join(steps) + f"""
SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = n.h AS verified FROM f{t} f, n{t} n"""


SQL["op13_merkle_manifest"] = _manifest_sql()
