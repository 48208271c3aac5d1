"""Quality rules for texts and for the hosts they come from, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import SEPARATORS, words
from almanac.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is refused where its shrunken failure rate is above this.
HOST_FAILURES = 0.5


def _next(of: Column) -> Column:
    """The array moved one place to the left."""
    return F.slice(of, F.lit(2), F.greatest(F.size(of), F.lit(0)))


def _before(of: Column, first: Column) -> Column:
    """The array moved one place to the right, with ``first`` in front."""
    return F.concat(F.array(first), F.slice(of, F.lit(1), F.greatest(F.size(of) - 1, F.lit(0))))


def with_repeated_words(rows: DataFrame, tokens: str, out: str) -> DataFrame:
    """Add the number of words in 3-word windows that occur twice or more in the row, the first ones included.

    Windows are 64-bit hashes of their words, sorted with their places, so that equal ones are neighbours; the places of
    those are sorted again, and each covers three words less what it shares with the one before. The work is
    that of sorting the row's words. Each step is a column of its own, and arrays are only moved and zipped, so
    that nothing is computed once per word that is needed once per row.
    """
    n = F.size(tokens)
    steps = rows.withColumn("_h", F.transform(tokens, lambda w: F.xxhash64(w)))
    pairs = F.zip_with("_h", _next(F.col("_h")), lambda a, b: F.xxhash64(a, b))
    steps = steps.withColumn("_g", F.slice(F.zip_with(pairs, _next(_next(F.col("_h"))), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(n - 2, F.lit(0))))
    steps = steps.withColumn("_s", F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    steps = steps.withColumn("_e", F.zip_with("_s", _next(F.col("_s")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    steps = steps.withColumn("_k", F.zip_with("_e", _before(F.col("_e"), F.lit(False)), lambda a, b: a | F.coalesce(b, F.lit(False))))
    spots = F.filter(F.zip_with("_s", "_k", lambda a, k: F.when(k, a["i"])), lambda x: x.isNotNull())
    steps = steps.withColumn("_p", F.sort_array(spots))
    fresh = F.zip_with("_p", _before(F.col("_p"), F.lit(None).cast("int")), lambda x, y: F.coalesce(F.least(F.lit(3), x - y), F.lit(3)))
    # The array moved to the right is as long as the other, but for the empty one.
    total = F.when(F.size("_p") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x))
    return steps.withColumn(out, total).drop("_h", "_g", "_s", "_e", "_k", "_p")


def measures(docs: DataFrame, host: str) -> DataFrame:
    """``doc_id, host`` and the counts of each row's whole text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), body.alias("text"))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != ""))
    rows = with_repeated_words(rows, "w", "n_repeat_words")
    return rows.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
    )


def verdicts(measured: DataFrame, worst: float = HOST_FAILURES) -> DataFrame:
    """One row per host: rows, failed rows, shrunken failure rate, and whether the host is refused.

    The prior is a beta distribution fitted to the hosts' own rates by moments: the mean rate m, and as many
    pseudo rows as make the spread between hosts what it is beyond chance. A host of few rows is
    thus judged mostly by the others. With one host, or hosts that differ by no more than chance, the prior
    is strong and all hosts get the mean rate.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    rated = hosts.withColumn("rate", F.col("bad") / F.col("n"))
    prior = rated.agg(
        (F.sum("bad") / F.sum("n")).alias("m"),
        F.avg("rate").alias("rate_mean"),
        F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n")).alias("inverse"),
    )
    m = F.col("m")
    beyond = F.greatest(F.col("spread") - m * (1 - m) * F.col("inverse"), F.lit(1e-6))
    strength = F.greatest(m * (1 - m) / beyond - 1, F.lit(1.0))
    prior = prior.select(m.alias("prior_rate"), strength.alias("prior_rows"))
    shrunk = (F.col("bad") + F.col("prior_rate") * F.col("prior_rows")) / (F.col("n") + F.col("prior_rows"))
    return rated.crossJoin(F.broadcast(prior)).select(
        "host", "n", "bad", shrunk.alias("host_rate"), (shrunk > worst).alias("host_refused")
    )


def judge(docs: DataFrame, host: str = "source", worst: float = HOST_FAILURES) -> DataFrame:
    """Counts, the base rule, and the verdict of its host for every row of ``docs``, repeated rows included.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. A row also counts as failed
    for its host if over a tenth of its characters are symbols or over a third of its lines repeat earlier ones. ``kept``
    is false if the base rule fails or the host is refused. Null, empty and blank texts have no
    words and fail. A null host is a host of its own. Null ids are kept; an empty table gives no rows; other columns are not
    looked at. Hosts are joined by key and no host is gathered anywhere.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rules = (10 * F.col("n_symbols") > F.col("word_chars")) | (3 * F.col("n_dup_lines") > F.col("n_lines"))
    measured = measures(docs, host).withColumn("base_failed", base).withColumn("failed", base | rules)
    measured = materialize(measured, "quality")
    hosts = verdicts(measured, worst).withColumnRenamed("host", "name")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("name")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_refused")).alias("kept"), "failed", "host_rate", "host_refused",
    )
