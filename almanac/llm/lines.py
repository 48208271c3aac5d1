"""Line dedup by a deletion-neighbourhood join, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import SEPARATORS
from almanac.operators.ordering import with_position
from almanac.session import materialize

#: Lines of at least this many words may differ by one word and still count as the same.
EDIT_WORDS = 8


def _spaced(text: Column) -> Column:
    """The text in lower case, with spaces for all separators but line ends: its lines then split at single characters."""
    text = F.lower(text)
    for separator in SEPARATORS:
        if separator not in " \n":
            text = F.replace(text, F.lit(separator), F.lit(" "))
    return text


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word put in, left out or replaced."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")

    def rest(of: Column, start: Column) -> Column:
        return F.slice(of, start, F.greatest(F.size(of) - start + 1, F.lit(0)))

    n, m = F.size(a), F.size(b)
    return (
        F.when(first == 0, n == m)
        .when(n == m, rest(a, first + 1) == rest(b, first + 1))
        .when(n == m + 1, rest(a, first + 1) == rest(b, first))
        .when(n + 1 == m, rest(a, first) == rest(b, first + 1))
        .otherwise(False)
    )


def _ends(w: Column, n: Column) -> Column:
    """Hashes of a line's first and last words, a little under half of them at each end.

    How many is a step function of the length, taken for the line's own length and for one word less: lines of
    like length then mostly have it in common, and one edit leaves one of the two ends of both as it is.
    """

    def share(m: Column) -> Column:
        half = F.floor((m - 1) / 2).cast("int")
        drop = F.greatest(F.length(F.bin(half)) - 3, F.lit(0))
        return F.call_function("shiftleft", F.call_function("shiftright", half, drop), drop)

    def both(g: Column) -> Column:
        return F.array(F.xxhash64(F.lit(0), g, F.slice(w, F.lit(1), g)), F.xxhash64(F.lit(1), g, F.slice(w, n - g + 1, g)))

    return F.flatten(F.transform(F.array_distinct(F.array(share(n), share(n - 1))), both))


def _lines(texts: DataFrame, only: str | None = None) -> DataFrame:
    """Lines that have a word: ``spot`` (where they are), two digests of their lower-cased words, ``n`` and the words ``w``.

    ``only`` names a column with the line numbers that are wanted.
    """
    more = [only] if only else []
    lines = texts.where(F.col("text").isNotNull()).select("doc_id", "digest", *more, F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("at", "line"))
    if only:
        lines = lines.where(F.array_contains(only, F.col("at")))
    lines = lines.withColumn("w", F.array_remove(F.split("line", " "), "")).where(F.size("w") > 0)
    both = [F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2")]
    return lines.select(F.struct("doc_id", "digest", "at").alias("spot"), *both, F.size("w").alias("n"), "w")


def neighbours(lines: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """``h1, h2, earlier``: the earliest other line within one word edit, for lines that have an earlier one.

    ``lines`` has ``h1, ends`` of all lines that may be edited, ``distinct`` has ``h1, h2, first``, one row per line; ``texts`` is where
    their words are. Every line emits the hashes of itself
    and of itself without each of its words; lines within one edit share such a key (with the same place left out, if a word is
    replaced). All lines of a key are within one edit of its earliest, so keys need an aggregate and no pairs. Only lines that
    share an end with another one emit their variants: one edit leaves one of the ends of both as it is. Only the texts
    that such lines are in are read again, and words never move, only hashes.
    """
    keys = lines.where(F.col("ends").isNotNull()).select("h1", F.explode("ends").alias("k"))
    shared = keys.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    found = keys.join(shared, "k", "left_semi").select("h1").distinct()
    candidates = materialize(distinct.select("h1", "h2", "first").join(found, "h1", "left_semi"), "candidates")
    where = candidates.groupBy(F.col("first.doc_id").alias("id"), F.col("first.digest").alias("d")).agg(F.collect_set("first.at").alias("ats"))
    some = texts.join(where, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).select("doc_id", "digest", "text", "ats")
    rows = _lines(some, only="ats").groupBy("h1", "h2").agg(F.min("spot").alias("first"), F.first("n").alias("n"), F.first("w").alias("w"))
    # From here on a line is its number in the order of first places.
    rows = materialize(with_position(rows, ["first", "h1", "h2"], "id"), "candidates")
    # Hashes of all words but one, from running XORs over the line.
    each = rows.select("id", "n", F.posexplode("w").alias("i", "word"))
    each = each.select("id", "n", "i", F.xxhash64("word", "i").alias("own"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("id")
    so_far = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select(
        "id", "n", "i", "own",
        F.bit_xor("own").over(so_far).alias("upto"), F.bit_xor("moved").over(so_far).alias("moved_upto"),
        F.bit_xor("moved").over(line).alias("moved_all"), F.bit_xor("own").over(line).alias("whole"),
    )
    rest = F.col("upto").bitwiseXOR(F.col("own")).bitwiseXOR(F.col("moved_all")).bitwiseXOR(F.col("moved_upto"))
    variant = F.struct((F.col("n") - 1).alias("m"), rest.alias("v"), F.col("i").alias("i"))
    full = F.struct(F.col("n").alias("m"), F.col("whole").alias("v"), F.lit(-1).alias("i"))
    made = F.when(F.col("i") == 0, F.array(variant, full)).otherwise(F.array(variant))
    made = materialize(each.select("id", F.explode(made).alias("x")).select("id", "x.*"), "variants")
    # Most keys are one line's own.
    common = made.groupBy("m", "v").agg(F.count("*").alias("c")).where("c > 1").select("m", "v")
    made = materialize(made.join(common, ["m", "v"], "left_semi"), "variants")
    # The earliest line of each key: with the same word left out, of those a word longer, and the line that is left.
    by_place = made.groupBy("m", "v", "i").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    one, other = F.when(F.col("i") < 0, F.col("low")), F.when(F.col("i") >= 0, F.col("low"))
    places = F.collect_list(F.when((F.col("i") >= 0) & (F.col("low") < F.col("high")), F.struct("i", "low")))
    keyed = by_place.groupBy("m", "v").agg(F.min(one).alias("full"), F.min(other).alias("cut"), places.alias("same"))
    keyed = keyed.where("size(same) > 0 OR (full IS NOT NULL AND cut IS NOT NULL)")
    own_place = F.get(F.filter("same", lambda s: s["i"] == F.col("i")), F.lit(0))["low"]
    best = F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least(own_place, "full"))
    met = made.join(keyed, ["m", "v"]).select("id", best.alias("best")).where("best < id").groupBy("id").agg(F.min("best").alias("best"))
    # A hash only proposes; the words decide.
    theirs = rows.select(F.col("id").alias("best"), F.col("w").alias("other"), F.col("first").alias("earlier"))
    checked = met.join(rows, "id").join(theirs, "best").where(_one_edit(F.col("w"), F.col("other")))
    return checked.select("h1", "h2", "earlier")


def repeated_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``doc_id, digest, removed``: the line numbers to take out of each text that has any."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    ends = F.when(F.col("n") >= edit_words, _ends(F.col("w"), F.col("n")))
    every = materialize(_lines(texts).select("spot", "h1", "h2", ends.alias("ends")), "lines")
    distinct = materialize(every.groupBy("h1", "h2").agg(F.min("spot").alias("first"), F.count("*").alias("c")), "lines")
    near = neighbours(every, distinct, texts)
    known = distinct.join(near, ["h1", "h2"], "left").where((F.col("c") > 1) | F.col("earlier").isNotNull())
    keep = known.select("h1", "h2", F.least("first", F.coalesce("earlier", "first")).alias("keep"))
    spots = every.select("spot", "h1", "h2").join(keep, ["h1", "h2"]).where(F.col("spot") > F.col("keep"))
    return spots.groupBy("spot.doc_id", "spot.digest").agg(F.array_sort(F.collect_set("spot.at")).alias("removed"))


def dedup_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``row`` (the row of ``docs``, all its columns), ``text`` without repeated lines, ``n_lines``, ``n_removed``.

    Lines are compared by their lower-cased words. A line goes if a line at an earlier place (by id, then text digest, then
    line number; null ids first) has the same words or, in lines of at least ``edit_words`` words, all but one put in,
    left out or replaced. The earliest of such lines stays, and so do lines without a word. Null texts stay null; a text may
    become empty. Rows that are equal in id and text are one place and share their fate. Rows, their
    order of columns and other columns are kept as they are; an empty table gives no rows.
    """
    removed = repeated_lines(docs, edit_words).select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "removed")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("digest"))
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    joined = joined.select("row", "removed", F.col("row.text").alias("text")).withColumn("lines", F.split("text", "\n"))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places, F.col("removed")), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        "row",
        text.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeats(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """The rows and columns of ``docs`` with repeated lines taken out of ``text``."""
    done = dedup_lines(docs, edit_words)
    return done.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
