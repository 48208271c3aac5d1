"""License scans by digests of canonical texts, in Spark expressions only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words spelled in more than one way, each with the spelling that stands for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "modelled": "modeled",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: Notices and short licenses, by SPDX identifier where there is one.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
]

#: Lines that copies fill in with a year and a name, so that they become copyright lines.
BLANK_COPYRIGHT = re.compile(r"(?m)^.*\[yyyy\].*\n?")
TERMS_END = "END OF TERMS AND CONDITIONS"

#: Before the first mark of a copyright line, and between its marks, there are no letters and numbers.
BEFORE_MARK, BETWEEN = r"^[^\p{L}\p{N}©(]*", r"[^\p{L}\p{N}]*"
#: A longer list of known licenses is joined by shuffling instead of being sent to every task.
BROADCAST_KNOWN = 10_000


def is_copyright_line(low: Column) -> Column:
    """Whether a lower-case line only says who holds the copyright, and nothing about the terms.

    It begins with one or more marks ("copyright", "(c)", "©"), of which the last is "(c)" or "©" where there are several, or a
    year or "by" follows. Marks are counted without a repeated group, whose depth would grow with the line.
    """
    signs = F.replace(low, F.lit("(c)"), F.lit("©"))
    alike = F.replace(signs, F.lit("copyright"), F.lit("©"))
    bare = F.replace(signs, F.lit("copyright"), F.lit(" "))
    followed = alike.rlike(rf"{BEFORE_MARK}©{BETWEEN}(\d{{4}}|by )")
    word_first = signs.rlike(rf"{BEFORE_MARK}copyright") & bare.rlike(rf"^{BETWEEN}©")
    sign_first = signs.rlike(rf"{BEFORE_MARK}©") & bare.rlike(rf"^{BETWEEN}©{BETWEEN}©")
    return F.when(alike.contains("©"), followed | word_first | sign_first).otherwise(False)


def canonical_line(line: Column) -> Column:
    """Lower case, words and numbers only, one space between them, one spelling; empty for copyright lines."""
    low = F.lower(line)
    plain = F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    one = plain
    for old, new in SPELLINGS.items():
        one = F.regexp_replace(one, rf"\b{old}\b", new)
    spelled = F.when(plain.rlike(rf"\b(?:{'|'.join(SPELLINGS)})\b"), one).otherwise(plain)
    return F.when(is_copyright_line(low), F.lit("")).otherwise(spelled)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def whole_text(lines: Column) -> Column:
    """The canonical lines as one text; words of two parts get their one spelling across line ends too."""
    text = F.array_join(lines, " ")
    parts = {old: new for old, new in SPELLINGS.items() if " " in old}
    one = text
    for old, new in parts.items():
        one = F.regexp_replace(one, rf"\b{old}\b", new)
    return F.when(text.rlike(rf"\b(?:{'|'.join(parts)})\b"), one).otherwise(text)


def license_texts() -> Iterator[tuple[str, str]]:
    """Whole license texts of licenses.json as copies have them.

    With each title and without one, with the instructions behind the terms and without them, with blank copyright
    lines and without them, with links by either protocol.
    """
    for row in json.loads(files(__package__).joinpath("licenses.json").read_text(encoding="utf-8")):
        bodies = [row["text"]]
        if TERMS_END in row["text"]:
            terms = row["text"].partition(TERMS_END)[0]
            bodies += [terms, terms + TERMS_END]
        bodies += [BLANK_COPYRIGHT.sub("", b) for b in bodies]
        bodies += [b.replace("https://", "http://") for b in bodies] + [b.replace("http://", "https://") for b in bodies]
        for body in dict.fromkeys(bodies):
            for title in ("", *row["titles"]):
                yield row["license"], f"{title}\n{body}"


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, license`` of ``license, text`` rows; of licenses with the same canonical text the first by name."""
    whole = whole_text(canonical_lines(F.col("text")))
    rows = known.where(F.col("text").isNotNull()).select("license", whole.alias("c")).where("c <> ''")
    return rows.groupBy(digest(F.col("c")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_license, line_licenses, n_license_lines`` of every row of ``docs``.

    ``text_license`` is the known license that the entire text equals in canonical form, ``line_licenses`` the
    known ones (by name, with commas) that entire lines equal, ``n_license_lines`` the number of such lines. Null, empty
    and blank texts, and texts of copyright lines only, match nothing: null, an empty text and 0. Repeated rows get
    the same result each; null ids are kept; an empty table gives no rows; other columns are not looked at. ``known`` has
    ``license, text``; by default it is the notices of ``KNOWN`` and the whole texts of ``license_texts``.
    """
    spark = docs.sparkSession
    few = known is None
    texts = [*KNOWN, *license_texts()] if few else []
    known = spark.createDataFrame(texts, "license string, text string") if few else known
    digests = known_digests(known)
    if few and len(texts) <= BROADCAST_KNOWN:
        digests = F.broadcast(digests)
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    lines = rows.where(F.col("text").isNotNull()).withColumn("c", canonical_lines(F.col("text"))).where(F.size("c") > 0)
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(whole_text(F.col("c"))).alias("digest"))), F.transform("c", lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))))
    hits = lines.select("doc_id", "mark", F.explode(units).alias("u")).select("doc_id", "mark", "u.*").join(digests, "digest")
    copies = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    found = hits.groupBy("doc_id", "mark").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"),
        F.count_if(~F.col("whole")).alias("n"),
    )
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark"))
    joined = copies.alias("a").join(found.alias("b"), same, "left")
    result = joined.select(
        F.col("a.doc_id").alias("doc_id"),
        "text_license",
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce(F.floor(F.col("n") / F.col("copies")), F.lit(0)).cast("long").alias("n_license_lines"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    return result.drop("copy")
