"""Text of unknown encoding to plain ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_accents


def _differences(charset: str) -> tuple[str, str]:
    """Characters in which a one-byte charset differs from Latin-1: (Latin-1 side, its side)."""
    pairs = [(bytes([b]).decode("latin-1"), bytes([b]).decode(charset, "ignore")) for b in range(0x80, 0x100)]
    pairs = [(a, b) for a, b in pairs if b and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _as_utf8(content: Column) -> Column:
    """The text of bytes that are valid UTF-8 and have no control characters; NULL for others."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), text)


def _one_byte(content: Column, first: Column) -> Column:
    """Decode by the charset that ``first``, the first byte in hexadecimal, stands for.

    The two charsets that Spark does not decode are Latin-1 with some characters mapped.
    """
    latin = F.decode(content, "ISO-8859-1")
    return (
        F.when(first == "A4", F.translate(latin, *_differences("iso8859_15")))
        .when((first >= "80") & (first <= "BF"), F.translate(latin, *_differences("cp1252")))
        .otherwise(latin)
    )


def to_unicode(content: Column) -> Column:
    """Decode bytes: UTF-8 where they are valid as such and have no control characters; else by the
    first byte, A4 ISO-8859-15, 80 to BF Windows-1252, any other Latin-1."""
    return F.coalesce(_as_utf8(content), _one_byte(content, F.hex(F.substring(content, 1, 1))))


def from_unicode(text: Column, charset: str) -> Column:
    """The bytes of a text in ``utf8``, ``latin1``, ``iso8859_15`` or ``cp1252``; it must have no other characters."""
    if charset == "utf8":
        return F.encode(text, "UTF-8")
    if charset == "latin1":
        return F.encode(text, "ISO-8859-1")
    latin, own = _differences(charset)
    return F.encode(F.translate(text, own, latin), "ISO-8859-1")


def to_ascii(content: Column) -> Column:
    """Decode, take accents off, remove everything outside ASCII."""
    return strip_accents(to_unicode(content))


def read_text_any_encoding(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``text``: one row per file that is not empty, its whole content as ASCII.

    For small files: each is one row. :func:`read_lines_any_encoding` takes files of any size.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select("path", to_ascii(F.col("content")).alias("text"))


def read_lines_any_encoding(spark: SparkSession, path: str, pattern: str = "*", ascii_only: bool = True) -> DataFrame:
    """``path``, ``place``, ``text``: one row per line of every file, decoded by the rule of :func:`to_unicode` for the whole file.

    ``place`` orders the lines of a file. Files are split over tasks at line ends and may have any size: no file is a row. Lines are
    read as bytes. Whether a file is UTF-8 is an aggregate over its lines, as no character holds a line end; its first
    byte is that of the first line of the first block. A file whose first byte is a line end has that one. Only the line end ``\\n`` is taken off.
    Empty files have no rows.
    """
    lines = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
            F.col("value").cast("binary").alias("content"),
        )
    )
    first = F.when(F.length("content") == 0, F.lit("0A")).otherwise(F.hex(F.substring("content", 1, 1)))
    files = lines.groupBy("path").agg(
        F.bool_and(_as_utf8(F.col("content")).isNotNull()).alias("utf8"), F.min_by(first, "place").alias("first")
    )
    text = F.when(F.col("utf8"), F.col("content").cast("string")).otherwise(_one_byte(F.col("content"), F.col("first")))
    return lines.join(files, "path").select("path", "place", (strip_accents(text) if ascii_only else text).alias("text"))
