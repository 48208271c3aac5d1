"""Report files in dated folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which files are reports, and what a dated folder is called.
TEXT_FILES = "(?i).*.txt"
DATED = r"\d{4}.\d{2}.\d{2}"


def list_files(spark: SparkSession, path: str, file_rule: str = TEXT_FILES) -> DataFrame:
    """``path``, ``folder``, ``name``, ``length`` of the files whose name has the pattern.

    ``folder`` is the folder right below ``path``. File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = "/" + path.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    below = F.substring_index(F.col("path"), base, -1)
    return files.select(
        "path",
        F.when(below.contains("/"), F.substring_index(below, "/", 1)).alias("folder"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
    ).where(F.col("name").rlike(file_rule))


def choose_folder(spark: SparkSession, path: str, mode: str = "latest") -> str:
    """The folder to read: ``all`` is ``path`` itself, ``latest`` the folder below it with the
    largest date, and a text with a date ``yyyy.mm.dd`` that folder."""
    mode = mode.lower()
    if mode == "all":
        return path
    dated = re.search(DATED, mode)
    if dated:
        return f"{path}/{dated.group(0)}"
    if mode != "latest":
        raise ValueError(f"mode must be all, latest or a date yyyy.mm.dd, not {mode!r}")
    dated_folders = [(int(n.replace(".", "")), n) for n in _folders_below(spark, path) if n.replace(".", "").isdigit()]
    return f"{path}/{max(dated_folders)[1]}" if dated_folders else path


def _folders_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``, empty ones included; nothing below them is listed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()]


def read_lines(
    spark: SparkSession, path: str, mode: str = "latest", file_rule: str = TEXT_FILES
) -> DataFrame:
    """``file``, ``block``, ``line``, ``text``: the lines of the chosen report files.

    ``block`` is where the part of the file starts that one task read, ``line`` rises
    within it; both are taken in the scan, before rows can move.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(choose_folder(spark, path, mode))
        .where(F.col("_metadata.file_name").rlike(file_rule))
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
    )
