"""What several operators of this folder share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def python_tasks(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, one thread each.

    On a cluster without that folder the package comes with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def words(text: Column) -> Column:
    """The words of a text; null gives no words."""
    body = F.coalesce(F.btrim(text, F.lit(SEPARATORS)), F.lit(""))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SEPARATOR_RUN))


def id_number(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def quarter(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 4; the rows with 2 are held out from learning."""
    return id_number(doc_id) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """True for held-out rows; a null id is neither held out nor learned from."""
    return F.coalesce(quarter(doc_id) == 2, F.lit(False))


def may_learn(doc_id: str = "doc_id") -> Column:
    return F.coalesce(quarter(doc_id) != 2, F.lit(False))


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def hashed_share(rows: DataFrame, count: int, at_most: int, *on: str) -> DataFrame:
    """About ``at_most`` of ``count`` rows, chosen by a hash of ``on``: the same ones each time, from everywhere."""
    if count <= at_most:
        return rows
    parts = 1 << 30
    return rows.where(F.pmod(F.xxhash64(*on), F.lit(parts)) < int(parts * at_most / count))
